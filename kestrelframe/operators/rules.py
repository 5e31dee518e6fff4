"""Status rules: readiness, validation, missions, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages
from .orderstats import with_quantiles


def texts(*pairs: tuple[Column, Column]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(c, t) for c, t in pairs)))


def percent(text: str, share: Column) -> Column:
    """``text`` with the share in percent."""
    return F.format_string(text, share * 100)


def full_score(blur: Column, largest: Column, dark: Column, blocked: Column) -> Column:
    """Readiness of a sampled video: 100 less weighted faults; a blocked one has 40 at most."""
    raw = F.greatest(F.lit(0.0), 100 - blur * 30 - F.when(largest < 1, (1 - largest) * 50).otherwise(0.0) - F.when(dark > 0.2, dark * 20).otherwise(0.0))
    return F.when(blocked, F.least(raw, F.lit(40.0))).otherwise(raw)


def extracted_score(blur: Column, largest: Column, dark: Column, isolated: Column) -> Column:
    """Readiness of extracted frames, within 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - blur * 30 - (1 - largest) * 40 - dark * 20 - isolated * 20))


def readiness(rows: DataFrame, kind: str = "full", block_blur: float = 0.5, block_component: float = 0.5, block_dark: float = 0.7, low_inliers: float = 50.0) -> DataFrame:
    """Adds ``blocking``, ``warnings``, ``status``, ``score`` to rows of ratios.

    Columns: ``blur``, ``dark``, ``largest``, ``isolated``, and for ``full`` also ``near_zero``,
    ``pure_rotation``, ``jumps``, ``inliers``; all but ``jumps`` and ``inliers`` are shares.
    """
    blur, dark, largest, isolated = (F.col(c) for c in ("blur", "dark", "largest", "isolated"))
    blocking = [(blur > block_blur, percent(messages.EXCESSIVE_BLUR, blur)), (largest < block_component, percent(messages.DISCONNECTED, largest))]
    warnings = [((blur > 0.1) & (blur <= block_blur), percent(messages.MODERATE_BLUR, blur))]
    if kind == "full":
        warnings += [
            (F.col("near_zero") > 0.3, percent(messages.HIGH_REDUNDANCY, F.col("near_zero"))),
            (F.col("pure_rotation") > 0.3, percent(messages.PURE_ROTATION, F.col("pure_rotation"))),
            (F.col("jumps") > 0, F.format_string(messages.ABRUPT_JUMPS, F.col("jumps"))),
            (F.col("inliers") < low_inliers, F.format_string(messages.LOW_OVERLAP, F.col("inliers"))),
        ]
    else:
        warnings.append((isolated > 0.2, percent(messages.MANY_ISOLATED, isolated)))
        blocking.append((dark > block_dark, percent(messages.TOO_DARK, dark)))
    out = rows.withColumns({"blocking": texts(*blocking), "warnings": texts(*warnings)})
    blocked = F.size("blocking") > 0
    score = full_score(blur, largest, dark, blocked) if kind == "full" else extracted_score(blur, largest, dark, isolated)
    return out.withColumns({"status": F.when(blocked, "NOT_READY").when(F.size("warnings") > 0, "WARNING").otherwise("READY"), "score": score})


def recommendations(blocking: Column, warnings: Column) -> Column:
    said = F.lower(F.array_join(F.concat(blocking, warnings), " "))
    return texts((said.contains("blur"), F.lit(messages.RECOMMEND_SHUTTER)), (said.contains("overlap") | said.contains("disconnected"), F.lit(messages.RECOMMEND_OVERLAP)))


def exposure(hist: DataFrame, by: Sequence[str], level: str = "level", n: str = "n") -> DataFrame:
    """Exposure flags from luminance histograms: shadows (up to 5), highlights (from 250), median."""
    v, c = F.col(level), F.col(n)
    return hist.groupBy(*by).agg((F.sum(F.when(v <= 5, c).otherwise(0)) / F.sum(c)).alias("shadow"), (F.sum(F.when(v >= 250, c).otherwise(0)) / F.sum(c)).alias("highlight"), F.percentile(v, F.lit(0.5), c).alias("median")).withColumns({"is_dark": (F.col("shadow") > 0.4) | (F.col("median") < 30), "is_overexposed": (F.col("highlight") > 0.4) | (F.col("median") > 225)})


def residuals(rows: DataFrame) -> DataFrame:
    """Adds errors of ``recon_*`` against ``local_*``, of checkpoints only: controls never reach error figures."""
    d = {c: F.col(f"recon_{c}") - F.col(f"local_{c}") for c in "xyz"}
    out = rows.where(F.col("role") == "CHECKPOINT").withColumns({f"d{c}": v for c, v in d.items()})
    h = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    return out.withColumns({"horizontal_error": h, "error_3d": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)})


def datum_mismatch(a: Column, b: Column) -> Column:
    """Both known, and different."""
    return F.coalesce((a != "UNKNOWN") & (b != "UNKNOWN") & (a != b), F.lit(False))


def rmse(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Checkpoint errors by axis, mean, upper median, maximum; heights are void if any datum differs."""
    r = lambda c: F.sqrt(F.avg(F.col(c) ** 2))
    ok = ~F.coalesce(F.bool_or("vertical_datum_mismatch"), F.lit(False))
    rows = rows.where("dx IS NOT NULL")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), r("dx").alias("rmse_x"), r("dy").alias("rmse_y"), F.when(ok, r("dz")).alias("rmse_z"), r("horizontal_error").alias("rmse_h"), F.when(ok, r("error_3d")).alias("rmse_3d"),
        F.avg("error_3d").alias("mean_3d"), F.max("error_3d").alias("max_3d"), ok.alias("z_validated"),
    )
    out = with_quantiles(out, rows, "error_3d", {"median_3d": ("upper", 0.5)}, by)
    return out.select(*by, "n", "rmse_x", "rmse_y", "rmse_z", "rmse_h", "rmse_3d", "mean_3d", "median_3d", "max_3d", "z_validated")


def decision(n: Column, rmse_3d: Column, least: int = 4, limit: float = 1.0) -> Column:
    return F.when(n < least, "NOT_ENOUGH_CHECKPOINTS").when(rmse_3d.isNull(), "FAILED").when(rmse_3d <= limit, "PASSED").otherwise("FAILED")


def correspondence(explicit: Column, distance: Column, radius: float) -> tuple[Column, Column]:
    """Method and status of a checkpoint's match: given ones are valid; a surface match is weak beyond half the radius."""
    method = F.when(explicit, "EXPLICIT").otherwise("CLOSEST_SURFACE")
    return method, F.when(explicit, "VALID").when(distance.isNull() | (distance > radius), "OUTSIDE_COVERAGE").when(distance > 0.5 * radius, "WEAK_CORRESPONDENCE").otherwise("VALID")


def confusion(pairs: DataFrame, classes: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Per class of ``classes(label)``: true and false counts, IoU, precision, recall, F1 (0 where undefined)."""
    cells = pairs.groupBy(truth, guess).agg(F.count("*").alias("n"))
    hit = cells.where(F.col(truth) == F.col(guess)).select(F.col(truth).alias("label"), F.col("n").alias("tp"))
    rows = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("actual"))
    cols = cells.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("guessed"))
    out = classes.select("label").join(hit, "label", "left").join(rows, "label", "left").join(cols, "label", "left").fillna(0, ["tp", "actual", "guessed"])
    tp, a, g = F.col("tp"), F.col("actual"), F.col("guessed")
    z = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return out.select("label", "tp", (g - tp).alias("fp"), (a - tp).alias("fn"), z(tp, a + g - tp).alias("iou"), z(tp, g).alias("precision"), z(tp, a).alias("recall"), z(2 * tp, a + g).alias("f1"))


def vote(observations: DataFrame, ids: DataFrame, fallback: int = 0) -> DataFrame:
    """Class of the largest summed confidence for each of ``ids(id)``, lowest on ties; ``fallback`` without support.

    ``observations(id, label, confidence)``; views without confidence do not count.
    """
    seen = observations.where(F.col("confidence") > 0)
    sums = seen.groupBy("id", "label").agg(F.sum("confidence").alias("c"), F.count("*").alias("n"))
    best = sums.groupBy("id").agg(F.max(F.struct("c", (-F.col("label")).alias("l"))).alias("b"), F.sum("n").alias("support"))
    return ids.select("id").join(best, "id", "left").select("id", F.coalesce(-F.col("b.l"), F.lit(fallback)).alias("label"), F.coalesce(F.col("b.c") / F.col("support"), F.lit(0.0)).alias("confidence"), F.coalesce("support", F.lit(0)).alias("support"))


def support_class(distance: Column, strong: Column, weak: Column) -> Column:
    return F.when(distance <= strong, "SUPPORTED").when(distance > weak, "UNOBSERVED").otherwise("WEAK")


def heuristic_label(z: Column, low: Column, neutral: Column, green: Column) -> tuple[Column, Column]:
    """Label and confidence by colour and height over the 10th percentile ``low``; vegetation beats road beats height."""
    high = z > low + 2
    road = neutral & ~high
    label = F.when(green, "VEGETATION").when(road, "ROAD").when(high, "BUILDING").otherwise("GROUND")
    return label, F.when(green, 0.7).when(road, 0.6).when(high, 0.5).otherwise(0.6)


def orientation_fusion(convention: Column, extrinsics: Column) -> Column:
    return F.when(convention == "UNKNOWN", "BLOCKED_FRAME_UNKNOWN").when(F.coalesce(extrinsics, F.lit("NOT_AVAILABLE")) == "NOT_AVAILABLE", "BLOCKED_EXTRINSIC_MISSING").otherwise("AVAILABLE")


def fps_consistent(fps: Column, meta_fps: Column, seconds: Column, meta_seconds: Column) -> Column:
    return (F.abs(fps - meta_fps) <= F.greatest(F.lit(0.1), meta_fps * 0.02)) & (F.abs(seconds - meta_seconds) <= F.greatest(F.lit(1.0), meta_seconds * 0.02))


def frame_time_consistent(t: Column, start: Column, frame: Column, fps: Column) -> Column:
    return F.abs(t - start - frame / fps) <= F.greatest(F.lit(0.25), 2 / fps)


def export_status(exists: Column, size: Column, stated: Column) -> Column:
    return F.when(~exists, "MISSING").when(size <= 0, "FAILED").otherwise(F.coalesce(stated, F.lit("VERIFIED")))


def upload_errors(engine: Column, frames: Column, name: Column, suffix: Column) -> Column:
    """What an upload is refused for: engine, frame budget of 3 to 1500, name of 1 to 160 characters, file kind."""
    return texts((~engine.isin("auto", "cpu", "colmap"), F.lit("engine")), (~frames.between(3, 1500), F.lit("frames")), (~F.length(F.trim(name)).between(1, 160), F.lit("name")), (~F.lower(suffix).isin(".mp4", ".mov", ".avi", ".mkv"), F.lit("suffix")))


def schema_status(errors: Column, warnings: Column) -> Column:
    return F.when(F.size(errors) > 0, "INVALID").when(F.size(warnings) > 0, "VALID_WITH_WARNINGS").otherwise("VALID")


def missing_columns(have: Column, want: Sequence[str]) -> Column:
    return F.array_except(F.array(*(F.lit(c) for c in want)), have)
