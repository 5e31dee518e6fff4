"""Class tables, colours and rules for labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .messages import UNKNOWN_COLOURS

# fixed values: classification codes of the LAS format by label; all others are 1 (unclassified)
LAS_CODES = {0: 1, 1: 2, 2: 11, 3: 6, 4: 5, 5: 9, 6: 1, 7: 1}


def las_code(label: Column) -> Column:
    out = F.lit(1)
    for k, v in LAS_CODES.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def rgb_key(r: Column, g: Column, b: Column) -> Column:
    """24-bit key of a colour."""
    return r.cast("long") * 65536 + g.cast("long") * 256 + b.cast("long")


def class_of(r: Column, g: Column, b: Column, classes: dict[tuple[int, int, int], int]) -> Column:
    """Class of a colour; null for a colour that has none, which :func:`check_colours` turns into an error."""
    key, out = rgb_key(r, g, b), F.lit(None).cast("int")
    for (red, green, blue), c in classes.items():
        out = F.when(key == red * 65536 + green * 256 + blue, c).otherwise(out)
    return out


def check_colours(r: Column, g: Column, b: Column, classes: dict[tuple[int, int, int], int]) -> Column:
    """As :func:`class_of`, but the query fails on a colour without a class and names it."""
    found = class_of(r, g, b, classes)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(UNKNOWN_COLOURS), F.concat_ws(" ", r, g, b))).cast("int"))


def colormap(value: Column, low: Column, high: Column, invert: Column) -> tuple[Column, Column, Column]:
    """Blue over green to red, clamped; inverted if asked; values that are no numbers are magenta."""
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    t = part((value - low) / F.when(high == low, 1.0).otherwise(high - low))
    t = F.when(invert, 1 - t).otherwise(t)
    bad = value.isNull() | F.isnan(value)
    r, g, b = (part(1.5 - F.abs(1 - 4 * (t - shift))) for shift in (0.5, 0.25, 0.0))
    return F.when(bad, 1.0).otherwise(r), F.when(bad, 0.0).otherwise(g), F.when(bad, 1.0).otherwise(b)


def softmax_argmax(logits: Column) -> tuple[Column, Column]:
    """Class (from 0, lowest on ties) and probability of the largest logit of an array."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.array_position(logits, top) - 1, 1 / total


def sfm_profile(frames: Column) -> Column:
    return F.when(frames < 200, "SMALL").when(frames < 800, "MEDIUM").when(frames < 2000, "LARGE").otherwise("VERY_LARGE")


def dense_profile(frames: Column) -> Column:
    return F.when(frames < 50, "QUALITY").when(frames <= 200, "BALANCED").otherwise("FAST")


def disk_estimate(video_bytes: Column, frames: Column) -> Column:
    """Bytes a job needs: three times the video, 12 MiB a frame, 2 GiB besides."""
    return 3 * video_bytes + frames * (12 * 1024 * 1024) + 2 * 1024**3


def support_status(points: Column, cameras: Column) -> Column:
    return F.when(points > 100_000, "GOOD").when(points > 50 * cameras, "MARGINAL").otherwise("INSUFFICIENT")


def safe_id(text: Column) -> Column:
    """Identifiers that can neither leave their folder nor overflow their column."""
    return F.coalesce(text.rlike(r"\A[a-zA-Z0-9_-]{1,64}\z"), F.lit(False))
