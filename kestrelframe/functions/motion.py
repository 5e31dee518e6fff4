"""Sensor formulas: quaternions, GNSS quality, barometer, motion quality, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]

# fixed values: default position sigmas in metres by fix quality
SIGMA = {"RTK_FIXED": 0.02, "RTK_FLOAT": 0.2, "PPK_FIXED": 0.02, "PPK_FLOAT": 0.2, "DGPS": 0.5, "GNSS_SINGLE": 2.5, "UNKNOWN": 5.0}


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a + (b - a) * f


def slerp(q1: Quat, q2: Quat, f: Column) -> Quat:
    """Shortest-arc interpolation; nearly equal attitudes are mixed linearly. The result has unit length."""
    dot = sum((a * b for a, b in zip(q1[1:], q2[1:], strict=True)), q1[0] * q2[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    c = F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(c)
    near = c > 0.9995
    safe = F.when(near, 1.0).otherwise(F.sin(angle))
    wa = F.when(near, 1 - f).otherwise(F.sin((1 - f) * angle) / safe)
    wb = F.when(near, f).otherwise(F.sin(f * angle) / safe) * sign
    raw = [wa * a + wb * b for a, b in zip(q1, q2, strict=True)]
    norm = F.sqrt(sum((r * r for r in raw[1:]), raw[0] * raw[0]))
    return tuple(r / norm for r in raw)  # type: ignore[return-value]


def rotation_of(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def gnss_quality(text: Column) -> Column:
    """A known fix quality in upper case, else ``UNKNOWN``."""
    up = F.upper(text)
    return F.when(up.isin(*SIGMA), up).otherwise("UNKNOWN")


def sigmas(quality: Column, sx: Column, sy: Column, sz: Column) -> tuple[Column, Column, Column, Column]:
    """Sigmas with defaults by quality (1.5 times it for height), at least a millimetre; and whether all were measured."""
    base = F.lit(5.0)
    for name, s in SIGMA.items():
        base = F.when(quality == name, F.lit(s)).otherwise(base)

    def safe(v: Column, fallback: Column) -> Column:
        return F.when(v.isNull() | F.isnan(v) | (v <= 0), fallback).otherwise(F.greatest(F.lit(0.001), v))

    measured = F.coalesce((sx > 0) & (sy > 0) & (sz > 0), F.lit(False))
    return safe(sx, base), safe(sy, base), safe(sz, base * 1.5), measured


def weight(sigma: Column) -> Column:
    """Inverse variance, kept within 1e-4 and 1e4."""
    return F.least(F.lit(1e4), F.greatest(F.lit(1e-4), 1 / (sigma * sigma)))


def relative_altitude(pressure: Column, reference: Column, celsius: float = 15.0) -> Column:
    """Hypsometric height over the reference pressure; 0 for pressures that cannot be."""
    k = 8.3144598 * (celsius + 273.15) / (9.80665 * 0.0289644)
    return F.when((pressure <= 0) | (reference <= 0), 0.0).otherwise(k * F.log(F.when(pressure > 0, reference).otherwise(1.0) / F.when(pressure > 0, pressure).otherwise(1.0)))


def motion_quality(ax: Column, ay: Column, az: Column, gx: Column, gy: Column, gz: Column) -> dict[str, Column]:
    """Score and flags of a frame; a sensor that is null lowers nothing."""
    off = F.abs(F.sqrt(ax * ax + ay * ay + az * az) - 9.81)
    spin = F.sqrt(gx * gx + gy * gy + gz * gz)
    shaken, turned = F.coalesce(off > 3.0, F.lit(False)), F.coalesce(spin > 1.0, F.lit(False))
    score = F.when(shaken, F.greatest(F.lit(0.1), 1 - off / 10)).otherwise(1.0) * F.when(turned, F.greatest(F.lit(0.1), 1 - spin / 5)).otherwise(1.0)
    score = F.bround(score, 3)
    return {
        "score": score,
        "high_acceleration": shaken,
        "rapid_rotation": turned,
        "blur_risk": F.when(spin > 2.0, "HIGH").when(turned, "MEDIUM").otherwise("LOW"),
        "at_risk": (score < 0.7) | shaken | turned,
    }


def gps_week_to_epoch(week: Column, seconds: Column, leap: int = 18) -> Column:
    """GPS week and seconds to Unix seconds; the GPS clock began at 1980-01-06."""
    return F.lit(315964800.0) + week * 604800.0 + seconds - leap


def micros_to_seconds(text: Column) -> Column:
    """Microseconds as text to seconds, 0 where they cannot be read."""
    return F.coalesce(text.cast("string").try_cast("double") / 1e6, F.lit(0.0))
