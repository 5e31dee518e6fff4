"""WGS84 coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the WGS84 ellipsoid and the UTM grid
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
SCALE = 0.9996
FALSE_EASTING = 500000.0


def geodetic_to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Degrees and metres to earth-centred metres."""
    la, lo = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - E2) + alt) * F.sin(la)


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 5) -> tuple[Column, Column, Column]:
    """Earth-centred metres to degrees and metres, by fixed-point rounds; at the poles the height is taken along z."""
    p = F.sqrt(x * x + y * y)

    def step(la: Column, _: Column) -> Column:
        n = A / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
        return F.atan2(z + E2 * n * F.sin(la), p)

    la = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(z, p * (1 - E2)), step)
    n = A / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    pole = p < 1e-10
    alt = F.when(pole, F.abs(z) - A * math.sqrt(1 - E2)).otherwise(p / F.cos(la) - n)
    return F.when(pole, F.when(z > 0, 90.0).otherwise(-90.0)).otherwise(F.degrees(la)), F.when(pole, 0.0).otherwise(F.degrees(F.atan2(y, x))), alt


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _kruger() -> tuple[float, list[float]]:
    """Rectifying radius, and the forward series in the third flattening to order 4."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49561 / 161280 * n**4,
    ]
    return radius, alpha


def utm_from_geodetic(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone, by the Krueger series (below a millimetre inside the zone)."""
    radius, alpha = _kruger()
    e = math.sqrt(E2)
    la, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    tau = F.sinh(F.atanh(F.sin(la)) - e * F.atanh(e * F.sin(la)))
    xi, eta = F.atan2(tau, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + tau * tau))
    north, east = xi, eta
    for k, c in enumerate(alpha, 1):
        north = north + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return FALSE_EASTING + SCALE * radius * east, F.when(lat >= 0, 0.0).otherwise(10_000_000.0) + SCALE * radius * north


def planar_step(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Metres between neighbours on a local plane, longitude scaled at the first point."""
    dy = (lat1 - lat0) * 111000.0
    dx = (lon1 - lon0) * 111000.0 * F.cos(F.radians(lat0))
    return F.sqrt(dx * dx + dy * dy)
