"""Planar coordinates and distances as column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TransverseMercator:
    """Forward projection by the published series (Snyder 1987, eq. 8-9 and 8-10).

    The defaults are the public parameters of EPSG:3116 on the GRS80 ellipsoid.
    """

    lon0: float = -74.07750791666666
    lat0: float = 4.596200416666666
    k0: float = 1.0
    false_east: float = 1_000_000.0
    false_north: float = 1_000_000.0
    a: float = 6_378_137.0
    f: float = 1 / 298.257222101

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    def meridian_terms(self) -> tuple[float, float, float, float]:
        e2 = self.e2
        e4, e6 = e2**2, e2**3
        return (
            1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256,
            3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024,
            15 * e4 / 256 + 45 * e6 / 1024,
            35 * e6 / 3072,
        )

    def meridian_arc(self, phi: float) -> float:
        m0, m2, m4, m6 = self.meridian_terms()
        return self.a * (m0 * phi - m2 * math.sin(2 * phi) + m4 * math.sin(4 * phi) - m6 * math.sin(6 * phi))

    def project(self, lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
        """Easting and northing in metres."""
        phi, lam = F.radians(lat), F.radians(lon)
        e2 = self.e2
        ep2 = e2 / (1 - e2)
        sin, cos = F.sin(phi), F.cos(phi)
        n = self.a / F.sqrt(1 - e2 * sin * sin)
        t = F.tan(phi) * F.tan(phi)
        c = ep2 * cos * cos
        a1 = (lam - math.radians(self.lon0)) * cos
        m0, m2, m4, m6 = self.meridian_terms()
        arc = self.a * (m0 * phi - m2 * F.sin(2 * phi) + m4 * F.sin(4 * phi) - m6 * F.sin(6 * phi))
        a2 = a1 * a1
        east = a1 + (1 - t + c) * a1 * a2 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a1 * a2 * a2 / 120
        north = a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a2 * a2 / 24 + (
            61 - 58 * t + t * t + 600 * c - 330 * ep2
        ) * a2 * a2 * a2 / 720
        x = self.false_east + self.k0 * n * east
        y = self.false_north + self.k0 * (arc - self.meridian_arc(math.radians(self.lat0)) + n * F.tan(phi) * north)
        return x, y


EPSG_3116 = TransverseMercator()


def project_tm(df, lon: str = "lon", lat: str = "lat", crs: TransverseMercator = EPSG_3116):
    """Add planar ``x`` and ``y`` in metres.

    The coordinates come out of one struct-valued step, so later expressions refer to the
    result instead of each repeating the series.
    """
    x, y = crs.project(lon, lat)
    return df.withColumn("_xy", F.struct(x.alias("x"), y.alias("y"))).withColumns(
        {"x": F.col("_xy.x"), "y": F.col("_xy.y")}
    ).drop("_xy")


def haversine(lon1, lat1, lon2, lat2, radius: float = 6_371_008.8) -> Column:
    """Great-circle distance in metres."""
    dphi = F.radians(lat2) - F.radians(lat1)
    dlam = F.radians(lon2) - F.radians(lon1)
    h = F.sin(dphi / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlam / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(h))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Planar distance from a point to a segment; a zero-length segment is a point."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.nullif(length2, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))
    return F.sqrt((px - (ax + t * dx)) ** 2 + (py - (ay + t * dy)) ** 2)
