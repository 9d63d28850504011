"""Transverse Mercator in closed form, by the usual series in the ellipsoid's eccentricity."""

from __future__ import annotations

from dataclasses import dataclass
from math import radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TransverseMercator:
    """Ellipsoid, origin, scale and false origin; the defaults are those of EPSG:5179."""

    a: float = 6378137.0
    inverse_flattening: float = 298.257222101
    lat0: float = 38.0
    lon0: float = 127.5
    scale: float = 0.9996
    east: float = 1_000_000.0
    north: float = 2_000_000.0

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)

    def arc_terms(self) -> tuple[float, float, float, float]:
        """Factors of phi, sin 2phi, sin 4phi and sin 6phi in the meridian arc."""
        e2 = self.e2
        return (
            1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256,
            -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024),
            15 * e2**2 / 256 + 45 * e2**3 / 1024,
            -35 * e2**3 / 3072,
        )

    def arc0(self) -> float:
        p, t = radians(self.lat0), self.arc_terms()
        return self.a * (t[0] * p + t[1] * sin(2 * p) + t[2] * sin(4 * p) + t[3] * sin(6 * p))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing in metres."""
        p = F.radians(lat)
        second = self.e2 / (1 - self.e2)
        t0, t1, t2, t3 = self.arc_terms()
        arc = self.a * (t0 * p + t1 * F.sin(2 * p) + t2 * F.sin(4 * p) + t3 * F.sin(6 * p))
        n = self.a / F.sqrt(1 - self.e2 * F.sin(p) * F.sin(p))
        t, c = F.tan(p) * F.tan(p), second * F.cos(p) * F.cos(p)
        k = (F.radians(lon) - radians(self.lon0)) * F.cos(p)
        x = k + (1 - t + c) * F.pow(k, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * F.pow(k, 5) / 120
        y = k * k / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(k, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * F.pow(k, 6) / 720
        return self.east + self.scale * n * x, self.north + self.scale * (arc - self.arc0() + n * F.tan(p) * y)
