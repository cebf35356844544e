"""Transverse Mercator in both directions as column functions, and resampling between pixel sizes.

The series are those of Krueger in the third flattening, to its sixth power: errors are far below a millimetre
within some thousand kilometres of the central meridian."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of n**j, n**(j + 1), ... for the jth term, each as numerator and denominator.
FORWARD = (
    ((1, 2), (-2, 3), (5, 16), (41, 180), (-127, 288), (7891, 37800)),
    ((13, 48), (-3, 5), (557, 1440), (281, 630), (-1983433, 1935360)),
    ((61, 240), (-103, 140), (15061, 26880), (167603, 181440)),
    ((49561, 161280), (-179, 168), (6601661, 7257600)),
    ((34729, 80640), (-3418889, 1995840)),
    ((212378941, 319334400),),
)
INVERSE = (
    ((1, 2), (-2, 3), (37, 96), (-1, 360), (-81, 512), (96199, 604800)),
    ((1, 48), (1, 15), (-437, 1440), (46, 105), (-1118711, 3870720)),
    ((17, 480), (-37, 840), (-209, 4480), (5569, 90720)),
    ((4397, 161280), (-11, 504), (-830251, 7257600)),
    ((4583, 161280), (-108847, 3991680)),
    ((20648693, 638668800),),
)
LATITUDE = (
    ((2, 1), (-2, 3), (-2, 1), (116, 45), (26, 45), (-2854, 675)),
    ((7, 3), (-8, 5), (-227, 45), (2704, 315), (2323, 945)),
    ((56, 15), (-136, 35), (-1262, 105), (73814, 2835)),
    ((4279, 630), (-332, 35), (-399572, 14175)),
    ((4174, 315), (-144838, 6237)),
    ((601676, 22275),),
)


@dataclass(frozen=True)
class TransverseMercator:
    """A projection: ellipsoid (semi-axis in metres, inverse flattening), central meridian and origin in degrees, scale, and false coordinates."""

    central: float
    origin: float = 0.0
    scale: float = 0.9996
    false_easting: float = 500_000.0
    false_northing: float = 0.0
    a: float = 6378137.0
    inverse_flattening: float = 298.257223563

    @property
    def n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def radius(self) -> float:
        """Of the sphere whose meridian is as long."""
        n2 = self.n**2
        return self.a / (1 + self.n) * (1 + n2 / 4 + n2**2 / 64 + n2**3 / 256)

    def series(self, table: tuple) -> list[float]:
        return [sum(p / q * self.n ** (j + k) for k, (p, q) in enumerate(row)) for j, row in enumerate(table, 1)]

    @property
    def eccentricity(self) -> float:
        return 2 * math.sqrt(self.n) / (1 + self.n)

    @property
    def offset(self) -> float:
        """The northing of the origin's latitude, without false northing and scale."""
        s = math.sin(math.radians(self.origin))
        chi = math.asin(math.tanh(math.atanh(s) - self.eccentricity * math.atanh(self.eccentricity * s)))
        return self.radius * (chi + sum(c * math.sin(2 * j * chi) for j, c in enumerate(self.series(FORWARD), 1)))


def utm(zone: int, south: bool = False) -> TransverseMercator:
    """A UTM zone on WGS 84."""
    return TransverseMercator(6.0 * zone - 183.0, false_northing=10_000_000.0 if south else 0.0)


def _sum(terms: list[Column], start: Column) -> Column:
    return reduce(lambda x, y: x + y, terms, start)


def forward(lon: Column, lat: Column, p: TransverseMercator) -> tuple[Column, Column]:
    """Easting and northing, in metres, of longitude and latitude in degrees. A pole's northing is defined as well; null where either is."""
    s, d = F.sin(F.radians(lat)), F.radians(lon - p.central)
    t = F.sinh(F.atanh(s) - p.eccentricity * F.atanh(p.eccentricity * s))
    t = F.when(F.abs(lat) >= 90, F.signum(lat) * 1e300).otherwise(t)
    xi = F.when(F.abs(lat) >= 90, F.signum(lat) * (math.pi / 2)).otherwise(F.atan2(t, F.cos(d)))
    eta = F.when(F.abs(lat) >= 90, F.lit(0.0)).otherwise(F.atanh(F.sin(d) / F.sqrt(1 + t * t)))
    terms = list(enumerate(p.series(FORWARD), 1))
    east = _sum([c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in terms], eta)
    north = _sum([c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in terms], xi)
    return p.false_easting + p.scale * p.radius * east, p.false_northing + p.scale * (p.radius * north - p.offset)


def inverse(east: Column, north: Column, p: TransverseMercator) -> tuple[Column, Column]:
    """Longitude and latitude, in degrees, of easting and northing."""
    eta = (east - p.false_easting) / (p.scale * p.radius)
    xi = ((north - p.false_northing) / p.scale + p.offset) / p.radius
    terms = list(enumerate(p.series(INVERSE), 1))
    x = _sum([-c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in terms], xi)
    e = _sum([-c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in terms], eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = _sum([c * F.sin(2 * j * chi) for j, c in enumerate(p.series(LATITUDE), 1)], chi)
    return p.central + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(lat)


def pixel_keys(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with px and py, the pixel of a lattice of ``size`` metres that holds a point."""
    return df.withColumns({"px": F.floor(F.col(x) / size), "py": F.floor(F.col(y) / size)})


def resampled(pixels: DataFrame, size: float, to: float, values: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Pixels (px, py on a lattice of ``size``) on a lattice of ``to``: each value's mean by the areas of overlap, over pixels that have one, and
    ``area``, the share of the new pixel that old ones cover.

    An old pixel is keyed to the columns, then to the rows of new pixels that it overlaps; one exchange, with partial sums. Sizes need not divide
    each other. A new pixel without a value is null there."""

    def overlaps(df: DataFrame, p: str, new: str, part: str) -> DataFrame:
        low, high = F.col(p) * size, (F.col(p) + 1) * size
        df = df.withColumn(new, F.explode(F.sequence(F.floor(low / to), F.greatest(F.floor(low / to), F.ceil(high / to) - 1))))
        return df.withColumn(part, F.least(high, (F.col(new) + 1) * to) - F.greatest(low, F.col(new) * to)).filter(F.col(part) > size * 1e-12)

    p = overlaps(overlaps(pixels, "px", "qx", "wx"), "py", "qy", "wy").withColumn("w", F.col("wx") * F.col("wy"))
    mean = lambda v: F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("w"))))
    out = p.groupBy(*keys, "qx", "qy").agg(*[mean(v).alias(v) for v in values], (F.sum("w") / (to * to)).alias("area"))
    return out.withColumnsRenamed({"qx": "px", "qy": "py"})
