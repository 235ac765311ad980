"""Angles on the sky and their texts, distances, and the tangent projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEXAGESIMAL = r"^\s*([+-]?)(\d+)\s*[:hd ]\s*(\d+)\s*[:m ]\s*(\d+(?:\.\d*)?)s?\s*$"


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once and stays one node of the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _degrees(text: Column, body) -> Column:
    """``body(sign, units, minutes, seconds)`` of a text, which is evaluated once; NULL if it isn't one."""
    pieces = lambda t: F.split(F.regexp_replace(t, _SEXAGESIMAL, "$1,$2,$3,$4"), ",")
    number = lambda p, k: F.get(p, k).cast("double")
    return _bound(text, lambda t: F.when(t.rlike(_SEXAGESIMAL), _bound(pieces(t), lambda p: body(F.get(p, 0), number(p, 1), number(p, 2), number(p, 3)))))


def ra_to_degree(text: Column) -> Column:
    """``H:M:S`` or ``HhMmSs`` in degrees; NULL outside 0..24 hours or 0..60 minutes and seconds."""
    return _degrees(text, lambda sign, h, m, s: F.when((sign != "-") & h.between(0, 24) & m.between(0, 60) & s.between(0, 60), (h + m / 60 + s / 3600) * 15))


def dec_to_degree(text: Column) -> Column:
    """``D:M:S`` or ``DdMmSs`` in degrees; the sign is that of the text, so -0d30m is negative."""
    return _degrees(text, lambda sign, d, m, s: F.when(d.between(0, 90) & m.between(0, 60) & s.between(0, 60), F.when(sign == "-", -1.0).otherwise(1.0) * (d + m / 60 + s / 3600)))


def _general(x: Column) -> Column:
    """Up to six significant digits without trailing zeros, for values from 0 to 60."""
    digits = F.when(x >= 10, x.cast("decimal(9,4)").cast("string")).otherwise(x.cast("decimal(9,5)").cast("string"))
    return F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))


def _sexagesimal(units: Column, after: str) -> Column:
    """Whole units, ``after`` and whole minutes in two digits each, then the seconds."""
    two = lambda n: F.substring((F.floor(n) + 100).cast("string"), 2, 2)
    rest = lambda n: (n - F.floor(n)) * 60
    return _bound(units, lambda u: F.concat(two(u), F.lit(after), two(rest(u)), F.lit("m"), _general(rest(rest(u))), F.lit("s")))


def degree_to_ra(c: Column) -> Column:
    """Degrees as ``HHhMMmSs``; NULL outside 0..360."""
    return F.when(c.between(0, 360), _sexagesimal(c / 15, "h"))


def degree_to_dec(c: Column) -> Column:
    """Degrees as ``+DDdMMmSs``; NULL outside -90..90."""
    return F.when(c.between(-90, 90), F.concat(F.when(c < 0, "-").otherwise("+"), _sexagesimal(F.abs(c), "d")))


def distance_flat(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def distance_on_sphere(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees between two points given in degrees, by the haversine."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), F.lit(2.0))
    h = half(dec1, dec2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half(ra1, ra2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def in_cone(ra: Column, dec: Column, ra0: float, dec0: float, radius: float) -> Column:
    return distance_on_sphere(ra, dec, F.lit(ra0), F.lit(dec0)) < radius


def in_box(ra: Column, dec: Column, ra0: float, dec0: float, width: float, height: float | None = None) -> Column:
    height = width if height is None else height
    near = F.pmod(ra - ra0 + 180.0, F.lit(360.0)) - 180.0
    return near.between(-width / 2, width / 2) & (dec - dec0).between(-height / 2, height / 2)


class TangentPlane:
    """A gnomonic (TAN) projection: reference pixel and position, and the matrix of degrees a pixel."""

    def __init__(self, crpix: tuple[float, float], crval: tuple[float, float], cd: tuple[tuple[float, float], tuple[float, float]]):
        self.crpix, self.crval, self.cd = crpix, crval, cd

    @classmethod
    def scaled(cls, crpix: tuple[float, float], crval: tuple[float, float], cdelt: tuple[float, float], pc=((1.0, 0.0), (0.0, 1.0))) -> TangentPlane:
        return cls(crpix, crval, tuple(tuple(cdelt[i] * pc[i][j] for j in range(2)) for i in range(2)))

    def to_world(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Right ascension and declination, in degrees, of a pixel position."""
        (a, b), (c, d) = self.cd
        dx, dy = x - self.crpix[0], y - self.crpix[1]
        xi, eta = F.radians(dx * a + dy * b), F.radians(dx * c + dy * d)
        ra0, dec0 = F.radians(F.lit(float(self.crval[0]))), F.radians(F.lit(float(self.crval[1])))
        below = F.cos(dec0) - eta * F.sin(dec0)
        ra = ra0 + F.atan2(xi, below)
        dec = F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.sqrt(xi * xi + below * below))
        return F.pmod(F.degrees(ra), F.lit(360.0)), F.degrees(dec)

    def to_image(self, ra: Column, dec: Column) -> tuple[Column, Column]:
        """The pixel position of a right ascension and declination; NULL on the far hemisphere."""
        (a, b), (c, d) = self.cd
        dra, dec_, dec0 = F.radians(ra - self.crval[0]), F.radians(dec), F.radians(F.lit(float(self.crval[1])))
        toward = F.sin(dec_) * F.sin(dec0) + F.cos(dec_) * F.cos(dec0) * F.cos(dra)
        xi = F.degrees(F.cos(dec_) * F.sin(dra) / toward)
        eta = F.degrees((F.sin(dec_) * F.cos(dec0) - F.cos(dec_) * F.sin(dec0) * F.cos(dra)) / toward)
        det = a * d - b * c
        seen = lambda v: F.when(toward > 0, v)
        return seen((xi * d - eta * b) / det + self.crpix[0]), seen((eta * a - xi * c) / det + self.crpix[1])

    def pixel_scale(self) -> tuple[float, float]:
        """Degrees a pixel along either axis."""
        (a, b), (c, d) = self.cd
        return (a * a + c * c) ** 0.5, (b * b + d * d) ** 0.5

    def pixel_area_arcsec2(self) -> float:
        (a, b), (c, d) = self.cd
        return abs(a * d - b * c) * 3600.0**2


def coverage(plane: TangentPlane, cells: DataFrame) -> DataFrame:
    """ra, dec (the middle), width, height and the least and greatest of both, in degrees, of what an image covers.

    Only the cells on its edge are looked at; right ascension is counted from the reference's, so a field
    across 0 is one.
    """
    ends = cells.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    rim = cells.join(F.broadcast(ends)).where((F.col("x") == F.col("lo_x")) | (F.col("x") == F.col("hi_x")) | (F.col("y") == F.col("lo_y")) | (F.col("y") == F.col("hi_y")))  # one row
    ra, dec = plane.to_world(F.col("x").cast("double"), F.col("y").cast("double"))
    from_middle = F.pmod(ra - plane.crval[0] + 180, F.lit(360.0)) - 180
    at = rim.select(from_middle.alias("a"), dec.alias("d")).agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("d").alias("dec_min"), F.max("d").alias("dec_max"))
    turned = lambda c: F.pmod(c + plane.crval[0], F.lit(360.0))
    return at.select(turned((F.col("a0") + F.col("a1")) / 2).alias("ra"), ((F.col("dec_min") + F.col("dec_max")) / 2).alias("dec"), (F.col("a1") - F.col("a0")).alias("width"), (F.col("dec_max") - F.col("dec_min")).alias("height"), turned(F.col("a0")).alias("ra_min"), turned(F.col("a1")).alias("ra_max"), "dec_min", "dec_max")
