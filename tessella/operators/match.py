"""Positional matching of two catalogues within an aperture.

Space is dealt into cells twice as wide as the aperture, or as a small share of it where rows are crowded, so the
range condition becomes an equality on cells and the exact distance a condition of the join.  A pair survives if the second row's nearest
is the first, and, among the second rows that chose it, the first's nearest is the second.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard


@dataclass(frozen=True)
class Aperture:
    """Half widths along the axes before rotation, and the rotation's angles in degrees."""

    axes: tuple[float, ...]
    angles: tuple[float, ...] = ()

    @classmethod
    def of(cls, dims: int, values: Sequence[float]) -> Aperture:
        """1-D: r.  2-D: r; rx, ry; or a, q, pa.  3-D: r; three semi-axes; or a, q1, q2 and three angles."""
        v = tuple(map(float, values))
        if len(v) == 1:
            return cls(v * dims)
        if dims == 2 and len(v) == 2 or dims == 3 and len(v) == 3:
            return cls(v)
        if dims == 2 and len(v) == 3:
            return cls((v[0], v[0] * v[1]), (v[2],))
        if dims == 3 and len(v) == 6:
            return cls((v[0], v[0] * v[1], v[0] * v[2]), v[3:])
        raise ValueError("this aperture doesn't fit the number of coordinates")

    def rotation(self) -> list[list[float]]:
        """Rows turn a difference of positions into the aperture's own axes."""
        n = len(self.axes)
        if not self.angles:
            return [[float(i == j) for j in range(n)] for i in range(n)]
        turn = lambda t: (math.cos(math.radians(t)), math.sin(math.radians(t)))
        c, s = turn(self.angles[0])
        if n == 2:
            return [[c, s], [-s, c]]
        c2, s2 = turn(self.angles[1])
        c3, s3 = turn(self.angles[2])
        x1, z1, z3 = [[c, s, 0.0], [-s, c, 0.0], [0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0], [0.0, c2, s2], [0.0, -s2, c2]], [[c3, s3, 0.0], [-s3, c3, 0.0], [0.0, 0.0, 1.0]]
        times = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
        return times(z3, times(z1, x1))

    def half_widths(self) -> list[float]:
        """Of the bounding box along each axis."""
        r, n = self.rotation(), len(self.axes)
        return [math.sqrt(sum((r[i][k] * self.axes[i]) ** 2 for i in range(n))) for k in range(n)]

    def distance(self, differences: list[Column]) -> Column:
        """Elliptical distance, in units of the first axis."""
        r, a0 = self.rotation(), self.axes[0]
        terms = []
        for row, axis in zip(r, self.axes):
            along = None
            for k, d in zip(row, differences):
                if k:
                    along = d * k if along is None else along + d * k
            along = F.lit(0.0) if along is None else along * (a0 / axis)
            terms.append(along * along)
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return F.abs(differences[0]) if len(differences) == 1 else F.sqrt(total)


def _spots(df: DataFrame, cols: Sequence[str], key: str) -> tuple[DataFrame, list[str]]:
    """(id, c0 ..) of the rows without a blank, and the names of the coordinates."""
    return df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)]).dropna(), [f"c{k}" for k in range(len(cols))]


def _cells(names: Sequence[str], widths: Sequence[float], reach: float) -> list[Column]:
    """The cells, twice as wide as ``widths``, that hold what lies up to ``reach`` widths away along each axis."""
    at = lambda c, w, k: F.floor((F.col(c) + k * w) / (2 * w))
    return [F.explode(F.sequence(at(c, w, -reach), at(c, w, reach))) if reach else at(c, w, 0) for c, w in zip(names, widths)]


def _crowding(left: DataFrame, right: DataFrame, names: list[str], widths: Sequence[float]) -> int:
    """How many pairs share a cell."""
    cells = [f"_{n}" for n in names]
    count = lambda df, n: df.groupBy(*[c.alias(k) for c, k in zip(_cells(names, widths, 0), cells)]).agg(F.count("*").alias(n))
    return count(left, "n").join(count(right, "m"), cells).agg(F.sum(F.col("n").cast("double") * F.col("m"))).head()[0] or 0


#: A search begins where a row shares its cell with not many more than so many others.
FEW = 4


def _nearest(left: DataFrame, right: DataFrame, names: list[str], aperture: Aperture, most: float = 1.0) -> DataFrame:
    """(c0 .., m), m of (r, first, id), for each position of ``left``: the row of ``right`` that is nearest, ties by its first coordinate and id.

    left: positions, each once; right: positions, each once, with an id; ``most``: up to how many apertures are looked at.  The
    search begins with so small a share of the aperture that few rows share a cell, and doubles: what has
    found a neighbour within it is done, so the pairs don't grow with the square of the density.
    """
    size, share = left.count() + right.count(), 1.0
    widths = lambda: [w * share * (1 + 1e-9) for w in aperture.half_widths()]
    while share > 1e-9 and _crowding(left, right, names, widths()) > FEW * size:
        share /= 4
    cells, done = [f"_{n}" for n in names], None
    theirs = [f"o{k}" for k in range(len(names))]
    r = aperture.distance([F.col(n) - F.col(o) for n, o in zip(names, theirs)])
    while True:
        near = left
        for c, name in zip(_cells(names, widths(), 1), cells):
            near = near.withColumn(name, c)
        far = right.select(F.col("id").alias("_id"), *[F.col(n).alias(o) for n, o in zip(names, theirs)], *[c.alias(name) for c, name in zip(_cells(names, widths(), 0), cells)])
        pairs = near.join(far, cells).withColumn("r", r).where(F.col("r") < aperture.axes[0] * share)
        best = pairs.groupBy(*names).agg(F.min(F.struct("r", F.col("o0").alias("first"), F.col("_id").alias("id"))).alias("m"))
        if share >= most and done is None:
            return best
        best = cut(best, "nearest")
        done = best if done is None else done.unionByName(best)
        if share >= most:
            return done
        rest = cut(left.join(best, names, "left_anti"), "left")
        discard(left)
        left = rest
        if left.isEmpty():
            return done
        share *= 2


def match(a: DataFrame, b: DataFrame, cols_a: Sequence[str], cols_b: Sequence[str], id_a: str, id_b: str, aperture: Sequence[float]) -> DataFrame:
    """(a_id, b_id, dist): one to one.

    Of rows at one place only that of the least id can be chosen, so each place is looked at once; a row of ``b`` whose id
    is at several places keeps all of them, for the id chooses once.
    """
    (left, names), (right, _) = _spots(a, cols_a, id_a), _spots(b, cols_b, id_b)
    moving = right.groupBy("id").agg(*[(F.min(c) != F.max(c)).alias(c) for c in names]).where(" OR ".join(names)).select("id", F.col("id").alias("_own"))
    right = cut(right.join(moving, "id", "left").groupBy(*names, "_own").agg(F.min("id").alias("id")).drop("_own"), "right")
    left = cut(left.groupBy(*names).agg(F.min("id").alias("id")), "left")
    found = _nearest(cut(right.select(*names).distinct(), "places"), left, names, Aperture.of(len(cols_a), aperture))
    pairs = right.join(found, names).groupBy(F.col("id").alias("b_id")).agg(F.min(F.struct("m.r", "m.first", "m.id", "c0")).alias("m"))
    chosen = pairs.groupBy(F.col("m.id").alias("a_id")).agg(F.min(F.struct("m.r", "m.c0", "b_id")).alias("m"))
    return chosen.select("a_id", "m.b_id", F.col("m.r").alias("dist"))


def not_matched(df: DataFrame, key: str, matched: DataFrame, side: str) -> DataFrame:
    """Rows of one catalogue without a partner."""
    return df.join(matched.select(F.col(side).alias(key)), key, "left_anti")


def merged(a: DataFrame, b: DataFrame, matched: DataFrame, id_a: str, id_b: str, asked: Sequence[str]) -> DataFrame:
    """Columns of both sides of the matched rows: ``aNAME``, ``bNAME``, ``a_all`` or ``b_all``."""
    left = a.select(F.col(id_a).alias("a_id"), *[F.col(f"`{c}`").alias(f"a {c}") for c in a.columns])
    right = b.select(F.col(id_b).alias("b_id"), *[F.col(f"`{c}`").alias(f"b {c}") for c in b.columns])
    wide = matched.join(left, "a_id").join(right, "b_id")
    out: list[Column] = []
    for x in asked:
        side, name = x[0], x[1:]
        names = (a if side == "a" else b).columns if name == "_all" else [name]
        out += [F.col(f"`{side} {n}`").alias(n if name != "_all" else f"{side}_{n}") for n in names]
    return wide.select(*out, "dist")


def match_point(a: DataFrame, cols: Sequence[str], key: str, point: Sequence[float], aperture: Sequence[float]) -> DataFrame:
    """The row nearest to one literal position within the aperture, by a filter and a top-1; no join."""
    ap = Aperture.of(len(cols), aperture)
    r = ap.distance([F.col(c).cast("double") - float(p) for c, p in zip(cols, point)])
    return a.select(F.col(key).alias("a_id"), r.alias("dist"), F.col(cols[0]).alias("first")).where(F.col("dist") < ap.axes[0]).orderBy("dist", "first", "a_id").limit(1).select("a_id", "dist")


def nearest_neighbour(a: DataFrame, b: DataFrame, cols_a: Sequence[str], cols_b: Sequence[str], id_a: str, id_b: str, start: float) -> DataFrame:
    """(a_id, b_id, dist): the nearest row of ``b`` for each of ``a``, without an aperture; rows with a blank have none.

    A radius that doubles, from ``start`` or less where rows are crowded, settles rows by cells: what finds a
    neighbour within it is done, the rest is tried again, until the radius spans both tables.  A sparse region costs a
    few more rounds; only rows far from all of ``b`` meet large parts of it.
    """
    (own, names), (other, _) = _spots(a, cols_a, id_a), _spots(b, cols_b, id_b)
    own = cut(own, "own")
    left, right = cut(own.select(*names).distinct(), "left"), cut(other.groupBy(*names).agg(F.min("id").alias("id")), "right")
    ends = left.unionByName(right.select(*names)).agg(*[(F.max(c) - F.min(c)).alias(c) for c in names]).head()
    span = math.sqrt(sum((ends[c] or 0.0) ** 2 for c in names))
    found = _nearest(left, right, names, Aperture.of(len(names), [start]), span * (1 + 1e-9) / start)
    best = own.join(found, names).groupBy(F.col("id").alias("a_id")).agg(F.min("m").alias("m"))
    return best.select("a_id", F.col("m.id").alias("b_id"), F.col("m.r").alias("dist"))
