"""Building the text of a query to a remote sky catalogue, and the same selection on a local table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sky

# Short names of remote data sets.
DATASETS = {"edr3": "gaiaedr3.gaia_source", "dr2": "gaiadr2.gaia_source", "dr1": "gaiadr1.gaia_source", "hipparcos": "public.hipparcos", "tyco2": "public.tyco2"}


def around(df: DataFrame, dataset: str, ra: str, dec: str, columns: Sequence[str] = (), ranges: Sequence[str] = ()) -> RemoteQuery:
    """The query for what overlaps with a table: the box about its positions, and its own range of each of ``ranges``."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in (ra, dec, *ranges) for n, f in (("lo", F.min), ("hi", F.max))]).head()
    if ends is None or ends[0] is None:
        raise ValueError("a table without positions overlaps with nothing")
    span = {c: (ends[f"lo_{c}"], ends[f"hi_{c}"]) for c in (ra, dec, *ranges)}
    middle = tuple(sum(span[c]) / 2 for c in (ra, dec))
    return RemoteQuery(dataset, middle, None, [span[c][1] - span[c][0] for c in (ra, dec)], columns, [(c, *span[c]) for c in ranges])


@dataclass(frozen=True)
class RemoteQuery:
    dataset: str
    center: tuple[float, float] | None = None
    radius: float | None = None
    width: Sequence[float] = ()
    columns: Sequence[str] = ()
    ranges: Sequence[tuple[str, float, float]] = ()

    def check(self) -> None:
        if self.center is not None and (self.radius is None) == (not self.width):
            raise ValueError("a centre needs either a radius or a width")
        if self.center is None and (self.radius is not None or self.width):
            raise ValueError("a radius or a width needs a centre")

    def text(self) -> str:
        """The query in the astronomical dialect of SQL; ranges include both ends."""
        self.check()
        where = []
        if self.center:
            ra, dec = self.center
            sides = ", ".join(f"{w:g}" for w in ((*self.width, *self.width) if len(self.width) == 1 else self.width))
            region = f"CIRCLE('ICRS', {ra:g}, {dec:g}, {self.radius:g})" if self.radius is not None else f"BOX('ICRS', {ra:g}, {dec:g}, {sides})"
            where.append(f"1=CONTAINS(POINT('ICRS', ra, dec), {region})")
        where += [f"{c}>={a:g} AND {c}<={b:g}" for c, a, b in self.ranges]
        chosen = ", ".join(self.columns) or "*"
        return f"SELECT {chosen} FROM {DATASETS.get(self.dataset, self.dataset)}" + (" WHERE " + " AND ".join(where) if where else "")

    def on(self, df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
        """The same selection of a local table."""
        self.check()
        if self.center and self.radius is not None:
            df = df.where(sky.in_cone(F.col(ra), F.col(dec), *self.center, self.radius))
        elif self.center:
            df = df.where(sky.in_box(F.col(ra), F.col(dec), *self.center, *self.width[:2]))
        for c, a, b in self.ranges:
            df = df.where(F.col(c).between(a, b))
        return df.select(*self.columns) if self.columns else df
