"""Statistics of columns: single values, ranks, sigma clipping, the mode, histograms and cumulative frequencies."""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard


def within(df: DataFrame, low: float | None = None, high: float | None = None, ref: str = "", value: str = "") -> DataFrame:
    """Rows with ``low <= ref < high``; ``ref`` is the value itself unless given."""
    c = F.col(ref or value)
    if low is not None:
        df = df.where(c >= low)
    return df.where(c < high) if high is not None else df


def single_values(c: Column) -> list[Column]:
    """number, minimum, maximum, sum, mean, population standard deviation and median of the non-blank values."""
    c = c.cast("double")
    return [F.count(c).alias("number"), F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.median(c).alias("median")]


def rank_of_quantile(n: int, q: float) -> int:
    """The index, from 0, of a quantile among ``n`` sorted values: nearest, halves down."""
    x = (n - 1) * q
    return int(np.ceil(x - 0.5))


def ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n (rows alike), upto (rows of the group up to the value), total (rows of the group).

    Equal rows are counted where they are, the counts dealt out by range and the ranges' sums added up: no
    task sorts a whole group, and a value that fills a group is one row.
    """
    keys = list(keys)
    alike = df.select(*keys, value).dropna().groupBy(*keys, value).agg(F.count("*").alias("n"))
    dealt = cut(alike.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("_part", *keys).agg(F.sum("n").alias("_n"))
    before = sums.select("_part", *keys, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("total"))
    own = W.partitionBy("_part", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.withColumn("_own", F.sum("n").over(own)).join(before, ["_part", *keys])
    return summed.select(*keys, value, "n", (F.col("_before") + F.col("_own")).alias("upto"), "total")


def holds(rank: Column) -> Column:
    """Whether a row of ``ranked`` stands at a rank, from 1."""
    return (F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto"))


def medians(df: DataFrame, keys: Sequence[str], value: str, rows: DataFrame | None = None) -> DataFrame:
    """keys, median, for groups of any size; ``rows`` are the ``ranked`` ones, if they are at hand."""
    middle = holds(F.floor((F.col("total") + 1) / 2)) | holds(F.floor(F.col("total") / 2) + 1)
    return (ranked(df, keys, value) if rows is None else rows).where(middle).groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("median"))


def summary(df: DataFrame, keys: Sequence[str], value: str, rows: DataFrame | None = None) -> DataFrame:
    """``single_values`` of each group, for groups of any size; ``rows`` as for ``medians``."""
    d = df.where(F.col(value).isNotNull())
    return d.groupBy(*keys).agg(*single_values(F.col(value))[:-1]).join(medians(d, keys, value, rows), list(keys), "left")


def quantiles(df: DataFrame, value: str, qs: Sequence[float]) -> DataFrame:
    """(q, value) by nearest rank."""
    rows = ranked(df, [], value)
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return df.sparkSession.createDataFrame([(float(q), None) for q in qs], f"q double, value {df.schema[value].dataType.simpleString()}")
    wanted = df.sparkSession.createDataFrame([(float(q), rank_of_quantile(n, q) + 1) for q in qs], "q double, _at long")
    return rows.join(F.broadcast(wanted), holds(F.col("_at"))).select("q", F.col(value).alias("value"))


def quantile_range(df: DataFrame, value: str, low: float, high: float | None = None) -> DataFrame:
    """Rows between two quantiles, the upper one excluded; one quantile stands for itself and its complement."""
    at = {r["q"]: r["value"] for r in quantiles(df, value, [low, 1 - low if high is None else high]).collect()}
    return within(df, at[low], at[1 - low if high is None else high], value=value)


def quantile_function(df: DataFrame, value: str, at: float) -> DataFrame:
    """The quantile of a value, by one aggregation: that of the nearest element, ties upward; below the least
    it is minus infinity, from the greatest on infinity."""
    c = F.col(value)
    a = df.select(c).dropna().agg(F.count(c).alias("n"), F.count(F.when(c <= at, 1)).alias("below"), F.max(F.when(c <= at, c)).alias("prev"), F.min(F.when(c > at, c)).alias("next"))
    index = F.when(F.col("next") - at <= at - F.col("prev"), F.col("below")).otherwise(F.col("below") - 1)
    # of equal elements the scan stops at the first larger one, so the last of them is the lower neighbour
    got = F.when(F.col("n") == 0, None).when(F.col("below") == 0, float("-inf")).when(F.col("next").isNull(), float("inf")).otherwise(index / (F.col("n") - 1))
    return a.select(F.lit(float(at)).alias("value"), got.cast("double").alias("quantile"))


# sigma clipping


def _clip_round(df: DataFrame, keys: list[str], value: str, bounds: DataFrame | None, crowded: bool) -> DataFrame:
    inside = df if bounds is None else df.join(bounds.select(*keys, "low", "high"), keys).where((F.col(value) > F.col("low")) & (F.col(value) < F.col("high")))
    c = F.col(value).cast("double")
    rest = [F.count(c).alias("size"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")]
    if crowded:
        return inside.groupBy(*keys).agg(*rest).join(medians(inside, keys, value).withColumnRenamed("median", "med"), keys)
    return inside.groupBy(*keys).agg(*rest, F.median(c).alias("med"))


def sigma_clip(df: DataFrame, keys: list[str], value: str, multiple: float, param: float, most: int = 50, crowded: bool = False) -> DataFrame:
    """keys, number, median, mean, std after clipping to median +- multiple * std.

    ``crowded`` groups are too large for one task to hold the values of; their medians are found by rank.

    ``param`` of 1 or more is a number of rounds, less is the tolerance on the change of the standard
    deviation.  The number is that after the last clip, the statistics are those of the round before it
    unless the deviation came to 0.  Only bounds per group travel between rounds, never values; a group
    that hasn't settled after ``most`` rounds has blanks.
    """
    df = df.select(*keys, value).dropna()
    first = _clip_round(df, keys, value, None, crowded)
    low = F.greatest(F.coalesce("low", F.lit(float("-inf"))), F.col("med") - multiple * F.col("std"))
    high = F.least(F.coalesce("high", F.lit(float("inf"))), F.col("med") + multiple * F.col("std"))
    state = first.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    state = cut(state.withColumns({"low": low, "high": high}), "clip")
    if param >= 1:
        for _ in range(int(param) - 1):
            fresh = _clip_round(df, keys, value, state, crowded).withColumnsRenamed({c: f"{c}_" for c in ("size", "med", "mean", "std")})
            both = state.join(fresh, keys, "left")  # a group with nothing left keeps its last values
            moved = both.select(*keys, "low", "high", *[F.coalesce(f"{c}_", c).alias(c) for c in ("size", "med", "mean", "std")]).withColumns({"low": low, "high": high})
            old, state = state, cut(moved, "clip")
            discard(old)
        ends = df.join(state.select(*keys, "low", "high"), keys).where((F.col(value) > F.col("low")) & (F.col(value) < F.col("high"))).groupBy(*keys).agg(F.count("*").alias("left"))
        out = state.join(ends, keys, "left")
        number = F.when(F.col("size") == 1, 1).otherwise(F.coalesce("left", F.lit(0)))
        return out.select(*keys, number.cast("long").alias("number"), F.col("med").alias("median"), "mean", "std")
    single = F.col("size") <= 1
    state = state.withColumns({"number": F.when(single, F.col("size")), "done": single})
    for _ in range(most):
        live = state.where(~F.col("done"))
        if live.isEmpty():
            break
        fresh = _clip_round(df, keys, value, live, crowded).withColumnsRenamed({"size": "size_", "med": "med_", "mean": "mean_", "std": "std_"})
        both = live.join(fresh, keys, "left")
        flat = F.col("std_") == 0
        settled = F.coalesce(flat | ((F.col("std") - F.col("std_")) / F.nullif(F.col("std_"), F.lit(0.0)) < param), F.lit(True))
        now = lambda old: F.when(~settled | flat, F.col(f"{old}_")).otherwise(F.col(old))
        moved = both.select(*keys, "low", "high", now("size").alias("size"), now("med").alias("med"), now("mean").alias("mean"), now("std").alias("std"), F.when(settled, F.coalesce("size_", F.lit(0))).alias("number"), settled.alias("done"))
        moved = moved.withColumns({"low": low, "high": high})
        old, state = state, cut(state.where("done").unionByName(moved), "clip")
        discard(old)
    blank = lambda c: F.when(F.col("done"), F.col(c))
    return state.select(*keys, blank("number").cast("long").alias("number"), blank("med").alias("median"), blank("mean").alias("mean"), blank("std").alias("std"))


def sigma_clip_array(v: np.ndarray, multiple: float, param: float, most: int = 50) -> tuple[float, float, float, float]:
    """(number, median, mean, std) of one small array, by the same rules; for tiles and windows."""
    v = np.sort(v[~np.isnan(v)].astype(float))
    if len(v) < 2:
        return (float(len(v)), *((v[0], v[0], 0.0) if len(v) else (np.nan,) * 3))
    old = None
    for k in range(int(param) if param >= 1 else most):
        if not len(v):
            break
        now = float(np.median(v)), float(v.mean()), float(v.std())
        if param < 1 and old is not None:
            if now[2] == 0:
                return (float(len(v)), *now)
            if (old[2] - now[2]) / now[2] < param:
                return (float(len(v)), *old)
        v = v[(v > now[0] - multiple * now[2]) & (v < now[0] + multiple * now[2])]
        old = now
    else:
        if param < 1:
            return (np.nan,) * 4
    return (float(len(v)), *(old or (np.nan,) * 3))


def report(df: DataFrame, value: str) -> DataFrame:
    """number, minimum, maximum, sum, mean, std, median, mode, modequant, modesym, modesymvalue of a column, in one row."""
    d = df.select(F.lit(1).alias("_all"), F.col(value).cast("double").alias(value)).dropna()
    rows = cut(ranked(d, ["_all"], value), "ranked")
    return summary(d, ["_all"], value, rows).join(mode(d, ["_all"], value, rows=rows), "_all", "left").drop("_all")


# the mode

GOLDEN = 1.618034
SECTION = 0.38197
LEAST_SYMMETRY = 0.2


def _nearest(a: np.ndarray, m: int, i: np.ndarray) -> np.ndarray:
    """For the values mirrored about a[m] from i below, how far above m the nearest element lies."""
    mirrored = 2 * a[m] - a[m - i]
    j = np.searchsorted(a, mirrored, side="right") - m
    inside = j < len(a) - m
    up = np.where(inside, a[np.minimum(m + j, len(a) - 1)], np.inf)
    return np.where(inside & ~(up - mirrored < mirrored - a[m + j - 1]), j - 1, j)


def _bracket(n: int) -> Generator[int, float, int]:
    """Yields the ranks to be probed, is sent their departures, and returns the rank about which the mirror departs least.

    A golden section between the quantiles 0.01 and 0.55, over probes at ranks; it ends when the bracket is narrower than
    a hundredth of its middle.
    """
    low, high = rank_of_quantile(n, 0.01), rank_of_quantile(n, 0.55)
    best = int((high + GOLDEN * low) / (1 + GOLDEN))
    least = yield best
    while high - low > 3:
        wider = high - best > best - low
        probe = int(best + SECTION * (high - best)) if wider else int(best - SECTION * (best - low))
        if high - low < 0.01 * (best + probe):
            break
        found = yield probe
        if found == np.inf:  # the mirror reaches beyond the distribution: look lower
            high, better = max(best, probe), probe < best
        else:
            better = found < least
            if better == wider:
                low = min(best, probe)
            else:
                high = max(best, probe)
        if better:
            best, least = probe, found
    return (low + high) // 2


def _probes(n: int, m: int) -> np.ndarray:
    """How far below rank m the mirror is looked at: about a thousand places of a large distribution."""
    half = n // 2
    return np.arange(1, min(half, m + 1, n - m), half // 1000 if half > 1000 else 1)


def _departure(i: np.ndarray, j: np.ndarray, m: int, mirror: float) -> float:
    """The greatest difference of a rank and its mirror's; infinite if a mirror lies too far within."""
    if not len(i):
        return 0
    return np.inf if (i > j + int(mirror * m**0.5)).any() else int(np.abs(i - j).max())


def _symmetry(n: int, m: int, middle: float, start: float, end: float) -> tuple[float, float, float, float]:
    symmetry = 0.0 if end == start else (end - middle) / (middle - start)
    return (float(middle), m / (n - 1), float(symmetry), float(end)) if symmetry > LEAST_SYMMETRY else (np.nan,) * 4


def mode_of_sorted(a: np.ndarray, mirror: float = 1.5) -> tuple[float, float, float, float]:
    """(mode, its quantile, symmetricity, value where symmetry ends) of sorted values.

    The mode is the rank at which the distribution mirrored about it departs least from the actual one.  Too
    little symmetry gives blanks.
    """
    n = len(a)
    if not n:
        return (np.nan,) * 4
    search = _bracket(n)
    try:
        m = next(search)
        while True:
            i = _probes(n, m)
            m = search.send(_departure(i, _nearest(a, m, i), m, mirror))
    except StopIteration as done:
        m = done.value
    top = min(2 * m, n - 1)
    start = a[rank_of_quantile(2 * m + 1, 0.01)]
    if a[m] <= start:
        return (np.nan,) * 4
    i = np.arange(1, max(top - m, 1))
    apart = np.flatnonzero(np.abs(i - _nearest(a, m, i)) > int(mirror * m**0.5)) if len(i) else []
    return _symmetry(n, m, a[m], start, a[m + i[apart[0]]] if len(apart) else a[top])


#: A larger group is searched by probes on its ranked values, the same search with the same result.
MODE_VALUES = 1 << 20


#: Ranks of a block of ``_packed``.
PACKED = 1 << 16


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, v, n, upto of ``ranked``) by blocks of ranks: keys, vs, uptos (sorted arrays as bytes) and first, the ranks before.

    What is looked up again and again needs a few places of a block then, not a pass over its rows.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("upto")
        head = g[keys].iloc[:1].reset_index(drop=True)
        return head.assign(first=int(g["upto"].iloc[0] - g["n"].iloc[0]), vs=g["v"].to_numpy("f8").tobytes(), uptos=g["upto"].to_numpy("i8").tobytes())

    blocks = rows.withColumn("_block", F.floor((F.col("upto") - 1) / PACKED))
    return cut(blocks.groupBy(*keys, "_block").applyInPandas(run, f"{kinds}, first long, vs binary, uptos binary"), "packed")


def _asked(packed: DataFrame, keys: list[str], wanted: dict[tuple, np.ndarray], by_rank: bool) -> dict[tuple, dict[int, tuple]]:
    """For each group and place in its sorted ``wanted``: the value at that rank; or of a value, how many lie at or below it, the last
    of these and the first above.

    One pass over the blocks; what is wanted has about a thousand places for each group.
    """
    kinds = ", ".join(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        for d in frames:
            out = []
            for r in d.to_dict("records"):
                key = tuple(None if x != x else x for x in (r[k] for k in keys))
                w = wanted.get(key)
                if w is None:
                    continue
                v, upto = np.frombuffer(r["vs"], "f8"), np.frombuffer(r["uptos"], "i8")
                if by_rank:
                    place = np.arange(*np.searchsorted(w, [r["first"], upto[-1]], "left"))
                    part = pd.DataFrame({"place": place, "most": v[np.searchsorted(upto, w[place], "right")], "upto": 0, "least": 0.0})
                else:  # a value counts for the first wanted one at or above it, and so for all behind
                    ends = np.append(np.searchsorted(v, w, "right"), len(v))
                    starts = np.append(0, ends[:-1])
                    place = np.flatnonzero(ends > starts)
                    part = pd.DataFrame({"place": place, "most": v[ends[place] - 1], "upto": upto[ends[place] - 1], "least": v[starts[place]]})
                if len(part):
                    out.append(part.assign(**dict(zip(keys, key))))
            if out:
                yield pd.concat(out)[[*keys, "place", "most", "upto", "least"]]

    got = packed.mapInPandas(run, f"{kinds}, place long, most double, upto long, least double").groupBy(*keys, "place").agg(F.max("most").alias("most"), F.max("upto").alias("upto"), F.min("least").alias("least"))
    out: dict[tuple, dict[int, tuple]] = {}
    for r in got.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r["place"]] = (r["most"], r["upto"], r["least"])
    return out


def _values_at(packed: DataFrame, keys: list[str], ranks: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
    """The values at ranks (from 0, in any order) of each group."""
    unique = {k: np.unique(r) for k, r in ranks.items()}
    got = _asked(packed, keys, unique, True)
    return {k: np.array([got[k][p][0] for p in range(len(unique[k]))])[np.searchsorted(unique[k], r)] for k, r in ranks.items()}


def _ranks_near(packed: DataFrame, keys: list[str], mirrored: dict[tuple, np.ndarray], middles: dict[tuple, int], sizes: dict[tuple, int]) -> dict[tuple, np.ndarray]:
    """How far above each group's middle rank the element nearest to each mirrored value lies."""
    unique = {k: np.unique(v) for k, v in mirrored.items()}
    got, out = _asked(packed, keys, unique, False), {}
    for k, v in mirrored.items():
        size, mine = len(unique[k]), got.get(k, {})
        most, upto, least = (np.array([mine.get(p, (-np.inf, 0, np.inf))[c] for p in range(size + 1)], float) for c in range(3))
        below, count = np.maximum.accumulate(most)[:size], np.maximum.accumulate(upto)[:size]
        above = np.minimum.accumulate(least[::-1])[::-1][1:]
        at = np.searchsorted(unique[k], v)
        j = count[at] - middles[k]
        inside = j < sizes[k] - middles[k]
        out[k] = np.where(inside & ~(above[at] - v < v - below[at]), j - 1, j)
    return out


def _first_apart(rows: DataFrame, keys: list[str], state: dict[tuple, tuple[int, int, float]], mirror: float) -> dict[tuple, int]:
    """The first step i from each group's middle rank at which the mirror is further from its rank than is allowed, if any.

    state: rank, number and value of the middle.  The values below it, mirrored, are laid among those above; how many of
    these lie at or below each comes from sums over ranges, and a run of equal values is decided as a whole.
    """
    spark = rows.sparkSession
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    known = F.broadcast(spark.createDataFrame([(*k, m, n, v) for k, (m, n, v) in state.items()], f"{kinds}, _m long, _size long, _mid double"))  # large groups only
    named = known.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`"))
    d = rows.join(named, on).drop(*[f"_{k}" for k in keys])
    reach = F.least(2 * F.col("_m"), F.col("_size") - 1) - F.col("_m") - 1  # steps looked at
    lower = d.where((F.col("upto") - F.col("n") < F.col("_m")) & (F.col("upto") > F.col("_m") - reach) & (reach > 0)).select(
        *keys, (2 * F.col("_mid") - F.col("v")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("upto"), F.lit(None).cast("double").alias("own"),
        F.greatest(F.lit(1), F.col("_m") - F.col("upto") + 1).alias("from"), F.least(reach, F.col("_m") - F.col("upto") + F.col("n")).alias("to"), "_m", "_size",
    )
    upper = d.where(F.col("upto") > F.col("_m")).select(*keys, F.col("v").alias("at"), F.lit(0).alias("kind"), "upto", F.col("v").alias("own"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"), "_m", "_size")
    dealt = cut(upper.unionByName(lower).repartitionByRange(*keys, "at", "kind").withColumn("_part", F.spark_partition_id()), "mirrors")
    ends = dealt.groupBy(*keys, "_part").agg(F.max("upto").alias("_u"), F.max("own").alias("_last"), F.min("own").alias("_next"))
    order = W.partitionBy(*keys).orderBy("_part")
    before, behind = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    ends = ends.select(*[F.col(f"`{k}`").alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), F.max("_u").over(before).alias("_bu"), F.max("_last").over(before).alias("_bl"), F.min("_next").over(behind).alias("_bn"))
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`"))
    own = W.partitionBy(*keys, "_part")
    back = own.orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    ahead = own.orderBy(F.desc("at"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)  # a frame to the end would be worked out anew for each row
    laid = dealt.withColumns({"_u": F.max("upto").over(back), "_l": F.max("own").over(back), "_n": F.min("own").over(ahead)}).where("kind = 1").join(ends, on)
    count, low, up = F.coalesce("_u", "_bu", F.col("_m") + 0), F.coalesce("_l", "_bl"), F.coalesce("_n", "_bn")
    j = count - F.col("_m")
    near = F.when((j < F.col("_size") - F.col("_m")) & ~F.coalesce(up - F.col("at") < F.col("at") - low, F.lit(False)), j - 1).otherwise(j)
    allowed = F.floor(F.lit(mirror) * F.sqrt(F.col("_m").cast("double")))
    first = F.when(F.abs(F.col("from") - near) > allowed, F.col("from")).when(F.col("to") > near + allowed, F.greatest(F.col("from"), near + allowed + 1))
    return {tuple(r[k] for k in keys): r["i"] for r in laid.groupBy(*keys).agg(F.min(first).alias("i")).where("i IS NOT NULL").collect()}


def _modes_of_large(rows: DataFrame, keys: list[str], sizes: dict[tuple, int], mirror: float) -> list[tuple]:
    """(keys, mode, modequant, modesym, modesymvalue) of large groups, whose searches go on side by side."""
    packed = _packed(rows, keys)
    searches = {k: _bracket(n) for k, n in sizes.items()}
    asked, middles = {k: next(s) for k, s in searches.items()}, {}
    while asked:
        steps = {k: _probes(sizes[k], m) for k, m in asked.items()}
        values = _values_at(packed, keys, {k: np.append(m, m - steps[k]) for k, m in asked.items()})
        near = _ranks_near(packed, keys, {k: 2 * v[0] - v[1:] for k, v in values.items()}, asked, sizes)
        following = {}
        for k, m in asked.items():
            try:
                following[k] = searches[k].send(_departure(steps[k], near[k], m, mirror))
            except StopIteration as done:
                middles[k] = done.value
        asked = following
    places = _values_at(packed, keys, {k: np.array([m, rank_of_quantile(2 * m + 1, 0.01), min(2 * m, sizes[k] - 1)]) for k, m in middles.items()})
    rising = {k: v for k, v in places.items() if v[0] > v[1]}
    apart = _first_apart(rows, keys, {k: (middles[k], sizes[k], float(v[0])) for k, v in rising.items()}, mirror) if rising else {}
    ends = _values_at(packed, keys, {k: np.array([middles[k] + i]) for k, i in apart.items()}) if apart else {}
    return [(*k, *(_symmetry(sizes[k], middles[k], v[0], v[1], float(ends[k][0]) if k in ends else v[2]) if k in rising else (np.nan,) * 4)) for k, v in places.items()]


def mode(df: DataFrame, keys: list[str], value: str, mirror: float = 1.5, most: int = MODE_VALUES, rows: DataFrame | None = None) -> DataFrame:
    """keys, mode, modequant, modesym, modesymvalue of each group.

    Groups of up to ``most`` values are searched in one task each.  The search of a larger one looks at about a thousand
    ranks at a time, each time in two passes over blocks of its ranked values; its bracket, of which there is one for
    ``most`` values at least, is held by the driver.
    """
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", mode double, modequant double, modesym double, modesymvalue double"
    rows = cut(ranked(df, keys, value), "ranked") if rows is None else rows
    rows = rows.select(*keys, F.col(value).cast("double").alias("v"), "n", "upto", "total")
    large = {tuple(r[k] for k in keys): r["total"] for r in rows.where(F.col("total") > most).select(*keys, "total").distinct().collect()}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v")
        got = mode_of_sorted(np.repeat(group["v"].to_numpy(), group["n"].to_numpy()), mirror)
        head = group[keys].iloc[:1].reset_index(drop=True)
        return head.assign(**dict(zip(("mode", "modequant", "modesym", "modesymvalue"), got)))

    out = rows.where(F.col("total") <= most).groupBy(*keys).applyInPandas(run, schema)
    if not large:
        return out
    found = _modes_of_large(rows.where(F.col("total") > most), list(keys), large, mirror)
    blank = lambda x: None if isinstance(x, float) and x != x else x
    return out.unionByName(df.sparkSession.createDataFrame([tuple(map(blank, r)) for r in found], schema))


# histograms


def bin_edges(low: float, high: float, n: int, start: float | None = None) -> tuple[float, float]:
    """First edge and width of ``n`` bins; ``start`` shifts all so that an edge falls on it."""
    width = (high - low) / n
    if start is not None:
        shift = (start - low) % width
        low += shift if shift == 0 else shift - width
    return low, width


def bin_of(c: Column, low: float, width: float, n: int, high: float | None = None) -> Column:
    """The bin, from 0, of values in the range; the last one includes the greatest value ``high``."""
    k = F.floor((c - low) / width)
    return F.when((c >= low) & (c <= (low + n * width if high is None else high)), F.least(k, F.lit(n - 1)))


def value_range(df: DataFrame, value: str) -> tuple[float, float]:
    r = df.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b")).head()
    return r["a"], r["b"]


def histogram(df: DataFrame, value: str, n: int = 100, low: float | None = None, high: float | None = None, start: float | None = None, normalize: bool = False, maxbinone: bool = False) -> DataFrame:
    """bin, center, number: every bin, empty ones too."""
    if low is None or high is None:
        a, b = value_range(df, value)
        low, high = a if low is None else low, b if high is None else high
    low, width = bin_edges(low, high, n, start)
    top = high if start is None else None
    counts = df.select(bin_of(F.col(value).cast("double"), low, width, n, top).alias("bin")).dropna().groupBy("bin").count()
    out = df.sparkSession.range(n).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left")  # at most n rows
    out = out.select("bin", (F.lit(low) + F.col("bin") * width + width / 2).alias("center"), F.coalesce("count", F.lit(0)).cast("long").alias("number"))
    whole = W.partitionBy()
    if normalize:
        return out.withColumn("number", F.col("number") / F.sum("number").over(whole))
    return out.withColumn("number", F.col("number") / F.max("number").over(whole)) if maxbinone else out


def cumulative(hist: DataFrame, normalize: bool = False) -> DataFrame:
    """bin, center, number: the running sum of a histogram."""
    run = F.sum("number").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("number").over(W.partitionBy())
    return hist.select("bin", "center", (run / total if normalize else run).alias("number"))


def histogram_2d(df: DataFrame, x: str, y: str, nx: int = 100, ny: int = 20) -> DataFrame:
    """bin_dim1, bin_dim2 (centres), hist_number over the full grid."""
    (ax, bx), (ay, by) = value_range(df, x), value_range(df, y)
    wx, wy = (bx - ax) / nx, (by - ay) / ny
    counts = df.select(bin_of(F.col(x).cast("double"), ax, wx, nx, bx).alias("i"), bin_of(F.col(y).cast("double"), ay, wy, ny, by).alias("j")).dropna().groupBy("i", "j").count()
    grid = df.sparkSession.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    center = lambda k, a, w: F.lit(a) + F.col(k) * w + w / 2
    return grid.join(counts, ["i", "j"], "left").select(center("i", ax, wx).alias("bin_dim1"), center("j", ay, wy).alias("bin_dim2"), F.coalesce("count", F.lit(0)).cast("long").alias("hist_number"))


def mirrored(df: DataFrame, value: str, about: float) -> DataFrame:
    """The values up to ``about`` and their reflection."""
    below = df.where(F.col(value) <= about).select(F.col(value).cast("double").alias(value))
    return below.unionByName(below.where(F.col(value) < about).select((2 * about - F.col(value)).alias(value)))


def ascii_plot(hist: list[tuple[float, float]], height: int = 10) -> str:
    """A text plot of a collected histogram, one column a bin."""
    most = max((v for _, v in hist), default=0) or 1
    rows = ["".join("*" if v > 0 and v * height / most >= level - 0.5 else " " for _, v in hist) for level in range(height, 0, -1)]
    return "\n".join(f" |{r}" for r in rows) + "\n |" + "-" * len(hist)


# outliers


def distance_hits(v: np.ndarray, window: int, sigma: float, clip: tuple[float, float]) -> np.ndarray:
    """For sorted values, where the gap after a value lies more than ``sigma`` clipped deviations above the
    clipped median of the ``window`` - 1 gaps before it; False where there aren't as many."""
    gaps = np.diff(v)
    hits = np.zeros(len(v), bool)
    for k in range(window - 1, len(gaps)):
        _, med, _, std = sigma_clip_array(gaps[k - window + 1 : k], *clip)
        hits[k] = gaps[k] - med > sigma * std
    return hits


def flat_hits(v: np.ndarray, previous: int, threshold: float, contiguous: int, clip: tuple[float, float]) -> np.ndarray:
    """For sorted values, where a run of ``contiguous`` slopes (two values ahead less two behind) begins that
    each lie more than ``threshold`` clipped deviations above the clipped median of the ``previous`` slopes."""
    slopes = v[4:] - v[:-4] if len(v) > 4 else np.empty(0)
    steep = np.zeros(len(v), bool)
    for k in range(previous, len(slopes)):
        _, med, _, std = sigma_clip_array(slopes[k - previous : k], *clip)
        steep[k + 2] = std > 1e-6 and (slopes[k] - med) / std > threshold
    run = steep.copy()
    for k in range(1, contiguous):
        run[:-k] &= steep[k:]
        run[-k:] = False
    return run


#: Ranks that one task looks through, besides what it sees of its neighbours'.
BLOCK = 1 << 15


def first_hit(df: DataFrame, keys: Sequence[str], value: str, find: Callable[[np.ndarray], np.ndarray], before: int, after: int, block: int = BLOCK) -> DataFrame:
    """keys, outlier: the first of each group's sorted values that ``find`` marks; NULL if it marks none.

    Ranks are dealt into blocks, each with the ``before`` and ``after`` ranks around it, so groups of any size
    are looked through in parallel.
    """
    keys = list(keys)
    rows = ranked(df, keys, value).select(*keys, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("rank"))
    own = F.floor(F.col("rank") / block)
    span = F.sequence(F.floor(F.greatest(F.col("rank") - after, F.lit(0)) / block), F.floor((F.col("rank") + before) / block))
    rows = rows.select(*keys, "v", "rank", own.alias("own"), F.explode(span).alias("block"))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", rank long, v double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        at = np.flatnonzero(find(group["v"].to_numpy()) & (group["own"] == group["block"]).to_numpy())[:1]
        return group.iloc[at][[*keys, "rank", "v"]]

    hits = rows.groupBy(*keys, "block").applyInPandas(run, schema)
    first = hits.groupBy(*keys).agg(F.min_by("v", "rank").alias("outlier"))
    return df.select(*keys).distinct().join(first, keys, "left")


def outlier_by_distance(df: DataFrame, keys: Sequence[str], value: str, window: int, sigma: float, clip: tuple[float, float] = (3.0, 0.2)) -> DataFrame:
    """keys, outlier: the last sorted value before the first gap that is too wide; windows of up to two have none."""
    find = (lambda v: distance_hits(v, window, sigma, clip)) if window > 2 else (lambda v: np.zeros(len(v), bool))
    return first_hit(df, keys, value, find, window, 1)


def flat_outlier(df: DataFrame, keys: Sequence[str], value: str, previous: int, threshold: float, contiguous: int, clip: tuple[float, float] = (3.0, 0.2)) -> DataFrame:
    """keys, outlier: where the sorted values stop being flat."""
    return first_hit(df, keys, value, lambda v: flat_hits(v, previous, threshold, contiguous, clip), previous + 4, contiguous + 2)


def is_sorted(df: DataFrame, value: str, order: str) -> DataFrame:
    """(increasing, decreasing): whether the non-blank values rise, or fall, along ``order``; equal neighbours do both.

    Rows are dealt out by range of ``order``: each range looks at its own neighbours, and the ranges' ends at
    one another, of which there are as many as partitions.
    """
    d = cut(df.select(F.col(order).alias("o"), F.col(value).alias("v")).dropna().repartitionByRange("o").withColumn("_part", F.spark_partition_id()), "ranges")
    step = F.col("v") - F.lag("v").over(W.partitionBy("_part").orderBy("o"))
    each = d.withColumn("step", step).groupBy("_part").agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.min_by("v", "o").alias("first"), F.max_by("v", "o").alias("last"))
    over = F.col("first") - F.lag("last").over(W.orderBy("_part"))
    each = each.withColumn("over", over)
    up = F.coalesce(F.least(F.min("lo"), F.min("over")) >= 0, F.lit(True))
    return each.agg(up.alias("increasing"), F.coalesce(F.greatest(F.max("hi"), F.max("over")) <= 0, F.lit(True)).alias("decreasing"))


def unique(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct non-blank values with the place of their first occurrence."""
    return df.select(value, order).dropna(subset=[value]).groupBy(value).agg(F.min(order).alias("first"))
