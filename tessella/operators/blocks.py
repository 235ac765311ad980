"""Images as blocks: one row for each block of cells, its layers packed as arrays.

Steps that look at a cell's surroundings get a block with a rim of its neighbours' cells: each block sends its
edges to the blocks around it, so a step shuffles the image once, whatever its reach, and several steps whose
reaches add up to the rim share one.  Steps without a rim are maps.  What spans blocks (components, labels' values)
goes through small tables of the labels at the rims.

Arrays are indexed [y, x].  Cells that the table doesn't have are blank; ``in`` tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard
from ..plans.skew import spread_join
from . import grid

#: Cells along each side of a block, about.
SIDE = 256
KINDS = {"f8": np.nan, "i8": 0, "u1": 0}  # what stands outside the image

Arrays = dict[str, np.ndarray]


@dataclass(frozen=True)
class Place:
    """Where an array lies: its first cell's coordinates, counted from 0 in the image, and the image's size."""

    x: int
    y: int
    nx: int
    ny: int
    rim: int

    def index(self, shape: tuple[int, int]) -> np.ndarray:
        """The number of each cell in raster order, from 0."""
        return (self.y + np.arange(shape[0]))[:, None] * self.nx + (self.x + np.arange(shape[1]))[None, :]

    def outside(self, shape: tuple[int, int]) -> np.ndarray:
        y, x = self.y + np.arange(shape[0]), self.x + np.arange(shape[1])
        return ((y < 0) | (y >= self.ny))[:, None] | ((x < 0) | (x >= self.nx))[None, :]

    def core(self, a: np.ndarray) -> np.ndarray:
        r = self.rim
        return a[r : a.shape[0] - r, r : a.shape[1] - r]


@dataclass(frozen=True)
class Layout:
    """How an image is cut into blocks of sx x sy cells, and the kinds of their layers."""

    x0: int
    y0: int
    nx: int
    ny: int
    sx: int
    sy: int
    layers: dict[str, str]

    @property
    def schema(self) -> str:
        return "bx int, by int, " + ", ".join(f"`{n}` binary" for n in self.layers)

    def shape(self, bx: int, by: int) -> tuple[int, int]:
        return min(self.sy, self.ny - by * self.sy), min(self.sx, self.nx - bx * self.sx)

    def place(self, bx: int, by: int, rim: int = 0) -> Place:
        return Place(bx * self.sx - rim, by * self.sy - rim, self.nx, self.ny, rim)

    def read(self, row, names: Sequence[str]) -> Arrays:
        shape = self.shape(row["bx"], row["by"])
        return {n: np.frombuffer(row[n], self.layers[n]).reshape(shape) for n in names}

    def pieces(self, row: dict, rim: int, wide: Sequence[str]) -> Iterator[dict]:
        """The block for itself, and its edges for the blocks around it, where dx, dy tell where they come from."""
        across, down = -(-self.nx // self.sx), -(-self.ny // self.sy)
        arrays = self.read(row, wide)
        yield {**row, "dx": 0, "dy": 0}
        for dx, dy in grid.offsets(2):
            bx, by = row["bx"] + dx, row["by"] + dy
            if 0 <= bx < across and 0 <= by < down:
                at = tuple(slice(None) if d == 0 else slice(-rim, None) if d > 0 else slice(None, rim) for d in (dy, dx))
                yield {**dict.fromkeys(self.layers), **{n: a[at].tobytes() for n, a in arrays.items()}, "bx": bx, "by": by, "dx": -dx, "dy": -dy}

    def gathered(self, pieces: list[dict], rim: int, wide: Sequence[str]) -> tuple[Arrays, Place, dict]:
        """A block's arrays, those of ``wide`` with a rim, from its pieces."""
        row = next(r for r in pieces if r["dx"] == r["dy"] == 0)
        h, w = self.shape(row["bx"], row["by"])
        arrays = self.read(row, [n for n in self.layers if n not in wide])
        for n in wide:
            arrays[n] = np.full((h + 2 * rim, w + 2 * rim), KINDS[self.layers[n]], self.layers[n])
        for r in pieces:
            bh, bw = self.shape(r["bx"] + r["dx"], r["by"] + r["dy"])
            ph, pw = (min(rim, bh) if r["dy"] else bh), (min(rim, bw) if r["dx"] else bw)
            y = {-1: rim - ph, 0: rim, 1: rim + h}[r["dy"]]
            x = {-1: rim - pw, 0: rim, 1: rim + w}[r["dx"]]
            for n in wide:
                arrays[n][y : y + ph, x : x + pw] = np.frombuffer(r[n], self.layers[n]).reshape(ph, pw)
        return arrays, self.place(row["bx"], row["by"], rim), row

    def packed(self, made: Arrays, p: Place, row: dict, kept: Sequence[str]) -> pd.DataFrame:
        """The row of a block whose layers are ``made``, but for those ``kept``."""
        shape = self.shape(row["bx"], row["by"])
        new = {n: np.ascontiguousarray(made[n] if made[n].shape == shape else p.core(made[n]), k).tobytes() for n, k in self.layers.items() if n not in kept}
        return pd.DataFrame([{"bx": row["bx"], "by": row["by"], **{n: row[n] for n in kept}, **new}], columns=["bx", "by", *self.layers])


@dataclass(frozen=True)
class Blocks:
    df: DataFrame  # bx, by and a binary column for each layer
    layout: Layout

    # maps

    def _run(self, each: Callable[[Arrays, Place, dict], pd.DataFrame], schema: str, rim: int, wide: Sequence[str]) -> DataFrame:
        lay = self.layout
        if not rim:

            def plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in frames:
                    for row in pdf.to_dict("records"):
                        yield each(lay.read(row, list(lay.layers)), lay.place(row["bx"], row["by"]), row)

            return self.df.mapInPandas(plain, schema)
        if rim > min(lay.sx, lay.sy):
            raise ValueError("a rim can't be wider than a block")

        def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for row in pdf.to_dict("records"):
                    yield pd.DataFrame(list(lay.pieces(row, rim, wide)), columns=["bx", "by", "dx", "dy", *lay.layers])

        def grouped(pieces: pd.DataFrame) -> pd.DataFrame:
            return each(*lay.gathered(pieces.to_dict("records"), rim, wide))

        around = self.df.mapInPandas(sent, "bx int, by int, dx int, dy int, " + ", ".join(f"`{n}` binary" for n in lay.layers))
        return around.groupBy("bx", "by").applyInPandas(grouped, schema)  # nine pieces at most

    def rows(self, each: Callable[[Arrays, Place], pd.DataFrame], schema: str, rim: int = 0, wide: Sequence[str] = ()) -> DataFrame:
        """A table that ``each`` makes of every block's arrays; those of ``wide`` have a rim."""
        return self._run(lambda a, p, row: each(a, p), schema, rim, wide)

    def mapped(self, each: Callable[[Arrays, Place], Arrays], layers: dict[str, str], rim: int = 0, wide: Sequence[str] = (), drop: Sequence[str] = (), tag: str = "blocks") -> Blocks:
        """The image with the layers that ``each`` makes of every block, written; the rest as they were, but for ``drop``."""
        kept = {n: k for n, k in self.layout.layers.items() if n not in drop and n not in layers}
        new = replace(self.layout, layers={**kept, **layers})
        made = self._run(lambda a, p, row: new.packed(each(a, p), p, row, list(kept)), new.schema, rim, wide)
        return Blocks(cut(made, tag), new)

    def told(self, table: DataFrame, each: Callable[[Arrays, Place, pd.DataFrame], Arrays], layers: dict[str, str], tag: str = "blocks") -> Blocks:
        """Like ``mapped`` without a rim, where ``each`` also gets the block's rows of ``table`` (bx, by and more)."""
        lay = self.layout
        kept = {n: k for n, k in lay.layers.items() if n not in layers}
        new = replace(lay, layers={**kept, **layers})

        def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame(columns=["bx", "by", *new.layers])
            row, p = own.to_dict("records")[0], lay.place(int(own["bx"].iloc[0]), int(own["by"].iloc[0]))
            return new.packed(each(lay.read(row, list(lay.layers)), p, told), p, row, list(kept))

        return Blocks(cut(self.df.groupBy("bx", "by").cogroup(table.groupBy("bx", "by")).applyInPandas(run, new.schema), tag), new)

    def asked(self, table: DataFrame, each: Callable[[Arrays, Place, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """What ``each`` makes of every block's arrays and its rows of ``table`` (bx, by and more)."""
        lay = self.layout
        names = [c.split()[0] for c in schema.split(", ")]

        def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(told):
                return pd.DataFrame(columns=names)
            row = own.to_dict("records")[0]
            return each(lay.read(row, list(lay.layers)), lay.place(row["bx"], row["by"]), told)

        return self.df.groupBy("bx", "by").cogroup(table.groupBy("bx", "by")).applyInPandas(run, schema)

    def cells(self, **columns: tuple[str, str]) -> DataFrame:
        """x, y and the named layers (name = (layer, type)) of the cells that the table had."""

        lay = self.layout

        def each(a: Arrays, p: Place) -> pd.DataFrame:
            y, x = np.nonzero(a["in"])
            out = pd.DataFrame({"x": x + p.x + lay.x0, "y": y + p.y + lay.y0})
            for name, (layer, _) in columns.items():
                out[name] = a[layer][y, x]
            return out

        return self.rows(each, "x int, y int, " + ", ".join(f"{n} {kind}" for n, (_, kind) in columns.items()))

    # labels

    def owner(self, label: str) -> list:
        """bx, by of the block in which the cell of a label (its number from 1) lies."""
        at, lay = F.col(label) - 1, self.layout
        return [F.floor(at % lay.nx / lay.sx).cast("int").alias("bx"), F.floor(F.floor(at / lay.nx) / lay.sy).cast("int").alias("by")]

    def labelled(self, mask: Callable[[Arrays], np.ndarray], connectivity: int, name: str = "label") -> Blocks:
        """With the layer ``name``: each component of the mask has the number of its first cell in raster order, from 1; 0 elsewhere."""

        def local(a: Arrays, p: Place) -> Arrays:
            on = mask(a)
            root = grid._block_roots(on, connectivity)
            number = np.append(p.index(on.shape).ravel() + 1, 0)
            return {name: number[root]}

        own = self.mapped(local, {name: "i8"}, tag="labels")
        links = cut(own.touching(name, connectivity), "links")
        if links.isEmpty():
            return own
        roots = grid.least_linked(links.withColumnsRenamed({"a": "cell", "b": "from"})).where("cell <> root")
        table = roots.select(*own.owner("cell"), F.col("cell").alias("old"), F.col("root").alias("new"))
        out = own.told(table, lambda a, p, t: {name: replaced(a[name], t["old"].to_numpy(), t["new"].to_numpy())}, {name: "i8"}, "labels")
        discard(links, own.df)
        return out

    def touching(self, name: str, connectivity: int) -> DataFrame:
        """(a, b): labels of a block's cells beside other labels of the blocks around it, in either order."""
        steps = grid.offsets(2, connectivity)

        def pairs(a: Arrays, p: Place) -> pd.DataFrame:
            wide = a[name]
            core, h, w = p.core(wide), wide.shape[0], wide.shape[1]
            rim = np.ones(wide.shape, bool)
            rim[1:-1, 1:-1] = False
            found = []
            for dx, dy in steps:
                at = (slice(1 + dy, h - 1 + dy), slice(1 + dx, w - 1 + dx))
                hit = rim[at] & (core > 0) & (wide[at] > 0)
                found.append(np.stack([core[hit], wide[at][hit]], axis=1))
            both = np.unique(np.concatenate(found), axis=0)
            return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

        return self.rows(pairs, "a long, b long", 1, [name]).distinct()

    def painted(self, label: str, table: DataFrame, out: str, kind: str = "f8", default: float = 0, tag: str = "painted") -> Blocks:
        """With the layer ``out``: the value that ``table`` (label, value) has for each cell's label, else the default."""
        sx, sy = self.layout.sx, self.layout.sy
        present = self.rows(lambda a, p: pd.DataFrame({"label": (u := np.unique(a[label]))[u > 0]}).assign(bx=p.x // sx, by=p.y // sy), "label long, bx int, by int")
        told = spread_join(cut(present, "present"), table.select("label", "value"), "label", "bx")  # one label may lie in most blocks

        def each(a: Arrays, p: Place, t: pd.DataFrame) -> Arrays:
            known = replaced(np.where(np.isin(a[label], t["label"]), a[label], 0), t["label"].to_numpy(), np.arange(1, len(t) + 1))
            return {out: np.append(np.array([default], kind), t["value"].to_numpy().astype(kind))[known]}

        return self.told(told.select("bx", "by", "label", "value"), each, {out: kind}, tag)

    def filled(self, mask: Callable[[Arrays], np.ndarray], connectivity: int, most: int | None, out: str) -> Blocks:
        """With the layer ``out``: the mask with those of its holes set that don't reach the image's edge and have at most ``most`` cells."""
        free = self.labelled(lambda a: ~mask(a), connectivity, "_hole")

        def sizes(a: Arrays, p: Place) -> pd.DataFrame:
            labels, inverse, n = np.unique(a["_hole"], return_inverse=True, return_counts=True)
            y, x = p.y + np.arange(a["_hole"].shape[0]), p.x + np.arange(a["_hole"].shape[1])
            edge = ((y == 0) | (y == p.ny - 1))[:, None] | ((x == 0) | (x == p.nx - 1))[None, :]
            touches = np.bincount(inverse.ravel(), edge.ravel(), len(labels)) > 0
            return pd.DataFrame({"label": labels, "n": n, "open": touches})[labels > 0]

        holes = free.rows(sizes, "label long, n long, open boolean").groupBy("label").agg(F.sum("n").alias("n"), F.max("open").alias("open")).where("NOT open")
        holes = holes if most is None else holes.where(F.col("n") <= most)
        told = free.painted("_hole", holes.select("label", F.lit(1).alias("value")), "_fill", "u1")
        done = told.mapped(lambda a, p: {out: mask(a) | (a["_fill"] > 0)}, {out: "u1"}, drop=["_hole", "_fill"], tag="filled")
        discard(free.df, told.df)
        return done


def replaced(a: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``a`` with the values of ``old`` replaced by those of ``new``."""
    if not len(old):
        return a
    order = np.argsort(old)
    old, new = old[order], new[order]
    at = np.minimum(np.searchsorted(old, a), len(old) - 1)
    return np.where(old[at] == a, new[at], a)


def of_cells(cells: DataFrame, values: Sequence[str] = ("v",), multiples: Sequence[Sequence[int]] = (), kinds: dict[str, str] | None = None, side: int = SIDE) -> Blocks | None:
    """The cells (x, y and ``values``) as blocks, whose sides are multiples of all widths in ``multiples``; None without cells."""
    kinds = {n: (kinds or {}).get(n, "f8") for n in values}
    ends = cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    if ends is None or ends[0] is None:
        return None
    unit = [lcm(*(m[k] for m in multiples)) if multiples else 1 for k in (0, 1)]
    sx, sy = (u * max(1, side // u) for u in unit)
    x0, x1, y0, y1 = map(int, ends)
    layers = {"in": "u1", **kinds}
    lay = Layout(x0, y0, x1 - x0 + 1, y1 - y0 + 1, sx, sy, layers)

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        row = {"bx": int(g["bx"].iloc[0]), "by": int(g["by"].iloc[0])}
        p = lay.place(**row)
        made = {n: np.full(lay.shape(**row), KINDS[k], k) for n, k in layers.items()}
        at = np.flatnonzero(g["x"].notna())
        cell = (g["y"].to_numpy()[at].astype(int) - y0 - p.y, g["x"].to_numpy()[at].astype(int) - x0 - p.x)
        for n in layers:
            made[n][cell] = 1 if n == "in" else g[n].to_numpy()[at]
        return lay.packed(made, p, row, [])

    b = [F.floor((F.col(d) - o) / s).cast("int").alias(n) for d, o, s, n in (("x", x0, sx, "bx"), ("y", y0, sy, "by"))]
    typed = [F.col(n).cast("double" if kinds[n] == "f8" else "long").alias(n) for n in values]
    # a row without a cell for each block, as some may have none
    every = cells.sparkSession.range(-(-lay.ny // sy)).select(F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"), *[F.lit(None).cast("double" if kinds[n] == "f8" else "long").alias(n) for n in values], F.explode(F.sequence(F.lit(0), F.lit(-(-lay.nx // sx) - 1))).alias("bx"), F.col("id").cast("int").alias("by"))
    rows = cells.select(F.col("x").cast("int"), F.col("y").cast("int"), *typed, *b).unionByName(every)
    return Blocks(cut(rows.groupBy("bx", "by").applyInPandas(pack, lay.schema), "blocks"), lay)  # a block's size is fixed


# arrays


def shifted(a: np.ndarray, dx: int, dy: int, fill) -> np.ndarray:
    """What each cell sees at (dx, dy)."""
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def eroded(on: np.ndarray, connectivity: int, outside: np.ndarray | None = None, firm: np.ndarray | None = None) -> np.ndarray:
    """Set cells that touch an unset one become unset, but for those that are ``firm``; what is outside touches nothing."""
    held = on if outside is None else on | outside
    touched = np.zeros(on.shape, bool)
    for dx, dy in grid.offsets(2, connectivity):
        touched |= ~shifted(held, dx, dy, True)
    return on & (~touched if firm is None else ~touched | firm)


def dilated(on: np.ndarray, connectivity: int, outside: np.ndarray | None = None) -> np.ndarray:
    out = on.copy()
    for dx, dy in grid.offsets(2, connectivity):
        out |= shifted(on, dx, dy, False)
    return out if outside is None else out & ~outside


def opened(on: np.ndarray, depth: int, connectivity: int, outside: np.ndarray | None = None) -> np.ndarray:
    for _ in range(depth):
        on = eroded(on, connectivity, outside)
    for _ in range(depth):
        on = dilated(on, connectivity, outside)
    return on


def without_holes(on: np.ndarray, connectivity: int) -> np.ndarray:
    """Holes that don't reach the array's edge become set."""
    root = grid._block_roots(~on, connectivity)
    edge = np.concatenate([root[0], root[-1], root[:, 0], root[:, -1]])
    return on | ((root < on.size) & ~np.isin(root, edge))


def weighted(v: np.ndarray, kernel: dict[tuple[int, int], float]) -> np.ndarray:
    """The kernel-weighted mean around each cell; blanks are left out of the weights."""
    known = ~np.isnan(v)
    total, weight = np.zeros(v.shape), np.zeros(v.shape)
    zero = np.where(known, v, 0.0)
    for (dx, dy), w in kernel.items():
        total += w * shifted(zero, -dx, -dy, 0.0)
        weight += w * shifted(known.astype(float), -dx, -dy, 0.0)
    return np.divide(total, weight, out=np.full(v.shape, np.nan), where=weight != 0)


def reach(kernel: dict[tuple[int, int], float] | None) -> int:
    return max((max(map(abs, s)) for s in kernel), default=0) if kernel else 0


def tiles_of(shape: tuple[int, int], widths: Sequence[int]) -> Iterator[tuple[int, int, tuple[slice, slice]]]:
    """(i, j, cells) of the tiles of a block, along x and y; the last of each row and column may be smaller."""
    for j in range(-(-shape[0] // widths[1])):
        for i in range(-(-shape[1] // widths[0])):
            yield i, j, (slice(j * widths[1], min(shape[0], (j + 1) * widths[1])), slice(i * widths[0], min(shape[1], (i + 1) * widths[0])))
