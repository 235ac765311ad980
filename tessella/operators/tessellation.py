"""Tessellations of two layers: channels of one size, and tiles within each channel.

Tiles are numbered channel after channel; ``place`` is a tile's position among all tiles of the image in raster order,
and the permutation leads from one to the other.  Statistics and convolutions by channel never cross a channel's
edge; what lies near an inner edge can be convolved anew over the whole image.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grid


def along(size: int, width: int, remainder: float) -> tuple[int, int]:
    """The width of the first tile along an axis, and the number of tiles.

    A remainder of up to the given part of a tile goes to the first tile; a larger one is shared with a tile, cut in
    halves, at both ends.
    """
    rest = size % width
    if width >= size:
        return size, 1
    if not rest:
        return width, size // width
    return ((rest + width) // 2, size // width + 1) if rest > remainder * width else (rest + width, size // width)


@dataclass(frozen=True)
class Tessellation:
    """Of an image of ``sizes`` (x, y), from coordinate 1: ``channels`` along each axis, tiles of ``widths``."""

    sizes: Sequence[int]
    widths: Sequence[int]
    channels: Sequence[int] = (1, 1)
    remainder: float = 0.1

    def __post_init__(self):
        for size, channels in zip(self.sizes, self.channels):
            if size % channels or size < channels:
                raise ValueError(f"{channels} channels don't divide {size} cells")

    def axis(self, d: int) -> tuple[int, int, int]:
        """Cells of a channel, width of its first tile and number of its tiles along an axis."""
        size = self.sizes[d] // self.channels[d]
        return size, *along(size, self.widths[d], self.remainder)

    @property
    def tiles(self) -> int:
        return self.axis(0)[2] * self.axis(1)[2] * self.channels[0] * self.channels[1]

    def channel(self) -> Column:
        """The channel of the cell (x, y), from 0."""
        at = [F.floor((F.col(d) - 1) / self.axis(k)[0]) for k, d in enumerate("xy")]
        return at[1] * self.channels[0] + at[0]

    def tile(self) -> Column:
        """The tile of the cell (x, y), from 0, channel after channel."""
        at = []
        for k, d in enumerate("xy"):
            size, first, count = self.axis(k)
            within = (F.col(d) - 1) % size
            at.append(F.when(within < first, 0).otherwise(F.least(F.floor((within - first) / self.widths[k]) + 1, F.lit(count - 1))))
        nx, ny = self.axis(0)[2], self.axis(1)[2]
        return self.channel() * (nx * ny) + at[1] * nx + at[0]

    def place(self, tile: Column) -> Column:
        """Where a tile stands among all of the image in raster order, from 0."""
        nx, ny = self.axis(0)[2], self.axis(1)[2]
        channel, within = F.floor(tile / (nx * ny)), tile % (nx * ny)
        x = channel % self.channels[0] * nx + within % nx
        y = F.floor(channel / self.channels[0]) * ny + F.floor(within / nx)
        return y * (nx * self.channels[0]) + x

    def permutation(self, spark: SparkSession) -> DataFrame:
        """(place, tile) of every tile."""
        return spark.range(self.tiles).select(self.place(F.col("id")).alias("place"), F.col("id").alias("tile"))

    def statistics(self, cells: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
        """tile, place and the aggregates of each tile's cells."""
        found = cells.withColumn("tile", self.tile()).groupBy("tile").agg(*aggregates)
        return found.select("tile", self.place(F.col("tile")).alias("place"), *[c for c in found.columns if c != "tile"])

    def convolve(self, cells: DataFrame, kernel: dict[tuple[int, int], float], edge_correction: bool = True) -> DataFrame:
        """(x, y, v): every channel convolved on its own; what lies beyond its edge is left out of the weights."""
        own = cells.select(self.channel().alias("_c"), "x", "y", "v")
        return grid.convolve(own, {(0, *s): w for s, w in kernel.items()}, ("_c", "x", "y"), edge_correction).drop("_c")

    def correct_edges(self, cells: DataFrame, convolved: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
        """``convolved`` by channels, with the cells that the kernel reaches from an inner edge convolved over the whole image.

        Only cells within twice the reach of an inner edge take part.
        """
        reach = [max((abs(s[k]) for s in kernel), default=0) for k in (0, 1)]

        def near(times: int) -> Column:
            out = F.lit(False)
            for k, d in enumerate("xy"):
                size = self.axis(k)[0]
                within, far = (F.col(d) - 1) % size, times * reach[k]
                after = (within < far) & (F.col(d) > size)
                before = (within >= size - far) & (F.col(d) <= self.sizes[k] - size)
                # a reach wider than a channel passes several edges
                out = out | (F.lit(True) if far > size and self.channels[k] > 1 else after | before)
            return out

        anew = grid.convolve(cells.where(near(2)), kernel).where(near(1)).select("x", "y", F.col("v").alias("_v"), F.lit(True).alias("_near"))
        return convolved.join(anew, ["x", "y"], "left").select("x", "y", F.when(F.col("_near"), F.col("_v")).otherwise(F.col("v")).alias("v"))
