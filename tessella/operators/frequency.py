"""Convolution and deconvolution in the frequency domain.

A two-dimensional transform is one of each row and then one of each column; rows and columns are the parallel
units.  A line longer than ``LINE`` is transformed in four steps: laid out as n1 x n2, its columns are
transformed, each value is turned by its twiddle factor, the rows are transformed, and the places transposed, so no
task holds more than one of these short lines.  The array is padded by the kernel's reach at least, so the far edge
never wraps round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest line that one task transforms.
LINE = 1 << 14


def padded(n: int) -> tuple[int, int]:
    """n1, n2, whose product is ``n`` or a little more; n2 is 1 for a line that one task transforms."""
    if n <= LINE:
        return n, 1
    n2 = 1 << ((n - 1).bit_length() // 2)
    return -(-n // n2), n2


def lines(df: DataFrame, key: str, at: str, shape: tuple[int, int], out: str, inverse: bool = False) -> DataFrame:
    """(key, out, re, im): the transforms of the lines (key, at, re, im), of n1 * n2 places from 0; places without a row are 0."""
    n1, n2 = shape
    n = n1 * n2
    turned = (lambda v: np.fft.ifft(v) * len(v)) if inverse else np.fft.fft
    sign, scale = (1, 1 / n) if inverse else (-1, 1.0)

    def line(g: pd.DataFrame, place: str, length: int) -> np.ndarray:
        v = np.zeros(length, complex)
        v[g[place].to_numpy()] = g["re"].to_numpy() + 1j * g["im"].to_numpy()
        return turned(v)

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        f = line(g, at, n) * scale
        return pd.DataFrame({key: g[key].iloc[0], out: np.arange(n), "re": f.real, "im": f.imag})

    if n2 == 1:
        return df.groupBy(key).applyInPandas(whole, f"{key} long, {out} long, re double, im double")

    def first(g: pd.DataFrame) -> pd.DataFrame:
        k1, a2 = np.arange(n1), int(g["_a2"].iloc[0])
        f = line(g, "_a1", n1) * np.exp(sign * 2j * np.pi * (k1 * a2 % n) / n)
        return pd.DataFrame({key: g[key].iloc[0], "_k1": k1, "_a2": a2, "re": f.real, "im": f.imag})

    def second(g: pd.DataFrame) -> pd.DataFrame:
        f = line(g, "_a2", n2) * scale
        return pd.DataFrame({key: g[key].iloc[0], out: int(g["_k1"].iloc[0]) + n1 * np.arange(n2), "re": f.real, "im": f.imag})

    laid = df.select(key, F.floor(F.col(at) / n2).alias("_a1"), (F.col(at) % n2).alias("_a2"), "re", "im")
    half = laid.groupBy(key, "_a2").applyInPandas(first, f"{key} long, _k1 long, _a2 long, re double, im double")
    return half.groupBy(key, "_k1").applyInPandas(second, f"{key} long, {out} long, re double, im double")


def plane(cells: DataFrame, width: tuple[int, int], height: tuple[int, int]) -> DataFrame:
    """(u, v, re, im): the transform of the cells (x, y, v); blanks and what is missing count as 0."""
    d = cells.select((F.col("x") - 1).cast("long").alias("x"), (F.col("y") - 1).cast("long").alias("y"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    return lines(lines(d, "y", "x", width, "u"), "u", "y", height, "v")


def size(cells: DataFrame, reach: list[int]) -> tuple[int, int, tuple[int, int], tuple[int, int]]:
    box = cells.agg(F.max("x").alias("w"), F.max("y").alias("h")).head()
    nx, ny = box["w"] or 0, box["h"] or 0
    return nx, ny, padded(nx + 2 * reach[0]), padded(ny + 2 * reach[1])


def convolve(cells: DataFrame, kernel: dict[tuple[int, int], float], inverse: bool = False, least: float = 1e-6) -> DataFrame:
    """(x, y, v) of the cells convolved with a kernel of weights by offset; blanks count as 0.

    With ``inverse`` the cells are deconvolved: frequencies that the kernel passes less than ``least`` of become 0.
    """
    nx, ny, width, height = size(cells, [max((abs(k[d]) for k in kernel), default=0) for d in (0, 1)])
    w, h, total = width[0] * width[1], height[0] * height[1], sum(kernel.values())

    def passed(frames):
        for g in frames:
            u, v = g["u"].to_numpy(), g["v"].to_numpy()
            k = sum(c / total * np.exp(-2j * np.pi * (u * i % w / w + v * j % h / h)) for (i, j), c in kernel.items())
            f = g["re"].to_numpy() + 1j * g["im"].to_numpy()
            f = np.where(np.abs(k) > least, f / np.where(np.abs(k) > least, k, 1), 0) if inverse else f * k
            yield pd.DataFrame({"u": u, "v": v, "re": f.real, "im": f.imag})

    done = plane(cells, width, height).mapInPandas(passed, "u long, v long, re double, im double")
    columns = lines(done, "u", "v", height, "y", inverse=True).where(F.col("y") < ny)
    back = lines(columns, "y", "u", width, "x", inverse=True).where(F.col("x") < nx)
    return back.select((F.col("x") + 1).cast("int").alias("x"), (F.col("y") + 1).cast("int").alias("y"), F.col("re").alias("v"))


def kernel(sharp: DataFrame, blurred: DataFrame, reach: int, least: float = 1e-6) -> DataFrame:
    """(i, j, w) of the kernel, up to ``reach`` from its middle, that turns one image into the other.

    The quotient of the two transforms, transformed back; both images must fade out toward their edges.
    Frequencies that the sharp image lacks count as 0.
    """
    _, _, width, height = size(sharp, [reach, reach])
    w, h = width[0] * width[1], height[0] * height[1]
    f = plane(sharp, width, height)
    g = plane(blurred, width, height).select("u", "v", F.col("re").alias("c"), F.col("im").alias("d"))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    there = F.sqrt(power) > least
    re = F.when(there, (F.col("c") * F.col("re") + F.col("d") * F.col("im")) / power).otherwise(0.0)
    im = F.when(there, (F.col("d") * F.col("re") - F.col("c") * F.col("im")) / power).otherwise(0.0)
    quotient = f.join(g, ["u", "v"]).select("u", "v", re.alias("re"), im.alias("im"))
    signed = lambda c, n: F.when(F.col(c) > reach, F.col(c) - n).otherwise(F.col(c))
    near = lambda c, n: (F.col(c) <= reach) | (F.col(c) >= n - reach)
    columns = lines(quotient, "u", "v", height, "y", inverse=True).where(near("y", h))
    back = lines(columns, "y", "u", width, "x", inverse=True).where(near("x", w))
    return back.select(signed("x", w).cast("int").alias("i"), signed("y", h).cast("int").alias("j"), F.col("re").alias("w"))
