"""Row selection and column addressing of tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(df: DataFrame, asked: str, searchin: str = "name", ignorecase: bool = False) -> list[str]:
    """Columns by number from 1, ``_all``, ``/pattern/`` or exact name; by unit or comment if asked for."""
    if asked == "_all":
        return list(df.columns)
    if asked.isdigit():
        if not 1 <= int(asked) <= len(df.columns):
            raise ValueError(f"no column {asked}")
        return [df.columns[int(asked) - 1]]
    about = {f.name: f.name if searchin == "name" else str(f.metadata.get(searchin, "")) for f in df.schema.fields}
    flags = re.I if ignorecase else 0
    if len(asked) > 2 and asked[0] == asked[-1] == "/":
        found = [n for n, v in about.items() if re.search(asked[1:-1], v, flags)]
    else:
        found = [n for n, v in about.items() if re.fullmatch(re.escape(asked), v, flags)]
    if not found:
        raise ValueError(f"no column matches {asked!r}")
    return found


def in_range(c: Column, low: float, high: float) -> Column:
    """``low <= c < high``."""
    return (c >= low) & (c < high)


def equal(c: Column, *values) -> Column:
    return c.isin(*values)


def not_equal(c: Column, *values) -> Column:
    return ~c.isin(*values)


def winding(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """The winding number of the polygon about (x, y); edges are half-open upward."""
    total = None
    for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]]):
        side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        up = (y >= y1) & (y < y2) & (side > 0)
        down = (y >= y2) & (y < y1) & (side < 0)
        term = F.when(up, 1).when(down, -1).otherwise(0)
        total = term if total is None else total + term
    return total


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    return x.isNotNull() & y.isNotNull() & (winding(x, y, vertices) != 0)


def out_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    return x.isNotNull() & y.isNotNull() & (winding(x, y, vertices) == 0)


def keep(df: DataFrame, *criteria: Column) -> DataFrame:
    """Rows that meet all criteria; a blank in one drops the row."""
    return df.where(reduce(lambda a, b: a & b, criteria)) if criteria else df


def no_blank(df: DataFrame, *asked: str) -> DataFrame:
    """Rows without a blank in the given columns."""
    names = [n for a in asked for n in resolve(df, a)]
    return df.dropna(subset=names)
