"""Reverse-Polish column arithmetic: a string of tokens becomes Column expressions.

Numbers are literals, ``$3`` and ``$NAME`` (or a bare column name) are columns, everything else is an
operator.  What is left on the stack are the results.  Blanks are NULL.  Integers are computed as longs
and floats as doubles; narrow literal types of the original tools only decide whether a result is an
integer, a float or a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers, sky

WIDTH = {"uint8": 8, "uint16": 16, "uint32": 32, "int8": 8, "int16": 16, "int32": 32, "int64": 64}


@dataclass
class Operand:
    column: Column
    kind: str  # "int", "float" or "text"
    named: str = ""  # the exact type, where a cast gave one

    def number(self) -> Column:
        return self.column.cast("bigint" if self.kind == "int" else "double")


def _both(a: Operand, b: Operand) -> str:
    return "int" if a.kind == b.kind == "int" else "float"


def _pair(a: Operand, b: Operand) -> tuple[Column, Column]:
    kind = "bigint" if _both(a, b) == "int" else "double"
    return a.column.cast(kind), b.column.cast(kind)


def _arithmetic(op: Callable[[Column, Column], Column]) -> Callable[..., Operand]:
    return lambda a, b: Operand(op(*_pair(a, b)), _both(a, b))


def _divide(a: Operand, b: Operand) -> Operand:
    x, y = _pair(a, b)
    if _both(a, b) == "int":  # cut off toward zero; by zero is blank
        return Operand(F.when(y != 0, F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint")))), "int")
    return Operand(F.try_divide(x, y), "float")


def _modulo(a: Operand, b: Operand) -> Operand:
    if _both(a, b) != "int":
        raise ValueError("% takes integers")
    x, y = _pair(a, b)
    return Operand(F.when(y != 0, x % F.nullif(y, F.lit(0).cast("bigint"))), "int")


def _compare(op: Callable[[Column, Column], Column], if_blank: int) -> Callable[..., Operand]:
    """0 or 1.  A blank integer gives a blank; a blank float compares as NaN does."""

    def run(a: Operand, b: Operand) -> Operand:
        if "text" in (a.kind, b.kind):
            return Operand(op(a.column.cast("string"), b.column.cast("string")).cast("int"), "int")
        got = op(*_pair(a, b)).cast("int")
        return Operand(got if _both(a, b) == "int" else F.coalesce(got, F.lit(if_blank)), "int")

    return run


def _truth(a: Operand) -> Column:
    """C truth; a blank is not zero and so true."""
    return F.coalesce(a.number() != 0, F.lit(True))


def _bits(op: Callable[[Column, Column], Column]) -> Callable[..., Operand]:
    def run(a: Operand, b: Operand) -> Operand:
        if _both(a, b) != "int":
            raise ValueError("bit operators take integers")
        return Operand(op(*_pair(a, b)), "int", a.named)

    return run


def _shift(name: str) -> Callable[..., Operand]:
    return lambda a, b: Operand(F.call_function(name, a.column.cast("bigint"), b.column.cast("int")), "int", a.named)


def _bitnot(a: Operand) -> Operand:
    """One's complement in the operand's own width."""
    c = F.bitwise_not(a.column.cast("bigint"))
    if a.named.startswith("uint") and a.named in WIDTH:
        c = c.bitwiseAND(F.lit((1 << WIDTH[a.named]) - 1).cast("bigint"))
    return Operand(c, "int", a.named)


def _where(out: Operand, cond: Operand, value: Operand) -> Operand:
    kind = out.kind
    cast = {"int": "bigint", "float": "double", "text": "string"}[kind]
    return Operand(F.when(F.coalesce(cond.number() != 0, F.lit(False)), value.column.cast(cast)).otherwise(out.column.cast(cast)), kind)


def _cast(name: str) -> Callable[[Operand], Operand]:
    return lambda a: Operand(numbers.to_type(a.column, name), "float" if name in numbers.FLOAT_TYPES else "int", name)


def _log(f: Callable[[Column], Column]) -> Callable[[Operand], Operand]:
    """Of zero it is minus infinity, of less it is blank."""
    return lambda a: Operand(F.when(a.number() == 0, F.lit(float("-inf"))).when(a.number() > 0, f(a.column.cast("double"))), "float")


OPERATORS: dict[str, tuple[int, Callable[..., Operand | list[Operand]]]] = {
    "+": (2, _arithmetic(lambda x, y: x + y)),
    "-": (2, _arithmetic(lambda x, y: x - y)),
    "x": (2, _arithmetic(lambda x, y: x * y)),
    "/": (2, _divide),
    "%": (2, _modulo),
    "abs": (1, lambda a: Operand(F.abs(a.number()), a.kind)),
    "pow": (2, lambda a, b: Operand(F.pow(a.column.cast("double"), b.column.cast("double")), "float")),
    "sqrt": (1, lambda a: Operand(F.when(a.number() >= 0, F.sqrt(a.column.cast("double"))), "float")),
    "log": (1, _log(F.log)),
    "log10": (1, _log(F.log10)),
    "lt": (2, _compare(lambda x, y: x < y, 0)),
    "le": (2, _compare(lambda x, y: x <= y, 0)),
    "gt": (2, _compare(lambda x, y: x > y, 0)),
    "ge": (2, _compare(lambda x, y: x >= y, 0)),
    "eq": (2, _compare(lambda x, y: x == y, 0)),
    "ne": (2, _compare(lambda x, y: x != y, 1)),
    "and": (2, lambda a, b: Operand((_truth(a) & _truth(b)).cast("int"), "int")),
    "or": (2, lambda a, b: Operand((_truth(a) | _truth(b)).cast("int"), "int")),
    "not": (1, lambda a: Operand((~_truth(a)).cast("int"), "int")),
    "isblank": (1, lambda a: Operand(a.column.isNull().cast("int"), "int")),
    "where": (3, _where),
    "bitand": (2, _bits(lambda x, y: x.bitwiseAND(y))),
    "bitor": (2, _bits(lambda x, y: x.bitwiseOR(y))),
    "bitxor": (2, _bits(lambda x, y: x.bitwiseXOR(y))),
    "lshift": (2, _shift("shiftleft")),
    "rshift": (2, _shift("shiftright")),
    "bitnot": (1, _bitnot),
    "ra-to-degree": (1, lambda a: Operand(sky.ra_to_degree(a.column), "float")),
    "dec-to-degree": (1, lambda a: Operand(sky.dec_to_degree(a.column), "float")),
    "degree-to-ra": (1, lambda a: Operand(sky.degree_to_ra(a.column.cast("double")), "text")),
    "degree-to-dec": (1, lambda a: Operand(sky.degree_to_dec(a.column.cast("double")), "text")),
    "distance-flat": (4, lambda a, b, c, d: Operand(sky.distance_flat(*(o.column.cast("double") for o in (a, b, c, d))), "float")),
    "distance-on-sphere": (4, lambda a, b, c, d: Operand(sky.distance_on_sphere(*(o.column.cast("double") for o in (a, b, c, d))), "float")),
    **{name: (1, _cast(name)) for name in (*numbers.INTEGER_TYPES, *numbers.FLOAT_TYPES)},
}

#: Tokens that reduce a whole column to one number, which every row then sees.
REDUCTIONS = ("minvalue", "maxvalue", "numbervalue", "sumvalue", "meanvalue", "stdvalue", "medianvalue")


def reduced(df: DataFrame, a: Operand, name: str) -> Operand:
    """A reduction of the non-blank values, as a scalar subquery that is worked out once."""
    from ..operators.statistics import medians

    v = F.col("v")
    rows = df.select(a.number().alias("v")).where(v.isNotNull())
    if name == "medianvalue":
        return Operand(medians(rows, [], "v").select("median").agg(F.first("median")).scalar(), "float")
    how = {"minvalue": F.min(v), "maxvalue": F.max(v), "numbervalue": F.count(v), "sumvalue": F.sum(v), "meanvalue": F.avg(v), "stdvalue": F.stddev_pop(v)}[name]
    kind = "int" if name == "numbervalue" or (a.kind == "int" and name in ("minvalue", "maxvalue", "sumvalue")) else "float"
    return Operand(rows.agg(how).scalar(), kind)


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def literal(token: str) -> Operand | None:
    """The operand of a number, or of nan and inf."""
    low = token.lower()
    if low in ("nan", "+nan", "-nan"):
        return Operand(F.lit(None).cast("double"), "float")
    if low in ("inf", "+inf", "-inf"):
        return Operand(F.lit(float(low)), "float")
    if not _NUMBER.match(token):
        return None
    if re.fullmatch(r"[+-]?\d+", token):
        return Operand(F.lit(int(token)), "int")
    return Operand(F.lit(float(token)), "float")


def column_operand(df: DataFrame, token: str) -> Operand:
    """A column by ``$k`` (from 1), ``$name`` or name."""
    name = token[1:] if token.startswith("$") else token
    if token.startswith("$") and name.isdigit():
        if not 1 <= int(name) <= len(df.columns):
            raise ValueError(f"no column {token}")
        name = df.columns[int(name) - 1]
    if name not in df.columns:
        raise ValueError(f"neither a number, an operator nor a column: {token!r}")
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if numbers.is_float(kind):
        return Operand(F.when(~F.isnan(c), c), "float")
    return Operand(c, "int" if numbers.is_integer(kind) else "text")


FILE_TOKENS = ("tofile-", "tofilefree-")


def evaluate(df: DataFrame, tokens: str | list[str], wcs: sky.TangentPlane | None = None, files: dict[str, Column] | None = None) -> list[Column]:
    """The columns that the tokens leave on the stack, first pushed first.  The last token must be an operator.

    With ``files``, tofile-NAME puts the top of the stack there under its name and tofilefree-NAME also takes it off;
    ``plans.side_files`` writes them.
    """
    tokens = tokens.split() if isinstance(tokens, str) else list(tokens)
    stack: list[Operand] = []
    bound: dict[str, Operand] = {}
    last = tokens[-1] if tokens else ""
    if last not in OPERATORS and last not in ("wcstoimg", "imgtowcs", "size", *REDUCTIONS) and not (files is not None and last.startswith(FILE_TOKENS)):
        raise ValueError("the last token must be an operator")
    for at, token in enumerate(tokens):
        if token.startswith("set-"):
            bound[token[4:]] = stack.pop()
        elif token.startswith(FILE_TOKENS):
            name = token.partition("-")[2]
            if files is None or not stack or not name or "/" in name or name in files:
                raise ValueError(f"{token} needs an operand, and a name of its own among files that are to be written")
            files[name] = stack[-1].column
            stack = stack[:-1] if token.startswith("tofilefree-") else stack
        elif token in bound:
            stack.append(bound[token])
        elif token in ("wcstoimg", "imgtowcs"):
            if wcs is None:
                raise ValueError(f"{token} needs a projection")
            y, x = stack.pop().column.cast("double"), stack.pop().column.cast("double")
            stack += [Operand(c, "float") for c in (wcs.to_image if token == "wcstoimg" else wcs.to_world)(x, y)]
        elif token in REDUCTIONS:
            stack.append(reduced(df, stack.pop(), token))
        elif token == "size":  # of a column along its only axis, blanks included
            axis = tokens[at - 1]
            stack = stack[:-2]
            if axis != "1":
                raise ValueError("a column has one axis")
            stack.append(Operand(df.agg(F.count("*")).scalar(), "int"))
        elif token in OPERATORS:
            n, f = OPERATORS[token]
            if len(stack) < n:
                raise ValueError(f"{token} takes {n} operands")
            operands, stack = stack[len(stack) - n :], stack[: len(stack) - n]
            stack.append(f(*operands))
        else:
            stack.append(literal(token) or column_operand(df, token))
    return [o.column for o in stack]
