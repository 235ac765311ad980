"""Numeric conventions: blanks are NULL inside the library, and NaN becomes NULL where data enters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least and greatest value of each named integer type, and the Spark type that holds it without loss.
INTEGER_TYPES = {
    "uint8": (0, 2**8 - 1, "short"),
    "int8": (-(2**7), 2**7 - 1, "byte"),
    "uint16": (0, 2**16 - 1, "int"),
    "int16": (-(2**15), 2**15 - 1, "short"),
    "uint32": (0, 2**32 - 1, "bigint"),
    "int32": (-(2**31), 2**31 - 1, "int"),
    "uint64": (0, 2**64 - 1, "decimal(20,0)"),
    "int64": (-(2**63), 2**63 - 1, "bigint"),
}
FLOAT_TYPES = {"float32": "float", "float64": "double"}


def is_float(t: T.DataType) -> bool:
    return isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, (T.IntegralType, T.DecimalType, T.BooleanType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """``df`` with NaN as NULL in every floating-point column."""
    return df.withColumns({f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema.fields if is_float(f.dataType)})


def to_type(c: Column, name: str) -> Column:
    """``c`` as a named numeric type; fractions are cut off, and what the type can't hold is NULL."""
    if name in FLOAT_TYPES:
        return c.cast(FLOAT_TYPES[name])
    least, most, held = INTEGER_TYPES[name]
    whole = F.floor(c.cast("decimal(38,6)")) if name == "uint64" else c
    low, high = (F.lit(str(v)).cast("decimal(20,0)") if name == "uint64" else F.lit(v) for v in (least, most))
    return F.when(whole.between(low, high), whole.cast(held))


def either_null(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull()
