"""Rounding used before results are compared or hashed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


TIE_SHIFT = 3.7e-10
"""Decimal inputs often land exactly on a rounding tie, where engines differ by one unit in
the last place. The shift is far above float noise and moves such values off the tie."""


def rnd(value: Column | str, digits: int = 6) -> Column:
    """Round, and turn a negative zero into zero."""
    value = F.col(value) if isinstance(value, str) else value
    rounded = F.round(value + F.lit(TIE_SHIFT), digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def printf(pattern: str, *values: Column) -> Column:
    """Text of numbers as C's printf gives it: of the binary value, ties to even. Null if a value is null.

    ``format_string`` rounds the shortest decimal text of a double instead: 20.3036055, stored a little below that,
    becomes 20.303606.
    """

    @F.arrow_udf("string")
    def write(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if None in row else pattern % row for row in rows], pa.string())

    return write(*values)
