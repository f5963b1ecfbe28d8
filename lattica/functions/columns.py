"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables of up to this many rows may be broadcast after they have been counted.
BROADCAST_ROWS = 100_000


def finite(v: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def scrub(v: Column) -> Column:
    """The value, or 0 where it is null, NaN or infinite."""
    return F.coalesce(finite(v), F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(a: Column | str, eps: float = 1e-8) -> Column:
    """The vector over (its norm + eps): lengths stay slightly under 1."""
    n = norm(a) + F.lit(eps)
    return F.transform(a, lambda v: v.cast("double") / n)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most `rows` rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
