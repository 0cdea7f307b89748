"""Rounding of doubles to n digits, half to even on the exact binary value, in plain double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1 cuts a double into two halves whose products are exact


def py_round(x: Column, digits: int) -> Column:
    """round(x, digits) as Python does, for |x| * 10^digits under 2^52. Null gives null."""
    m = F.lit(float(10**digits))
    p, c = x * m, x * F.lit(_SPLIT)
    high = c - (c - x)
    error = (high * m - p) + (x - high) * m  # what the product p lacks
    low = F.floor(p).cast("double")
    rest = p - low
    up = F.when(rest > 0.5, 1.0).when(rest < 0.5, 0.0).when(error > 0, 1.0).when(error < 0, 0.0).when(F.pmod(low, F.lit(2.0)) == 1.0, 1.0).otherwise(0.0)
    return F.when(x.isNotNull(), (low + up) / m)


def py_round_sql(x: str, digits: int) -> str:
    """The same as DuckDB SQL; x should be a column's name."""
    m, c = f"{10**digits}.0::DOUBLE", f"({x} * {_SPLIT!r}::DOUBLE)"
    p, high = f"({x} * {m})", f"({c} - ({c} - {x}))"
    error = f"(({high} * {m} - {p}) + ({x} - {high}) * {m})"
    low = f"floor({p})"
    return (
        f"((CASE WHEN {p} - {low} > 0.5 THEN 1.0::DOUBLE WHEN {p} - {low} < 0.5 THEN 0.0::DOUBLE WHEN {error} > 0 THEN 1.0::DOUBLE WHEN {error} < 0 THEN 0.0::DOUBLE"
        f" WHEN abs({low} % 2) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + {low}) / {m})"
    )
