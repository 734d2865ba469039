"""Rounding that gives the same double in every engine.

``round(x, d)`` is implemented differently across engines at half-way points
(decimal-string HALF_UP in Spark, binary arithmetic elsewhere). Values that are
compared across engines use ``floor(x * 10^d + 0.5) / 10^d``, which is plain
IEEE arithmetic and therefore reproducible.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def sql_round_half_up(expr: str, digits: int) -> str:
    scale = f"{float(10 ** digits)}::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"
