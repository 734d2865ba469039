"""Partitioning, ordering and broadcast helpers shared by operators.

Broadcast policy: sides built from literal dimension tables (status ranks, rule
tables, tier labels) are hinted explicitly because their size is fixed by
construction. Sides derived from data (pool statistics, keyword lists per pool)
are left to AQE, which measures the materialised shuffle stage and switches to a
broadcast join only when the measured size is below
``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column],
                    n: int, rank_col: str = "rank") -> DataFrame:
    """``row_number() <= n`` per group. Spark plans this as WindowGroupLimit, so each
    map task keeps at most ``n`` rows per group before the shuffle: a hot group
    sends ``n x tasks`` rows, not the whole group, to one reducer."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def first_per_key(df: DataFrame, key_cols: Sequence[str], order: Sequence[Column],
                  payload: Sequence[str]) -> DataFrame:
    """Keep, per key, the row that is smallest under ``order``.

    ``min(struct(order..., payload...))``, combined before the shuffle: a key holding a
    third of all rows sends one partial row per task instead of filling one task. With
    string fields Spark plans a SortAggregate (each task sorts its own rows by key).
    """
    sort_fields = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = F.min(F.struct(*sort_fields, *[F.col(c) for c in payload])).alias("_best")
    out = df.groupBy(*key_cols).agg(best)
    return out.select(*key_cols, *[F.col("_best").getField(c).alias(c) for c in payload])


def null_last(c: Column) -> Column:
    """Sort helper: ``(is_null, value)`` as a struct field pair for ``min(struct)``."""
    return F.struct(c.isNull().alias("n"), c.alias("v"))
