"""Model request/response tables.

Calls to a hosted model are outside the engine: requests are built as rows,
responses are landed as rows and parsed here.
"""
from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage

CHUNK_SIZE = 60
_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill_template(template: str, values: Mapping[str, Column], limits: Mapping[str, int] | None = None) -> Column:
    """Single-pass ``{name}`` substitution (like ``str.format``: a value that
    itself contains ``{x}`` is not substituted again); ``{{``/``}}`` are literal
    braces; values are cut to ``limits[name]`` characters."""
    limits = limits or {}
    parts: list[Column] = []
    pos = 0
    t = template.replace("{{", "\x00").replace("}}", "\x01")
    for m in _PLACEHOLDER.finditer(t):
        parts.append(F.lit(t[pos:m.start()].replace("\x00", "{").replace("\x01", "}")))
        name = m.group(1)
        v = F.coalesce(values[name].cast("string"), F.lit(""))
        parts.append(F.substring(v, 1, limits[name]) if name in limits else v)
        pos = m.end()
    parts.append(F.lit(t[pos:].replace("\x00", "{").replace("\x01", "}")))
    return F.concat(*parts)


def request_rows(df: DataFrame, key_cols: list[str], template: str, values: Mapping[str, Column],
                 limits: Mapping[str, int] | None = None) -> DataFrame:
    """Rows ``(keys..., request_key, prompt)`` with a content hash as request key."""
    prompt = fill_template(template, values, limits)
    return df.select(*key_cols, prompt.alias("prompt")).withColumn(
        "request_key", F.substring(F.sha1(F.col("prompt")), 1, 16))


def parse_json_response(raw: Column, schema: str) -> Column:
    """R16 + N3: strip a code fence, then parse strictly; anything that is not valid
    JSON yields NULL (the caller supplies the fallback)."""
    body = tx.strip_code_fences(raw)
    v = F.try_parse_json(body)
    return F.when(v.isNotNull(), F.from_json(body, schema))


def chunk_ids(df: DataFrame, group_col: str, order_col: str, size: int = CHUNK_SIZE,
              num_partitions: int | None = None) -> DataFrame:
    """F8: batch number of each row within its group (``size`` rows per batch) in
    ``order_col`` order (keys assumed unique within a group).

    The position is computed without putting a group in one task: rows are
    range-partitioned by (group, key) (a hot group spans several partitions),
    ranked inside each range partition, and shifted by the counts of the earlier
    partitions of the same group (a table of partitions x groups rows). The range
    partitioning is checkpointed so its sampled bounds are fixed for both uses."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, group_col, order_col)
                         .withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_lrank", F.row_number().over(
        Window.partitionBy("_pid", group_col).orderBy(order_col)))
    counts = ranged.groupBy(group_col, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    pos = local.join(offsets, [group_col, "_pid"]).withColumn("_pos", F.col("_off") + F.col("_lrank"))
    return pos.withColumn("chunk_id", F.floor((F.col("_pos") - 1) / size).cast("long")).drop(
        "_pid", "_lrank", "_off", "_pos")
