"""Exact de-duplication (native: DataFrame functions only).

Rows are grouped by a 128-bit hash of the normalised text *and* the text itself, so
Spark compares bytes whenever two hashes meet: different texts that share a hash
stay in different groups. Partial aggregation leaves one row per group and map task
before the shuffle, so a text held by a third of all rows is no hot spot. Texts move
once; everything after works on (id, hash) rows.

Defined results: null text counts as empty (all nulls and empty texts are equal);
white-space runs count as one space; a null id is larger than any id; of rows
repeated with one id and equal text exactly one is kept; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import SPACE, free_name, text_or_empty


def normalise(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), SPACE, " ")


def hash128(c: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(c.cast("binary")))


def _keyed(rows: DataFrame, h: str, norm: str, collided: DataFrame | None) -> DataFrame:
    """``rows`` with the key of their group in ``h``: the content hash, followed by the text
    itself where different texts share the hash."""
    if collided is None:
        return rows
    hit = free_name(rows.columns, "collided")
    found = rows.join(collided.select(F.col("h").alias(hit)), F.col(h) == F.col(hit), "left")
    return found.withColumn(h, F.concat(F.col(h), F.when(F.col(hit).isNotNull(), F.col(norm).cast("binary")).otherwise(F.lit(b"")))).drop(hit)


def classes(docs: DataFrame, id_col: str, text_col: str,
            content_hash: Callable[[Column], Column] = hash128) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``(members, groups, collided)``: one row per (key, id) with its number of rows, one
    per group of equal texts (key, digest, smallest id, size), checkpointed, and the
    hashes that different texts share, if there are any."""
    ensure_checkpoint_dir(docs.sparkSession)
    keyed = (docs.select(F.col(id_col).cast("long").alias("doc_id"), normalise(F.col(text_col)).alias("norm"))
                 .withColumn("h", content_hash(F.col("norm"))))

    def grouped(rows: DataFrame) -> DataFrame:
        return (rows.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                    .select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
                    .checkpoint())

    groups = grouped(keyed)
    collided = groups.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    if collided.isEmpty():
        collided = None
    else:  # rows of those hashes, and only those, are told apart by their texts
        keyed = _keyed(keyed, "h", "norm", collided)
        groups = grouped(keyed)
    return keyed.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "h", "n"), groups, collided


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    members, groups, _ = classes(docs, id_col, text_col, content_hash)
    joined = members.join(groups, "h")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return (joined.select("doc_id", "keep_id", "group_size", "text_sha256", copy.alias("copy"))
                  .select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                          (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                          "text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    members, groups, collided = classes(docs, id_col, text_col, content_hash)
    h, i, norm = (free_name(docs.columns, x) for x in ("content_hash", "kept_id", "norm"))
    stay = (members.join(groups, "h").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
                   .select(F.col("h").alias(h), F.col("doc_id").alias(i)))
    hashed = docs.withColumn(norm, normalise(F.col(text_col))).withColumn(h, content_hash(F.col(norm)))
    hashed = _keyed(hashed, h, norm, collided).drop(norm)
    same = (hashed[h] == stay[h]) & hashed[id_col].cast("long").eqNullSafe(stay[i])
    return hashed.join(stay, same, "left_semi").dropDuplicates([id_col, h]).select(*docs.columns)
