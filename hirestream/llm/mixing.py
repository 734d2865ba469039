"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; every document of a source is wanted
``target / source size`` times. The whole part is certain; the fraction is a copy
probability. Two documents at a time, mass (probability times words) moves from one
to the other until one probability is 0 or 1; the random direction keeps every
probability's expectation, and the words of the pair stay the same. What is left of a
group is one document with a fraction. Groups are hash buckets of a source, a few
thousand documents each; the leftovers of ``FAN_IN`` buckets meet in the next level
of a tree until one is left per source, which is rounded on its own. So a source's
words differ from its target by less than one document.

Only (id, source, size) rows are shuffled, and a source with a third of all rows is
spread over its buckets. Buckets, order and random numbers depend on ids, never on
partitions, so reruns and retried tasks agree.

Defined results: null text has size 0; a source may be null (ranked last); rows of
size 0 are taken 0 times; a source without words has target 0; repeated rows are
rounded row by row; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import free_name, n_words, trimmed

FAN_IN = 64
PER_BUCKET = 8192
NEAR = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float], max_ratio: float) -> DataFrame:
    """Targets of sources: ``sizes`` has one row per source (``source, source_size``).

    Shares follow the weights, dealt in turn to sources ordered by code point (null
    last). A target stops at ``max_ratio`` times its source; the rest is shared again by
    weight. The fixed point is found in closed form: sources are capped in order of
    cap per weight until the share of the next one stays below its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_ratio))
    rows = sizes.withColumn("weight", w).withColumn("cap", cap).withColumn("turn", F.col("cap") / F.col("weight"))
    order = Window.orderBy("turn", F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
                .withColumn("capped", F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
                .withColumn("open_weight", F.sum("weight").over(onwards))
                .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
                .withColumn("open", F.col("level") <= F.col("turn")))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(everything)
    rows = rows.withColumn("fair", level)
    target = F.when(F.col("fair").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fair") * F.col("weight")))
    return rows.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def pivot(p: list[float], size: list[int], rng: random.Random) -> int:
    """Round ``p`` in place until at most one entry is fractional; its index or -1."""
    held = -1
    for j in range(len(p)):
        if not NEAR < p[j] < 1 - NEAR:
            p[j] = float(round(p[j]))
            continue
        if held < 0:
            held = j
            continue
        a, b = size[held], size[j]
        up = min(a * (1 - p[held]), b * p[j])    # words that can move from j to the held one
        down = min(a * p[held], b * (1 - p[j]))  # and back
        if rng.random() * (up + down) < down:
            p[held], p[j] = p[held] + up / a, p[j] - up / b
        else:
            p[held], p[j] = p[held] - down / a, p[j] + down / b
        left = -1
        for i in (held, j):
            if NEAR < p[i] < 1 - NEAR:
                left = i
            else:
                p[i] = float(round(p[i]))
        held = left
    return held


_FIELDS = "doc_id long, row_key long, source string, size long, base long, p double, bucket long, pos long, open boolean"


def _rounder(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "doc_id", "row_key", "size"], kind="stable", na_position="last").reset_index(drop=True)
        source = pdf["source"].iloc[0]
        rng = random.Random(f"{seed}|{level}|{pdf['bucket'].iloc[0]}|{'0' if source is None else '1' + source}")
        p, size = pdf["p"].tolist(), pdf["size"].tolist()
        held = pivot(p, size, rng)
        if last and held >= 0:
            p[held], held = float(rng.random() < p[held]), -1
        pdf["p"] = p
        pdf["open"] = False
        if held >= 0:
            pdf.loc[held, "open"] = True
        return pdf
    return run


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_ratio: float = 3.0, seed: int = 0,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        per_bucket: int = PER_BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: ``doc_id, row_key, source, size, source_size, target,
    copies, taken``; ``row_key`` is a hash of the text."""
    ensure_checkpoint_dir(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"),
                       F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")).checkpoint()
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = targets(sizes.select("source", "source_size"), weights, max_ratio).checkpoint()
    n_docs = slim.count()
    buckets = max(1, -(-n_docs // per_bucket))

    g = goal.withColumnRenamed("source", "goal_source")
    wanted = slim.join(g, F.col("source").eqNullSafe(F.col("goal_source")), "inner").drop("goal_source")
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(NEAR))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("row_key"))
    level0 = wanted.select("doc_id", "row_key", "source", "size", whole.cast("long").alias("base"),
                           F.greatest(ratio - whole, F.lit(0.0)).alias("p"),
                           F.pmod(place, F.lit(buckets)).cast("long").alias("bucket"), place.alias("pos"),
                           F.lit(True).alias("open"))
    done, level = [], 0
    rows = level0
    while True:
        last = buckets == 1
        rounded = rows.groupBy("source", "bucket").applyInPandas(trimmed(_rounder(seed, level, last)), _FIELDS).checkpoint()
        done.append(rounded.filter(~F.col("open")))
        if last:
            break
        buckets, level = -(-buckets // fan_in), level + 1
        rows = rounded.filter("open").withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("base") + F.round("p").cast("long"))
    return (out.withColumn("copies", copies)
               .join(g, F.col("source").eqNullSafe(F.col("goal_source")), "inner")
               .select("doc_id", "row_key", "source", "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).alias("taken")))


def take_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as many times as the mix takes it."""
    mixed = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how)
    key, n, m_id, m_key, m_source = (free_name(docs.columns, x) for x in
                                     ("row_key", "copies", "mix_id", "mix_key", "mix_source"))
    plan = (mixed.filter("copies > 0").groupBy("doc_id", "row_key", "source").agg(F.sum("copies").alias(n))
                 .select(F.col("doc_id").alias(m_id), F.col("row_key").alias(m_key), F.col("source").alias(m_source), n))
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    on = (keyed[id_col].cast("long").eqNullSafe(plan[m_id]) & (keyed[key] == plan[m_key])
          & keyed[source_col].cast("string").eqNullSafe(plan[m_source]))
    unique = keyed.join(plan, on, "inner").dropDuplicates([id_col, key, source_col])
    once = free_name([*unique.columns], "copy_no")
    return unique.withColumn(once, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
