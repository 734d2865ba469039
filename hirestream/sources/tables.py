"""Reading the landed driver tables and binding them to the engine's data model.

The driver tables are TPC-H-like; the bindings below map them onto postings,
candidates, landing snapshots and link probes so every registered query reads
the given tables (its work grows with them).
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# --- binding constants (shared with the SQL oracle) ---------------------------
AS_OF = "2001-08-02T00:00:00+00:00"
AS_OF_EPOCH = 996710400
CURRENCY_BY_MOD5 = ["INR", "USD", "EUR", "GBP", None]
PERIOD_BY_STATUS = {"O": "yearly", "F": "monthly", "P": "hourly"}
APPLICANT_MOD = 400
LINK_BASE = "https://jobs.example.org/"
# ------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def postings(spark: SparkSession, sf_dir: str, with_description: bool = False,
             orders: DataFrame | None = None, keep: tuple[str, ...] = (), whole_days: bool = False) -> DataFrame:
    """Standard postings view (D1 columns): one posting per order.

    job_id=o_orderkey, employer=c_mktsegment, title=o_orderpriority, city=nation name,
    posted=o_orderdate, salary min=o_totalprice, max=o_totalprice+c_acctbal when the
    balance is positive, currency by o_orderkey % 5, period by o_orderstatus,
    applicants=o_orderkey % 400, pool = lower(segment). ``whole_days`` dates postings by
    the quarter, so that postings of equal age meet.
    """
    o = read(spark, sf_dir, "orders") if orders is None else orders
    c = read(spark, sf_dir, "customer")
    # nation is a fixed-size dimension (one row per country): broadcast.
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    cur = F.element_at(F.array(*[F.lit(x) for x in CURRENCY_BY_MOD5]),
                       (F.col("o_orderkey") % 5 + 1).cast("int"))
    per = F.element_at(F.create_map(*[F.lit(x) for kv in PERIOD_BY_STATUS.items() for x in kv]),
                       F.col("o_orderstatus"))
    p = (o.join(c, o.o_custkey == c.c_custkey, "inner")
          .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    cols = [
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderpriority").alias("job_title"),
        F.col("c_mktsegment").alias("employer_name"),
        F.col("n_name").alias("job_city"),
        F.lit(None).cast("string").alias("job_state"),
        (F.col("o_orderpriority") == "1-URGENT").alias("job_is_remote"),
        F.unix_seconds((F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")) if whole_days
                        else F.col("o_orderdate").cast("timestamp"))).alias("job_posted_at_timestamp"),
        F.col("o_totalprice").alias("job_min_salary"),
        F.when(F.col("c_acctbal") > 0, F.col("o_totalprice") + F.col("c_acctbal")).alias("job_max_salary"),
        cur.alias("job_salary_currency"),
        per.alias("job_salary_period"),
        (F.col("o_orderkey") % APPLICANT_MOD).cast("int").alias("_applicant_count"),
        F.concat(F.lit(LINK_BASE), F.col("o_orderkey").cast("string")).alias("job_apply_link"),
        F.lower(F.col("c_mktsegment")).alias("pool"),
        F.col("o_orderkey").alias("_ord"),
    ]
    if with_description:
        d = read(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("job_description"))
        p = p.join(d, F.col("o_orderkey") == F.col("doc_id"), "left")
        cols.append(F.col("job_description"))
    return p.select(*cols, *[F.col(k) for k in keep])


def embedded_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that carry an embedding (inner join on vec_id = job_id); pool = label."""
    e = read(spark, sf_dir, "embeddings")
    # Join the embeddings to orders first (the selective join), then enrich the
    # survivors with customer and nation; Catalyst keeps the written join order.
    o = read(spark, sf_dir, "orders").join(e, F.col("o_orderkey") == F.col("vec_id"), "inner")
    p = postings(spark, sf_dir, orders=o, keep=("embedding", "label"))
    return p.drop("pool").withColumn("pool", F.col("label").cast("string")).drop("label")


def candidates_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate vector per pool: the lowest-id embedding of each label."""
    e = read(spark, sf_dir, "embeddings")
    return (e.groupBy(F.col("label").cast("string").alias("pool"))
             .agg(F.min("vec_id").alias("candidate_id"),
                  F.min_by("embedding", "vec_id").alias("cand_embedding")))


def single_candidate(spark: SparkSession, sf_dir: str, pool: str = "all") -> DataFrame:
    """The lowest-id embedding as the one candidate of pool ``pool``."""
    e = read(spark, sf_dir, "embeddings")
    return e.agg(F.min("vec_id").alias("candidate_id"),
                 F.min_by("embedding", "vec_id").alias("cand_embedding")).withColumn("pool", F.lit(pool))
