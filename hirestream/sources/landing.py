"""Request manifest and landed snapshots.

Fetching from job boards is out of scope; payloads are landed rows
``(request_key, fetched_at, payload)``. These operators decide which requests
are still missing or stale, as a Spark job over the manifest and the landing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import as_of_epoch


def request_key(query_text, location, page):
    """16 hex chars of sha1 over the request parameters."""
    return F.substring(F.sha1(F.concat_ws("|", query_text, location, page.cast("string"))), 1, 16)


def request_manifest(role_locations: DataFrame, num_pages: int = 2) -> DataFrame:
    """S3: one row per (role, location, page); ``role_locations`` carries
    ``role, domain, location`` (already paired by the caller's join)."""
    q = F.trim(F.concat_ws(" ", F.col("role"), F.col("domain"), F.lit("in"), F.col("location")))
    return (role_locations
            .withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(num_pages))))
            .withColumn("query_text", q)
            .withColumn("request_key", request_key(q, F.col("location"), F.col("page"))))


def fresh_snapshots(landing: DataFrame, *, as_of, ttl_seconds: int = 86400, force: bool = False) -> DataFrame:
    """Per key the latest landed payload, kept iff its age is within ``ttl`` and
    it parses as JSON (a corrupt payload is a miss). ``force`` keeps nothing."""
    if force:
        return landing.limit(0).select("request_key", "fetched_at", "payload")
    latest = (landing.groupBy("request_key")
              .agg(F.max(F.struct("fetched_at", "payload")).alias("l"))
              .select("request_key", "l.fetched_at", "l.payload"))
    age = F.lit(as_of_epoch(as_of)) - F.unix_seconds(F.col("fetched_at").cast("timestamp"))
    return latest.filter((age <= ttl_seconds) & F.try_parse_json(F.col("payload")).isNotNull())


def pending_requests(manifest: DataFrame, landing: DataFrame, *, as_of, ttl_seconds: int = 86400,
                     force: bool = False) -> DataFrame:
    """Requests still to be made: manifest rows without a fresh snapshot."""
    fresh = fresh_snapshots(landing, as_of=as_of, ttl_seconds=ttl_seconds, force=force)
    return manifest.join(fresh.select("request_key"), "request_key", "left_anti")
