"""Keyed applications table (D12): projection, upsert, status changes, views,
queue decisions (P4, P9-P11, J7, A9-A12, F7).

The table is a versioned parquet snapshot (see :mod:`hirestream.sources.sinks`);
every operator here is a pure DataFrame -> DataFrame step so a batch of many
candidates' applications is processed with one join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.status import PROTECTED_COLUMNS, VALID_STATUSES, current_status
from ..plans.strategy import top_n_per_group

# --- fixed values ------------------------------------------------------------
APPLICATION_COLUMNS = ["job_id", "source", "company", "title", "location", "posted_days_ago",
                       "salary_mid_lpa", "fit_score", "composite_score", "apply_link", "status",
                       "queued_at", "applied_at", "last_response_at", "last_response_summary",
                       "artifact_dir", "notes"]
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# -----------------------------------------------------------------------------

SCHEMA = ("job_id string, source string, company string, title string, location string, "
          "posted_days_ago double, salary_mid_lpa double, fit_score double, composite_score double, "
          "apply_link string, status string, queued_at string, applied_at string, last_response_at string, "
          "last_response_summary string, artifact_dir string, notes string")


def _c(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, TIME_FORMAT)


def to_application_rows(ranked: DataFrame, *, as_of_text: str, default_source: str = "api") -> DataFrame:
    """ranked/fetched rows -> D12 rows, rounded per column, status ``queued``."""
    first = lambda *names: F.coalesce(*[F.when(~_blank(_c(ranked, n)), _c(ranked, n)) for n in names],
                                      F.lit(""))
    return ranked.select(
        first("job_id").cast("string").alias("job_id"),
        F.coalesce(F.when(~_blank(_c(ranked, "_source")), _c(ranked, "_source")), F.lit(default_source)).alias("source"),
        first("employer_name", "company").alias("company"),
        first("job_title", "title").alias("title"),
        first("job_city", "city", "_source_location").alias("location"),
        round_half_up(_c(ranked, "posted_days_ago", "double"), 1).alias("posted_days_ago"),
        round_half_up(_c(ranked, "salary_mid_lpa", "double"), 2).alias("salary_mid_lpa"),
        round_half_up(_c(ranked, "fit_score", "double"), 4).alias("fit_score"),
        round_half_up(_c(ranked, "composite_score", "double"), 4).alias("composite_score"),
        first("job_apply_link", "apply_link").alias("apply_link"),
        F.lit("queued").alias("status"), F.lit(as_of_text).alias("queued_at"),
        F.lit("").alias("applied_at"), F.lit("").alias("last_response_at"),
        F.lit("").alias("last_response_summary"),
        F.coalesce(_c(ranked, "artifact_dir"), F.lit("")).alias("artifact_dir"),
        F.lit("").alias("notes"))


def upsert(snapshot: DataFrame, batch: DataFrame, *, as_of_text: str) -> DataFrame:
    """J7/A11 (T14, sheet semantics): one full outer join on ``job_id``.

    New keys are inserted as given (``queued_at`` defaults to ``as_of``; a blank
    status stays blank and reads back as queued). Existing keys take the batch
    value of every non-protected column whose batch value is non-empty; protected
    columns (status, timestamps, response, notes) never change here.
    Columns present on only one side are kept (header evolution, S8)."""
    cols = list(snapshot.columns) + [c for c in batch.columns if c not in snapshot.columns]
    s = snapshot.select([F.col(c).alias(f"s_{c}") for c in snapshot.columns])
    b = batch.select([F.col(c).alias(f"b_{c}") for c in batch.columns])
    j = s.join(b, F.col("s_job_id") == F.col("b_job_id"), "full_outer")
    is_new = F.col("s_job_id").isNull()
    out = []
    for c in cols:
        sv = F.col(f"s_{c}") if c in snapshot.columns else F.lit(None)
        bv = F.col(f"b_{c}") if c in batch.columns else F.lit(None)
        if c == "job_id":
            v = F.coalesce(sv, bv)
        elif c == "queued_at":
            v = F.when(is_new, F.coalesce(F.when(~_blank(bv), bv), F.lit(as_of_text))).otherwise(sv)
        elif c in PROTECTED_COLUMNS:
            v = F.when(is_new, bv).otherwise(sv)
        else:
            v = F.when(is_new, bv).when(F.col("b_job_id").isNotNull() & ~_blank(bv), bv).otherwise(sv)
        out.append(v.alias(c))
    return j.select(out)


def set_status(snapshot: DataFrame, updates: DataFrame, *, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply ``updates(job_id, status, at, response_summary?, notes?, seq)`` in
    ``(at, seq)`` order per job. Invalid statuses are returned as rejects.

    Status = last update; ``applied_at`` = time of the last ``applied`` update;
    a response summary sets ``last_response_at`` and the summary; notes are kept when
    non-empty. Both are whole unless the caller sets ``max_chars`` (a sheet cell's limit).
    Unknown job ids change nothing."""
    def cell(c: Column) -> Column:
        return c if max_chars is None else F.substring(c, 1, max_chars)

    valid = updates.filter(F.col("status").isin(VALID_STATUSES))
    rejects = updates.filter(~F.col("status").isin(VALID_STATUSES) | F.col("status").isNull())
    key = F.struct(F.col("at"), _c(updates, "seq", "long"))
    agg = valid.groupBy("job_id").agg(
        F.max_by("status", key).alias("u_status"),
        F.max(F.when(F.col("status") == "applied", F.col("at"))).alias("u_applied_at"),
        F.max_by(F.when(_c(updates, "response_summary").isNotNull(), F.col("at")),
                 F.when(_c(updates, "response_summary").isNotNull(), key)).alias("u_resp_at"),
        F.max_by(_c(updates, "response_summary"),
                 F.when(_c(updates, "response_summary").isNotNull(), key)).alias("u_resp"),
        F.max_by(_c(updates, "notes"), F.when(~_blank(_c(updates, "notes")), key)).alias("u_notes"))
    j = snapshot.join(agg, "job_id", "left")
    hit = F.col("u_status").isNotNull()
    repl = {
        "status": F.when(hit, F.col("u_status")).otherwise(F.col("status")),
        "applied_at": F.coalesce(time_text(F.col("u_applied_at")), F.col("applied_at")),
        "last_response_at": F.coalesce(time_text(F.col("u_resp_at")), F.col("last_response_at")),
        "last_response_summary": F.coalesce(cell(F.col("u_resp")), F.col("last_response_summary")),
        "notes": F.coalesce(cell(F.col("u_notes")), F.col("notes")),
    }
    return j.select([repl.get(c, F.col(c)).alias(c) for c in snapshot.columns]), rejects


def queued_view(apps: DataFrame, limit: int | None = None) -> DataFrame:
    """Blank status counts as queued; ``limit`` takes the first rows in
    (queued_at, job_id) order."""
    q = apps.filter(current_status(F.col("status")) == "queued")
    return q.orderBy("queued_at", "job_id").limit(limit) if limit is not None else q


def applied_view(apps: DataFrame) -> DataFrame:
    return apps.filter(F.coalesce(F.col("status"), F.lit("")) == "applied")


def watch_set(apps: DataFrame) -> DataFrame:
    """P10: applications whose replies matter: status not blank, queued or skipped."""
    s = F.coalesce(F.col("status"), F.lit(""))
    return apps.filter(~s.isin("", "queued", "skipped"))


def status_counts(apps: DataFrame) -> DataFrame:
    """Applications per status (blank reads as queued)."""
    return apps.groupBy(current_status(F.col("status")).alias("status")).agg(
        F.count(F.lit(1)).alias("n_applications"))


def queue_decisions(apps: DataFrame, *, daily_cap: int, only_with_artifacts: bool = True,
                    auto_advance: bool = True, dropped: DataFrame | None = None) -> DataFrame:
    """Queued rows with an artifact folder are eligible; per queue
    day the first ``daily_cap`` in (queued_at, job_id) order are processed
    (``submitted`` when auto-advancing, else ``kept``); the rest are ``deferred``;
    queued rows without artifacts are ``skipped_no_artifacts``; those whose ``job_id`` is in
    ``dropped`` (the user's decisions) are ``dropped`` and take no place under the cap.

    The cap is a WindowGroupLimit (per-task top ``daily_cap`` before the shuffle),
    so a busy day never sorts in one task; the capped set (cap x days rows) is
    joined back by key."""
    q = apps.filter(current_status(F.col("status")) == "queued").withColumn(
        "queue_day", F.substring(F.col("queued_at"), 1, 10))
    gone = F.lit(False)
    if dropped is not None:
        d = dropped.select(F.col("job_id").alias("_gone")).distinct()
        q, gone = q.join(d, F.col("job_id") == F.col("_gone"), "left"), F.col("_gone").isNotNull()
    has_art = ~_blank(F.col("artifact_dir"))
    eligible = q.filter(~gone & has_art) if only_with_artifacts else q.filter(~gone)
    capped = top_n_per_group(eligible, ["queue_day"], [F.col("queued_at"), F.col("job_id")], daily_cap)
    picked = capped.select("job_id", F.lit(True).alias("_picked"))
    j = q.join(picked, "job_id", "left")
    action = (F.when(gone, "dropped").when(~has_art & F.lit(only_with_artifacts), "skipped_no_artifacts")
              .when(F.col("_picked"), "submitted" if auto_advance else "kept").otherwise("deferred"))
    return j.select("job_id", "queue_day", action.alias("action"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """A10."""
    return decisions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
