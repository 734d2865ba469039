"""Application status domain and precedence."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
VALID_STATUSES = ["queued", "applied", "viewed", "screening", "interviewing", "offer",
                  "rejected", "withdrawn", "skipped"]
STATUS_RANK = {"queued": 0, "applied": 1, "viewed": 2, "screening": 3, "interviewing": 4,
               "offer": 5, "rejected": 5, "skipped": -1, "withdrawn": -1}
UNKNOWN_RANK = -2
MAIL_LABELS = ["viewed", "screening", "interviewing", "offer", "rejected", "irrelevant"]
# Label precedence when several pieces of evidence are present (highest first).
LABEL_PRECEDENCE = ["offer", "interviewing", "screening", "viewed", "rejected", "irrelevant"]
# Columns an upsert never overwrites on an existing application.
PROTECTED_COLUMNS = ["status", "queued_at", "applied_at", "last_response_at",
                     "last_response_summary", "notes"]
# -----------------------------------------------------------------------------


def status_rank(status: Column) -> Column:
    m = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, status), F.lit(UNKNOWN_RANK))


def current_status(status: Column, default: str = "queued") -> Column:
    """Blank status reads as ``default`` (a blank sheet cell reads back as queued)."""
    return F.coalesce(F.when(F.trim(status) != "", F.lower(F.trim(status))), F.lit(default))
