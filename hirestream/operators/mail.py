"""Inbound messages -> verdicts -> monotone application statuses
(Q4, Q5, J6, J8, M8, W4 batch form).

A landed model verdict can replace the rule labeller: both produce
``(msg_id, label, matched_company, confidence, evidence)`` rows that
:func:`validate_verdicts` checks before anything is applied.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import LABEL_PRECEDENCE, MAIL_LABELS, current_status, status_rank

# --- fixed values: default evidence rules (label, pattern, confidence) --------
DEFAULT_RULES = [
    ("offer", r"(?i)(offer letter|pleased to offer|job offer|congratulations on your selection|joining formalities)", 0.9),
    ("interviewing", r"(?i)(interview|panel|technical round|assignment)", 0.9),
    ("screening", r"(?i)(notice period|current ctc|expected ctc|phone screen|screening call|availability for a call)", 0.9),
    ("viewed", r"(?i)(application (has been )?received|reviewing your (profile|application))", 0.9),
    ("rejected", r"(?i)(not be moving forward|not moving forward|position has been filled|other candidates)", 0.9),
]
# -----------------------------------------------------------------------------


def label_messages(messages: DataFrame, *, rules: Sequence[tuple[str, str, float]] = DEFAULT_RULES,
                   body_col: str = "body", company_col: str | None = None,
                   max_evidence: int | None = None) -> DataFrame:
    """Q4: the highest-precedence rule whose pattern occurs in the body decides the
    label (offer > interviewing > screening > viewed > rejected); the evidence is the
    verbatim matched text, cut only if the caller sets ``max_evidence``. No rule, or no
    matched company when a company column is given, means ``irrelevant``. Patterns are
    literals, compiled once per task."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    label, confidence, evidence = F.lit("irrelevant"), F.lit(0.0), F.lit("")
    for name, pattern, conf in sorted(rules, key=lambda r: LABEL_PRECEDENCE.index(r[0]), reverse=True):
        hit = body.rlike(pattern)
        label = F.when(hit, F.lit(name)).otherwise(label)
        confidence = F.when(hit, F.lit(float(conf))).otherwise(confidence)
        evidence = F.when(hit, F.regexp_substr(body, F.lit(pattern))).otherwise(evidence)
    if company_col:
        known = F.coalesce(F.col(company_col), F.lit("")) != ""
        label = F.when(known, label).otherwise(F.lit("irrelevant"))
        confidence = F.when(known, confidence).otherwise(F.lit(0.0))
        evidence = F.when(known, evidence).otherwise(F.lit(""))
    if max_evidence is not None:
        evidence = F.substring(evidence, 1, max_evidence)
    return messages.select("*", label.alias("label"), confidence.alias("confidence"), evidence.alias("evidence_snippet"))


def validate_verdicts(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q5: labels are trimmed/lower-cased; rows outside the label domain are rejected."""
    v = verdicts.withColumn("label", F.lower(F.trim(F.col("label"))))
    ok = F.col("label").isin(MAIL_LABELS)
    return v.filter(ok), v.filter(~ok | F.col("label").isNull())


GRAM = 3


def _pieces(s: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of ``s``."""
    last = F.length(s) - (n - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(s, i, n)))) \
            .otherwise(F.array().cast("array<string>"))


def _rarest(needles: DataFrame, frequency: DataFrame) -> DataFrame:
    """``needle, gram``: of each needle the run of ``GRAM`` characters that the fewest known
    names have; needles with a run that none has are in no known name and are left out by
    the caller's join."""
    g = needles.select("needle", F.explode(_pieces(F.col("needle"), GRAM)).alias("gram")).join(frequency, "gram", "left")
    return g.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("needle", "g.gram")


def match_companies(verdicts: DataFrame, known: DataFrame, *, verdict_col: str = "matched_company",
                    known_col: str = "company", order_col: str = "company_order") -> DataFrame:
    """A verdict company matches a known company when either contains the other
    (both lower-cased and trimmed); the first known company in ``order_col`` order wins.
    Returns ``(verdict, company)``.

    A substring index of runs of ``GRAM`` characters: a name can only be inside another that
    has the rarest of its runs, so it is looked up by that run and then verified. Every text
    gives as many rows as it has characters, however long a verdict is. Names shorter than a
    run are looked up whole among the other side's short runs, of which only the first known
    company is kept."""
    v = (verdicts.select(F.lower(F.trim(F.col(verdict_col))).alias("verdict")).distinct()
         .filter(F.col("verdict") != ""))
    k = (known.select(F.lower(F.trim(F.col(known_col))).alias("company"), F.col(order_col).alias("ord"))
         .filter(F.col("company") != "")
         .groupBy("company").agg(F.min("ord").alias("ord")))
    k_grams = k.select("company", "ord", F.explode(_pieces(F.col("company"), GRAM)).alias("gram"))
    frequency = k_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # known names inside a verdict
    k_by = _rarest(k.filter(F.length("company") >= GRAM).select(F.col("company").alias("needle")), frequency).withColumnRenamed("needle", "company")
    v_grams = v.select("verdict", F.explode(_pieces(F.col("verdict"), GRAM)).alias("gram"))
    inside = v_grams.join(k_by, "gram").filter(F.contains("verdict", "company")).select("verdict", "company").join(k, "company")
    # verdicts inside a known name
    v_by = _rarest(v.filter(F.length("verdict") >= GRAM).select(F.col("verdict").alias("needle")), frequency).withColumnRenamed("needle", "verdict")
    around = v_by.join(k_grams, "gram").filter(F.contains("company", "verdict"))
    # names shorter than a run, on either side
    def short(name: str) -> Column:
        return F.explode(F.flatten(F.array(*[_pieces(F.col(name), n) for n in range(1, GRAM)])))

    v_short = v.select("verdict", short("verdict").alias("company")).join(k, "company")
    first = (k.select("company", "ord", short("company").alias("verdict"))
              .groupBy("verdict").agg(F.min(F.struct("ord", "company")).alias("f")).select("verdict", "f.company", "f.ord").join(v, "verdict"))
    columns = ["verdict", "company", "ord"]
    cands = inside.select(columns).unionByName(around.select(columns)).unionByName(v_short.select(columns)).unionByName(first.select(columns))
    best = cands.groupBy("verdict").agg(F.min(F.struct("ord", "company")).alias("m"))
    return best.select("verdict", F.col("m.company").alias("company"))


def fold_statuses(applications: DataFrame, events: DataFrame, *, key_col: str = "job_id",
                  label_col: str = "label", ts_col: str = "received_at", id_col: str = "msg_id",
                  default_status: str = "applied") -> DataFrame:
    """The final status of each application after its messages.

    Sequentially a message advances the status only to a strictly higher rank;
    the result is therefore the earliest message of the highest rank above the
    starting rank (offer and rejected share rank 5: the earlier one stays). As an
    aggregate: ``max(struct(rank, -time, -id))`` over qualifying messages, which
    combines map-side and is independent of arrival order."""
    apps = applications.select(F.col(key_col).alias("_k"),
                               current_status(F.col("status"), default_status).alias("start_status"))
    ev = events.select(F.col(key_col).alias("_k"), F.col(label_col).alias("_label"),
                       F.col(ts_col).alias("_ts"), F.col(id_col).alias("_id"))
    j = ev.join(apps, "_k")
    r = status_rank(F.col("_label"))
    cand = F.when(r > status_rank(F.col("start_status")),
                  F.struct(r.alias("rank"), (-F.unix_micros(F.col("_ts").cast("timestamp"))).alias("nts"),
                           (-F.col("_id")).alias("nid"), F.col("_label").alias("status"),
                           F.col("_ts").alias("ts")))
    agg = j.groupBy("_k").agg(F.max(cand).alias("best"), F.count(F.lit(1)).alias("n_messages"),
                              F.count(cand).alias("n_candidates"))
    out = apps.join(agg, "_k", "left")
    return out.select(
        F.col("_k").alias(key_col), "start_status",
        F.coalesce(F.col("best.status"), F.col("start_status")).alias("status"),
        F.coalesce(F.col("best.rank"), status_rank(F.col("start_status"))).alias("status_rank"),
        F.unix_micros(F.col("best.ts").cast("timestamp")).alias("advanced_at_us"),
        F.coalesce(F.col("n_messages"), F.lit(0)).cast("long").alias("n_messages"),
        F.coalesce(F.col("n_candidates"), F.lit(0)).cast("long").alias("n_candidates"))
