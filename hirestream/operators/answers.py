"""Screening answers.

Answers arrive as landed model responses (JSON text, possibly fenced); they are
parsed against an explicit schema, blanks are filled (N4), explicit candidate
preferences override model values (J13), and the result renders to labelled
lines (N5).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# --- fixed values: answer keys (list-valued keys marked) and their labels -----
ANSWER_LABELS = {
    "years_of_total_experience": "Total years of experience",
    "years_of_qc_micro_experience": "Years in QC Microbiology",
    "current_ctc_lpa": "Current CTC (LPA)",
    "expected_ctc_lpa": "Expected CTC (LPA)",
    "notice_period_days": "Notice period (days)",
    "current_location": "Current location",
    "willing_to_relocate_to_job_location": "Willing to relocate?",
    "earliest_join_date": "Earliest join date",
    "highest_qualification": "Highest qualification",
    "regulatory_audits_faced": "Regulatory audits faced",
    "core_techniques": "Core techniques",
    "instruments_handled": "Instruments handled",
    "people_managed": "People managed",
    "why_this_role": "Why this role",
    "open_to_shift_work": "Open to shift work?",
    "screening_red_flags": "Likely recruiter probes",
}
LIST_KEYS = ["regulatory_audits_faced", "core_techniques", "instruments_handled", "screening_red_flags"]
# -----------------------------------------------------------------------------

STRUCT_FIELDS = ", ".join(f"`{k}`: {'array<string>' if k in LIST_KEYS else 'string'}" for k in ANSWER_LABELS)
SCHEMA = ", ".join(f"`{k}` {'array<string>' if k in LIST_KEYS else 'string'}" for k in ANSWER_LABELS)


def parse_answers(df: DataFrame, raw_col: str, out_col: str = "answers") -> DataFrame:
    """N3 + N4: fenced or bare JSON -> answers struct; anything unparseable, and any
    missing key, becomes blank ('' or an empty list).

    Each step is its own column so later expressions reference attributes (no
    expression tree is copied into the sixteen field reads)."""
    d = df.withColumn("_ans_body", tx.strip_code_fences(F.col(raw_col)))
    d = d.withColumn("_ans_parsed", F.when(F.try_parse_json(F.col("_ans_body")).isNotNull(),
                                           F.from_json(F.col("_ans_body"), SCHEMA)))
    p = F.col("_ans_parsed")
    d = d.withColumn(out_col, F.struct(*[
        (F.coalesce(p.getField(k), F.array().cast("array<string>")) if k in LIST_KEYS
         else F.coalesce(p.getField(k), F.lit(""))).alias(k)
        for k in ANSWER_LABELS]))
    return d.drop("_ans_body", "_ans_parsed")


def first_name(explicit: Column, full_name: Column) -> Column:
    """The explicit first name, else the first word of the contact name."""
    first = F.try_element_at(F.split(F.trim(F.coalesce(full_name, F.lit(""))), r"\s+"), F.lit(1))
    return F.coalesce(F.when(F.coalesce(explicit, F.lit("")) != "", explicit), first, F.lit(""))


def apply_preferences(answers: Column, prefs: Column) -> Column:
    """Explicit preferences always win (numbers when present, relocation as a
    boolean, join date when non-empty)."""
    def pick(key, pref):
        return F.when(pref.isNotNull(), pref.cast("string")).otherwise(answers.getField(key))
    relocate = prefs.getField("willing_to_relocate")
    join = prefs.getField("earliest_join_date")
    return (answers
            .withField("current_ctc_lpa", pick("current_ctc_lpa", prefs.getField("current_ctc_lpa")))
            .withField("expected_ctc_lpa", pick("expected_ctc_lpa", prefs.getField("expected_ctc_lpa")))
            .withField("notice_period_days", pick("notice_period_days", prefs.getField("notice_period_days")))
            .withField("willing_to_relocate_to_job_location", F.when(
                relocate.isNotNull(), F.when(relocate, F.lit("True")).otherwise(F.lit("False")))
                .otherwise(answers.getField("willing_to_relocate_to_job_location")))
            .withField("earliest_join_date", F.when(F.coalesce(join, F.lit("")) != "", join)
                       .otherwise(answers.getField("earliest_join_date"))))


def answer_lines(answers: Column) -> Column:
    """Heading plus ``- **Label**: value`` per key; lists comma-joined or
    ``(none)``, blanks ``(blank)``."""
    lines = [F.lit("# Screening answers")]
    for k, label in ANSWER_LABELS.items():
        v = answers.getField(k)
        if k in LIST_KEYS:
            txt = F.when(F.size(v) > 0, F.array_join(v, ", ")).otherwise(F.lit("(none)"))
        else:
            txt = F.when(v != "", v).otherwise(F.lit("(blank)"))
        lines.append(F.concat(F.lit(f"- **{label}**: "), txt))
    return F.array(*lines)
