"""Report tables and texts: cells (P5), salary display (P15), top-jobs table (P16), landed
salary overlay (J11), role summaries on presets (J12), best role (F9), letters (N8)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.salary import fx_rate
from .rank import with_salary


def render_cell(c: Column, dtype: str) -> Column:
    """P5: NULL -> '', list -> ', '-joined, bool -> TRUE/FALSE, else text."""
    if dtype.startswith("array"):
        return F.coalesce(F.array_join(c, ", "), F.lit(""))
    if dtype == "boolean":
        return F.when(c.isNull(), F.lit("")).when(c, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    return F.coalesce(c.cast("string"), F.lit(""))


def as_cells(df: DataFrame) -> DataFrame:
    """P5 for every column."""
    return df.select(*[render_cell(F.col(n), t).alias(n) for n, t in df.dtypes])


def salary_text(lo: Column, hi: Column) -> Column:
    """``₹lo-hiL``, a single value, or a dash."""
    lo, hi = round_half_up(lo, 1), round_half_up(hi, 1)
    return (F.when(lo.isNotNull() & hi.isNotNull() & (lo != hi), F.format_string("₹%.1f-%.1fL", lo, hi))
            .when(F.coalesce(lo, hi).isNotNull(), F.format_string("₹%.1fL", F.coalesce(lo, hi))).otherwise(F.lit("—")))


def top_jobs_table(top: DataFrame) -> DataFrame:
    """Ranked rows as a report table."""
    return top.select("pool", "rank", "title", "company", "city",
                      salary_text(F.col("salary_min_lpa"), F.col("salary_max_lpa")).alias("salary"),
                      F.format_string("%.4f", F.col("composite_score")).alias("score"),
                      F.when(F.col("remote"), "remote").otherwise("onsite").alias("mode"))


def salary_overlay(postings: DataFrame, extracted: DataFrame) -> DataFrame:
    """Salaries by priority structured > free text > landed extraction > missing.
    ``extracted`` is ``(job_id, x_min, x_max, x_cur)`` in lakh already, never divided
    again."""
    j = with_salary(postings).select("job_id", "_sal").join(extracted, "job_id", "left")
    use = (F.col("_sal.source") == "missing") & F.coalesce("x_min", "x_max").isNotNull()
    lo = F.when(use, F.round(F.col("x_min") * fx_rate(F.col("x_cur")), 2)).otherwise(F.col("_sal.min_lpa"))
    hi = F.when(use, F.round(F.col("x_max") * fx_rate(F.col("x_cur")), 2)).otherwise(F.col("_sal.max_lpa"))
    return j.select("job_id", lo.alias("salary_min_lpa"), hi.alias("salary_max_lpa"),
                    F.coalesce((lo + hi) / 2, lo, hi).alias("salary_mid_lpa"),
                    F.when(use, F.lit("llm")).otherwise(F.col("_sal.source")).alias("salary_source"))


def attach_summaries(presets: DataFrame, summaries: DataFrame) -> DataFrame:
    """Role presets (``role_slug, pool``) with their pool's summary: a preset without
    postings yields an error row, a pool without a preset is kept under its key."""
    j = presets.join(summaries, "pool", "full_outer")
    return j.select(F.coalesce("role_slug", F.concat(F.lit("pool_"), F.col("pool"))).alias("role_slug"), "pool",
                    F.coalesce("n_ranked", F.lit(0)).cast("long").alias("n_ranked"), "best_salary_lpa", "best_composite",
                    F.when(F.col("n_ranked").isNull(), F.lit("no postings")).otherwise(F.lit("")).alias("error"))


def best_role(summaries: DataFrame) -> DataFrame:
    """the pool with the best composite (ties: lowest pool)."""
    return summaries.orderBy(F.col("best_composite").desc(), F.col("pool")).limit(1).select("pool", "best_composite")


def letter_lines(resume: Column, body: Column, company: Column, first_name: Column, as_of: Column) -> Column:
    """A dated letter as ordered lines: sender, date, recipient, salutation, the body's
    paragraphs, sign-off with the first name. ``as_of`` is the letter's date."""
    contact = resume.getField("contact")
    paras = F.filter(F.transform(F.split(body, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.concat(F.array(contact.getField("name"), contact.getField("email"), F.date_format(as_of, "dd MMMM yyyy"), F.lit(""),
                            F.lit("Hiring Manager"), F.coalesce(company, F.lit("")), F.lit(""), F.lit("Dear Hiring Manager,")),
                    paras, F.array(F.lit("Sincerely,"), first_name))
