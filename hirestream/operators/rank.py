"""Candidate x posting scoring and ranking."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.salary import parse_salary
from ..functions.timefn import as_of_epoch, days_whole, posted_epoch, recency_score
from ..functions.vectors import fit_score
from ..plans.strategy import top_n_per_group
from ..session import spooled

DEFAULT_WEIGHTS = (0.45, 0.35, 0.20)


def _col(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def with_salary(postings: DataFrame) -> DataFrame:
    """M5-M7: salary struct per posting."""
    sal = parse_salary(_col(postings, "job_min_salary", "double"),
                       _col(postings, "job_max_salary", "double"),
                       _col(postings, "job_salary_currency"), _col(postings, "job_salary_period"),
                       _col(postings, "job_description"))
    return postings.withColumn("_sal", sal)


def pool_salary_stats(postings_with_salary: DataFrame, pool_col: str = "pool") -> DataFrame:
    """A1: median and population std of salary midpoints per pool, NULLs ignored.

    Rows are first counted per (pool, midpoint), which spreads a pool over all tasks; the
    moments come from (value, count) rows, and the median is the value where the running
    count of the pool's distinct values passes the half, found by two ordered passes over
    those rows instead of one task's state holding the pool."""
    mid = F.col("_sal.mid_lpa")
    counts = postings_with_salary.groupBy(F.col(pool_col), mid.alias("v")).agg(F.count(F.lit(1)).alias("k"))
    known = F.col("v").isNotNull()
    n_known = F.sum(F.when(known, F.col("k")))
    mean = F.sum(F.when(known, F.col("v") * F.col("k"))) / n_known
    totals = counts.groupBy(pool_col).agg(F.sum("k").alias("n_postings"), F.coalesce(n_known, F.lit(0)).cast("long").alias("n_known"),
                                          mean.alias("mean_mid"))
    centred = counts.filter(known).join(totals.select(F.col(pool_col).alias("_p"), "n_known", "mean_mid"), F.col(pool_col) == F.col("_p"))
    spread = centred.groupBy(pool_col).agg(F.sqrt(F.sum(F.col("k") * F.pow(F.col("v") - F.col("mean_mid"), 2)) / F.first("n_known")).alias("std_mid"))
    # values in buckets of the pool's order: a bucket's total is one row, so only the bucket
    # that holds the middle is looked at value by value
    bucket = F.floor("v")
    per_bucket = centred.groupBy(pool_col, "n_known", bucket.alias("b")).agg(F.sum("k").alias("bk"))
    w = Window.partitionBy(pool_col).orderBy("b")
    per_bucket = per_bucket.withColumn("upto", F.sum("bk").over(w)).withColumn("before", F.col("upto") - F.col("bk"))
    lo, hi = F.floor((F.col("n_known") - 1) / 2), F.floor(F.col("n_known") / 2)  # 0-based middle ranks
    holds = per_bucket.filter(((F.col("before") <= lo) & (lo < F.col("upto"))) | ((F.col("before") <= hi) & (hi < F.col("upto"))))
    inside = centred.select(F.col(pool_col), "v", "k", bucket.alias("b")).join(
        holds.select(F.col(pool_col).alias("_p"), F.col("b").alias("_b"), "n_known", "before"),
        (F.col(pool_col) == F.col("_p")) & (F.col("b") == F.col("_b")))
    wv = Window.partitionBy(pool_col, "b").orderBy("v")
    inside = inside.withColumn("end", F.col("before") + F.sum("k").over(wv)).withColumn("begin", F.col("end") - F.col("k"))
    at = lambda rank_: F.max(F.when((F.col("begin") <= rank_) & (rank_ < F.col("end")), F.col("v")))
    median = inside.groupBy(pool_col).agg(((at(lo) + at(hi)) / 2).alias("median_mid"))
    return (totals.select(pool_col, "n_postings", "n_known").join(spread, pool_col, "left").join(median, pool_col, "left"))


SKETCH_K = 400  # of the KLL sketch: its rank error stays below SKETCH_ERROR with high probability
SKETCH_ERROR = 0.02


def salary_sketches(postings_with_salary: DataFrame, by: Sequence[str] = ("pool",)) -> DataFrame:
    """A1 for very large pools: ``by…, n_known, sketch``, a mergeable quantile sketch (KLL) of
    the known salary midpoints. Its size does not depend on the pool's; sketches of parts
    (days, sources) can be kept and merged by :func:`merged_sketches`."""
    known = postings_with_salary.filter(F.col("_sal.mid_lpa").isNotNull())
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_known"), F.kll_sketch_agg_double(F.col("_sal.mid_lpa"), SKETCH_K).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ("pool",)) -> DataFrame:
    """Sketches of parts as one per ``by``."""
    return sketches.groupBy(*by).agg(F.sum("n_known").alias("n_known"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantile(sketch: Column, rank: float = 0.5) -> Column:
    """A value whose rank is within ``SKETCH_ERROR`` of ``rank``."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(rank))


def score_postings(postings: DataFrame, *, as_of, pool_col: str = "pool") -> DataFrame:
    """Candidate-independent scores: salary (M2) and recency (M3), per posting."""
    as_of_s = as_of_epoch(as_of)
    p = with_salary(postings)
    stats = pool_salary_stats(p, pool_col).select(pool_col, "n_known", "median_mid", "std_mid")
    # One row per pool; Spark broadcasts it when it has measured it to be small, and splits
    # a pool that holds a third of all postings otherwise.
    p = p.join(stats, pool_col, "left")
    med = F.col("median_mid")
    sd = F.coalesce(F.when(F.col("std_mid") != 0, F.col("std_mid")), F.lit(1.0))
    z = (F.coalesce(F.col("_sal.mid_lpa"), med) - med) / sd
    salary_score = F.when(F.col("n_known") == 0, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-z)))
    epoch = posted_epoch(_col(p, "job_posted_at_timestamp", "long"),
                         _col(p, "job_posted_at_datetime_utc"))
    days = days_whole(as_of_s, epoch)
    return (p.withColumn("posted_days_ago", days)
             .withColumn("_salary_score", salary_score)
             .withColumn("_recency_score", recency_score(days))
             .drop("n_known", "median_mid", "std_mid"))


def rank_postings(postings: DataFrame, candidates: DataFrame, *, as_of,
                  weights: Sequence[float] = DEFAULT_WEIGHTS, pool_col: str = "pool",
                  posting_vec: str = "embedding", candidate_vec: str = "cand_embedding",
                  candidate_id: str = "candidate_id", splits: int = 1, recruiter_penalty: float = 0.0) -> DataFrame:
    """Score every posting against every candidate of the same pool (an equi-join
    on the pool key: postings are blocked by role, never crossed with all
    candidates). ``splits`` cuts each pool's postings into that many parts by job id and
    sends its candidates to each, so that few large pools use many tasks. Postings flagged
    as a recruiter's (P1e, ``_is_third_party_recruiter``) lose ``recruiter_penalty`` of their
    composite. Returns the ranked projection P3 plus ``candidate_id``/``pool``."""
    s = score_postings(postings, as_of=as_of, pool_col=pool_col)
    part = _part(splits)
    cands = candidates.select(F.col(pool_col).alias("_cand_pool"), candidate_id, candidate_vec,
                              F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("_cand_part"))
    j = s.withColumn("_part", part).join(cands, (F.col(pool_col) == F.col("_cand_pool")) & (F.col("_part") == F.col("_cand_part")), "inner")
    fit = fit_score(F.col(posting_vec), F.col(candidate_vec))
    return _projection(j, fit, weights, pool_col, candidate_id, recruiter_penalty)


def _part(splits: int) -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(splits)).cast("int")


def _composite(fit: Column, weights: Sequence[float]) -> Column:
    """M4."""
    w_fit, w_sal, w_rec = weights
    return (w_fit * fit + w_sal * F.col("_salary_score") + w_rec * F.col("_recency_score")) / (w_fit + w_sal + w_rec)


def _projection(j: DataFrame, fit: Column, weights: Sequence[float], pool_col: str, candidate_id: str, recruiter_penalty: float = 0.0) -> DataFrame:
    """P3 of scored postings joined with their candidates."""
    composite = _composite(fit, weights)
    if recruiter_penalty:
        composite = composite - F.when(F.coalesce(_col(j, "_is_third_party_recruiter", "boolean"), F.lit(False)), recruiter_penalty).otherwise(0.0)
    return j.select(
        F.col(candidate_id), F.col(pool_col).alias("pool"),
        F.col("job_id"),
        F.coalesce(_col(j, "job_title"), F.lit("")).alias("title"),
        F.coalesce(_col(j, "employer_name"), F.lit("")).alias("company"),
        F.coalesce(F.when(_col(j, "job_city") != "", _col(j, "job_city")),
                   _col(j, "_source_location"), F.lit("")).alias("city"),
        F.coalesce(_col(j, "job_state"), F.lit("")).alias("state"),
        F.coalesce(_col(j, "job_is_remote", "boolean"), F.lit(False)).alias("remote"),
        F.col("posted_days_ago"),
        F.col("_sal.min_lpa").alias("salary_min_lpa"),
        F.col("_sal.max_lpa").alias("salary_max_lpa"),
        F.col("_sal.mid_lpa").alias("salary_mid_lpa"),
        F.col("_sal.source").alias("salary_source"),
        F.round(fit, 4).alias("fit_score"),
        F.round(F.col("_salary_score"), 4).alias("salary_score"),
        F.round(F.col("_recency_score"), 4).alias("recency_score"),
        F.round(composite, 4).alias("composite_score"),
        F.coalesce(F.when(_col(j, "job_apply_link") != "", _col(j, "job_apply_link")),
                   _col(j, "job_google_link"), F.lit("")).alias("apply_link"),
    )


LEVELS = 64  # of what salary and recency can add to a composite
HEAD_ROWS = 256  # postings of a pool that every candidate is scored against


def levelled(postings: DataFrame, weights: Sequence[float], posting_vec: str, pool_col: str = "pool") -> DataFrame:
    """``job_id, pool, vec, _salary_score, _recency_score, level`` of scored postings: level 0
    has the best salary and recency; a posting's composite is at most :func:`_most`."""
    _, w_sal, w_rec = weights
    known = (w_sal * F.col("_salary_score") + w_rec * F.col("_recency_score")) / F.lit(float((w_sal + w_rec) or 1))
    level = F.least(F.greatest(F.floor((1 - known) * LEVELS), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    return postings.select("job_id", F.col(pool_col).alias("pool"), F.col(posting_vec).alias("vec"), "_salary_score", "_recency_score", level.alias("level"))


def _most(level: Column, weights: Sequence[float]) -> Column:
    """The best composite of a level, with a perfect fit; rounding may add half a place."""
    w_fit, w_sal, w_rec = weights
    return (w_fit + (w_sal + w_rec) * (1 - level / LEVELS)) / (w_fit + w_sal + w_rec) + 1e-4


def head_levels(rows: DataFrame, head_rows: int) -> DataFrame:
    """``pool, level, n, head`` per level of a pool: the best levels that together have
    ``head_rows`` postings are its head. A pool has at most ``LEVELS`` rows here."""
    counts = rows.groupBy("pool", "level").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pool").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("head", before < head_rows)


def open_levels(best: DataFrame, candidates: DataFrame, levels: DataFrame, weights: Sequence[float], n: int) -> DataFrame:
    """``candidate_id, pool, level``: levels behind the head in which a posting could still
    be among a candidate's ``n`` best, given its ``best`` of the head."""
    last = best.filter(F.col("rank") == n).select("candidate_id", "pool", F.col("composite_score").alias("least"))
    rest = candidates.select("candidate_id", "pool").join(levels.filter(~F.col("head")).select("pool", "level"), "pool")
    return (rest.join(last, ["candidate_id", "pool"], "left")
                .filter(F.col("least").isNull() | (_most(F.col("level"), weights) >= F.col("least"))).select("candidate_id", "pool", "level"))


def best_per_candidate(postings: DataFrame, candidates: DataFrame, *, as_of, n: int, weights: Sequence[float] = DEFAULT_WEIGHTS,
                       pool_col: str = "pool", posting_vec: str = "embedding", candidate_vec: str = "cand_embedding",
                       candidate_id: str = "candidate_id", splits: int = 1, head_rows: int = HEAD_ROWS) -> DataFrame:
    """J1/F1 without all pairs: the ``n`` best postings of every candidate, as
    ``top_n_per_candidate(rank_postings(...))`` gives them.

    Salary and recency are known before any pair is made, and a fit is at most 1, so
    postings fall into levels by the best composite they can have. Candidates are scored
    against the head of their pool, then against those levels alone that can still reach
    their n-th score. Attributes are joined to the winners only."""
    scored = score_postings(postings, as_of=as_of, pool_col=pool_col)
    rows = spooled(levelled(scored, weights, posting_vec, pool_col))
    cands = spooled(candidates.select(F.col(candidate_id).alias("candidate_id"), F.col(pool_col).alias("pool"), F.col(candidate_vec).alias("cand_vec")))
    levels = spooled(head_levels(rows, head_rows))
    parts = F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("part")
    dealt = rows.withColumn("part", _part(splits))

    def scores(j: DataFrame) -> DataFrame:
        fit = fit_score(F.col("vec"), F.col("cand_vec"))
        return j.select("candidate_id", "pool", "job_id", fit.alias("fit"), F.round(_composite(fit, weights), 4).alias("composite_score"))

    group = ["candidate_id", "pool"]
    head = dealt.join(levels.filter("head").select("pool", "level"), ["pool", "level"])
    best = spooled(top_n_per_group(scores(head.join(cands.select("*", parts), ["pool", "part"])), group, rank_order(), n))
    more = open_levels(best, cands, levels, weights, n).join(cands, group).select("*", parts)
    rest = scores(dealt.join(more, ["pool", "level", "part"]))
    top = top_n_per_group(best.drop("rank").unionByName(rest), group, rank_order(), n, "_rank").withColumnRenamed("job_id", "_job").withColumnRenamed("pool", "_pool")
    won = scored.join(top.withColumnRenamed("candidate_id", "_cand"), (F.col("job_id") == F.col("_job")) & (F.col(pool_col) == F.col("_pool")))
    out = _projection(won.withColumn(candidate_id, F.col("_cand")), F.col("fit"), weights, pool_col, candidate_id)
    w = Window.partitionBy(candidate_id, "pool").orderBy(*rank_order())
    return out.withColumn("rank", F.row_number().over(w))


def rank_order() -> list[Column]:
    """Composite (already rounded) descending, then job id: a total order."""
    return [F.col("composite_score").desc(), F.col("job_id").asc()]


def top_n(ranked: DataFrame, n: int = 15) -> DataFrame:
    """F1 for one candidate: TakeOrderedAndProject (per-task top-n, then merge)."""
    return ranked.orderBy(*rank_order()).limit(n)


def top_n_per_candidate(ranked: DataFrame, n: int = 15,
                        group_cols: Sequence[str] = ("candidate_id", "pool")) -> DataFrame:
    """F1 per candidate/pool via WindowGroupLimit."""
    return top_n_per_group(ranked, list(group_cols), rank_order(), n)


def role_summary(top: DataFrame, group_col: str = "pool", keywords: DataFrame | None = None, gaps: DataFrame | None = None,
                 reports: DataFrame | None = None) -> DataFrame:
    """Best salary (NULL -> 0, T23), median salary of the top rows, best composite and
    its job, row count; given ``keywords`` (pool, tier) the number of critical ones, given
    ``gaps`` (pool, n_must_add) the mean number to add, and given ``reports`` (pool,
    before_pct, after_pct) the mean scores and their difference. Top rows are few per
    group, so their median is taken as it is."""
    out = (top.groupBy(group_col)
           .agg(F.count(F.lit(1)).alias("n_ranked"),
                F.coalesce(F.max("salary_mid_lpa"), F.lit(0.0)).alias("best_salary_lpa"),
                F.median("salary_mid_lpa").alias("median_top_salary_lpa"),
                F.max("composite_score").alias("best_composite"),
                F.max_by("job_id", F.struct(F.col("composite_score"), -F.col("job_id"))).alias("best_job_id"),
                F.round(F.avg("fit_score"), 4).alias("avg_fit")))
    if keywords is not None:
        out = out.join(keywords.groupBy(F.col("pool").alias(group_col)).agg(F.count_if(F.col("tier") == "critical").alias("n_critical")), group_col, "left")
    if gaps is not None:
        out = out.join(gaps.groupBy(F.col("pool").alias(group_col)).agg(round_half_up(F.avg("n_must_add"), 2).alias("mean_must_add")), group_col, "left")
    if reports is not None:
        r = reports.groupBy(F.col("pool").alias(group_col)).agg(round_half_up(F.avg("before_pct"), 1).alias("before_pct"),
                                                               round_half_up(F.avg("after_pct"), 1).alias("after_pct"))
        out = out.join(r.withColumn("delta", round_half_up(F.col("after_pct") - F.col("before_pct"), 1)), group_col, "left")
    return out
