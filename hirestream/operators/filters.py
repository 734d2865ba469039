"""Posting filters and dedupe."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.salary import floor_mid_lpa
from ..functions.timefn import as_of_epoch, days_fractional, posted_epoch
from ..plans.strategy import first_per_key, null_last

DROP_REASONS = ["blacklist", "stale", "crowded", "low_salary"]


def _col(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _any_substring(hay: Column, needles: Sequence[str]) -> Column:
    arr = F.array(*[F.lit(n.lower()) for n in needles])
    return F.exists(arr, lambda n: F.contains(hay, n))


def filter_cascade(postings: DataFrame, *, as_of, max_age_days: float = 21,
                   max_applicants: int | None = 200, employer_blacklist: Sequence[str] | None = None,
                   salary_floor_lpa: float | None = None,
                   recruiter_keywords: Sequence[str] | None = None) -> DataFrame:
    """One pass; the first failing test claims the row (blacklist, stale,
    crowded, low salary). Adds ``drop_reason`` (NULL = kept),
    ``_is_third_party_recruiter`` and ``_days_since_posted``."""
    as_of_s = as_of_epoch(as_of)
    emp = F.lower(F.trim(F.coalesce(_col(postings, "employer_name"), F.lit(""))))
    age = days_fractional(as_of_s, posted_epoch(_col(postings, "job_posted_at_timestamp", "long"),
                                                _col(postings, "job_posted_at_datetime_utc")))
    false = F.lit(False)
    blacklisted = _any_substring(emp, employer_blacklist) if employer_blacklist else false
    stale = F.coalesce(age > F.lit(float(max_age_days)), false)
    crowded = (F.coalesce(_col(postings, "_applicant_count", "int") > max_applicants, false)
               if max_applicants is not None else false)
    if salary_floor_lpa is not None:
        mid = floor_mid_lpa(_col(postings, "job_min_salary", "double"),
                            _col(postings, "job_max_salary", "double"),
                            _col(postings, "job_salary_currency"), _col(postings, "job_salary_period"))
        low = F.coalesce(mid < F.lit(float(salary_floor_lpa)), false)
    else:
        low = false
    reason = (F.when(blacklisted, "blacklist").when(stale, "stale").when(crowded, "crowded")
              .when(low, "low_salary"))
    recruiter = (_any_substring(emp, recruiter_keywords) if recruiter_keywords else false)
    return (postings.withColumn("drop_reason", reason)
            .withColumn("_is_third_party_recruiter", reason.isNull() & recruiter)
            .withColumn("_days_since_posted", age))


def dedupe_key(df: DataFrame) -> Column:
    """U4 key: lower/trim employer | title (whitespace collapsed) | city."""
    def part(name: str) -> Column:
        return F.lower(F.trim(F.coalesce(_col(df, name), F.lit(""))))
    title = F.regexp_replace(part("job_title"), r"\s+", " ")
    return F.concat_ws("|", part("employer_name"), title, part("job_city"))


def dedupe_freshest(df: DataFrame, order_col: str = "_ord", payload: Sequence[str] | None = None) -> DataFrame:
    """U4: per key keep the youngest posting; unknown age loses; equal ages prefer the
    longer description, then the earlier row (``order_col``). Rows whose key is
    wholly blank are never merged (T18). Ages are frozen at ``as_of`` (T5)."""
    key = dedupe_key(df)
    blank = F.regexp_replace(key, r"\|", "") == ""
    k = F.when(blank, F.concat(F.lit("_uniq_"), F.col(order_col).cast("string"))).otherwise(key)
    keyed = df.withColumn("_dkey", k).withColumn(
        "_dlen", F.length(F.coalesce(_col(df, "job_description"), F.lit(""))))
    payload = list(payload or df.columns)
    order = [null_last(F.col("_days_since_posted")), -F.col("_dlen"), F.col(order_col)]
    return first_per_key(keyed, ["_dkey"], order, payload)


def filter_postings(postings: DataFrame, *, as_of, order_col: str = "_ord", link_status: DataFrame | None = None,
                    **params) -> DataFrame:
    """P1, then U4 (one survivor per dedupe key), then, given landed probes, P2."""
    c = filter_cascade(postings, as_of=as_of, **params)
    kept = dedupe_freshest(c.filter(F.col("drop_reason").isNull()), order_col=order_col)
    return kept if link_status is None else drop_dead_links(kept, link_status)


def filter_stats(postings: DataFrame, *, as_of, order_col: str = "_ord", link_status: DataFrame | None = None,
                 **params) -> DataFrame:
    """A2: one row of counters of the run that :func:`filter_postings` makes: rows per
    drop reason, duplicates collapsed, links dropped, output. Counts of the cascade and of
    the survivors are one row each and added up."""
    c = filter_cascade(postings, as_of=as_of, **params)
    kept = dedupe_freshest(c.filter(F.col("drop_reason").isNull()), order_col=order_col)
    dead = F.lit(False)
    if link_status is not None:
        kept, dead = link_health(kept, link_status), ~F.col("link_alive")
    zero = F.lit(0).cast("long")
    reason = lambda r: F.count_if(F.col("drop_reason") == r)
    cascade = c.agg(
        F.count(F.lit(1)).alias("input"), reason("stale").alias("dropped_stale"), reason("crowded").alias("dropped_crowded"),
        reason("blacklist").alias("dropped_blacklist"), reason("low_salary").alias("dropped_low_salary"),
        F.count_if(F.col("_is_third_party_recruiter")).alias("flagged_recruiter"),
        F.count_if(F.col("drop_reason").isNull()).alias("survivors"), zero.alias("deduped"), zero.alias("dropped_broken_link"))
    after = kept.agg(F.count(F.lit(1)).alias("deduped"), F.count_if(dead).alias("dropped_broken_link"))
    after = after.select(*[F.col(n) if n in after.columns else zero.alias(n) for n in cascade.columns])
    total = cascade.unionByName(after).agg(*[F.sum(n).cast("long").alias(n) for n in cascade.columns])
    return total.select("input", "dropped_stale", "dropped_crowded", "dropped_broken_link", "dropped_blacklist",
                        "dropped_low_salary", (F.col("survivors") - F.col("deduped")).alias("collapsed_duplicates"),
                        "flagged_recruiter", (F.col("deduped") - F.col("dropped_broken_link")).alias("output"))


def link_health(postings: DataFrame, link_status: DataFrame, url_col: str = "job_apply_link") -> DataFrame:
    """P2's flag ``link_alive``: an empty link, or one whose landed probe is 2xx/3xx (a 405
    on HEAD is decided by the GET probe). A link without a probe is dead; of several
    probes of one URL any that answers counts."""
    code = F.when(F.col("head_status") == 405, F.col("get_status")).otherwise(F.col("head_status"))
    probes = (link_status.groupBy(F.col("url").alias("_url")).agg(F.max(F.coalesce(code.between(200, 399), F.lit(False))).alias("_ok")))
    j = postings.join(probes, F.col(url_col) == F.col("_url"), "left")
    blank = F.coalesce(F.col(url_col), F.lit("")) == ""
    return j.withColumn("link_alive", blank | F.coalesce(F.col("_ok"), F.lit(False))).drop("_url", "_ok")


def drop_dead_links(postings: DataFrame, link_status: DataFrame, url_col: str = "job_apply_link") -> DataFrame:
    """The rows whose link is alive."""
    return link_health(postings, link_status, url_col).filter("link_alive").drop("link_alive")


def merge_sources(pools: Sequence[DataFrame], order_col: str = "_ord", payload: Sequence[str] | None = None) -> DataFrame:
    """Union of pools in order; first row wins per ``job_id``, or per the U4
    key when the id is blank (wholly blank rows all share one key, T18)."""
    tagged = [p.withColumn("_pool_ord", F.lit(i)) for i, p in enumerate(pools)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    jid = F.trim(F.coalesce(F.col("job_id").cast("string"), F.lit("")))
    key = F.when(jid != "", F.concat(F.lit("id:"), jid)).otherwise(F.concat(F.lit("k:"), dedupe_key(u)))
    payload = list(payload or [c for c in u.columns])
    return first_per_key(u.withColumn("_mkey", key), ["_mkey"],
                         [F.col("_pool_ord"), F.col(order_col)], payload)


def source_dedupe_key(df: DataFrame) -> Column:
    """job_id, else apply link, else sha1(title + employer + city)."""
    jid = F.coalesce(F.col("job_id").cast("string"), F.lit(""))
    link = F.coalesce(_col(df, "job_apply_link"), F.lit(""))
    h = F.sha1(F.concat(F.coalesce(_col(df, "job_title"), F.lit("")),
                        F.coalesce(_col(df, "employer_name"), F.lit("")),
                        F.coalesce(_col(df, "job_city"), F.lit(""))))
    return F.when(jid != "", jid).when(link != "", link).otherwise(h)


def dedupe_in_source(postings: DataFrame, order_col: str = "_ord", payload: Sequence[str] | None = None) -> DataFrame:
    """Of rows that share :func:`source_dedupe_key` the first in ``order_col``."""
    return first_per_key(postings.withColumn("_skey", source_dedupe_key(postings)), ["_skey"], [F.col(order_col)],
                         list(payload or postings.columns))


def board_key(df: DataFrame) -> Column:
    """U3 key: lower-case employer | title | city."""
    return F.concat_ws("|", *[F.lower(F.coalesce(_col(df, c), F.lit(""))) for c in ("employer_name", "job_title", "job_city")])


def dedupe_boards(aliases: Sequence[DataFrame], order_col: str = "_ord", payload: Sequence[str] | None = None) -> DataFrame:
    """Per role alias the first row of each board key, then, over the aliases in their
    order, the first row of each ``job_id``. Two combined aggregations; no row is compared
    with another."""
    columns = list(payload or aliases[0].columns)
    need = list(dict.fromkeys([*columns, "job_id", order_col]))
    firsts = [first_per_key(a.withColumn("_bkey", board_key(a)), ["_bkey"], [F.col(order_col)], need)
              .select(*need, F.lit(i).alias("_alias_ord")) for i, a in enumerate(aliases)]
    pooled = firsts[0]
    for f in firsts[1:]:
        pooled = pooled.unionByName(f)
    pooled = pooled.withColumn("_jkey", F.coalesce(F.col("job_id").cast("string"), F.lit("")))
    return first_per_key(pooled, ["_jkey"], [F.col("_alias_ord"), F.col(order_col)], ["_alias_ord", *columns])
