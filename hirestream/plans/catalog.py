"""Registered queries: each binds one or more operators to the driver tables.

Every entry is ``fn(spark, sf_dir) -> DataFrame`` and reads whole tables. The
matching DuckDB SQL lives in :mod:`hirestream.plans.oracle` under the same name.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.salary import floor_mid_lpa
from ..functions.timefn import days_fractional, days_whole, recency_score
from ..functions.vectors import fit_score
from ..operators import filters, rank, reports
from ..session import cut_lineage, scratch_path, spooled
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# Parameters of the filter binding (shared with the oracle SQL).
FILTER_PARAMS = dict(max_age_days=400, max_applicants=350, employer_blacklist=["build"],
                     salary_floor_lpa=15.0, recruiter_keywords=["auto"])


# ---------------------------------------------------------------- ranking ----

@query("rank_top")
def rank_top(spark, sf_dir):
    """Flagship: one candidate (lowest embedding id) against every embedded posting;
    top 15 by composite score."""
    p = T.embedded_postings(spark, sf_dir).withColumn("pool", F.lit("all"))
    ranked = rank.rank_postings(p, T.single_candidate(spark, sf_dir), as_of=T.AS_OF)
    return rank.top_n(ranked, 15)


@query("top_per_pool")
def top_per_pool(spark, sf_dir):
    """Top 3 per role pool (pool = embedding label), each pool with its own candidate
    and its own salary statistics."""
    ranked = rank.rank_postings(T.embedded_postings(spark, sf_dir),
                                T.candidates_per_label(spark, sf_dir), as_of=T.AS_OF)
    return rank.top_n_per_candidate(ranked, 3)


CANDIDATE_EVERY, SPLITS = 25, 8


@query("rank_many")
def rank_many(spark, sf_dir):
    """J1/F1 with many candidates: every 25th vector is a candidate of its pool; the best 3
    postings of each, scored level by level as far as a posting can still be among them."""
    e = T.read(spark, sf_dir, "embeddings")
    cands = e.filter(F.col("vec_id") % CANDIDATE_EVERY == 0).select(
        F.col("label").cast("string").alias("pool"), F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("cand_embedding"))
    return rank.best_per_candidate(T.embedded_postings(spark, sf_dir), cands, as_of=T.AS_OF, n=3, splits=SPLITS)


@query("fit_scores")
def fit_scores(spark, sf_dir):
    """J1 + M1: every embedding scored against its pool's candidate (blocked by label)."""
    e = T.read(spark, sf_dir, "embeddings").withColumn("pool", F.col("label").cast("string"))
    c = T.candidates_per_label(spark, sf_dir)
    j = e.join(c, "pool", "inner")
    return j.select("vec_id", "pool", "candidate_id",
                    F.round(fit_score(F.col("embedding"), F.col("cand_embedding")), 6).alias("fit"))


RECRUITER_PENALTY = 0.15


@query("rank_penalised")
def rank_penalised(spark, sf_dir):
    """P1e/J1: the top 3 per pool when postings that the filter flags as a recruiter's lose
    some of their composite."""
    flagged = filters.filter_cascade(T.embedded_postings(spark, sf_dir), as_of=T.AS_OF, **FILTER_PARAMS)
    ranked = rank.rank_postings(flagged, T.candidates_per_label(spark, sf_dir), as_of=T.AS_OF, recruiter_penalty=RECRUITER_PENALTY)
    return rank.top_n_per_candidate(ranked, 3)


@query("role_summary")
def role_summary(spark, sf_dir):
    """A13 over the per-pool top 3."""
    return rank.role_summary(top_per_pool(spark, sf_dir))


# ----------------------------------------------------------------- salary ----

@query("salary_lpa")
def salary_lpa(spark, sf_dir):
    """M5-M7: structured pay, or for pending orders what their description says: a range,
    one value, or nothing."""
    p = T.postings(spark, sf_dir)
    pend, k = F.col("job_salary_period") == "hourly", F.col("job_id")
    lo = (k % 30 + 5).cast("string")
    said = (F.when(k % 4 == 0, F.concat(F.lit("Pay is "), lo, F.lit(" - "), (k % 30 + 9).cast("string"), F.lit(" LPA, reviewed yearly")))
            .when(k % 4 == 1, F.concat(F.lit("up to "), lo, F.lit(".5 lakhs a year"))).when(k % 4 == 2, F.lit("pay by agreement")))
    p = (p.withColumn("job_min_salary", F.when(~pend, F.col("job_min_salary"))).withColumn("job_max_salary", F.when(~pend, F.col("job_max_salary")))
          .withColumn("job_description", F.when(pend, said)))
    p = rank.with_salary(p)
    return p.select("job_id", F.col("_sal.min_lpa").alias("salary_min_lpa"),
                    F.col("_sal.max_lpa").alias("salary_max_lpa"),
                    F.col("_sal.mid_lpa").alias("salary_mid_lpa"),
                    F.col("_sal.currency").alias("salary_currency"),
                    F.col("_sal.source").alias("salary_source"))


@query("salary_pool_stats")
def salary_pool_stats(spark, sf_dir):
    s = rank.pool_salary_stats(rank.with_salary(T.postings(spark, sf_dir)))
    return s.select("pool", "n_postings", "n_known", F.round("median_mid", 4).alias("median_mid"),
                    F.round(F.coalesce(F.when(F.col("std_mid") != 0, F.col("std_mid")), F.lit(1.0)), 4)
                    .alias("std_mid"))


QUANTILES = (0.1, 0.5, 0.9)


@query("salary_sketch")
def salary_sketch(spark, sf_dir):
    """A1 by sketches: quantiles of each pool's salary midpoints from quarterly sketches that
    are merged, and whether each one's true rank is within the stated error."""
    p = spooled(rank.with_salary(T.postings(spark, sf_dir)).select("pool", "job_posted_at_timestamp", "_sal"))
    quarter = F.date_trunc("quarter", F.timestamp_seconds("job_posted_at_timestamp")).alias("quarter")
    parts = rank.salary_sketches(p.select("pool", quarter, "_sal"), ("pool", "quarter"))
    s = rank.merged_sketches(parts)
    asked = s.select("pool", "n_known", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), rank.sketched_quantile(F.col("sketch"), q).alias("v"))
                                                            for q in QUANTILES])).alias("a")).select("pool", "n_known", "a.*")
    counted = (p.filter("_sal.mid_lpa is not null").join(F.broadcast(asked), "pool")  # a few rows per pool
                .groupBy("pool", "n_known", "q").agg(F.count_if(F.col("_sal.mid_lpa") < F.col("v")).alias("less"),
                                                     F.count_if(F.col("_sal.mid_lpa") <= F.col("v")).alias("upto")))
    near = ((F.col("less") / F.col("n_known") <= F.col("q") + rank.SKETCH_ERROR) & (F.col("upto") / F.col("n_known") >= F.col("q") - rank.SKETCH_ERROR))
    return counted.select("pool", "n_known", F.col("q").alias("quantile"), near.alias("within_error"))


@query("salary_distribution")
def salary_distribution(spark, sf_dir):
    """Histogram of salary midpoints, 10 equal-width buckets over 0-500 LPA
    (bucket 0: below, 11: at or above)."""
    p = rank.with_salary(T.postings(spark, sf_dir))
    b = F.expr("width_bucket(_sal.mid_lpa, 0.0D, 500.0D, 10)")
    return (p.filter(F.col("_sal.mid_lpa").isNotNull()).groupBy(b.cast("long").alias("bucket"))
             .agg(F.count(F.lit(1)).alias("n_postings")))


# ---------------------------------------------------------------- recency ----

@query("recency")
def recency(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders")
    epoch = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    d = days_whole(T.AS_OF_EPOCH, epoch)
    return o.select(F.col("o_orderkey").alias("job_id"), d.alias("days_whole"),
                    F.round(days_fractional(T.AS_OF_EPOCH, epoch), 4).alias("days_frac"),
                    F.round(recency_score(d), 6).alias("recency_score"))


# ---------------------------------------------------------------- filters ----

@query("filter_cascade")
def filter_cascade(spark, sf_dir):
    c = filters.filter_cascade(T.postings(spark, sf_dir), as_of=T.AS_OF, **FILTER_PARAMS)
    return c.select("job_id", "drop_reason", F.col("_is_third_party_recruiter").alias("is_recruiter"),
                    F.round("_days_since_posted", 4).alias("days_since_posted"))


@query("filter_stats")
def filter_stats(spark, sf_dir):
    return filters.filter_stats(T.postings(spark, sf_dir, with_description=True), as_of=T.AS_OF,
                                link_status=posting_links(spark, sf_dir), **FILTER_PARAMS)


def posting_links(spark, sf_dir):
    """Landed probes of posting links: none for every eleventh order, two for every
    fifth (the second one answers), statuses by order key."""
    k = F.col("o_orderkey")
    o = T.read(spark, sf_dir, "orders").filter(k % 11 != 0)
    probe = F.struct(F.when(k % 7 == 0, 404).when(k % 7 == 1, 405).when(k % 7 == 2, 301).otherwise(200).alias("head_status"),
                     F.when(k % 3 == 0, 200).otherwise(503).alias("get_status"))
    again = F.struct(F.lit(200).alias("head_status"), F.lit(200).alias("get_status"))
    return o.select(F.concat(F.lit(T.LINK_BASE), k.cast("string")).alias("url"),
                    F.inline(F.when(k % 5 == 0, F.array(probe, again)).otherwise(F.array(probe))))


@query("filter_run")
def filter_run(spark, sf_dir):
    """P1, U4 and P2 in one run: the postings that are left."""
    kept = filters.filter_postings(T.postings(spark, sf_dir, with_description=True), as_of=T.AS_OF,
                                   link_status=posting_links(spark, sf_dir), **FILTER_PARAMS)
    return kept.select(filters.dedupe_key(kept).alias("dedupe_key"), "job_id", "job_apply_link")


@query("dedupe_freshest")
def dedupe_freshest(spark, sf_dir):
    kept = filters.filter_postings(T.postings(spark, sf_dir, with_description=True, whole_days=True), as_of=T.AS_OF, **FILTER_PARAMS)
    return kept.select(filters.dedupe_key(kept).alias("dedupe_key"), "job_id")


@query("floor_salary")
def floor_salary(spark, sf_dir):
    """P1d: the filter's own INR midpoint reading per posting."""
    p = T.postings(spark, sf_dir)
    mid = floor_mid_lpa(F.col("job_min_salary"), F.col("job_max_salary"),
                        F.col("job_salary_currency"), F.col("job_salary_period"))
    return p.select("job_id", mid.alias("floor_mid_lpa"))


# ------------------------------------------------------ links, merge, landing ----

from ..functions import text as tx  # noqa: E402
from ..operators import ats, documents, keywords  # noqa: E402
from ..sources import landing  # noqa: E402

LINK_TTL_SECONDS = 7 * 86400
ROLE_DOMAIN = "analytics"


def link_status(spark, sf_dir):
    """Landed probe results derived from pages (one row per URL)."""
    pg = T.read(spark, sf_dir, "pages")
    head = (F.when(F.col("page_id") % 7 == 0, 404).when(F.col("page_id") % 7 == 1, 405)
            .when(F.col("page_id") % 7 == 2, 301).otherwise(200))
    get = F.when(F.col("page_id") % 3 == 0, 200).otherwise(503)
    return pg.select("url", head.alias("head_status"), get.alias("get_status"))


@query("dead_links")
def dead_links(spark, sf_dir):
    pg = T.read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("job_apply_link"))
    out = filters.link_health(pg, link_status(spark, sf_dir))
    return out.select("page_id", F.col("job_apply_link").alias("url"), "link_alive")


def _part_pool(spark, sf_dir, cond):
    pt = T.read(spark, sf_dir, "part").filter(cond)
    return pt.select(F.when(F.col("p_size") > 45, F.lit(None)).otherwise(F.col("p_partkey").cast("string"))
                     .alias("job_id"), F.col("p_name").alias("job_title"),
                     F.col("p_brand").alias("employer_name"), F.col("p_type").alias("job_city"),
                     F.col("p_partkey").alias("_ord"))


@query("merge_sources")
def merge_sources(spark, sf_dir):
    """Two overlapping boards (parts of size <= 30 and >= 20); ids blank for
    the largest sizes so the U4 key decides for them."""
    a = _part_pool(spark, sf_dir, F.col("p_size") <= 30)
    b = _part_pool(spark, sf_dir, F.col("p_size") >= 20)
    m = filters.merge_sources([a, b], payload=["_pool_ord", "job_id", "_ord"])
    return m.select(F.col("_mkey").alias("merge_key"), F.col("_pool_ord").alias("source_ord"),
                    "job_id", F.col("_ord").alias("part_key"))


@query("source_dedupe")
def source_dedupe(spark, sf_dir):
    """Parts as one source's rows; ids blank for large sizes, links for some."""
    k = F.col("p_partkey")
    pt = T.read(spark, sf_dir, "part").select(
        F.when(F.col("p_size") <= 20, (k % 500).cast("string")).alias("job_id"),
        F.when(F.col("p_size") <= 35, F.concat(F.lit(T.LINK_BASE), (k % 300).cast("string"))).otherwise("").alias("job_apply_link"),
        F.col("p_name").alias("job_title"), F.col("p_brand").alias("employer_name"), F.col("p_type").alias("job_city"), k.alias("_ord"))
    return filters.dedupe_in_source(pt, payload=["_ord"]).select("_skey", F.col("_ord").alias("part_key")).withColumnRenamed("_skey", "source_key")


@query("board_dedupe")
def board_dedupe(spark, sf_dir):
    """Parts found under two role aliases (overlapping sizes; upper-case titles under
    the second), pooled again by job id."""
    k = F.col("p_partkey")
    pt = T.read(spark, sf_dir, "part").select((k % 700).cast("string").alias("job_id"), F.col("p_brand").alias("employer_name"),
                                              F.col("p_name").alias("job_title"), F.col("p_type").alias("job_city"), k.alias("_ord"), "p_size")
    a = pt.filter(F.col("p_size") <= 30).drop("p_size")
    b = pt.filter(F.col("p_size") >= 20).drop("p_size").withColumn("job_title", F.upper("job_title"))
    out = filters.dedupe_boards([a, b], payload=["job_title", "_ord"])
    return out.select(F.col("_jkey").alias("job_id"), F.col("_alias_ord").alias("alias_ord"), "job_title", F.col("_ord").alias("part_key"))


def _role_locations(spark, sf_dir):
    r = T.read(spark, sf_dir, "region")
    n = T.read(spark, sf_dir, "nation")
    return (r.join(n, r.r_regionkey == n.n_regionkey)
            .select(F.col("r_name").alias("role"), F.lit(ROLE_DOMAIN).alias("domain"),
                    F.col("n_name").alias("location")))


@query("request_manifest")
def request_manifest(spark, sf_dir):
    m = landing.request_manifest(_role_locations(spark, sf_dir), num_pages=2)
    return m.select("request_key", "role", "location", "page", "query_text")


def _landing(spark, sf_dir):
    """Landed snapshots derived from orders: the customer's region/nation and page
    1 + o_orderkey % 2 name the request; pending orders land corrupt payloads."""
    o = T.read(spark, sf_dir, "orders")
    c = T.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(T.read(spark, sf_dir, "nation"))
    r = F.broadcast(T.read(spark, sf_dir, "region"))
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    q = F.trim(F.concat_ws(" ", F.col("r_name"), F.lit(ROLE_DOMAIN), F.lit("in"), F.col("n_name")))
    page = (F.col("o_orderkey") % 2 + 1).cast("int")
    payload = F.when(F.col("o_orderstatus") == "P", F.lit("{\"data\": [")).otherwise(
        F.concat(F.lit("{\"data\": [{\"job_id\": \""), F.col("o_orderkey").cast("string"), F.lit("\"}]}")))
    return j.select(landing.request_key(q, F.col("n_name"), page).alias("request_key"),
                    F.col("o_orderdate").alias("fetched_at"), payload.alias("payload"))


@query("pending_requests")
def pending_requests(spark, sf_dir):
    m = landing.request_manifest(_role_locations(spark, sf_dir), num_pages=2)
    p = landing.pending_requests(m, _landing(spark, sf_dir), as_of=T.AS_OF, ttl_seconds=LINK_TTL_SECONDS)
    return p.select("request_key", "role", "location", "page", "query_text")


# ----------------------------------------------------------- document text ----

@query("doc_clean")
def doc_clean(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_posting_text(F.col("text")).alias("clean_text"))


@query("doc_tokens")
def doc_tokens(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    toks = tx.resume_tokens(F.col("text"))
    return d.select("doc_id", F.size(toks).cast("long").alias("n_tokens"),
                    F.array_join(F.array_sort(toks), " ").alias("tokens"))


@query("doc_contacts")
def doc_contacts(spark, sf_dir):
    return documents.contacts_and_name(T.read(spark, sf_dir, "documents"))


@query("html_text")
def html_text(spark, sf_dir):
    pg = T.read(spark, sf_dir, "pages")
    return pg.select("page_id", tx.html_to_text(F.col("html")).alias("text"))


def _short_line_heading(line):
    """Binding heading rule: an alias heading, else any line of at most two words
    (lower-cased, surrounding ``.:`` removed) opens a section."""
    alias = tx.detect_section(line)
    short = F.when((tx.word_count(line) >= 1) & (tx.word_count(line) <= 2),
                   F.lower(tx.strip_chars(tx.pytrim(line), " .:")))
    return F.coalesce(alias, short)


@query("line_sections")
def line_sections(spark, sf_dir):
    ln = documents.lines(T.read(spark, sf_dir, "documents"))
    return documents.label_sections(ln, _short_line_heading(F.col("line"))).withColumn(
        "line_no", F.col("line_no").cast("long"))


@query("entry_groups")
def entry_groups(spark, sf_dir):
    s = line_sections(spark, sf_dir)
    g = documents.group_entries(s)
    return g.select("doc_id", "section", "entry_id", "title", "company", "start_date", "end_date", "n_bullets")


# --------------------------------------------------------------- keywords ----

TOP_PER_DOC = 30  # F2 is a top-n report
LANGS = ["en", "fr", "de", "es"]


def _docs_by_source(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("pool"), "text")


@query("phrase_topn")
def phrase_topn(spark, sf_dir):
    return keywords.top_phrases(_docs_by_source(spark, sf_dir), top_per_doc=TOP_PER_DOC)


@query("doc_frequency")
def doc_frequency(spark, sf_dir):
    return keywords.document_frequency(_docs_by_source(spark, sf_dir))


@query("market_keywords")
def market_keywords(spark, sf_dir):
    d = _docs_by_source(spark, sf_dir)
    return keywords.market_keywords(d, keywords.docs_per_pool(d))


CLASSES = ["hard_skill", "tool", "certification", "domain_term", "soft_skill", "noise"]


def landed_answers(vocabulary):
    """Landed classification responses bound to the phrases (each comes once): one fenced or bare JSON list
    per phrase, its class by length (every seventh length has no answer), its canonical
    form the first word of even-length phrases."""
    n = F.length("phrase")
    item = F.struct(F.col("phrase").alias("keyword"), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), n % 7 + 1).alias("category"),
                    F.when(n % 2 == 0, F.substring_index("phrase", " ", 1)).otherwise(F.col("phrase")).alias("canonical"))
    body = F.to_json(F.array(item))
    raw = F.when(n % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return vocabulary.filter(n % 7 < len(CLASSES)).select(raw.alias("raw"))


@query("classified_keywords")
def classified_keywords(spark, sf_dir):
    """Keyword records under landed classifications, with noise dropped,
    synonyms collapsed and the report order as a rank per pool."""
    d = _docs_by_source(spark, sf_dir)
    answers = keywords.landed_classification(landed_answers(keywords.vocabulary(d)), single=False)
    mk = keywords.market_keywords(d, keywords.docs_per_pool(d), answers)
    # a keyword needs a tenth of its pool's documents, so a pool's rank sorts few rows
    return mk.withColumn("report_rank", F.row_number().over(Window.partitionBy("pool").orderBy(*keywords.report_order())).cast("long"))


def language_keywords(spark, sf_dir):
    """Keyword records mined from the documents of each language (the pools)."""
    d = T.read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("pool"), "text")
    return keywords.market_keywords(d, keywords.docs_per_pool(d))


def part_keywords(spark, sf_dir):
    """Keyword records mined from all parts as postings: two pools whose types are common
    (critical), frequent (recommended) and, as names, rare (nice to have), and the rest."""
    pt = T.read(spark, sf_dir, "part")
    pool = (F.when((F.col("p_type") == "PROMO") | ((F.col("p_type") == "SMALL") & (F.col("p_size") < 25)), "0")
            .when((F.col("p_type") == "LARGE") | ((F.col("p_type") == "MEDIUM") & (F.col("p_size") < 25)), "1").otherwise("2"))
    d = pt.select(F.col("p_partkey").alias("doc_id"), pool.alias("pool"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return keywords.market_keywords(d, keywords.docs_per_pool(d))


def _coverage(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").withColumn("pool", F.col("lang"))
    return ats.keyword_coverage(d, language_keywords(spark, sf_dir))


@query("keyword_coverage")
def keyword_coverage(spark, sf_dir):
    c = _coverage(spark, sf_dir)
    return c.select("doc_id", "tier", F.col("n_terms").cast("long").alias("n_terms"),
                    F.col("n_hits").cast("long").alias("n_hits"), "coverage",
                    F.array_join(F.array_sort("hits"), "|").alias("hits"))


@query("coverage_rollup")
def coverage_rollup(spark, sf_dir):
    """A6 roll-up with GROUPING SETS: per (source, tier), per source, overall."""
    c = _coverage(spark, sf_dir).filter(F.col("tier") != "all")
    src = T.read(spark, sf_dir, "documents").select("doc_id", "source")
    j = c.join(src, "doc_id")
    rate = F.sum("n_hits") / F.nullif(F.sum("n_terms"), F.lit(0))
    return (j.rollup("source", "tier")
            .agg(F.grouping_id().alias("level"), F.countDistinct("doc_id").alias("n_docs"),
                 F.sum("n_hits").cast("long").alias("n_hits"), F.sum("n_terms").cast("long").alias("n_terms"),
                 F.round(rate, 6).alias("hit_rate")))


@query("keyword_gap")
def keyword_gap(spark, sf_dir):
    """Each conversation's turns as a résumé against the keywords of a language."""
    cv = T.read(spark, sf_dir, "conversations")
    said = cv.select("conv_id", F.explode_outer(tx.resume_tokens(F.col("text"))).alias("token"))  # no token spans two turns
    sets = said.groupBy("conv_id").agg(F.collect_set("token").alias("tokens"))
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.col("conv_id") % len(LANGS) + 1).cast("int"))
    cands = sets.select(lang.alias("pool"), F.col("conv_id").alias("candidate_id"), "tokens")
    return _gap_counts(keywords.gap_analysis(cands, language_keywords(spark, sf_dir)))


@query("keyword_gap_text")
def keyword_gap_text(spark, sf_dir):
    """Each turn of a conversation as a text against the keywords of a language, by
    containment in the whole text."""
    cv = T.read(spark, sf_dir, "conversations")
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.col("conv_id") % len(LANGS) + 1).cast("int"))
    cands = cv.select(lang.alias("pool"), (F.col("conv_id") * 1000 + F.col("turn")).alias("candidate_id"), "text")
    return _gap_counts(ats.text_gap(cands, language_keywords(spark, sf_dir)))


def _gap_counts(g):
    """Buckets of a gap analysis counted, and the keywords that must be added."""
    def n(b):
        return F.size(F.filter("gap", lambda x: x.getField("bucket") == b)).cast("long")
    must = F.transform(F.filter("gap", lambda x: x.getField("bucket") == "must_add"), lambda x: x.getField("keyword"))
    return g.select(F.col("candidate_id").alias("conv_id"), n("already_have").alias("n_already_have"),
                    n("must_add").alias("n_must_add"), n("should_emphasize").alias("n_should_emphasize"),
                    F.array_join(F.array_sort(must), "|").alias("must_add"))


# ---------------------------------------------------------------- ATS ----

@query("format_checks")
def format_checks(spark, sf_dir):
    lay = documents.layout_from_html(T.read(spark, sf_dir, "pages"))
    f = ats.format_checks(lay)
    return f.select(F.col("doc_id").alias("page_id"), *ats.CHECKS,
                    F.size("format_notes").cast("long").alias("n_notes"), F.round("format_score", 6).alias("format_score"))


def _documents_with_keywords(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("pool"))
    terms = ats.Terms(language_keywords(spark, sf_dir))
    return ats.with_keywords(d, terms), terms


@query("doc_overall")
def doc_overall(spark, sf_dir):
    d, terms = _documents_with_keywords(spark, sf_dir)
    return ats.score_documents(d, terms=terms, lists=()).select(
        "doc_id", F.round("report_keyword_score", 6).alias("keyword_score"),
        F.round("report_format_score", 6).alias("format_score"), F.col("report_overall").alias("overall"))


@query("before_after")
def before_after(spark, sf_dir):
    """Each document before and after appending its missed keywords as a
    ``Skills:`` line."""
    d = T.read(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("pool"))
    return _before_after(d, ats.Terms(language_keywords(spark, sf_dir)))


def _before_after(d, terms):
    d = ats.score_documents(ats.with_keywords(d, terms), name="before", terms=terms, lists=("misses",))
    missed = F.get(ats.tier_values("before_coverage", "misses"), len(ats.TIERS) - 1)
    d = ats.once(d, "after_text", F.concat(F.col("text"), F.lit("\nSkills: "), F.array_join(F.array_sort(missed), ", ")))
    return ats.before_after(ats.score_documents(d, F.col("after_text"), "after", terms, lists=()))


# ------------------------------------------------------------ applications ----

from ..functions import mail as mailfn  # noqa: E402
from ..operators import applications as apps  # noqa: E402
from ..operators import mail  # noqa: E402
from ..streaming import status_stream  # noqa: E402
from ..functions.status import current_status, status_rank  # noqa: E402

AS_OF_TEXT = "2001-08-02 00:00:00"
SNAPSHOT_BEFORE = "1998-01-01"
BATCH_FROM = "1997-01-01"
QUEUE_CAP = 2


def _app_rows(spark, sf_dir, batch: bool):
    """Applications bound to orders: the snapshot holds orders before 1998, the new
    batch orders from 1997 (overlap = refreshed rows)."""
    # the raw column against a literal of its own type, so the scan skips row groups
    day = F.col("o_orderdate")
    bound = lambda d: F.lit(d).cast("timestamp_ntz")
    o = T.read(spark, sf_dir, "orders").filter(day >= bound(BATCH_FROM) if batch else day < bound(SNAPSHOT_BEFORE))
    p = T.postings(spark, sf_dir, orders=o)
    posted = F.timestamp_seconds(F.col("job_posted_at_timestamp"))
    jid = F.col("job_id")
    o_status = F.when(F.col("job_salary_period") == "monthly", "applied").when(
        F.col("job_salary_period") == "yearly", "queued").otherwise("")
    if batch:
        title = F.when(jid % 2 == 0, F.concat(F.col("job_title"), F.lit(" II"))).otherwise(F.col("job_title"))
        link = F.when(jid % 4 == 0, F.lit("")).otherwise(F.concat(F.col("job_apply_link"), F.lit("?v=2")))
        status, queued_at, applied_at = F.lit("queued"), F.lit(""), F.lit("")
        art = F.when(jid % 5 == 0, F.concat(F.lit("artifacts/v2/"), jid.cast("string"))).otherwise(F.lit(""))
    else:
        title, link, status = F.col("job_title"), F.col("job_apply_link"), o_status
        queued_at = F.date_format(posted, apps.TIME_FORMAT)
        applied_at = F.when(o_status == "applied", F.date_format(posted + F.expr("INTERVAL 1 DAY"),
                                                                 apps.TIME_FORMAT)).otherwise(F.lit(""))
        art = F.when(jid % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("artifacts/"), jid.cast("string")))
    days = days_whole(T.AS_OF_EPOCH, F.col("job_posted_at_timestamp")).cast("double")
    return p.select(jid.cast("string").alias("job_id"), F.lit("orders").alias("source"),
                    F.col("employer_name").alias("company"), title.alias("title"),
                    F.col("job_city").alias("location"), days.alias("posted_days_ago"),
                    F.lit(None).cast("double").alias("salary_mid_lpa"), F.lit(None).cast("double").alias("fit_score"),
                    F.lit(None).cast("double").alias("composite_score"), link.alias("apply_link"),
                    status.alias("status"), queued_at.alias("queued_at"), applied_at.alias("applied_at"),
                    F.lit("").alias("last_response_at"), F.lit("").alias("last_response_summary"),
                    art.alias("artifact_dir"), F.lit("").alias("notes"))


@query("app_upsert")
def app_upsert(spark, sf_dir):
    return apps.upsert(_app_rows(spark, sf_dir, False), _app_rows(spark, sf_dir, True), as_of_text=AS_OF_TEXT)


@query("app_status_counts")
def app_status_counts(spark, sf_dir):
    return apps.status_counts(app_upsert(spark, sf_dir))


def _status_updates(spark, sf_dir):
    """Status changes bound to line items: R -> rejected (with a response), A ->
    applied, N -> an invalid status (rejected by validation)."""
    li = T.read(spark, sf_dir, "lineitem")
    st = (F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "applied")
          .otherwise("viewd"))
    resp = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("rejected: line "), F.col("l_linenumber").cast("string")))
    notes = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("shipped "), F.col("l_linenumber").cast("string"))) \
        .otherwise(F.lit(""))
    return li.select(F.col("l_orderkey").cast("string").alias("job_id"), st.alias("status"),
                     F.col("l_shipdate").alias("at"), resp.alias("response_summary"), notes.alias("notes"),
                     F.col("l_linenumber").cast("long").alias("seq"))


@query("status_update")
def status_update(spark, sf_dir):
    out, _ = apps.set_status(app_upsert(spark, sf_dir), _status_updates(spark, sf_dir))
    return out.select("job_id", "status", "applied_at", "last_response_at", "last_response_summary", "notes")


@query("application_rows")
def application_rows(spark, sf_dir):
    """Ranked postings as application rows, and those that are queued."""
    ranked = rank.rank_postings(T.embedded_postings(spark, sf_dir), T.candidates_per_label(spark, sf_dir), as_of=T.AS_OF)
    rows = apps.to_application_rows(ranked.withColumn("artifact_dir", F.concat(F.lit("artifacts/"), F.col("job_id"))), as_of_text=AS_OF_TEXT)
    return apps.queued_view(rows).select("job_id", "source", "company", "title", "location", "posted_days_ago", "salary_mid_lpa",
                                         "fit_score", "apply_link", "status", "queued_at", "artifact_dir")


@query("queue_drops")
def queue_drops(spark, sf_dir):
    """A10 with decisions taken: nothing is advanced automatically, so what the cap lets
    through is kept, and applications whose posting was filtered meanwhile are dropped."""
    gone = filters.filter_cascade(T.postings(spark, sf_dir), as_of=T.AS_OF, **FILTER_PARAMS).filter("drop_reason is not null")
    return apps.decision_counts(apps.queue_decisions(app_upsert(spark, sf_dir), daily_cap=QUEUE_CAP, auto_advance=False,
                                                     dropped=gone.select(F.col("job_id").cast("string").alias("job_id"))))


@query("applied_rows")
def applied_rows(spark, sf_dir):
    """Applications that have been sent, and nothing else."""
    return apps.applied_view(app_upsert(spark, sf_dir)).select("job_id", "company", "status")


@query("apply_queue")
def apply_queue(spark, sf_dir):
    return apps.queue_decisions(app_upsert(spark, sf_dir), daily_cap=QUEUE_CAP)


@query("apply_queue_counts")
def apply_queue_counts(spark, sf_dir):
    return apps.decision_counts(apps.queue_decisions(app_upsert(spark, sf_dir), daily_cap=QUEUE_CAP))


@query("watch_set")
def watch_set(spark, sf_dir):
    w = apps.watch_set(app_upsert(spark, sf_dir))
    return w.select("job_id", "company", "status")


# ------------------------------------------------------------------- mail ----

# Binding rule table: evidence words frequent in the test conversations, one per
# label, so that precedence decides between several matches.
BINDING_RULES = [("offer", "that", 0.9), ("interviewing", "from", 0.8),
                 ("screening", "with", 0.7), ("viewed", "this", 0.6),
                 ("rejected", "tion", 0.5)]
EVENT_LABELS = {"view": "viewed", "signup": "applied", "click": "screening",
                "purchase": "offer", "error": "rejected"}


@query("mail_labels")
def mail_labels(spark, sf_dir):
    cv = T.read(spark, sf_dir, "conversations")
    m = mail.label_messages(cv.select("conv_id", "turn", F.col("text").alias("body")), rules=BINDING_RULES)
    return m.select("conv_id", "turn", "label", "confidence", "evidence_snippet")


@query("verdict_check")
def verdict_check(spark, sf_dir):
    """Q5: event types as landed verdicts, some in capitals or with spaces: how many are
    labels of the domain, and how many are rejected."""
    ev = T.read(spark, sf_dir, "events")
    label = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), F.upper("event_type"))).when(
        F.col("event_id") % 5 == 1, F.lit("Offer ")).when(F.col("event_id") % 5 == 2, F.lit(None)).otherwise(F.lit("viewed"))
    ok, bad = mail.validate_verdicts(ev.select("event_id", label.alias("label")))
    rows = ok.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return rows.groupBy("label", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("company_match")
def company_match(spark, sf_dir):
    """Every part's brand as a verdict company against the known brands, ordered
    by first appearance (lowest part key)."""
    pt = T.read(spark, sf_dir, "part")
    verdicts = pt.select(F.col("p_brand").alias("matched_company"))
    known = pt.select(F.col("p_brand").alias("company"), F.col("p_partkey").alias("company_order"))
    return mail.match_companies(verdicts, known)


def _messages(spark, sf_dir):
    """Messages bound to conversations: headers (with a duplicate ``from`` whose
    last value wins) and base64url parts (plain text for even turns, HTML for odd)."""
    cv = T.read(spark, sf_dir, "conversations")
    enc = F.translate(F.regexp_replace(F.base64(F.encode(F.col("text"), "UTF-8")), "[\\r\\n=]", ""), "+/", "-_")
    html = F.translate(F.regexp_replace(F.base64(F.encode(
        F.concat(F.lit("<html><style>p{}</style><p>"), F.col("text"), F.lit("</p></html>")), "UTF-8")), "[\\r\\n=]", ""),
        "+/", "-_")
    parts = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.lit("text/plain").alias("mime"), enc.alias("data")))) \
        .otherwise(F.array(F.struct(F.lit("text/html").alias("mime"), html.alias("data"))))
    headers = F.array(
        F.struct(F.lit("From").alias("name"), F.lit("first@example.org").alias("value")),
        F.struct(F.lit("Subject").alias("name"), F.substring(F.col("text"), 1, 30).alias("value")),
        F.struct(F.lit("FROM").alias("name"), F.concat(F.col("role"), F.lit("@example.org")).alias("value")))
    return cv.select("conv_id", "turn", headers.alias("headers"), parts.alias("parts"))


@query("mail_decode")
def mail_decode(spark, sf_dir):
    m = _messages(spark, sf_dir)
    h = mailfn.headers_map(F.col("headers"))
    return m.select("conv_id", "turn", F.element_at(h, F.lit("from")).alias("from_address"),
                    F.element_at(h, F.lit("subject")).alias("subject"),
                    mailfn.body_text(F.col("parts")).alias("body"))


def _event_messages(spark, sf_dir):
    ev = T.read(spark, sf_dir, "events")
    lab = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_LABELS.items() for x in kv]), F.col("event_type"))
    return ev.select(F.col("user_id").alias("job_id"), lab.alias("label"), F.col("ts").alias("received_at"),
                     F.col("event_id").alias("msg_id"))


def _event_applications(spark, sf_dir):
    ev = T.read(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("job_id")).distinct().withColumn(
        "status", F.when(F.col("job_id") % 4 == 0, "screening").otherwise("applied"))


@query("status_fold")
def status_fold(spark, sf_dir):
    return mail.fold_statuses(_event_applications(spark, sf_dir), _event_messages(spark, sf_dir))


EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _message_rows(events):
    """Messages of the events stream: ``job_id, label, msg_id`` and the time."""
    lab = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_LABELS.items() for x in kv]), F.col("event_type"))
    return events.select(F.col("user_id").alias("job_id"), lab.alias("label"), "ts", F.col("event_id").alias("msg_id"))


def _watched(spark, sf_dir, max_files=None, lookback="7 days"):
    """W1-W6 over all landed events; returns the table that the watcher kept."""
    import uuid
    table = scratch_path(spark, f"streams/status/{uuid.uuid4().hex}")
    sinks.save_snapshot(spark, status_stream.initial_state(_event_applications(spark, sf_dir)), table, 1, key="job_id")
    msgs = _message_rows(status_stream.message_stream(spark, sf_dir, EVENT_SCHEMA, table="events", max_files_per_trigger=max_files))
    msgs = status_stream.dedupe_messages(msgs, id_col="msg_id", time_col="ts", lookback=lookback)
    status_stream.start_watch(msgs, table, checkpoint=f"{table}/_stream").awaitTermination()
    return table


@query("status_fold_stream")
def status_fold_stream(spark, sf_dir):
    """The same fold as ``status_fold`` driven as a stream over the events."""
    return status_stream.statuses(sinks.load_snapshot(spark, _watched(spark, sf_dir), status_stream.STATE_SCHEMA))


@query("watch_counts")
def watch_counts(spark, sf_dir):
    """The three counters that the watcher kept, over all its batches."""
    c = spark.read.schema("checked long, classified long, advanced long").parquet(f"{_watched(spark, sf_dir)}/counts/*")
    return c.agg(*[F.sum(n).cast("long").alias(n) for n in ("checked", "classified", "advanced")])


@query("msg_dedup_stream")
def msg_dedup_stream(spark, sf_dir):
    """The events read by two sources (a replay) and de-duplicated on the message id
    within the watermark; every message survives exactly once."""
    import uuid
    a, b = (status_stream.message_stream(spark, sf_dir, EVENT_SCHEMA, table="events") for _ in range(2))
    d = status_stream.dedupe_messages(a.unionByName(b), id_col="event_id", time_col="ts", lookback="7 days")
    base = scratch_path(spark, f"streams/dedup/{uuid.uuid4().hex}")
    return status_stream.append_batches(d.select("event_id", "user_id", "event_type"), f"{base}/data", checkpoint=f"{base}/_stream")


# ------------------------------------------------------- requests, checks ----

from ..operators import checks, embeddings, requests  # noqa: E402
from ..sources import postings as postings_src  # noqa: E402
from ..sources import sinks  # noqa: E402

# Our own request template (the reference's prompt texts are not reproduced).
KEYWORD_REQUEST_TEMPLATE = ("Classify the key phrases of a {role} posting.\n"
                            "Return JSON {{\"keywords\": [...]}}.\n---\n{job_description}")


@query("request_rows")
def request_rows(spark, sf_dir):
    """One model request per document, with its whole text."""
    d = T.read(spark, sf_dir, "documents")
    r = requests.request_rows(d, ["doc_id"], KEYWORD_REQUEST_TEMPLATE,
                              {"role": F.col("source"), "job_description": F.col("text")})
    return r.select("doc_id", "request_key", F.length("prompt").cast("long").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


def _responses(spark, sf_dir):
    """Landed responses bound to events: clicks arrive fenced, errors truncated."""
    ev = T.read(spark, sf_dir, "events")
    raw = (F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
           .when(F.col("event_type") == "error", F.substring(F.col("props"), 1, 6))
           .otherwise(F.col("props")))
    return ev.select("event_id", raw.alias("raw"))


@query("response_rows")
def response_rows(spark, sf_dir):
    """R16 + N3: fenced or bare JSON responses parsed to typed rows; invalid JSON
    falls back to NULL fields with ``parsed = false``."""
    r = _responses(spark, sf_dir)
    p = requests.parse_json_response(F.col("raw"), "k int")
    return r.select("event_id", p.getField("k").alias("k"), p.isNotNull().alias("parsed"))


def _turn_pairs(spark, sf_dir):
    """Assistant turns with the user turn just before them (equi-join on conv and turn)."""
    cv = T.read(spark, sf_dir, "conversations")
    a = cv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("rewrite"))
    u = cv.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                  F.col("text").alias("original"))
    return a.join(u, ["conv_id", "turn"])


@query("rewrite_checks")
def rewrite_checks(spark, sf_dir):
    """Q6/Q10: each assistant turn as a rewrite of the previous user turn."""
    p = _turn_pairs(spark, sf_dir)
    c = checks.rewrite_checks(F.col("original"), F.col("rewrite"))
    s = checks.summary_checks(F.col("rewrite"))
    return p.select("conv_id", "turn", c.getField("bullet_count_ok").alias("bullet_count_ok"),
                    c.getField("word_range_ok").alias("word_range_ok"), c.getField("numbers_ok").alias("numbers_ok"),
                    c.getField("no_forbidden").alias("no_forbidden"),
                    c.getField("no_first_person").alias("no_first_person"),
                    s.getField("length_ok").alias("summary_length_ok"))


@query("grounding_checks")
def grounding_checks(spark, sf_dir):
    """Q8/Q9: capitalised words of each assistant turn must occur in the user turn
    before it; the letter must name the first two words of that turn."""
    p = _turn_pairs(spark, sf_dir)
    caps = F.array_distinct(F.filter(F.transform(F.split(F.trim(F.col("rewrite")), r"\s+"),
                                                 lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")),
                                     lambda w: w.rlike(r"^\p{Lu}")))
    ow = checks.words(F.col("original"))
    letter = checks.letter_checks(F.col("rewrite"), F.coalesce(F.get(ow, 0), F.lit("")),
                                  F.coalesce(F.get(ow, 1), F.lit("")))
    return p.select("conv_id", "turn", F.size(caps).cast("long").alias("n_items"),
                    F.size(checks.grounding_violations(caps, F.col("original"))).cast("long").alias("n_violations"),
                    letter.getField("length_ok").alias("letter_length_ok"),
                    letter.getField("names_role").alias("names_role"),
                    letter.getField("names_company").alias("names_company"))


@query("keyword_chunks")
def keyword_chunks(spark, sf_dir):
    """F8: classification batches of 60 keywords per pool, alphabetical."""
    d = _docs_by_source(spark, sf_dir)
    kws = keywords.document_frequency(d).select("pool", "phrase")  # each once
    c = requests.chunk_ids(kws, "pool", "phrase")
    return c.groupBy("pool", "chunk_id").agg(F.count(F.lit(1)).alias("n_keywords"),
                                              F.min("phrase").alias("first_keyword"))


# ------------------------------------------------------- sources and sinks ----

def _board_rows(spark, sf_dir):
    """Second-board rows bound to parts: ids blank for the largest sizes, URLs in
    one of three aliases, India for even sizes, text dates."""
    pt = T.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return pt.select(
        F.lit("board").alias("site"), F.when(F.col("p_size") <= 45, k.cast("string")).alias("id"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("company"),
        F.when(k % 2 == 0, F.col("p_type")).alias("city"), F.col("p_type").alias("location"),
        F.lit(None).cast("string").alias("state"),
        F.when(F.col("p_size") % 2 == 0, F.lit("India")).otherwise(F.lit("USA")).alias("country"),
        (k % 3 == 0).alias("is_remote"), F.col("p_type").alias("description"),
        F.when(k % 3 == 0, F.concat(F.lit("https://d.example/"), k.cast("string"))).alias("job_url_direct"),
        F.when(k % 3 == 1, F.concat(F.lit("https://j.example/"), k.cast("string"))).alias("job_url"),
        F.lit(None).cast("string").alias("url"),
        F.when(k % 4 == 0, F.lit("2001-07-15")).when(k % 4 == 1, F.lit("2001-07-15T10:30:00"))
        .when(k % 4 == 2, F.lit("2001-07-15 10:30:00")).otherwise(F.lit("not a date")).alias("date_posted"),
        (F.col("p_retailprice") * 1000).alias("min_amount"), F.lit(None).cast("double").alias("max_amount"),
        F.when(k % 5 == 0, F.lit("USD")).alias("currency"),
        F.when(k % 7 == 0, F.lit("monthly")).alias("interval"),
        F.when(k % 6 == 0, (k % 300).cast("string")).alias("applicants"),
        F.lit(None).cast("string").alias("num_applicants"),
        F.when(k % 6 == 1, F.lit("12.0")).alias("linkedin_applicants"),
        F.lit(None).cast("string").alias("listing_type"))


@query("keywords_artifact")
def keywords_artifact(spark, sf_dir):
    """S6 then S9: keyword records written as JSON artifacts per pool and read back; fields
    that the schema does not name are ignored."""
    import uuid
    path = scratch_path(spark, f"artifacts/keywords/{uuid.uuid4().hex}")
    sinks.write_artifacts(classified_by_language(spark, sf_dir).withColumn("note", F.lit("x")), path, ["pool"])
    return postings_src.read_keywords(spark, path, multi_line=False).select("keyword", "display", "category", "frequency", "raw_count", "tier")


@query("answers_artifact")
def answers_artifact(spark, sf_dir):
    """Answers written as JSON artifacts and read back."""
    import uuid
    ev = T.read(spark, sf_dir, "events")
    raw = F.to_json(F.struct(F.col("props").alias("why_this_role"), F.array("event_type").alias("core_techniques")))
    a = ans.parse_answers(ev.select("event_id", "event_type", raw.alias("raw")), "raw")
    path = scratch_path(spark, f"artifacts/answers/{uuid.uuid4().hex}")
    sinks.write_artifacts(a.select("event_id", "event_type", "answers"), path, ["event_type"])
    back = spark.read.schema(f"event_id long, answers struct<{ans.STRUCT_FIELDS}>").json(path)
    return back.select("event_id", F.col("answers.why_this_role").alias("why"), F.array_join("answers.core_techniques", ",").alias("techniques"),
                       F.col("answers.open_to_shift_work").alias("shift"))


@query("board_rows")
def board_rows(spark, sf_dir):
    """S2/T-1: board rows normalised to postings."""
    n = postings_src.normalise_board_rows(_board_rows(spark, sf_dir), "board", "Remote")
    return n.select("job_id", "job_title", "employer_name", "job_city", "job_country", "job_posted_at_timestamp",
                    "job_min_salary", "job_salary_currency", "job_salary_period", "job_apply_link",
                    "_applicant_count")


@query("postings_roundtrip")
def postings_roundtrip(spark, sf_dir):
    """S6 then S1: postings written as JSON artifacts partitioned by pool, read back
    with the explicit posting schema (``_source_location`` filled where absent)."""
    p = T.postings(spark, sf_dir).select(
        F.col("job_id").cast("string").alias("job_id"), "job_title", "employer_name", "job_city",
        "job_posted_at_timestamp", "job_min_salary", "job_max_salary", "job_salary_currency",
        "job_salary_period", "job_apply_link", "_applicant_count", "pool")
    import uuid
    path = scratch_path(spark, f"artifacts/postings/{uuid.uuid4().hex[:12]}")
    sinks.write_artifacts(p, path, ["pool"], fmt="json")
    r = postings_src.read_postings(spark, path, source_location="landed", multi_line=False)
    return r.select("job_id", "job_title", "employer_name", "job_city", "job_posted_at_timestamp",
                    "job_min_salary", "job_max_salary", "job_salary_currency", "job_salary_period",
                    "job_apply_link", "_applicant_count", "_source_location")


@query("salary_display")
def salary_display(spark, sf_dir):
    """``₹lo-hiL`` / single value / dash, per posting."""
    p = rank.with_salary(T.postings(spark, sf_dir))
    return p.select("job_id", reports.salary_text(F.col("_sal.min_lpa"), F.col("_sal.max_lpa")).alias("salary_text"))


# ---------------------------------------------------------- rows-only ops ----

VECTOR_WIDTH = 64


@query("hashed_vectors")
def hashed_vectors(spark, sf_dir):
    """K1 by a producer: unit vectors of hashed TF-IDF for all documents, as rows of the
    slots that are not zero."""
    d = T.read(spark, sf_dir, "documents")
    d = spooled(d.select("doc_id", F.array_join(keywords.doc_tokens(d), " ").alias("text")))
    v = embeddings.embed(d, embeddings.HashedTfIdf.fit(d, VECTOR_WIDTH))
    return v.select("doc_id", F.posexplode("vector").alias("slot", "w")).filter("w <> 0").select("doc_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("w").cast("double"), 4).alias("weight"))


@query("phrase_cosine")
def phrase_cosine(spark, sf_dir):
    """K3 by vectors: the best phrases of each document that has a vector, scored by the
    cosine of the phrase's vector with the document's; the embeddings are both tables (a
    phrase has the vector that its MD5 names)."""
    e = T.read(spark, sf_dir, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    top = keywords.top_phrases(_docs_by_source(spark, sf_dir), top_per_doc=TOP_PER_DOC).select("doc_id", "pool", "n", "phrase")
    top = spooled(top.join(docs.select("doc_id"), "doc_id", "left_semi"))  # others are scored by nothing
    n = e.count()
    vecs = (top.select("phrase").distinct().withColumn("of", embeddings.term_slot(F.col("phrase"), n))
               .join(docs, F.col("of") == F.col("doc_id")).select("phrase", "vector"))
    return embeddings.cosine_scores(top, docs, vecs).select("doc_id", "pool", "n", "phrase", F.round("score", 6).alias("score"))


@query("phrase_mmr")
def phrase_mmr(spark, sf_dir):
    """K4: MMR re-ranking of every scored phrase of each document."""
    d = _docs_by_source(spark, sf_dir)
    return embeddings.mmr_documents(d, keywords.docs_per_pool(d), top_n=TOP_PER_DOC, diversity=0.3)


@query("mined_keywords")
def mined_keywords(spark, sf_dir):
    """K5 in full: keyword records per source from the phrases that MMR picks, with part
    names as seed terms of every source and landed classifications."""
    d = _docs_by_source(spark, sf_dir)
    names = T.read(spark, sf_dir, "part").select(F.lower("p_name").alias("seed"), F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string")).alias("pool"))
    return embeddings.mine_keywords(d, top_n=TOP_PER_DOC, seeds=names.distinct(),
                                    classification=keywords.landed_classification(landed_answers(keywords.vocabulary(d))))


@query("doc_vectors")
def doc_vectors(spark, sf_dir):
    """K1: TF-IDF document vectors (default producer), one row per entry."""
    v = embeddings.doc_vectors(T.read(spark, sf_dir, "documents"))
    return v.select("doc_id", F.inline("vector")).withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- résumés ----

from ..operators import resume  # noqa: E402
from .strategy import top_n_per_group  # noqa: E402


def candidate_fields(spark, sf_dir):
    """The fields of one structured résumé (D4) per order as columns: roles are its line
    items (part name, supplier, ship month; open lines are current), skills its part types, a
    degree from its customer's region and nation, a certificate from its
    priority. Each list is bounded by the line items of one order. ``first_role`` is the
    title and company of the first experience. Spark drops from the plan what a query does
    not select, which it does not do for the fields of one struct."""
    o = T.read(spark, sf_dir, "orders")
    c = T.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = F.broadcast(T.read(spark, sf_dir, "nation"))
    r = F.broadcast(T.read(spark, sf_dir, "region"))
    li = T.read(spark, sf_dir, "lineitem")
    pt = T.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    su = T.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    order = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    roles = (li.join(pt, li.l_partkey == pt.p_partkey).join(su, li.l_suppkey == su.s_suppkey)
             .groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
                 F.min(F.struct(*order, F.col("p_name").alias("title"), F.col("s_name").alias("company"))).alias("_first"),
                 F.sort_array(F.collect_list(F.struct(
                     *order,
                     F.struct(F.col("p_name").alias("title"), F.col("s_name").alias("company"),
                              F.lit("").alias("location"),
                              F.date_format("l_shipdate", "MMM yyyy").alias("start_date"),
                              F.when(F.col("l_linestatus") == "O", F.lit("Present")).otherwise(
                                  F.date_format(F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS"), "MMM yyyy"))
                              .alias("end_date"),
                              F.concat(F.array(F.format_string("Shipped %d units at %d%% discount",
                                                               F.col("l_quantity").cast("int"),
                                                               F.round(F.col("l_discount") * 100).cast("int"))),
                                       F.when(F.col("l_returnflag") == "R", F.array(F.lit("Handled a return")))
                                       .otherwise(F.array().cast("array<string>"))).alias("bullets")).alias("e")))
                 ).alias("_roles"),
                 F.sort_array(F.collect_set("p_type")).alias("skills")))
    base = (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(roles, "o_orderkey", "left"))
    year = F.year("o_orderdate")
    fields = [
        F.struct(F.concat_ws(" ", "c_mktsegment", "n_name").alias("name"),
                 F.concat(F.lit("cand"), F.col("o_orderkey").cast("string"), F.lit("@example.org")).alias("email"),
                 F.concat(F.lit("+91 98"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("phone"),
                 F.col("n_name").alias("location"), F.lit("").alias("linkedin"), F.lit("").alias("github"),
                 F.lit("").alias("portfolio")).alias("contact"),
        F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" placed with status "), F.col("o_orderstatus"),
                 F.lit(".")).alias("summary"),
        F.transform(F.coalesce("_roles", F.array()), lambda x: x.getField("e")).alias("experience"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        F.array(F.struct(F.concat(F.lit("B.Sc. "), F.col("r_name")).alias("degree"),
                         F.concat(F.col("n_name"), F.lit(" University")).alias("institution"),
                         F.lit("").alias("location"), (year - 4).cast("string").alias("start_date"),
                         year.cast("string").alias("end_date"), F.lit("").alias("details"))).alias("education"),
        F.array(F.struct(F.concat(F.lit("Priority "), F.col("o_orderpriority")).alias("name"),
                         F.lit("").alias("issuer"), F.lit("").alias("date"))).alias("certifications"),
        F.array().cast("array<struct<name:string,description:string,bullets:array<string>>>").alias("projects"),
        F.array().cast("array<string>").alias("publications"), F.array().cast("array<string>").alias("languages"),
        F.array().cast("array<string>").alias("awards")]
    return base.select(F.col("o_orderkey").alias("candidate_id"), *fields, F.struct("_first.title", "_first.company").alias("first_role"))


def candidates(spark, sf_dir):
    """:func:`candidate_fields` as one structured résumé (D4) per order."""
    c = candidate_fields(spark, sf_dir).drop("first_role")
    return c.select("candidate_id", F.struct(*c.columns[1:]).alias("resume"))


@query("resume_roundtrip")
def resume_roundtrip(spark, sf_dir):
    """N6 then the heuristic parser: every candidate rendered to text and parsed back."""
    cand = candidates(spark, sf_dir)
    docs = cand.select(F.col("candidate_id").alias("doc_id"), resume.render_text(F.col("resume")).alias("text"))
    p = resume.parse_resumes(docs)
    r = F.col("resume")
    exp = r.getField("experience")
    first = F.get(exp, 0)
    edu = F.get(r.getField("education"), 0)
    return p.select(
        F.col("doc_id").alias("candidate_id"), r.getField("contact").getField("name").alias("name"),
        r.getField("contact").getField("email").alias("email"), r.getField("contact").getField("phone").alias("phone"),
        r.getField("summary").alias("summary"), F.size(exp).cast("long").alias("n_roles"),
        F.aggregate(exp, F.lit(0).cast("long"), lambda acc, e: acc + F.size(e.getField("bullets"))).alias("n_bullets"),
        first.getField("title").alias("first_title"), first.getField("start_date").alias("first_start"),
        first.getField("end_date").alias("first_end"),
        F.array_join(r.getField("skills"), ", ").alias("skills"),
        F.size(r.getField("education")).cast("long").alias("n_education"), edu.getField("degree").alias("degree"),
        edu.getField("start_date").alias("edu_start"), edu.getField("end_date").alias("edu_end"),
        F.size(r.getField("certifications")).cast("long").alias("n_certs"))


@query("resume_merge")
def resume_merge(spark, sf_dir):
    """Extracted résumés (without summary for every third candidate, without skills for
    every fourth) over heuristic ones (other names)."""
    c = candidates(spark, sf_dir)
    r, k = F.col("resume"), F.col("candidate_id")
    none = F.array().cast("array<string>")
    extracted = (r.withField("summary", F.when(k % 3 == 0, F.lit("")).otherwise(r.getField("summary")))
                  .withField("skills", F.when(k % 4 == 0, none).otherwise(r.getField("skills"))))
    contact = r.getField("contact")
    heuristic = (r.withField("summary", F.lit("heuristic")).withField("skills", F.array(F.lit("guess")))
                  .withField("contact", contact.withField("linkedin", F.lit("in/x")).withField("name", F.lit("Other"))))
    m = c.select("candidate_id", resume.merge_parsed(extracted, heuristic).alias("m"))
    return m.select("candidate_id", F.col("m.contact.name").alias("name"), F.col("m.contact.linkedin").alias("linkedin"),
                    F.col("m.summary").alias("summary"), F.array_join("m.skills", ", ").alias("skills"),
                    F.size("m.experience").cast("long").alias("n_roles"))


@query("candidate_facts")
def candidate_facts(spark, sf_dir):
    """Fact sheets (cover-letter and screening variants) per candidate."""
    c = candidates(spark, sf_dir)
    cover = resume.candidate_facts(F.col("resume"))
    screen = resume.candidate_facts(F.col("resume"), with_education=False)

    def n_bullets(f):
        return F.aggregate(f.getField("experience"), F.lit(0).cast("long"), lambda a, e: a + F.size(e.getField("bullets")))
    return c.select("candidate_id", F.size(cover.getField("experience")).cast("long").alias("cover_roles"),
                    n_bullets(cover).alias("cover_bullets"), F.size(cover.getField("skills")).cast("long").alias("cover_skills"),
                    F.array_join(cover.getField("education"), "; ").alias("cover_education"),
                    F.size(screen.getField("experience")).cast("long").alias("screen_roles"),
                    n_bullets(screen).alias("screen_bullets"), F.length(screen.getField("summary")).cast("long").alias("summary_chars"))


@query("resume_text")
def resume_text(spark, sf_dir):
    """Each candidate's résumé flattened to the text used for matching."""
    c = candidates(spark, sf_dir)
    t = resume.resume_to_text(F.col("resume"))
    return c.select("candidate_id", F.length(t).cast("long").alias("n_chars"),
                    F.substring(F.sha1(t), 1, 16).alias("text_hash"))


@query("skill_order")
def skill_order(spark, sf_dir):
    """each candidate's skills reordered by the keyword tiers of its pool
    (critical first, then recommended, else original order)."""
    kw = part_keywords(spark, sf_dir)
    lists = kw.groupBy("pool").agg(
        F.array_sort(F.collect_list(F.when(F.col("tier") == "critical", F.col("keyword")))).alias("crit"),
        F.array_sort(F.collect_list(F.when(F.col("tier") == "recommended", F.col("keyword")))).alias("rec"))
    c = candidates(spark, sf_dir).withColumn("pool", (F.col("candidate_id") % 3).cast("string")).join(lists, "pool", "left")
    empty = F.array().cast("array<string>")
    skills = F.transform(F.col("resume.skills"), lambda s: F.lower(s))
    order = resume.reorder_skills(skills, F.coalesce("crit", empty), F.coalesce("rec", empty))
    return c.select("candidate_id", F.array_join(order, ", ").alias("skills_ordered"))


@query("tailoring_check")
def tailoring_check(spark, sf_dir):
    """J10 + P14 + Q7: a role's bullets (another one per candidate) overlaid with a rewrite,
    education entries naming a class dropped, and for some candidates employers renamed, a
    skill lost, a certificate exchanged and a degree added; the check reports what changed."""
    k = F.col("candidate_id")
    school = F.array(F.struct(F.lit("Class XII").alias("degree"), F.lit("School").alias("institution"), F.lit("").alias("location"),
                              F.lit("").alias("start_date"), F.lit("").alias("end_date"), F.lit("").alias("details")))
    # fields are edited one by one: a case between whole résumés is worked out for every field taken from it
    def edited(r, field, when, edit):
        return r.withField(field, F.when(when, edit(r.getField(field))).otherwise(r.getField(field)))

    c = candidates(spark, sf_dir).withColumn("resume", edited(F.col("resume"), "education", k % 3 == 0, lambda e: F.concat(e, school)))
    rewrites = F.create_map((k % 2).cast("int"), F.array(F.concat(F.lit("Rewritten bullet of "), k.cast("string")))).cast("map<int,array<string>>")
    cert = F.array(F.struct(F.lit("Forklift licence").alias("name"), F.lit("").alias("issuer"), F.lit("").alias("date")))
    degree = F.array(F.struct(F.lit("M.Sc. Logistics").alias("degree"), *[F.lit("").alias(x) for x in ("institution", "location", "start_date", "end_date", "details")]))
    after = resume.drop_class_education(resume.overlay_bullets(F.col("resume"), rewrites))
    after = edited(after, "experience", k % 5 == 0, lambda es: F.transform(es, lambda e: e.withField("company", F.lit("Renamed"))))
    after = edited(after, "skills", k % 5 == 0, lambda ss: F.slice(ss, 2, F.size(ss) + 1))
    after = edited(after, "certifications", k % 7 == 0, lambda _: cert)
    after = edited(after, "education", k % 11 == 0, lambda es: F.concat(es, degree))
    c = c.select("candidate_id", "resume", F.inline(F.array(F.struct(after.alias("after")))))
    ch, first = resume.tailoring_changes(F.col("resume"), F.col("after")), F.get(F.col("after.experience"), 0)
    c = c.select("candidate_id", first.alias("first"), F.inline(F.array(F.struct(ch.alias("ch")))))
    counted = ("employers_removed", "education_removed", "skills_removed")
    listed = ("employers_added", "education_added", "certs_removed", "certs_added", "numbers_lost", "names_lost")
    ch, first = F.col("ch"), F.col("first")
    return c.select("candidate_id", *[F.size(ch.getField(f)).cast("long").alias(f) for f in counted],
                    *[F.array_join(F.array_sort(ch.getField(f)), "|").alias(f) for f in listed],
                    F.array_join(F.coalesce(first.getField("bullets"), F.array().cast("array<string>")), "|")
                    .alias("first_bullets"))


@query("top_jobs_table")
def top_jobs_table(spark, sf_dir):
    """The 8 best postings per pool as a 7-column report table."""
    ranked = rank.rank_postings(T.embedded_postings(spark, sf_dir), T.candidates_per_label(spark, sf_dir), as_of=T.AS_OF)
    return reports.top_jobs_table(rank.top_n_per_candidate(ranked, 8))


# ------------------------------------------------------------ more reports ----

from ..functions.timefn import millis_to_utc_text  # noqa: E402
from ..sources import documents as docs_src  # noqa: E402
from ..functions.numeric import round_half_up  # noqa: E402

EVENTS_AS_OF = "2024-01-31 00:00:00"
LOOKBACK_DAYS = 7


@query("poll_counts")
def poll_counts(spark, sf_dir):
    """Messages checked, messages that could advance a status, and
    applications advanced."""
    f = mail.fold_statuses(_event_applications(spark, sf_dir), _event_messages(spark, sf_dir))
    return f.agg(F.sum("n_messages").cast("long").alias("checked"),
                 F.sum("n_candidates").cast("long").alias("classified"),
                 F.count_if(F.col("status") != F.col("start_status")).cast("long").alias("advanced"))


@query("recent_messages")
def recent_messages(spark, sf_dir):
    """S10/T-6: messages inside the look-back window, with the received time
    rendered from epoch milliseconds."""
    ev = T.read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    since = F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - F.expr(f"INTERVAL {LOOKBACK_DAYS} DAYS")
    return ev.filter(F.col("ts") >= since).select("event_id", "user_id", millis_to_utc_text(ms).alias("received_at"))


@query("salary_overlay")
def salary_overlay(spark, sf_dir):
    """Postings without structured pay (pending orders here) take landed
    extraction results (every third order, in lakh already; never divided again);
    priority structured > regex > extraction > missing."""
    p = T.postings(spark, sf_dir)
    pend = F.col("job_salary_period") == "hourly"
    p = (p.withColumn("job_min_salary", F.when(pend, None).otherwise(F.col("job_min_salary")))
          .withColumn("job_max_salary", F.when(pend, None).otherwise(F.col("job_max_salary"))))
    o = T.read(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 3 == 0)
    ext = o.select(F.col("o_orderkey").alias("job_id"),
                   round_half_up(F.col("o_totalprice") / 100000, 2).alias("x_min"), F.lit(None).cast("double").alias("x_max"),
                   F.when(F.col("o_orderkey") % 2 == 0, "INR").otherwise("USD").alias("x_cur"))
    return reports.salary_overlay(p, ext)


@query("app_export")
def app_export(spark, sf_dir):
    """P5: the applications table as sheet cells."""
    a = app_upsert(spark, sf_dir).withColumn("watched", F.col("status").isin("applied", "screening"))
    return reports.as_cells(a)


@query("tier_lists")
def tier_lists(spark, sf_dir):
    """Per language the critical and recommended keyword displays in report order."""
    return keywords.tier_lists(classified_by_language(spark, sf_dir))


def classified_by_language(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("pool"), "text")
    return keywords.market_keywords(d, keywords.docs_per_pool(d), keywords.landed_classification(landed_answers(keywords.vocabulary(d)), single=False))


TAILOR_THRESHOLD = 0.90


@query("tailoring_gate")
def tailoring_gate(spark, sf_dir):
    """A document needs tailoring when it covers under 90% of its language's critical
    and recommended terms."""
    d = T.read(spark, sf_dir, "documents").withColumn("pool", F.col("lang"))
    return ats.tailoring_gate(d, language_keywords(spark, sf_dir), threshold=TAILOR_THRESHOLD)


@query("role_dashboard")
def role_dashboard(spark, sf_dir):
    """A13 in full, languages as roles: the best postings per role (a posting's role is the
    language of its text), the role's critical keywords, what its documents as résumés must
    add on average, and their scores before and after their missed keywords are appended."""
    d = T.read(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("pool"))
    role = d.select(F.col("doc_id").alias("of"), "pool")
    p = T.embedded_postings(spark, sf_dir).drop("pool").join(role, F.col("job_id") == F.col("of")).drop("of")
    e = T.read(spark, sf_dir, "embeddings").join(role, F.col("vec_id") == F.col("of"))
    cands = e.groupBy("pool").agg(F.min("vec_id").alias("candidate_id"), F.min_by("embedding", "vec_id").alias("cand_embedding"))
    top = rank.top_n_per_candidate(rank.rank_postings(p, cands, as_of=T.AS_OF), 3)
    kw = spooled(language_keywords(spark, sf_dir))
    gaps = keywords.gap_analysis(d.select("pool", F.col("doc_id").alias("candidate_id"), tx.resume_tokens(F.col("text")).alias("tokens")), kw)
    must = gaps.select("pool", F.size(F.filter("gap", lambda x: x.getField("bucket") == "must_add")).alias("n_must_add"))
    reports = _before_after(d, ats.Terms(kw)).filter("metric = 'Overall ATS score'").join(role, F.col("doc_id") == F.col("of"))
    return rank.role_summary(top, keywords=kw, gaps=must, reports=reports)


@query("best_role")
def best_role(spark, sf_dir):
    """the role pool with the best baseline composite (ties: lowest pool id)."""
    return reports.best_role(role_summary(spark, sf_dir))


DOCUMENTS_PER_FILE = 50  # a file is read as one value, so its size must be bounded


@query("document_files")
def document_files(spark, sf_dir):
    """S6 + S5: documents written as text files of a few documents, partitioned by source,
    each file read back whole; characters per source."""
    import uuid
    d = T.read(spark, sf_dir, "documents").select("source", "text")
    path = scratch_path(spark, f"artifacts/documents/{uuid.uuid4().hex[:12]}")
    d.write.partitionBy("source").option("maxRecordsPerFile", DOCUMENTS_PER_FILE).text(path)
    ok, _ = docs_src.read_documents(spark, path)
    return (ok.select(F.regexp_extract("path", r"source=([^/]+)", 1).alias("source"),
                      F.length("text").alias("n"))
            .groupBy("source").agg(F.sum("n").cast("long").alias("n_chars")))


@query("app_snapshot")
def app_snapshot(spark, sf_dir):
    """The upserted table saved as version 1, bucketed by application; the status
    changes as version 2, in the buckets that they touch; readers see the current version."""
    import uuid
    path = scratch_path(spark, f"tables/applications/{uuid.uuid4().hex[:12]}")
    sinks.save_snapshot(spark, app_upsert(spark, sf_dir), path, key="job_id")
    updates = spooled(_status_updates(spark, sf_dir))
    sinks.save_changes(spark, path, apps.SCHEMA, lambda rows: apps.set_status(rows, updates)[0], updates, key="job_id")
    cur = sinks.load_snapshot(spark, path, apps.SCHEMA)
    return cur.select("job_id", "status", "applied_at", "last_response_at", "last_response_summary", "notes")


@query("cover_letter_lines")
def cover_letter_lines(spark, sf_dir):
    """A dated letter per candidate (header, recipient, salutation, body,
    sign-off with the first name) as ordered lines."""
    c = candidate_fields(spark, sf_dir)
    r = F.struct("contact", "summary")
    name = r.getField("contact").getField("name")
    first_name = F.coalesce(F.try_element_at(F.split(F.trim(name), " "), F.lit(1)), F.lit(""))
    role = F.col("first_role")
    body = F.concat(F.lit("I am applying for the "), F.coalesce(role.getField("title"), F.lit("open")),
                    F.lit(" role at "), F.coalesce(role.getField("company"), F.lit("your company")), F.lit(".\n\n"),
                    r.getField("summary"))
    lines = reports.letter_lines(r, body, role.getField("company"), first_name, F.lit(AS_OF_TEXT).cast("timestamp"))
    c = c.select("candidate_id", first_name.alias("first_name"), lines.alias("lines"))
    return c.select("candidate_id", F.size("lines").cast("long").alias("n_lines"), "first_name",
                    F.get("lines", 2).alias("dated"), F.array_join("lines", "\n").alias("letter"))


# -------------------------------------------------------- screening answers ----

from ..operators import answers as ans  # noqa: E402


@query("screening_answers")
def screening_answers(spark, sf_dir):
    """Landed answer responses (from events: fenced for clicks,
    truncated for errors) parsed, blank-filled, overridden by each user's explicit
    preferences (every third user states them) and rendered as labelled lines."""
    ev = T.read(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("props").alias("why_this_role"),
                              F.get_json_object("props", "$.k").alias("years_of_total_experience"),
                              F.format_string("%.2f", F.col("value")).alias("current_ctc_lpa"),
                              F.array(F.col("event_type")).alias("core_techniques")))
    raw = (F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(F.col("event_type") == "error", F.substring(body, 1, 20)).otherwise(body))
    prefs = F.when(F.col("user_id") % 3 == 0, F.struct(
        F.lit(25.0).alias("current_ctc_lpa"), F.lit(30.0).alias("expected_ctc_lpa"),
        F.lit(None).cast("double").alias("notice_period_days"), F.lit(True).alias("willing_to_relocate"),
        F.lit("2024-03-01").alias("earliest_join_date"))).otherwise(F.struct(
        F.lit(None).cast("double").alias("current_ctc_lpa"), F.lit(None).cast("double").alias("expected_ctc_lpa"),
        F.lit(None).cast("double").alias("notice_period_days"), F.lit(None).cast("boolean").alias("willing_to_relocate"),
        F.lit("").alias("earliest_join_date")))
    d = ev.select("event_id", "user_id", raw.alias("_raw"), prefs.alias("_prefs"))
    d = ans.parse_answers(d, "_raw", "_parsed")
    d = d.withColumn("_a", ans.apply_preferences(F.col("_parsed"), F.col("_prefs")))
    d = d.withColumn("_lines", ans.answer_lines(F.col("_a")))
    a, lines = F.col("_a"), F.col("_lines")
    return d.select("event_id", a.getField("years_of_total_experience").alias("years"),
                    a.getField("current_ctc_lpa").alias("current_ctc"),
                    a.getField("willing_to_relocate_to_job_location").alias("relocate"),
                    a.getField("earliest_join_date").alias("join_date"),
                    F.get(lines, 11).alias("techniques_line"), F.get(lines, 14).alias("why_line"),
                    ans.first_name(F.lit(None).cast("string"), F.concat(F.lit("User "), F.col("user_id").cast("string")))
                     .alias("first_name"))


@query("role_report")
def role_report(spark, sf_dir):
    """Role presets (nations, pool = nation key) with their pool's summary; a preset
    without postings yields an error row, a pool without a preset is kept under its key."""
    r = T.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("pool"),
                                               tx.slug(F.concat_ws(" ", F.col("n_name"), F.lit("& quality assurance, level"), F.col("n_regionkey")))
                                               .alias("role_slug"))
    return reports.attach_summaries(r, role_summary(spark, sf_dir))
