"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on DuckDB with the driver tables registered as views. Column
names match the Spark results. Literal decimals are cast to DOUBLE so that
DuckDB does not compute in DECIMAL.
"""
from __future__ import annotations

from collections.abc import Callable

AS_OF_EPOCH = 996710400

POSTINGS_CTE = """
postings AS (
  SELECT o.o_orderkey AS job_id, o.o_orderpriority AS job_title, c.c_mktsegment AS employer_name,
         n.n_name AS job_city, o.o_orderpriority = '1-URGENT' AS job_is_remote,
         CAST(epoch(o.o_orderdate) AS BIGINT) AS job_posted_at_timestamp,
         o.o_totalprice AS job_min_salary,
         CASE WHEN c.c_acctbal > 0 THEN o.o_totalprice + c.c_acctbal END AS job_max_salary,
         (['INR', 'USD', 'EUR', 'GBP', NULL])[CAST(o.o_orderkey % 5 AS INTEGER) + 1] AS job_salary_currency,
         CASE o.o_orderstatus WHEN 'O' THEN 'yearly' WHEN 'F' THEN 'monthly' WHEN 'P' THEN 'hourly' END
           AS job_salary_period,
         CAST(o.o_orderkey % 400 AS INTEGER) AS _applicant_count,
         'https://jobs.example.org/' || CAST(o.o_orderkey AS VARCHAR) AS job_apply_link,
         lower(c.c_mktsegment) AS pool,
         o.o_orderkey AS _ord, o.o_orderdate AS _posted
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

# Ranker salary reading (structured branch; amounts in the binding are never 0/NULL
# together, so the free-text branches cannot fire on it).
_LPA = """round(CASE WHEN per = 'monthly' THEN {v} * 12 WHEN per = 'hourly' THEN {v} * 2080 ELSE {v} END
   * CASE cur WHEN 'INR' THEN 1.0::DOUBLE WHEN 'USD' THEN 86.0::DOUBLE WHEN 'EUR' THEN 92.0::DOUBLE
              WHEN 'GBP' THEN 108.0::DOUBLE WHEN 'SGD' THEN 64.0::DOUBLE ELSE 1.0::DOUBLE END
   / 100000.0::DOUBLE, 2)"""

SALARY_CTE = """
sal0 AS (
  SELECT *, coalesce(nullif(upper(job_salary_currency), ''), 'INR') AS cur,
            coalesce(nullif(lower(job_salary_period), ''), 'annual') AS per,
            CASE WHEN job_min_salary <> 0 THEN job_min_salary END AS lo_raw,
            CASE WHEN job_max_salary <> 0 THEN job_max_salary END AS hi_raw
  FROM {src}
), sal1 AS (
  SELECT *, """ + _LPA.format(v="lo_raw") + """ AS salary_min_lpa,
            """ + _LPA.format(v="hi_raw") + """ AS salary_max_lpa,
            CASE WHEN lo_raw IS NOT NULL OR hi_raw IS NOT NULL THEN 'structured' ELSE 'missing' END
              AS salary_source
  FROM sal0
), sal AS (
  SELECT *, coalesce((salary_min_lpa + salary_max_lpa) / 2, salary_min_lpa, salary_max_lpa) AS salary_mid_lpa,
            CASE WHEN salary_source = 'structured' THEN cur ELSE coalesce(upper(job_salary_currency), '') END
              AS salary_currency
  FROM sal1
)"""

EMB_CTE = """
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS emb, CAST(label AS VARCHAR) AS label FROM embeddings)"""

# Ranked projection for postings with ``sal`` columns, pool stats ``st`` and
# candidates ``cand`` (pool, candidate_id, cemb).
RANKED_SELECT = """
scored AS (
  SELECT s.*, st.n_known, st.med, st.sd,
         CAST(floor((""" + str(AS_OF_EPOCH) + """ - job_posted_at_timestamp) / 86400.0::DOUBLE) AS BIGINT) AS days
  FROM sal s JOIN st ON s.pool = st.pool
), ranked AS (
  SELECT cand.candidate_id, sc.pool, sc.job_id, coalesce(sc.job_title, '') AS title,
         coalesce(sc.employer_name, '') AS company, coalesce(nullif(sc.job_city, ''), '') AS city,
         '' AS state, coalesce(sc.job_is_remote, false) AS remote, sc.days AS posted_days_ago,
         sc.salary_min_lpa, sc.salary_max_lpa, sc.salary_mid_lpa, sc.salary_source,
         (list_dot_product(sc.emb, cand.cemb) + 1.0::DOUBLE) / 2.0::DOUBLE AS fit,
         CASE WHEN sc.n_known = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-((coalesce(sc.salary_mid_lpa, sc.med) - sc.med)
              / coalesce(nullif(sc.sd, 0), 1.0::DOUBLE)))) END AS ss,
         exp(-greatest(sc.days, 0) / 30.0::DOUBLE) AS rs,
         sc.job_apply_link AS apply_link
  FROM scored sc JOIN cand ON sc.pool = cand.pool
), final AS (
  SELECT candidate_id, pool, job_id, title, company, city, state, remote, posted_days_ago,
         salary_min_lpa, salary_max_lpa, salary_mid_lpa, salary_source,
         round(fit, 4) AS fit_score, round(ss, 4) AS salary_score, round(rs, 4) AS recency_score,
         round((0.45::DOUBLE * fit + 0.35::DOUBLE * ss + 0.2::DOUBLE * rs) / 1.0::DOUBLE, 4) AS composite_score,
         apply_link
  FROM ranked
)"""

STATS_CTE = """
st AS (SELECT pool, count(salary_mid_lpa) AS n_known, median(salary_mid_lpa) AS med,
              stddev_pop(salary_mid_lpa) AS sd FROM sal GROUP BY pool)"""

FILTER_CTE = """
fc0 AS (
  SELECT p.*, lower(trim(coalesce(employer_name, ''))) AS emp,
         (""" + str(AS_OF_EPOCH) + """ - job_posted_at_timestamp) / 86400.0::DOUBLE AS age,
         upper(coalesce(nullif(job_salary_currency, ''), 'INR')) AS fcur,
         lower(coalesce(nullif(job_salary_period, ''), 'yearly')) AS fper
  FROM postings p
), fc1 AS (
  SELECT *, CASE WHEN fper LIKE 'month%' THEN job_min_salary * 12 WHEN fper LIKE 'hour%' THEN job_min_salary * 2080
                 ELSE job_min_salary END AS flo0,
            CASE WHEN fper LIKE 'month%' THEN job_max_salary * 12 WHEN fper LIKE 'hour%' THEN job_max_salary * 2080
                 ELSE job_max_salary END AS fhi0
  FROM fc0
), fc2 AS (
  SELECT *, CASE WHEN fcur = 'INR' THEN coalesce((flo + fhi) / 2, flo, fhi) END AS floor_mid
  FROM (SELECT *, CASE WHEN flo0 > 1000 THEN flo0 / 100000.0::DOUBLE ELSE flo0 END AS flo,
                  CASE WHEN fhi0 > 1000 THEN fhi0 / 100000.0::DOUBLE ELSE fhi0 END AS fhi FROM fc1)
), fc AS (
  SELECT *, CASE WHEN contains(emp, 'build') THEN 'blacklist'
                 WHEN age > 400.0::DOUBLE THEN 'stale'
                 WHEN _applicant_count > 350 THEN 'crowded'
                 WHEN floor_mid < 15.0::DOUBLE THEN 'low_salary' END AS drop_reason
  FROM fc2
), fcr AS (
  SELECT *, drop_reason IS NULL AND contains(emp, 'auto') AS is_recruiter,
         concat_ws('|', lower(trim(coalesce(employer_name, ''))),
                   regexp_replace(lower(trim(coalesce(job_title, ''))), '\\s+', ' ', 'g'),
                   lower(trim(coalesce(job_city, '')))) AS dkey
  FROM fc
)"""

#: SQL text, or a function that builds it: one that fails loses its own query only.
ORACLE: dict[str, str | Callable[[], str]] = {}

ORACLE["rank_top"] = "WITH " + ",".join([
    POSTINGS_CTE, EMB_CTE,
    "\np0 AS (SELECT p.* EXCLUDE (pool), 'all' AS pool, e.emb FROM postings p JOIN emb e ON e.vec_id = p.job_id)",
    SALARY_CTE.format(src="p0"), STATS_CTE,
    "\ncand AS (SELECT 'all' AS pool, min(vec_id) AS candidate_id, arg_min(emb, vec_id) AS cemb FROM emb)",
    RANKED_SELECT]) + """
SELECT * FROM final ORDER BY composite_score DESC, job_id LIMIT 15"""

ORACLE["top_per_pool"] = "WITH " + ",".join([
    POSTINGS_CTE, EMB_CTE,
    "\np0 AS (SELECT p.* EXCLUDE (pool), e.label AS pool, e.emb FROM postings p JOIN emb e ON e.vec_id = p.job_id)",
    SALARY_CTE.format(src="p0"), STATS_CTE,
    "\ncand AS (SELECT label AS pool, min(vec_id) AS candidate_id, arg_min(emb, vec_id) AS cemb FROM emb GROUP BY label)",
    RANKED_SELECT]) + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, pool
                                            ORDER BY composite_score DESC, job_id) AS rank FROM final)
WHERE rank <= 3"""

ORACLE["rank_many"] = ORACLE["top_per_pool"].replace(
    "SELECT label AS pool, min(vec_id) AS candidate_id, arg_min(emb, vec_id) AS cemb FROM emb GROUP BY label",
    "SELECT label AS pool, vec_id AS candidate_id, emb AS cemb FROM emb WHERE vec_id % 25 = 0")

ORACLE["role_summary"] = ORACLE["top_per_pool"].replace(
    "SELECT * FROM (SELECT *, row_number()", "top AS (SELECT * FROM (SELECT *, row_number()", 1).replace(
    "WHERE rank <= 3", "WHERE rank <= 3)")
ORACLE["role_summary"] = ORACLE["role_summary"].replace(
    "\ntop AS", ",\ntop AS", 1) + """
SELECT pool, count(*) AS n_ranked, coalesce(max(salary_mid_lpa), 0.0::DOUBLE) AS best_salary_lpa,
       median(salary_mid_lpa) AS median_top_salary_lpa, max(composite_score) AS best_composite,
       arg_max(job_id, (composite_score, -job_id)) AS best_job_id, round(avg(fit_score), 4) AS avg_fit
FROM top GROUP BY pool"""

ORACLE["fit_scores"] = "WITH " + EMB_CTE + """,
cand AS (SELECT label, min(vec_id) AS candidate_id, arg_min(emb, vec_id) AS cemb FROM emb GROUP BY label)
SELECT e.vec_id, e.label AS pool, c.candidate_id,
       round((list_dot_product(e.emb, c.cemb) + 1.0::DOUBLE) / 2.0::DOUBLE, 6) AS fit
FROM emb e JOIN cand c ON e.label = c.label"""

ORACLE["salary_lpa"] = "WITH " + POSTINGS_CTE + "," + SALARY_CTE.format(src="postings") + """
SELECT job_id, salary_min_lpa, salary_max_lpa, salary_mid_lpa, salary_currency, salary_source FROM sal
WHERE job_salary_period IS DISTINCT FROM 'hourly'
UNION ALL
SELECT job_id, lo, hi, (lo + hi) / 2, CASE WHEN lo IS NULL THEN coalesce(job_salary_currency, '') ELSE 'INR' END,
       CASE WHEN lo IS NULL THEN 'missing' ELSE 'regex' END
FROM (SELECT *, CASE job_id % 4 WHEN 0 THEN job_id % 30 + 5.0::DOUBLE WHEN 1 THEN job_id % 30 + 5.5::DOUBLE END AS lo,
             CASE job_id % 4 WHEN 0 THEN job_id % 30 + 9.0::DOUBLE WHEN 1 THEN job_id % 30 + 5.5::DOUBLE END AS hi
      FROM postings WHERE job_salary_period = 'hourly')"""

ORACLE["salary_pool_stats"] = "WITH " + POSTINGS_CTE + "," + SALARY_CTE.format(src="postings") + """
SELECT pool, count(*) AS n_postings, count(salary_mid_lpa) AS n_known, round(median(salary_mid_lpa), 4) AS median_mid,
       round(coalesce(nullif(stddev_pop(salary_mid_lpa), 0), 1.0::DOUBLE), 4) AS std_mid
FROM sal GROUP BY pool"""

ORACLE["salary_sketch"] = "WITH " + POSTINGS_CTE + "," + SALARY_CTE.format(src="postings") + """
SELECT pool, count(*) AS n_known, q AS quantile, true AS within_error FROM sal, (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q)
WHERE salary_mid_lpa IS NOT NULL GROUP BY pool, q"""

ORACLE["salary_distribution"] = "WITH " + POSTINGS_CTE + "," + SALARY_CTE.format(src="postings") + """
SELECT CAST(CASE WHEN salary_mid_lpa < 0 THEN 0 WHEN salary_mid_lpa >= 500 THEN 11
                 ELSE floor(salary_mid_lpa / 50.0::DOUBLE) + 1 END AS BIGINT) AS bucket,
       count(*) AS n_postings
FROM sal WHERE salary_mid_lpa IS NOT NULL GROUP BY 1"""

ORACLE["recency"] = """
SELECT o_orderkey AS job_id,
       CAST(floor((""" + str(AS_OF_EPOCH) + """ - epoch(o_orderdate)) / 86400.0::DOUBLE) AS BIGINT) AS days_whole,
       round((""" + str(AS_OF_EPOCH) + """ - epoch(o_orderdate)) / 86400.0::DOUBLE, 4) AS days_frac,
       round(exp(-greatest(floor((""" + str(AS_OF_EPOCH) + """ - epoch(o_orderdate)) / 86400.0::DOUBLE), 0) / 30.0::DOUBLE), 6)
         AS recency_score
FROM orders"""

ORACLE["filter_cascade"] = "WITH " + POSTINGS_CTE + "," + FILTER_CTE + """
SELECT job_id, drop_reason, is_recruiter, round(age, 4) AS days_since_posted FROM fcr"""

_FRESH = """row_number() OVER (PARTITION BY dkey ORDER BY age IS NULL, age, length(coalesce(d.text, '')) DESC, _ord) AS rn
  FROM fcr LEFT JOIN documents d ON d.doc_id = fcr.job_id WHERE drop_reason IS NULL"""
_LINKS = """,
probes AS (SELECT 'https://jobs.example.org/' || CAST(o_orderkey AS VARCHAR) AS url,
                  CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 7 = 0 THEN false
                       WHEN o_orderkey % 7 = 1 THEN o_orderkey % 3 = 0 ELSE true END AS ok
           FROM orders WHERE o_orderkey % 11 <> 0),
run AS (SELECT s.dkey, s.job_id, s.job_apply_link, coalesce(p.ok, false) AS alive
        FROM (SELECT dkey, job_id, job_apply_link, """ + _FRESH + """) s LEFT JOIN probes p ON p.url = s.job_apply_link WHERE s.rn = 1)"""

ORACLE["filter_stats"] = "WITH " + POSTINGS_CTE + "," + FILTER_CTE + _LINKS + """
SELECT count(*) AS input,
       count(*) FILTER (WHERE drop_reason = 'stale') AS dropped_stale,
       count(*) FILTER (WHERE drop_reason = 'crowded') AS dropped_crowded,
       (SELECT count(*) FILTER (WHERE NOT alive) FROM run) AS dropped_broken_link,
       count(*) FILTER (WHERE drop_reason = 'blacklist') AS dropped_blacklist,
       count(*) FILTER (WHERE drop_reason = 'low_salary') AS dropped_low_salary,
       count(*) FILTER (WHERE drop_reason IS NULL) - count(DISTINCT dkey) FILTER (WHERE drop_reason IS NULL)
         AS collapsed_duplicates,
       count(*) FILTER (WHERE is_recruiter) AS flagged_recruiter,
       (SELECT count(*) FILTER (WHERE alive) FROM run) AS output
FROM fcr"""

ORACLE["filter_run"] = "WITH " + POSTINGS_CTE + "," + FILTER_CTE + _LINKS + """
SELECT dkey AS dedupe_key, job_id, job_apply_link FROM run WHERE alive"""

ORACLE["dedupe_freshest"] = ("WITH " + POSTINGS_CTE.replace("epoch(o.o_orderdate)", "epoch(date_trunc('quarter', o.o_orderdate))") + "," + FILTER_CTE + """
SELECT dkey AS dedupe_key, job_id FROM (
  SELECT dkey, job_id, """ + _FRESH + """) WHERE rn = 1""")

ORACLE["source_dedupe"] = """
WITH s AS (SELECT p_partkey, CASE WHEN p_size <= 20 THEN CAST(p_partkey % 500 AS VARCHAR)
                  WHEN p_size <= 35 THEN 'https://jobs.example.org/' || CAST(p_partkey % 300 AS VARCHAR)
                  ELSE sha1(p_name || p_brand || p_type) END AS source_key FROM part)
SELECT source_key, min(p_partkey) AS part_key FROM s GROUP BY source_key"""

ORACLE["board_dedupe"] = """
WITH a AS (SELECT 0 AS alias_ord, p_name AS job_title, * FROM part WHERE p_size <= 30
           UNION ALL SELECT 1, upper(p_name), * FROM part WHERE p_size >= 20),
f AS (SELECT *, row_number() OVER (PARTITION BY alias_ord, lower(p_brand), lower(p_name), lower(p_type) ORDER BY p_partkey) AS rn FROM a),
g AS (SELECT *, row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY alias_ord, p_partkey) AS rk FROM f WHERE rn = 1)
SELECT CAST(p_partkey % 700 AS VARCHAR) AS job_id, alias_ord, job_title, p_partkey AS part_key FROM g WHERE rk = 1"""

ORACLE["floor_salary"] = "WITH " + POSTINGS_CTE + "," + FILTER_CTE + """
SELECT job_id, floor_mid AS floor_mid_lpa FROM fc2"""


# ============================================================ batch 2 =========
from ..functions import stopwords as _sw  # noqa: E402
from ..functions import text as _tx  # noqa: E402
from ..functions.numeric import sql_round_half_up as _rhu  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(x) for x in items) + "]"


def _clean(e: str) -> str:
    t = f"regexp_replace(coalesce({e}, ''), 'https?://\\S+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\S+@\\S+', ' ', 'g')"
    t = f"regexp_replace({t}, '[^A-Za-z0-9 \\-/\\+\\.#]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def _pytrim(e: str) -> str:
    return f"regexp_replace(coalesce({e}, ''), '^\\s+|\\s+$', '', 'g')"


def _lines(e: str) -> str:
    return (f"list_transform(string_split_regex(coalesce({e}, ''), '\\r\\n|\\r|\\n'), "
            f"lambda x: regexp_replace(x, '\\s+$', ''))")


def _strip_chars(e: str, chars: str) -> str:
    cls = "[" + "".join("\\" + ch if ch in "-]\\^[" else ch for ch in chars) + "]+"
    return f"regexp_replace(regexp_replace({e}, {_q('^' + cls)}, ''), {_q(cls + '$')}, '')"


def _word_count(e: str) -> str:
    return f"len(list_filter(string_split_regex(trim(coalesce({e}, '')), '\\s+'), lambda w: w <> ''))"


def _section(e: str) -> str:
    cleaned = f"regexp_replace(lower({_pytrim(e)}), ':+$', '')"
    cases = " ".join(f"WHEN {_q(a)} THEN {_q(c)}" for c, al in _tx.SECTION_ALIASES.items() for a in al)
    return f"(CASE WHEN length({cleaned}) <= 40 THEN (CASE {cleaned} {cases} END) END)"


ORACLE["dead_links"] = """
WITH ls AS (
  SELECT url, CASE WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 7 = 1 THEN 405 WHEN page_id % 7 = 2 THEN 301
                   ELSE 200 END AS head_status,
              CASE WHEN page_id % 3 = 0 THEN 200 ELSE 503 END AS get_status FROM pages)
SELECT p.page_id, p.url,
       coalesce(p.url, '') = '' OR coalesce(CASE WHEN ls.head_status = 405 THEN ls.get_status ELSE ls.head_status END, 999)
         BETWEEN 200 AND 399 AS link_alive
FROM pages p LEFT JOIN ls ON p.url = ls.url"""

ORACLE["merge_sources"] = """
WITH u AS (
  SELECT 0 AS pool_ord, CASE WHEN p_size > 45 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS job_id,
         p_name AS job_title, p_brand AS employer_name, p_type AS job_city, p_partkey AS _ord
  FROM part WHERE p_size <= 30
  UNION ALL
  SELECT 1, CASE WHEN p_size > 45 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END,
         p_name, p_brand, p_type, p_partkey FROM part WHERE p_size >= 20
), k AS (
  SELECT *, CASE WHEN trim(coalesce(job_id, '')) <> '' THEN 'id:' || trim(job_id)
            ELSE 'k:' || concat_ws('|', lower(trim(coalesce(employer_name, ''))),
                                   regexp_replace(lower(trim(coalesce(job_title, ''))), '\\s+', ' ', 'g'),
                                   lower(trim(coalesce(job_city, '')))) END AS mkey
  FROM u)
SELECT mkey AS merge_key, pool_ord AS source_ord, job_id, _ord AS part_key FROM (
  SELECT *, row_number() OVER (PARTITION BY mkey ORDER BY pool_ord, _ord) AS rn FROM k) WHERE rn = 1"""

_MANIFEST = """
rl AS (SELECT r.r_name AS role, n.n_name AS location,
              trim(concat_ws(' ', r.r_name, 'analytics', 'in', n.n_name)) AS query_text
       FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey),
manifest AS (
  SELECT substr(sha1(concat_ws('|', query_text, location, CAST(page AS VARCHAR))), 1, 16) AS request_key,
         role, location, CAST(page AS INTEGER) AS page, query_text
  FROM rl, (SELECT unnest([1, 2]) AS page))"""

ORACLE["request_manifest"] = "WITH " + _MANIFEST + "\nSELECT * FROM manifest"

ORACLE["pending_requests"] = "WITH " + _MANIFEST + """,
lnd AS (
  SELECT substr(sha1(concat_ws('|', trim(concat_ws(' ', r.r_name, 'analytics', 'in', n.n_name)), n.n_name,
                               CAST(o.o_orderkey % 2 + 1 AS VARCHAR))), 1, 16) AS request_key,
         o.o_orderdate AS fetched_at,
         CASE WHEN o.o_orderstatus = 'P' THEN '{"data": ['
              ELSE '{"data": [{"job_id": "' || CAST(o.o_orderkey AS VARCHAR) || '"}]}' END AS payload
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
latest AS (SELECT request_key, max({'f': fetched_at, 'p': payload}) AS l FROM lnd GROUP BY request_key),
fresh AS (SELECT request_key FROM latest
          WHERE """ + str(AS_OF_EPOCH) + """ - epoch(l.f) <= 604800 AND json_valid(l.p))
SELECT m.* FROM manifest m ANTI JOIN fresh f ON m.request_key = f.request_key"""

ORACLE["doc_clean"] = "SELECT doc_id, " + _clean("text") + " AS clean_text FROM documents"

_TOKS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), " + _q(_tx.TOKEN_PATTERN) + "))"
ORACLE["doc_tokens"] = ("SELECT doc_id, len(" + _TOKS + ") AS n_tokens, array_to_string(list_sort(" + _TOKS
                        + "), ' ') AS tokens FROM documents")

_NAME_OK = ("len(list_filter(string_split_regex(" + _pytrim("ln") + ", '\\s+'), lambda w: w <> '')) > 1 AND "
            "len(list_filter(string_split_regex(" + _pytrim("ln") + ", '\\s+'), lambda w: w <> '')) <= 6 AND "
            "len(list_filter(list_filter(string_split_regex(" + _pytrim("ln") + ", '\\s+'), lambda w: w <> ''), "
            "lambda w: upper(w[1]) = w[1] AND lower(w[1]) <> w[1])) >= "
            "len(list_filter(string_split_regex(" + _pytrim("ln") + ", '\\s+'), lambda w: w <> '')) - 1 AND "
            + _pytrim("ln") + " <> '' AND NOT regexp_matches(" + _pytrim("ln") + ", " + _q(_tx.EMAIL_PATTERN) + ") AND "
            "NOT regexp_matches(" + _pytrim("ln") + ", " + _q(_tx.URL_PATTERN) + ") AND "
            "NOT regexp_matches(" + _pytrim("ln") + ", " + _q(_tx.PHONE_PATTERN) + ")")

ORACLE["doc_contacts"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, """ + _lines("text") + """ AS lines FROM documents),
h AS (SELECT *, array_to_string(list_slice(lines, 1, 20), chr(10)) AS head FROM d),
m AS (SELECT *, regexp_extract(head, """ + _q(_tx.PHONE_PATTERN) + """, 0) AS ph FROM h)
SELECT doc_id, regexp_extract(head, """ + _q(_tx.EMAIL_PATTERN) + """, 0) AS email,
       CASE WHEN length(regexp_replace(ph, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 THEN trim(ph) ELSE '' END AS phone,
       regexp_extract(text, """ + _q(_tx.LINKEDIN_PATTERN) + """, 0) AS linkedin,
       regexp_extract(text, """ + _q(_tx.GITHUB_PATTERN) + """, 0) AS github,
       coalesce(regexp_replace(list_filter(list_slice(lines, 1, 10), lambda ln: """ + _NAME_OK + """)[1],
                               '^\\s+|\\s+$', '', 'g'), '') AS name
FROM m"""

ORACLE["html_text"] = """
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '(?i)<script[\\s\\S]*?</script>', ' ', 'g'), '(?i)<style[\\s\\S]*?</style>', ' ', 'g'),
  '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages"""

_HEAD = ("coalesce(" + _section("line") + ", CASE WHEN " + _word_count("line") + " BETWEEN 1 AND 2 THEN lower("
         + _strip_chars(_pytrim("line"), " .:") + ") END)")
_LINE_SECTIONS = """
d AS (SELECT doc_id, """ + _lines("text") + """ AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM d),
h AS (SELECT *, """ + _HEAD + """ AS head FROM l),
s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h),
ls AS (SELECT doc_id, line_no, section, regexp_matches(""" + _pytrim("line") + """, '^[\\-*•·◦]') AS is_bullet,
              """ + _pytrim("line") + """ AS text
       FROM s WHERE head IS NULL AND section IS NOT NULL AND """ + _pytrim("line") + """ <> '')"""

ORACLE["line_sections"] = "WITH " + _LINE_SECTIONS + "\nSELECT * FROM ls"

_DR = _q(_tx.DATE_RANGE_PATTERN)
_BEFORE = _strip_chars("trim(substr(text, 1, strpos(text, regexp_extract(text, " + _DR + ", 0)) - 1))", " -–|,")
ORACLE["entry_groups"] = "WITH " + _LINE_SECTIONS + """,
e0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) AS rn,
              regexp_matches(text, """ + _DR + """) AS has_range FROM ls),
e1 AS (SELECT *, (rn = 1) OR (NOT is_bullet AND has_range) AS hdr,
              CASE WHEN regexp_matches(text, """ + _DR + """) THEN """ + _BEFORE + """ END AS bf FROM e0),
e2 AS (SELECT *, sum(CAST(hdr AS INTEGER)) OVER (PARTITION BY doc_id, section ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry_id,
              contains(bf, ' — ') OR contains(bf, ' - ') AS has_dash, contains(bf, ',') AS has_comma FROM e1),
e3 AS (SELECT *,
         CASE WHEN NOT has_range THEN text
              WHEN has_dash THEN trim(regexp_extract(bf, '^(.*?) [—–-] ', 1))
              WHEN has_comma THEN trim(split_part(bf, ',', 1))
              ELSE trim(CASE WHEN contains(bf, ' at ') THEN substr(bf, 1, strpos(bf, ' at ') - 1) ELSE bf END) END AS t,
         CASE WHEN NOT has_range THEN ''
              WHEN has_dash THEN trim(regexp_replace(bf, '^.*? [—–-] ', ''))
              WHEN has_comma THEN trim(substr(bf, strpos(bf, ',') + 1))
              ELSE trim(CASE WHEN contains(bf, ' at ') THEN substr(bf, strpos(bf, ' at ') + 4) ELSE '' END) END AS c
       FROM e2)
SELECT doc_id, section, entry_id, max(CASE WHEN hdr THEN t END) AS title, max(CASE WHEN hdr THEN c END) AS company,
       max(CASE WHEN hdr AND has_range THEN regexp_extract(text, """ + _DR + """, 1) END) AS start_date,
       max(CASE WHEN hdr AND has_range THEN regexp_extract(text, """ + _DR + """, 3) END) AS end_date,
       count(*) FILTER (WHERE NOT hdr) AS n_bullets
FROM e3 GROUP BY doc_id, section, entry_id"""


def _canon(e: str) -> str:
    words = f"list_filter(string_split_regex(trim(lower(coalesce({e}, ''))), '\\s+'), lambda w: w <> '')"
    strip = ("list_transform(" + words + ", lambda w: CASE WHEN length(w) > 4 AND suffix(w, 'ing') THEN left(w, length(w) - 3) "
             "WHEN length(w) > 3 THEN (CASE WHEN suffix(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) "
             "WHEN suffix(w, 'es') AND length(w) > 3 THEN left(w, length(w) - 2) "
             "WHEN suffix(w, 's') AND length(w) > 2 THEN left(w, length(w) - 1) ELSE w END) ELSE w END)")
    return strip


CLASSES = ["hard_skill", "tool", "certification", "domain_term", "soft_skill", "noise"]


def gram_ctes(src: str) -> str:
    """CTEs ``np`` (pool sizes) and ``grams`` over a relation ``src(doc_id, pool, text)``."""
    return f"""
np AS (SELECT pool, count(*) AS n_docs FROM {src} GROUP BY pool),
tk AS (SELECT doc_id, pool, list_filter(regexp_extract_all(lower({_clean('text')}), '[a-z0-9]{{2,}}'),
                                   lambda t: NOT list_contains({_list(_sw.ENGLISH)}, t)) AS toks FROM {src}),
grams AS (SELECT pool, doc_id, 1 AS n, unnest(toks) AS phrase FROM tk
          UNION ALL
          SELECT pool, doc_id, 2 AS n, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))
          FROM tk)"""


_KEPT = f"length(phrase) BETWEEN 2 AND 50 AND NOT list_contains({_list(_tx.STOP_PHRASES)}, phrase)"


def score_ctes(src: str) -> str:
    """``sc``: every phrase of every document with its count and TF-IDF score."""
    return gram_ctes(src) + """,
cnt AS (SELECT pool, doc_id, n, phrase, count(*) AS tf FROM grams GROUP BY pool, doc_id, n, phrase),
dfq AS (SELECT pool, phrase, count(*) AS df FROM cnt GROUP BY pool, phrase),
sc AS (SELECT c.*, round(c.tf * (ln((1.0::DOUBLE + np.n_docs) / (1.0::DOUBLE + dfq.df)) + 1.0::DOUBLE), 9) AS score
       FROM cnt c JOIN dfq USING (pool, phrase) JOIN np USING (pool))"""


def keyword_ctes(src: str, classified: bool = False) -> str:
    """``held`` (phrases of documents with class and canonical form) and ``mk`` (keyword
    records); ``classified``: under the landed answers of the binding."""
    canonical = "array_to_string(list_filter(st, lambda x, i: i = 1 OR x <> st[i - 1]), ' ')"
    if classified:
        category = f"coalesce(({_list(CLASSES)})[CAST(length(phrase) % 7 AS INTEGER) + 1], 'hard_skill')"
        canonical = (f"CASE WHEN length(phrase) % 7 >= {len(CLASSES)} THEN {canonical} "
                     "WHEN length(phrase) % 2 = 0 THEN split_part(phrase, ' ', 1) ELSE phrase END")
    else:
        category = "'hard_skill'"
    return gram_ctes(src) + f""",
allp AS (SELECT DISTINCT pool, doc_id, phrase FROM grams WHERE {_KEPT}),
cls0 AS (SELECT DISTINCT pool, phrase FROM allp),
cls1 AS (SELECT pool, phrase, {_canon('phrase')} AS st FROM cls0),
cls AS (SELECT pool, phrase, {category} AS category, {canonical} AS canonical FROM cls1),
recs AS (SELECT pool, canonical, first(category ORDER BY phrase) AS category,
                first(phrase ORDER BY length(phrase) DESC, phrase) AS display
         FROM cls WHERE category <> 'noise' GROUP BY pool, canonical),
held AS (SELECT t.pool, t.doc_id, t.phrase, c.canonical FROM allp t JOIN cls c USING (pool, phrase)),
mem AS (SELECT pool, doc_id, canonical AS kw FROM held UNION SELECT pool, doc_id, phrase AS kw FROM held),
share AS (SELECT m.pool, m.kw, count(DISTINCT m.doc_id) AS raw_count FROM mem m
          SEMI JOIN recs r ON m.pool = r.pool AND m.kw = r.canonical GROUP BY m.pool, m.kw),
mk AS (SELECT r.pool, r.canonical AS keyword, r.display, r.category,
              {_rhu('s.raw_count / np.n_docs', 3)} AS frequency, s.raw_count,
              CASE WHEN s.raw_count / np.n_docs >= 0.6::DOUBLE THEN 'critical'
                   WHEN s.raw_count / np.n_docs >= 0.3::DOUBLE THEN 'recommended' ELSE 'nice_to_have' END AS tier
       FROM recs r JOIN share s ON r.pool = s.pool AND r.canonical = s.kw JOIN np ON r.pool = np.pool
       WHERE s.raw_count / np.n_docs >= 0.1::DOUBLE)"""


_REPORT_ORDER = """CASE tier WHEN 'critical' THEN 1 WHEN 'recommended' THEN 2 ELSE 3 END,
          CASE category WHEN 'hard_skill' THEN 1 WHEN 'tool' THEN 2 WHEN 'certification' THEN 3 WHEN 'domain_term' THEN 4
                        WHEN 'soft_skill' THEN 5 ELSE 99 END, frequency DESC, keyword"""
_DOCS_SRC = "src AS (SELECT doc_id, source AS pool, text FROM documents),"
_LANG_SRC = "src AS (SELECT doc_id, lang AS pool, text FROM documents),"
_PART_SRC = """src AS (SELECT p_partkey AS doc_id,
         CASE WHEN p_type = 'PROMO' OR (p_type = 'SMALL' AND p_size < 25) THEN '0'
              WHEN p_type = 'LARGE' OR (p_type = 'MEDIUM' AND p_size < 25) THEN '1' ELSE '2' END AS pool,
         p_type || ' ' || p_name AS text FROM part),"""

ORACLE["phrase_topn"] = lambda: "WITH " + _DOCS_SRC + score_ctes("src") + f"""
SELECT pool, doc_id, n, phrase, tf, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY score DESC, phrase) AS rank FROM sc)
WHERE rank <= 30 AND {_KEPT}"""
ORACLE["doc_frequency"] = lambda: "WITH " + _DOCS_SRC + gram_ctes("src") + f"""
SELECT pool, phrase, count(DISTINCT doc_id) AS n_docs FROM grams WHERE {_KEPT} GROUP BY pool, phrase"""
ORACLE["market_keywords"] = lambda: "WITH " + _DOCS_SRC + keyword_ctes("src") + "\nSELECT * FROM mk"
ORACLE["classified_keywords"] = lambda: ("WITH " + _DOCS_SRC + keyword_ctes("src", classified=True) + f"""
SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {_REPORT_ORDER}) AS report_rank FROM mk""")
ORACLE["doc_vectors"] = lambda: "WITH src AS (SELECT doc_id, 'all' AS pool, text FROM documents)," + score_ctes("src") + """
SELECT doc_id, phrase AS term, round(score / sqrt(sum(score * score) OVER (PARTITION BY doc_id)), 6) AS weight
FROM sc WHERE n = 1"""


ORACLE["hashed_vectors"] = lambda: "WITH src AS (SELECT doc_id, 'all' AS pool, text FROM documents)," + gram_ctes("src") + """,
sl AS (SELECT doc_id, ('0x' || substr(md5(phrase), 1, 8))::BIGINT % 64 AS slot, count(*) AS tf FROM grams WHERE n = 1 GROUP BY 1, 2),
idf AS (SELECT slot, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM sl GROUP BY slot),
w AS (SELECT doc_id, sl.slot, tf * idf AS w FROM sl JOIN idf ON idf.slot = sl.slot)
SELECT doc_id, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 4) AS weight FROM w"""

ORACLE["phrase_cosine"] = lambda: "WITH " + _DOCS_SRC + score_ctes("src") + f""",
top AS (SELECT pool, doc_id, n, phrase FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY score DESC, phrase) AS rank FROM sc) WHERE rank <= 30 AND {_KEPT})
SELECT top.doc_id, top.pool, top.n, top.phrase, round(list_cosine_similarity(d.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score
FROM top JOIN embeddings d ON d.vec_id = top.doc_id
JOIN embeddings p ON p.vec_id = ('0x' || substr(md5(top.phrase), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)"""

def mmr_ctes(by: str, top_n: int) -> str:
    """``c`` (candidates of ``sc`` per ``by``) and ``m``: one MMR pick (diversity 0.3) per step and
    group, every candidate left carrying its largest similarity to what was picked before."""
    order = "PARTITION BY {by} ORDER BY 0.7::DOUBLE * rel - 0.3::DOUBLE * red DESC, score DESC, phrase".format(by=by)
    keep = f"{by}, phrase, score, rel, ws, red, first_value(phrase) OVER w AS pick, first_value(ws) OVER w AS pws"
    return f""",
c AS (SELECT {by}, phrase, score, score / max(score) OVER (PARTITION BY {by}) AS rel, list_distinct(string_split(phrase, ' ')) AS ws,
             0.0::DOUBLE AS red FROM sc),
m AS (SELECT 1 AS k, {keep} FROM c WINDOW w AS ({order})
      UNION ALL
      SELECT k + 1, {keep}
      FROM (SELECT k, {by}, phrase, score, rel, ws, greatest(red, shared / (len(ws) + len(pws) - shared)) AS red
            FROM (SELECT *, len(list_intersect(ws, pws)) AS shared FROM m WHERE phrase <> pick AND k < {top_n}))
      WINDOW w AS ({order}))"""


ORACLE["phrase_mmr"] = lambda: "WITH RECURSIVE " + _DOCS_SRC + score_ctes("src") + mmr_ctes("doc_id", 30) + """
SELECT doc_id, phrase, score, k AS mmr_rank FROM m WHERE phrase = pick"""

#: Landed answers are for the documents' phrases; phrases of the seeds alone have none.
ORACLE["mined_keywords"] = lambda: ("WITH RECURSIVE " + """
src AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS doc_id, source AS pool, text FROM documents
        UNION ALL SELECT 'seeds', pool, string_agg(DISTINCT seed, chr(10) ORDER BY seed)
        FROM (SELECT lower(p_name) AS seed, 'src' || CAST(p_partkey % 20 AS VARCHAR) AS pool FROM part) GROUP BY pool),"""
    + score_ctes("src") + mmr_ctes("pool, doc_id, n", 30) + f""",
mp AS (SELECT pool, doc_id, phrase FROM m WHERE phrase = pick),
answered AS (SELECT DISTINCT phrase FROM grams WHERE doc_id <> 'seeds' AND {_KEPT}),"""
    + keyword_ctes("src", classified=True)[len(gram_ctes("src")) + 1:]
        .replace("FROM grams WHERE", "FROM mp WHERE")
        .replace("CASE WHEN length(phrase) % 7 >=", "CASE WHEN phrase NOT IN (SELECT phrase FROM answered) OR length(phrase) % 7 >=")
        .replace("coalesce((['hard_skill'", "coalesce(CASE WHEN phrase IN (SELECT phrase FROM answered) THEN (['hard_skill'")
        .replace("[CAST(length(phrase) % 7 AS INTEGER) + 1], 'hard_skill')", "[CAST(length(phrase) % 7 AS INTEGER) + 1] END, 'hard_skill')")
    + "\nSELECT * FROM mk")

def _coverage_ctes(text_expr: str = "text") -> str:
    return ("\ncd AS MATERIALIZED (SELECT doc_id, source, lang, regexp_replace(lower(coalesce(" + text_expr
            + ", '')), '\\s+', ' ', 'g') AS hay FROM documents),"
            """
cm AS (SELECT cd.doc_id, k.tier, k.display,
              (coalesce(k.keyword, '') <> '' AND contains(cd.hay, lower(k.keyword)))
              OR (coalesce(k.display, '') <> '' AND contains(cd.hay, lower(k.display)))
                AS hit
       FROM cd JOIN mk k ON k.pool = cd.lang),
tiers AS (SELECT unnest(['critical', 'recommended', 'nice_to_have', 'all']) AS tier),
cper AS (SELECT d.doc_id, t.tier, count(cm.display) AS n_terms, count(*) FILTER (WHERE cm.hit) AS n_hits,
                coalesce(array_to_string(list_sort(list(cm.display) FILTER (WHERE cm.hit)), '|'), '') AS hits,
                coalesce(array_to_string(list_sort(list(cm.display) FILTER (WHERE NOT cm.hit)), ', '), '') AS misses
         FROM (SELECT doc_id FROM cd) d CROSS JOIN tiers t
         LEFT JOIN cm ON cm.doc_id = d.doc_id AND (t.tier = 'all' OR cm.tier = t.tier)
         GROUP BY d.doc_id, t.tier),
cov AS (SELECT *, CASE WHEN n_terms = 0 THEN 1.0::DOUBLE ELSE """ + _rhu("n_hits / n_terms", 4) + """ END AS coverage
        FROM cper)""")


ORACLE["keyword_coverage"] = lambda: ("WITH " + _LANG_SRC + keyword_ctes("src") + "," + _coverage_ctes()
                              + "\nSELECT doc_id, tier, n_terms, n_hits, coverage, hits FROM cov")

ORACLE["coverage_rollup"] = lambda: ("WITH " + _LANG_SRC + keyword_ctes("src") + "," + _coverage_ctes() + """
SELECT d.source, c.tier, CAST(GROUPING(d.source, c.tier) AS INTEGER) AS level, count(DISTINCT c.doc_id) AS n_docs,
       sum(c.n_hits) AS n_hits, sum(c.n_terms) AS n_terms,
       round(sum(c.n_hits) / nullif(sum(c.n_terms), 0), 6) AS hit_rate
FROM cov c JOIN documents d ON c.doc_id = d.doc_id
WHERE c.tier <> 'all'
GROUP BY ROLLUP (d.source, c.tier)""")

ORACLE["keyword_gap"] = lambda: "WITH " + _LANG_SRC + keyword_ctes("src") + """,
cv AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS blob FROM conversations
       GROUP BY conv_id),
ct AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(coalesce(blob, '')), """ + _q(_tx.TOKEN_PATTERN) + """)) AS tokens
       FROM cv),
g AS (SELECT ct.conv_id, k.keyword,
             CASE WHEN k.keyword IS NULL THEN NULL
                  WHEN len(list_filter(ct.tokens, lambda t: contains(t, k.keyword) OR contains(t, lower(k.display)))) > 0
                  THEN 'already_have' WHEN k.tier = 'critical' THEN 'must_add' ELSE 'should_emphasize' END AS bucket
      FROM ct LEFT JOIN mk k ON k.pool = (['en', 'fr', 'de', 'es'])[CAST(ct.conv_id % 4 AS INTEGER) + 1])
SELECT conv_id, count(*) FILTER (WHERE bucket = 'already_have') AS n_already_have,
       count(*) FILTER (WHERE bucket = 'must_add') AS n_must_add,
       count(*) FILTER (WHERE bucket = 'should_emphasize') AS n_should_emphasize,
       coalesce(array_to_string(list_sort(list(keyword) FILTER (WHERE bucket = 'must_add')), '|'), '') AS must_add
FROM g GROUP BY conv_id"""


def _format_sql(paras: str, n_tables: str, n_images: str, header: str, footer: str, n_fonts: str) -> str:
    heads = _list([h.lower() for h in _tx.STANDARD_HEADINGS])
    tl = f"lower(array_to_string({paras}, chr(10)))"
    n_par = f"len(list_filter({paras}, lambda p: {_pytrim('p')} <> ''))"
    head = f"array_to_string(list_slice({paras}, 1, 6), chr(10))"
    checks = {
        "no_tables": f"({n_tables}) = 0",
        "no_images": f"({n_images}) = 0",
        "no_headers_footers": f"NOT ({_pytrim(header)} <> '' OR {_pytrim(footer)} <> '')",
        "standard_headings": f"len(list_filter({heads}, lambda h: contains({tl}, h))) >= 3",
        "single_font": f"({n_fonts}) <= 1",
        "reasonable_length": f"({n_par}) BETWEEN 15 AND 120",
        "has_email": f"regexp_matches({head}, {_q(_tx.EMAIL_PATTERN)})",
        "has_phone": f"regexp_matches({head}, {_q(_tx.LOOSE_PHONE_PATTERN)})",
    }
    return checks


_LAY = """
lay AS (SELECT page_id, coalesce(html, '') AS h,
               list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<p[^>]*>(.*?)</p>', 1),
                              lambda p: trim(regexp_replace(regexp_replace(p, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS paras
        FROM pages),
lay2 AS (SELECT page_id, paras,
                len(regexp_extract_all(h, '(?i)<table[\\s>]')) AS n_tables,
                len(regexp_extract_all(h, '(?i)<img[\\s>/]')) AS n_images,
                trim(regexp_replace(regexp_replace(regexp_extract(h, '(?is)<header[^>]*>(.*?)</header>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS header_text,
                trim(regexp_replace(regexp_replace(regexp_extract(h, '(?is)<footer[^>]*>(.*?)</footer>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS footer_text,
                len(list_distinct(list_transform(regexp_extract_all(h, '(?i)font-family\\s*:\\s*([^;"''}]+)', 1), lambda f: trim(f)))) AS n_fonts
         FROM lay)"""

_FC = _format_sql("paras", "n_tables", "n_images", "header_text", "footer_text", "n_fonts")
_NOTES = ("(CASE WHEN NOT (" + _FC["no_tables"] + ") THEN 1 ELSE 0 END + CASE WHEN NOT (" + _FC["no_images"]
          + ") THEN 1 ELSE 0 END + CASE WHEN NOT (" + _FC["no_headers_footers"] + ") THEN 1 ELSE 0 END"
          + " + CASE WHEN NOT (" + _FC["standard_headings"] + ") THEN 1 ELSE 0 END + CASE WHEN n_fonts > 1 THEN 1 ELSE 0 END"
          + " + CASE WHEN NOT (" + _FC["reasonable_length"] + ") THEN 1 ELSE 0 END + CASE WHEN NOT (" + _FC["has_email"]
          + ") THEN 1 ELSE 0 END + CASE WHEN NOT (" + _FC["has_phone"] + ") THEN 1 ELSE 0 END)")
ORACLE["format_checks"] = ("WITH " + _LAY + "\nSELECT page_id, " + ", ".join(f"{v} AS {k}" for k, v in _FC.items())
                           + ", CAST(" + _NOTES + " AS BIGINT) AS n_notes, round((" + " + ".join(
                               f"CASE WHEN {v} THEN 1 ELSE 0 END" for v in _FC.values()) + ") / 8.0::DOUBLE, 6) AS format_score"
                           + " FROM lay2")


def _doc_report_ctes(text_expr: str, sfx: str) -> str:
    """Coverage, keyword score, format score and overall per document for the text
    produced by ``text_expr`` (over ``documents``) — CTE names end with ``sfx``."""
    fc = _format_sql("paras", "0", "0", "''", "''", "0")
    fscore = "(" + " + ".join(f"CASE WHEN {v} THEN 1 ELSE 0 END" for v in fc.values()) + ") / 8.0::DOUBLE"
    cov = _coverage_ctes(text_expr).replace(" cd ", f" cd{sfx} ").replace("cd AS", f"cd{sfx} AS").replace(
        "FROM cd JOIN", f"FROM cd{sfx} JOIN").replace("FROM cd)", f"FROM cd{sfx})").replace("cd.", f"cd{sfx}.").replace(
        "cm AS", f"cm{sfx} AS").replace("cm.", f"cm{sfx}.").replace("JOIN cm ", f"JOIN cm{sfx} ").replace(
        "tiers AS", f"tiers{sfx} AS").replace("JOIN tiers ", f"JOIN tiers{sfx} ").replace(
        "cper AS", f"cper{sfx} AS").replace("FROM cper", f"FROM cper{sfx}").replace("cov AS", f"cov{sfx} AS")
    return cov + f""",
ks{sfx} AS (SELECT doc_id, coalesce(sum(CASE WHEN n_terms > 0 THEN (CASE tier WHEN 'critical' THEN 0.6::DOUBLE
                       WHEN 'recommended' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END) ELSE 0.0::DOUBLE END * coverage)
                   / sum(CASE WHEN n_terms > 0 THEN (CASE tier WHEN 'critical' THEN 0.6::DOUBLE
                       WHEN 'recommended' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END) ELSE 0.0::DOUBLE END), 0.0::DOUBLE) AS keyword_score
        FROM cov{sfx} WHERE tier <> 'all' GROUP BY doc_id),
fm{sfx} AS (SELECT doc_id, {fscore} AS format_score
        FROM (SELECT doc_id, {_lines(text_expr)} AS paras FROM documents)),
rep{sfx} AS (SELECT k.doc_id, k.keyword_score, f.format_score,
               {_rhu('100.0::DOUBLE * (0.7::DOUBLE * k.keyword_score + 0.3::DOUBLE * f.format_score)', 1)} AS overall
        FROM ks{sfx} k JOIN fm{sfx} f ON k.doc_id = f.doc_id)"""


ORACLE["doc_overall"] = lambda: ("WITH " + _LANG_SRC + keyword_ctes("src") + "," + _doc_report_ctes("text", "")
                         + "\nSELECT doc_id, round(keyword_score, 6) AS keyword_score, round(format_score, 6) AS format_score,"
                         + " overall FROM rep")

_AFTER_TEXT = ("(text || chr(10) || 'Skills: ' || coalesce((SELECT misses FROM cov WHERE cov.doc_id = documents.doc_id"
               " AND cov.tier = 'all'), ''))")
ORACLE["before_after"] = lambda: ("WITH " + _LANG_SRC + keyword_ctes("src") + "," + _doc_report_ctes("text", "") + ","
                          + _doc_report_ctes(_AFTER_TEXT, "a") + """,
mb AS (SELECT r.doc_id, 'Coverage: ' || c.tier AS metric, """ + _rhu("c.coverage * 100.0::DOUBLE", 1) + """ AS v
       FROM rep r JOIN cov c ON r.doc_id = c.doc_id
       UNION ALL SELECT doc_id, 'Format checks passed', """ + _rhu("100.0::DOUBLE * format_score", 1) + """ FROM rep
       UNION ALL SELECT doc_id, 'Overall ATS score', overall FROM rep),
ma AS (SELECT r.doc_id, 'Coverage: ' || c.tier AS metric, """ + _rhu("c.coverage * 100.0::DOUBLE", 1) + """ AS v
       FROM repa r JOIN cova c ON r.doc_id = c.doc_id
       UNION ALL SELECT doc_id, 'Format checks passed', """ + _rhu("100.0::DOUBLE * format_score", 1) + """ FROM repa
       UNION ALL SELECT doc_id, 'Overall ATS score', overall FROM repa)
SELECT mb.doc_id, mb.metric, mb.v AS before_pct, ma.v AS after_pct, """ + _rhu("ma.v - mb.v", 1) + """ AS delta
FROM mb JOIN ma ON mb.doc_id = ma.doc_id AND mb.metric = ma.metric""")


# ============================================================ batch 3 =========
from ..functions.status import STATUS_RANK as _RANK, VALID_STATUSES as _VALID  # noqa: E402
from ..operators.applications import APPLICATION_COLUMNS as _APP_COLS  # noqa: E402
from ..functions.status import PROTECTED_COLUMNS as _PROT  # noqa: E402

_FMT = "'%Y-%m-%d %H:%M:%S'"


def _app_rows_sql(batch: bool) -> str:
    cond = "strftime(_posted, '%Y-%m-%d') >= '1997-01-01'" if batch else "strftime(_posted, '%Y-%m-%d') < '1998-01-01'"
    o_status = "CASE job_salary_period WHEN 'monthly' THEN 'applied' WHEN 'yearly' THEN 'queued' ELSE '' END"
    if batch:
        title = "CASE WHEN job_id % 2 = 0 THEN job_title || ' II' ELSE job_title END"
        link = "CASE WHEN job_id % 4 = 0 THEN '' ELSE job_apply_link || '?v=2' END"
        status, qa, aa = "'queued'", "''", "''"
        art = "CASE WHEN job_id % 5 = 0 THEN 'artifacts/v2/' || CAST(job_id AS VARCHAR) ELSE '' END"
    else:
        title, link, status = "job_title", "job_apply_link", o_status
        qa = f"strftime(_posted, {_FMT})"
        aa = f"CASE WHEN {o_status} = 'applied' THEN strftime(_posted + INTERVAL 1 DAY, {_FMT}) ELSE '' END"
        art = "CASE WHEN job_id % 3 = 0 THEN '' ELSE 'artifacts/' || CAST(job_id AS VARCHAR) END"
    return f"""SELECT CAST(job_id AS VARCHAR) AS job_id, 'orders' AS source, employer_name AS company, {title} AS title,
         job_city AS location,
         CAST(floor(({AS_OF_EPOCH} - job_posted_at_timestamp) / 86400.0::DOUBLE) AS DOUBLE) AS posted_days_ago,
         NULL::DOUBLE AS salary_mid_lpa, NULL::DOUBLE AS fit_score, NULL::DOUBLE AS composite_score,
         {link} AS apply_link, {status} AS status, {qa} AS queued_at, {aa} AS applied_at,
         '' AS last_response_at, '' AS last_response_summary, {art} AS artifact_dir, '' AS notes
  FROM postings WHERE {cond}"""


def _upsert_select() -> str:
    out = []
    for c in _APP_COLS:
        if c == "job_id":
            out.append("coalesce(s.job_id, b.job_id) AS job_id")
        elif c == "queued_at":
            out.append("CASE WHEN s.job_id IS NULL THEN coalesce(nullif(b.queued_at, ''), '2001-08-02 00:00:00')"
                       " ELSE s.queued_at END AS queued_at")
        elif c in _PROT:
            out.append(f"CASE WHEN s.job_id IS NULL THEN b.{c} ELSE s.{c} END AS {c}")
        else:
            out.append(f"CASE WHEN s.job_id IS NULL THEN b.{c} WHEN b.job_id IS NOT NULL AND NOT (b.{c} IS NULL OR "
                       f"CAST(b.{c} AS VARCHAR) = '') THEN b.{c} ELSE s.{c} END AS {c}")
    return ",\n       ".join(out)


_UPSERT_CTE = ("WITH " + POSTINGS_CTE + ",\nsnap AS (" + _app_rows_sql(False) + "),\nbat AS (" + _app_rows_sql(True)
               + "),\nups AS (SELECT " + _upsert_select() + "\n  FROM snap s FULL OUTER JOIN bat b ON s.job_id = b.job_id)")
_CUR = "coalesce(CASE WHEN trim(status) <> '' THEN lower(trim(status)) END, 'queued')"

ORACLE["app_upsert"] = _UPSERT_CTE + "\nSELECT * FROM ups"
ORACLE["app_status_counts"] = (_UPSERT_CTE + "\nSELECT " + _CUR + " AS status, count(*) AS n_applications FROM ups"
                               " GROUP BY 1")
ORACLE["watch_set"] = (_UPSERT_CTE + "\nSELECT job_id, company, status FROM ups"
                       " WHERE coalesce(status, '') NOT IN ('', 'queued', 'skipped')")

ORACLE["status_update"] = _UPSERT_CTE + """,
up AS (SELECT CAST(l_orderkey AS VARCHAR) AS job_id,
              CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'applied' ELSE 'viewd' END AS status,
              l_shipdate AS at_ts,
              CASE WHEN l_returnflag = 'R' THEN 'rejected: line ' || CAST(l_linenumber AS VARCHAR) END AS response_summary,
              CASE WHEN l_linestatus = 'F' THEN 'shipped ' || CAST(l_linenumber AS VARCHAR) ELSE '' END AS notes,
              CAST(l_linenumber AS BIGINT) AS seq
       FROM lineitem),
v AS (SELECT * FROM up WHERE status IN """ + "(" + ", ".join(_q(x) for x in _VALID) + ")" + """),
agg AS (SELECT job_id, arg_max(status, {'a': at_ts, 's': seq}) AS u_status,
               max(CASE WHEN status = 'applied' THEN at_ts END) AS u_applied_at,
               arg_max(at_ts, {'a': at_ts, 's': seq}) FILTER (WHERE response_summary IS NOT NULL) AS u_resp_at,
               arg_max(response_summary, {'a': at_ts, 's': seq}) FILTER (WHERE response_summary IS NOT NULL) AS u_resp,
               arg_max(notes, {'a': at_ts, 's': seq}) FILTER (WHERE NOT (notes IS NULL OR notes = '')) AS u_notes
        FROM v GROUP BY job_id)
SELECT u.job_id, CASE WHEN a.u_status IS NOT NULL THEN a.u_status ELSE u.status END AS status,
       coalesce(strftime(a.u_applied_at, """ + _FMT + """), u.applied_at) AS applied_at,
       coalesce(strftime(a.u_resp_at, """ + _FMT + """), u.last_response_at) AS last_response_at,
       coalesce(a.u_resp, u.last_response_summary) AS last_response_summary,
       coalesce(a.u_notes, u.notes) AS notes
FROM ups u LEFT JOIN agg a ON u.job_id = a.job_id"""

_QUEUE = _UPSERT_CTE + """,
q AS (SELECT *, substr(queued_at, 1, 10) AS queue_day FROM ups WHERE """ + _CUR + """ = 'queued'),
el AS (SELECT * FROM q WHERE NOT (artifact_dir IS NULL OR artifact_dir = '')),
cap AS (SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY queue_day ORDER BY queued_at, job_id) AS rn
                            FROM el) WHERE rn <= 2),
dec AS (SELECT q.job_id, q.queue_day,
               CASE WHEN (q.artifact_dir IS NULL OR q.artifact_dir = '') THEN 'skipped_no_artifacts'
                    WHEN cap.job_id IS NOT NULL THEN 'submitted' ELSE 'deferred' END AS action
        FROM q LEFT JOIN cap ON q.job_id = cap.job_id)"""
ORACLE["apply_queue"] = _QUEUE + "\nSELECT * FROM dec"
ORACLE["apply_queue_counts"] = _QUEUE + "\nSELECT action, count(*) AS n FROM dec GROUP BY action"


def _mail_rules_sql(rules, body: str):
    lab = " ".join(f"WHEN regexp_matches({body}, {_q(p)}) THEN {_q(l)}" for l, p, _ in rules)
    conf = " ".join(f"WHEN regexp_matches({body}, {_q(p)}) THEN {float(c)}::DOUBLE" for l, p, c in rules)
    ev = " ".join(f"WHEN regexp_matches({body}, {_q(p)}) THEN regexp_extract({body}, {_q(p)}, 0)"
                  for l, p, _ in rules)
    return (f"CASE {lab} ELSE 'irrelevant' END", f"CASE {conf} ELSE 0.0::DOUBLE END", f"CASE {ev} ELSE '' END")


def _binding_rules():
    from .catalog import BINDING_RULES
    return BINDING_RULES


_lab, _conf, _ev = _mail_rules_sql(
    [("offer", "that", 0.9), ("interviewing", "from", 0.8), ("screening", "with", 0.7),
     ("viewed", "this", 0.6), ("rejected", "tion", 0.5)], "coalesce(text, '')")
ORACLE["mail_labels"] = (f"SELECT conv_id, turn, {_lab} AS label, {_conf} AS confidence, {_ev} AS evidence_snippet"
                         " FROM conversations")

ORACLE["company_match"] = """
WITH v AS (SELECT DISTINCT lower(trim(p_brand)) AS verdict FROM part WHERE lower(trim(p_brand)) <> ''),
k AS (SELECT lower(trim(p_brand)) AS company, min(p_partkey) AS ord FROM part WHERE lower(trim(p_brand)) <> ''
      GROUP BY 1),
c AS (SELECT v.verdict, k.company, k.ord FROM v JOIN k ON contains(v.verdict, k.company) OR contains(k.company, v.verdict))
SELECT verdict, first(company ORDER BY ord, company) AS company FROM c GROUP BY verdict"""

ORACLE["mail_decode"] = """
SELECT conv_id, turn, role || '@example.org' AS from_address, substr(text, 1, 30) AS subject,
       CASE WHEN turn % 2 = 0 THEN coalesce(text, '')
            ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                   '<html><style>p{}</style><p>' || text || '</p></html>',
                   '(?i)<script[\\s\\S]*?</script>', ' ', 'g'), '(?i)<style[\\s\\S]*?</style>', ' ', 'g'),
                   '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) END AS body
FROM conversations"""

_RK = "CASE {x} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in _RANK.items()) + " ELSE -2 END"
_FOLD = """
WITH ev AS (SELECT user_id AS job_id,
                   CASE event_type WHEN 'view' THEN 'viewed' WHEN 'signup' THEN 'applied' WHEN 'click' THEN 'screening'
                                   WHEN 'purchase' THEN 'offer' WHEN 'error' THEN 'rejected' END AS label,
                   ts, event_id AS msg_id FROM events),
ap AS (SELECT DISTINCT user_id AS job_id, CASE WHEN user_id % 4 = 0 THEN 'screening' ELSE 'applied' END AS start_status
       FROM events),
j AS (SELECT ev.*, ap.start_status, """ + _RK.format(x="ev.label") + """ AS r, """ + _RK.format(x="ap.start_status") + """ AS r0
      FROM ev JOIN ap ON ev.job_id = ap.job_id),
agg AS (SELECT job_id, max(CASE WHEN r > r0 THEN {'r': r, 'nts': -epoch_us(ts), 'nid': -msg_id, 'st': label, 'ts': ts} END) AS best,
               count(*) AS n_messages, count(CASE WHEN r > r0 THEN 1 END) AS n_candidates
        FROM j GROUP BY job_id)
SELECT ap.job_id, ap.start_status, coalesce(agg.best.st, ap.start_status) AS status,
       coalesce(agg.best.r, """ + _RK.format(x="ap.start_status") + """) AS status_rank,
       epoch_us(agg.best.ts) AS advanced_at_us, coalesce(agg.n_messages, 0) AS n_messages,
       coalesce(agg.n_candidates, 0) AS n_candidates
FROM ap LEFT JOIN agg ON ap.job_id = agg.job_id"""
ORACLE["status_fold"] = _FOLD
ORACLE["status_fold_stream"] = _FOLD
ORACLE["watch_counts"] = lambda: ORACLE["poll_counts"]
ORACLE["msg_dedup_stream"] = "SELECT event_id, user_id, event_type FROM events"


# ============================================================ batch 4 =========
from ..operators import checks as _ck  # noqa: E402


def _words(e: str) -> str:
    return (f"list_filter(list_transform(string_split_regex(trim(lower(coalesce({e}, ''))), '\\s+'), "
            f"lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '')")


def _bullets(e: str) -> str:
    return f"list_filter(list_transform({_lines(e)}, lambda l: {_pytrim('l')}), lambda l: l <> '')"


def _nums(e: str) -> str:
    return f"list_distinct(regexp_extract_all(coalesce({e}, ''), {_q(_ck.NUMBER_PATTERN)}))"


def _forbidden(e: str, phrases) -> str:
    return " OR ".join(f"contains(lower(coalesce({e}, '')), {_q(p)})" for p in phrases)


ORACLE["request_rows"] = """
WITH r AS (SELECT doc_id, 'Classify the key phrases of a ' || coalesce(source, '') || ' posting.' || chr(10)
                  || 'Return JSON {"keywords": [...]}.' || chr(10) || '---' || chr(10) || coalesce(text, '')
                  AS prompt FROM documents)
SELECT doc_id, substr(sha1(prompt), 1, 16) AS request_key, CAST(length(prompt) AS BIGINT) AS prompt_chars, sha256(prompt) AS prompt_sha256 FROM r"""

_FENCE = "(?i)```(?:json)?\\s*([\\s\\S]*?)```"
ORACLE["response_rows"] = """
WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN '```json' || chr(10) || props || chr(10) || '```'
                                      WHEN 'error' THEN substr(props, 1, 6) ELSE props END AS raw FROM events),
b AS (SELECT event_id, CASE WHEN regexp_matches(coalesce(raw, ''), """ + _q(_FENCE) + """)
                            THEN """ + _pytrim("regexp_extract(coalesce(raw, ''), " + _q(_FENCE) + ", 1)") + """
                            ELSE """ + _pytrim("raw") + """ END AS body FROM r)
SELECT event_id, CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.k') AS INTEGER) END AS k,
       coalesce(json_valid(body), false) AS parsed FROM b"""

_PAIRS = """
pairs AS (SELECT a.conv_id, a.turn, a.text AS rewrite, u.text AS original
          FROM conversations a JOIN conversations u
            ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user')"""

ORACLE["rewrite_checks"] = "WITH " + _PAIRS + """
SELECT conv_id, turn,
       len(""" + _bullets("rewrite") + """) = least(len(""" + _bullets("original") + """), 6) AS bullet_count_ok,
       len(list_filter(""" + _bullets("rewrite") + """, lambda b: NOT (len(""" + _words("b") + """) BETWEEN 16 AND 28))) = 0
         AS word_range_ok,
       len(list_filter(""" + _nums("original") + """, lambda n: NOT list_contains(""" + _nums("rewrite") + """, n))) = 0
         AS numbers_ok,
       NOT (""" + _forbidden("rewrite", _ck.BULLET_FORBIDDEN) + """) AS no_forbidden,
       len(list_filter(""" + _words("rewrite") + ", lambda w: list_contains(" + _list(_ck.FIRST_PERSON) + """, w))) = 0
         AS no_first_person,
       len(""" + _words("rewrite") + """) BETWEEN 60 AND 90 AS summary_length_ok
FROM pairs"""

_CAPS = ("list_distinct(list_filter(list_transform(string_split_regex(trim(rewrite), '\\s+'), "
         "lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda w: regexp_matches(w, '^\\p{Lu}')))")
ORACLE["grounding_checks"] = "WITH " + _PAIRS + """,
g AS (SELECT *, """ + _CAPS + """ AS caps, """ + _words("original") + """ AS ow FROM pairs)
SELECT conv_id, turn, CAST(len(caps) AS BIGINT) AS n_items,
       CAST(len(list_filter(caps, lambda x: NOT contains(lower(coalesce(original, '')), lower(x)))) AS BIGINT) AS n_violations,
       len(""" + _words("rewrite") + """) BETWEEN 220 AND 280 AS letter_length_ok,
       contains(lower(coalesce(rewrite, '')), lower(coalesce(ow[1], ''))) AS names_role,
       contains(lower(coalesce(rewrite, '')), lower(coalesce(ow[2], ''))) AS names_company
FROM g"""

ORACLE["keyword_chunks"] = lambda: "WITH " + _DOCS_SRC + gram_ctes("src") + """,
kd AS (SELECT DISTINCT pool, phrase FROM grams WHERE """ + _KEPT + """),
kc AS (SELECT pool, phrase, (row_number() OVER (PARTITION BY pool ORDER BY phrase) - 1) // 60 AS chunk_id FROM kd)
SELECT pool, CAST(chunk_id AS BIGINT) AS chunk_id, count(*) AS n_keywords, min(phrase) AS first_keyword
FROM kc GROUP BY pool, chunk_id"""

ORACLE["board_rows"] = """
WITH b AS (
  SELECT p_name AS title, p_brand AS company, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS city, p_type AS location,
         CASE WHEN p_size % 2 = 0 THEN 'India' ELSE 'USA' END AS country,
         CASE WHEN p_size <= 45 THEN CAST(p_partkey AS VARCHAR) END AS id,
         CASE WHEN p_partkey % 3 = 0 THEN 'https://d.example/' || CAST(p_partkey AS VARCHAR) END AS job_url_direct,
         CASE WHEN p_partkey % 3 = 1 THEN 'https://j.example/' || CAST(p_partkey AS VARCHAR) END AS job_url,
         CASE WHEN p_partkey % 4 = 0 THEN '2001-07-15' WHEN p_partkey % 4 = 1 THEN '2001-07-15T10:30:00'
              WHEN p_partkey % 4 = 2 THEN '2001-07-15 10:30:00' ELSE 'not a date' END AS date_posted,
         p_retailprice * 1000 AS min_amount,
         CASE WHEN p_partkey % 5 = 0 THEN 'USD' END AS currency, CASE WHEN p_partkey % 7 = 0 THEN 'monthly' END AS itv,
         CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey % 300 AS VARCHAR) END AS applicants,
         CASE WHEN p_partkey % 6 = 1 THEN '12.0' END AS linkedin_applicants
  FROM part),
n AS (
  SELECT *, trim(coalesce(title, '')) AS t, trim(coalesce(company, '')) AS e,
         coalesce(nullif(trim(coalesce(city, '')), ''), trim(coalesce(location, ''))) AS c,
         coalesce(nullif(trim(coalesce(job_url_direct, '')), ''), nullif(trim(coalesce(job_url, '')), ''), '') AS link
  FROM b)
SELECT 'board:board:' || substr(sha1(coalesce(nullif(trim(coalesce(id, '')), ''), nullif(link, ''), concat_ws('|', e, t, c))), 1, 16) AS job_id,
       t AS job_title, e AS employer_name, c AS job_city, trim(country) AS job_country,
       CAST(coalesce(CAST(TRY_CAST(date_posted AS DOUBLE) AS BIGINT),
                epoch(try_strptime(date_posted, '%Y-%m-%dT%H:%M:%S')),
                epoch(try_strptime(date_posted, '%Y-%m-%d %H:%M:%S')),
                epoch(try_strptime(date_posted, '%Y-%m-%d'))) AS BIGINT) AS job_posted_at_timestamp,
       min_amount AS job_min_salary,
       CASE WHEN trim(coalesce(currency, '')) <> '' THEN trim(currency)
            WHEN starts_with(lower(trim(country)), 'india') THEN 'INR' ELSE '' END AS job_salary_currency,
       coalesce(nullif(trim(coalesce(itv, '')), ''), 'yearly') AS job_salary_period,
       link AS job_apply_link,
       CAST(coalesce(CAST(trunc(TRY_CAST(applicants AS DOUBLE)) AS BIGINT),
                     CAST(trunc(TRY_CAST(linkedin_applicants AS DOUBLE)) AS BIGINT)) AS INTEGER) AS _applicant_count
FROM n"""

ORACLE["postings_roundtrip"] = "WITH " + POSTINGS_CTE + """
SELECT CAST(job_id AS VARCHAR) AS job_id, job_title, employer_name, job_city, job_posted_at_timestamp, job_min_salary,
       job_max_salary, job_salary_currency, job_salary_period, job_apply_link, _applicant_count,
       'landed' AS _source_location
FROM postings"""

ORACLE["salary_display"] = "WITH " + POSTINGS_CTE + "," + SALARY_CTE.format(src="postings") + """,
d AS (SELECT job_id, """ + _rhu("salary_min_lpa", 1) + " AS lo, " + _rhu("salary_max_lpa", 1) + """ AS hi FROM sal)
SELECT job_id, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND lo <> hi THEN printf('₹%.1f-%.1fL', lo, hi)
                    WHEN coalesce(lo, hi) IS NOT NULL THEN printf('₹%.1fL', coalesce(lo, hi)) ELSE '—' END AS salary_text
FROM d"""


# ============================================================ batch 5 =========
_ROLE_ORDER = "l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"
ORACLE["resume_roundtrip"] = """
WITH li AS (SELECT l.*, p.p_name, p.p_type, s.s_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
            JOIN supplier s ON l.l_suppkey = s.s_suppkey),
agg AS (SELECT l_orderkey, count(*) AS n_roles, count(*) + count(*) FILTER (WHERE l_returnflag = 'R') AS n_bullets,
               first(p_name || ' | ' || s_name ORDER BY """ + _ROLE_ORDER + """) AS first_title,
               first(strftime(l_shipdate, '%b %Y') ORDER BY """ + _ROLE_ORDER + """) AS first_start,
               first(CASE WHEN l_linestatus = 'O' THEN 'Present' ELSE strftime(l_shipdate + INTERVAL 30 DAY, '%b %Y') END
                     ORDER BY """ + _ROLE_ORDER + """) AS first_end,
               string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS skills
        FROM li GROUP BY l_orderkey)
SELECT o.o_orderkey AS candidate_id, c.c_mktsegment || ' ' || n.n_name AS name,
       'cand' || CAST(o.o_orderkey AS VARCHAR) || '@example.org' AS email,
       '+91 98' || lpad(CAST(o.o_orderkey AS VARCHAR), 8, '0') AS phone,
       'Order ' || o.o_orderpriority || ' placed with status ' || o.o_orderstatus || '.' AS summary,
       CAST(coalesce(a.n_roles, 0) AS BIGINT) AS n_roles, CAST(coalesce(a.n_bullets, 0) AS BIGINT) AS n_bullets,
       a.first_title, a.first_start, a.first_end, coalesce(a.skills, '') AS skills,
       CAST(1 AS BIGINT) AS n_education, 'B.Sc. ' || r.r_name || ' | ' || n.n_name || ' University' AS degree,
       CAST(year(o.o_orderdate) - 4 AS VARCHAR) AS edu_start, CAST(year(o.o_orderdate) AS VARCHAR) AS edu_end,
       CAST(1 AS BIGINT) AS n_certs
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN agg a ON a.l_orderkey = o.o_orderkey"""

_LI_RANKED = """
li AS (SELECT l.*, p.p_name, p.p_type, s.s_name,
              row_number() OVER (PARTITION BY l.l_orderkey ORDER BY """ + _ROLE_ORDER + """) AS role_rank
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

ORACLE["candidate_facts"] = "WITH " + _LI_RANKED + """,
rb AS (SELECT l_orderkey, role_rank, 1 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS nb FROM li),
agg AS (SELECT l_orderkey, count(*) AS n_roles, sum(nb) AS n_b, sum(nb) AS cover_b
        FROM rb GROUP BY l_orderkey),
sk AS (SELECT l_orderkey, count(DISTINCT p_type) AS n_sk FROM li GROUP BY l_orderkey)
SELECT o.o_orderkey AS candidate_id, CAST(coalesce(a.n_roles, 0) AS BIGINT) AS cover_roles,
       CAST(coalesce(a.cover_b, 0) AS BIGINT) AS cover_bullets, CAST(coalesce(sk.n_sk, 0) AS BIGINT) AS cover_skills,
       'B.Sc. ' || r.r_name || ' ' || n.n_name || ' University' AS cover_education,
       CAST(coalesce(a.n_roles, 0) AS BIGINT) AS screen_roles, CAST(coalesce(a.n_b, 0) AS BIGINT) AS screen_bullets,
       CAST(length('Order ' || o.o_orderpriority || ' placed with status ' || o.o_orderstatus || '.') AS BIGINT) AS summary_chars
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN agg a ON a.l_orderkey = o.o_orderkey
LEFT JOIN sk ON sk.l_orderkey = o.o_orderkey"""

ORACLE["resume_text"] = "WITH " + _LI_RANKED + """,
types AS (SELECT DISTINCT l_orderkey, p_type FROM li),
parts AS (
  SELECT o_orderkey AS cid, 0 AS sec, 0 AS k1, 0 AS k2, '' AS k3,
         'Order ' || o_orderpriority || ' placed with status ' || o_orderstatus || '.' AS part FROM orders
  UNION ALL SELECT l_orderkey, 1, role_rank, 0, '', p_name || ' at ' || s_name FROM li
  UNION ALL SELECT l_orderkey, 1, role_rank, 1, '',
                   printf('Shipped %d units at %d%% discount', CAST(l_quantity AS INTEGER), CAST(round(l_discount * 100) AS INTEGER)) FROM li
  UNION ALL SELECT l_orderkey, 1, role_rank, 2, '', 'Handled a return' FROM li WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, 2, 0, 0, p_type, p_type FROM types
  UNION ALL SELECT o_orderkey, 4, 0, 0, '', 'Priority ' || o_orderpriority FROM orders),
t AS (SELECT cid, string_agg(part, chr(10) ORDER BY sec, k1, k2, k3) AS txt FROM parts WHERE part <> '' GROUP BY cid)
SELECT cid AS candidate_id, CAST(length(txt) AS BIGINT) AS n_chars, substr(sha1(txt), 1, 16) AS text_hash FROM t"""

ORACLE["skill_order"] = lambda: "WITH " + _PART_SRC + keyword_ctes("src") + """,
kl AS (SELECT pool, coalesce(list_sort(list(keyword) FILTER (WHERE tier = 'critical')), []) AS crit,
              coalesce(list_sort(list(keyword) FILTER (WHERE tier = 'recommended')), []) AS rec FROM mk GROUP BY pool),
sk AS (SELECT l.l_orderkey, list_sort(list(DISTINCT lower(p.p_type))) AS skills
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey),
cs AS (SELECT o.o_orderkey AS candidate_id, coalesce(sk.skills, []) AS skills FROM orders o
       LEFT JOIN sk ON sk.l_orderkey = o.o_orderkey)
SELECT candidate_id, array_to_string(list_transform(list_sort(list_transform(skills, lambda s, i: {
         'b': CASE WHEN len(list_filter(kl.crit, lambda k: contains(s, k) OR contains(k, s))) > 0 THEN 0
                   WHEN len(list_filter(kl.rec, lambda k: contains(s, k) OR contains(k, s))) > 0 THEN 1 ELSE 2 END,
         'i': i, 's': s})), lambda x: x.s), ', ') AS skills_ordered
FROM cs JOIN kl ON kl.pool = CAST(cs.candidate_id % 3 AS VARCHAR)"""

ORACLE["tailoring_check"] = "WITH " + _LI_RANKED + """,
bl AS (SELECT l_orderkey, role_rank, printf('Shipped %d units at %d%% discount', CAST(l_quantity AS INTEGER), CAST(round(l_discount * 100) AS INTEGER)) AS b FROM li
       UNION ALL SELECT l_orderkey, role_rank, 'Handled a return' FROM li WHERE l_returnflag = 'R'),
piece AS (
  SELECT o_orderkey AS cid, 'Order ' || o_orderpriority || ' placed with status ' || o_orderstatus || '.' AS s, true AS old, true AS new FROM orders
  UNION ALL SELECT l_orderkey, p_name, true, true FROM li
  UNION ALL SELECT l_orderkey, s_name, true, l_orderkey % 5 <> 0 FROM li
  UNION ALL SELECT l_orderkey, 'Renamed', false, true FROM li WHERE l_orderkey % 5 = 0
  UNION ALL SELECT l_orderkey, strftime(l_shipdate, '%b %Y'), true, true FROM li
  UNION ALL SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'Present' ELSE strftime(l_shipdate + INTERVAL 30 DAY, '%b %Y') END, true, true FROM li
  UNION ALL SELECT l_orderkey, b, true, role_rank - 1 <> l_orderkey % 2 FROM bl
  UNION ALL SELECT l_orderkey, 'Rewritten bullet of ' || CAST(l_orderkey AS VARCHAR), false, true FROM li WHERE role_rank - 1 = l_orderkey % 2
  UNION ALL SELECT o_orderkey, unnest(['B.Sc. ' || r_name, n_name || ' University', CAST(year(o_orderdate) - 4 AS VARCHAR), CAST(year(o_orderdate) AS VARCHAR)]), true, true
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT o_orderkey, unnest(['Class XII', 'School']), true, false FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'M.Sc. Logistics', false, true FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL SELECT o_orderkey, 'Priority ' || o_orderpriority, true, o_orderkey % 7 <> 0 FROM orders
  UNION ALL SELECT o_orderkey, 'Forklift licence', false, true FROM orders WHERE o_orderkey % 7 = 0),
token AS (SELECT cid, old, new, 'number' AS kind, unnest(regexp_extract_all(s, '\\p{Sc}?\\p{N}+(?:[.,:/-]\\p{N}+)*[%\\p{L}]*')) AS t FROM piece
          UNION ALL SELECT cid, old, new, 'name', unnest(regexp_extract_all(s, '(?:^|[^\\p{L}\\p{N}])(\\p{Lu}[\\p{L}\\p{N}&''’-]*)', 1)) FROM piece),
lost AS (SELECT cid, kind, string_agg(t, '|' ORDER BY t) AS lost
         FROM (SELECT cid, kind, t FROM token GROUP BY cid, kind, t HAVING bool_or(old) AND NOT bool_or(new)) GROUP BY cid, kind),
n AS (SELECT l_orderkey, count(*) AS n_roles, count(DISTINCT s_name) AS n_firms, count(DISTINCT p_type) AS n_skills FROM li GROUP BY l_orderkey),
f AS (SELECT *, printf('Shipped %d units at %d%% discount', CAST(l_quantity AS INTEGER), CAST(round(l_discount * 100) AS INTEGER))
             || CASE WHEN l_returnflag = 'R' THEN '|Handled a return' ELSE '' END AS bullets FROM li WHERE role_rank = 1)
SELECT o_orderkey AS candidate_id, CAST(CASE WHEN o_orderkey % 5 = 0 THEN coalesce(n.n_firms, 0) ELSE 0 END AS BIGINT) AS employers_removed,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS education_removed,
       CAST(CASE WHEN o_orderkey % 5 = 0 AND coalesce(n.n_skills, 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS skills_removed,
       CASE WHEN n.n_roles IS NULL THEN '' WHEN o_orderkey % 2 = 0 THEN 'Rewritten bullet of ' || CAST(o_orderkey AS VARCHAR)
            ELSE f.bullets END AS first_bullets,
       CASE WHEN o_orderkey % 5 = 0 AND n.n_roles IS NOT NULL THEN 'Renamed' ELSE '' END AS employers_added,
       CASE WHEN o_orderkey % 11 = 0 THEN 'M.Sc. Logistics' ELSE '' END AS education_added,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Priority ' || o_orderpriority ELSE '' END AS certs_removed,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Forklift licence' ELSE '' END AS certs_added,
       coalesce(nums.lost, '') AS numbers_lost, coalesce(names.lost, '') AS names_lost
FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey LEFT JOIN f ON f.l_orderkey = o_orderkey
LEFT JOIN lost nums ON nums.cid = o_orderkey AND nums.kind = 'number' LEFT JOIN lost names ON names.cid = o_orderkey AND names.kind = 'name'"""

ORACLE["resume_merge"] = "WITH " + _LI_RANKED + """,
sk AS (SELECT l_orderkey, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS skills, count(DISTINCT role_rank) AS n_roles FROM li GROUP BY l_orderkey)
SELECT o.o_orderkey AS candidate_id, c.c_mktsegment || ' ' || n.n_name AS name, 'in/x' AS linkedin,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 'heuristic' ELSE 'Order ' || o.o_orderpriority || ' placed with status ' || o.o_orderstatus || '.' END AS summary,
       CASE WHEN o.o_orderkey % 4 = 0 OR sk.skills IS NULL THEN 'guess' ELSE sk.skills END AS skills,
       CAST(coalesce(sk.n_roles, 0) AS BIGINT) AS n_roles
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN sk ON sk.l_orderkey = o.o_orderkey"""

ORACLE["top_jobs_table"] = ORACLE["top_per_pool"].replace("WHERE rank <= 3", "WHERE rank <= 8").replace(
    "SELECT * FROM (SELECT *, row_number()", "tp AS (SELECT * FROM (SELECT *, row_number()", 1) + """)
SELECT pool, rank, title, company, city,
       CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND lo <> hi THEN printf('₹%.1f-%.1fL', lo, hi)
            WHEN coalesce(lo, hi) IS NOT NULL THEN printf('₹%.1fL', coalesce(lo, hi)) ELSE '—' END AS salary,
       printf('%.4f', composite_score) AS score, CASE WHEN remote THEN 'remote' ELSE 'onsite' END AS mode
FROM (SELECT *, """ + _rhu("salary_min_lpa", 1) + " AS lo, " + _rhu("salary_max_lpa", 1) + """ AS hi FROM tp)"""
ORACLE["top_jobs_table"] = ORACLE["top_jobs_table"].replace("\ntp AS (SELECT", ",\ntp AS (SELECT", 1)


# ============================================================ batch 6 =========
ORACLE["poll_counts"] = ("SELECT CAST(sum(n_messages) AS BIGINT) AS checked, CAST(sum(n_candidates) AS BIGINT) AS classified,"
                         " CAST(count(*) FILTER (WHERE status <> start_status) AS BIGINT) AS advanced FROM (" + _FOLD + ")")

ORACLE["recent_messages"] = """
SELECT event_id, user_id, strftime(epoch_ms(epoch_us(ts) // 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS received_at
FROM events WHERE epoch_us(ts) // 1000 >= epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - 7 * 86400 * 1000"""

_FX = ("CASE upper({c}) WHEN 'INR' THEN 1.0::DOUBLE WHEN 'USD' THEN 86.0::DOUBLE WHEN 'EUR' THEN 92.0::DOUBLE "
       "WHEN 'GBP' THEN 108.0::DOUBLE WHEN 'SGD' THEN 64.0::DOUBLE ELSE 1.0::DOUBLE END")
ORACLE["salary_overlay"] = "WITH " + POSTINGS_CTE + """,
p2 AS (SELECT * REPLACE (CASE WHEN job_salary_period = 'hourly' THEN NULL ELSE job_min_salary END AS job_min_salary,
                         CASE WHEN job_salary_period = 'hourly' THEN NULL ELSE job_max_salary END AS job_max_salary)
       FROM postings),""" + SALARY_CTE.format(src="p2") + """,
ext AS (SELECT o_orderkey AS job_id, """ + _rhu("o_totalprice / 100000.0::DOUBLE", 2) + """ AS x_min,
               CASE WHEN o_orderkey % 2 = 0 THEN 'INR' ELSE 'USD' END AS x_cur FROM orders WHERE o_orderkey % 3 = 0),
j AS (SELECT s.job_id, s.salary_min_lpa, s.salary_max_lpa, s.salary_source, e.x_min, e.x_cur,
             s.salary_source = 'missing' AND e.x_min IS NOT NULL AS use_x
      FROM sal s LEFT JOIN ext e ON s.job_id = e.job_id),
k AS (SELECT job_id, CASE WHEN use_x THEN round(x_min * """ + _FX.format(c="x_cur") + """, 2) ELSE salary_min_lpa END AS lo,
             CASE WHEN use_x THEN NULL ELSE salary_max_lpa END AS hi,
             CASE WHEN use_x THEN 'llm' ELSE salary_source END AS src FROM j)
SELECT job_id, lo AS salary_min_lpa, hi AS salary_max_lpa, coalesce((lo + hi) / 2, lo, hi) AS salary_mid_lpa,
       src AS salary_source FROM k"""


def _cell(c: str, t: str) -> str:
    if t == "boolean":
        return f"CASE WHEN {c} IS NULL THEN '' WHEN {c} THEN 'TRUE' ELSE 'FALSE' END AS {c}"
    return f"coalesce(CAST({c} AS VARCHAR), '') AS {c}"


ORACLE["app_export"] = (_UPSERT_CTE + ",\nw AS (SELECT *, status IN ('applied', 'screening') AS watched FROM ups)\nSELECT "
                        + ", ".join(_cell(c, "string") for c in _APP_COLS) + ", " + _cell("watched", "boolean")
                        + " FROM w")

ORACLE["tier_lists"] = lambda: "WITH " + _LANG_SRC + keyword_ctes("src", classified=True) + f"""
SELECT pool,
       coalesce(string_agg(display, ', ' ORDER BY {_REPORT_ORDER}) FILTER (WHERE tier = 'critical'), '') AS critical,
       coalesce(string_agg(display, ', ' ORDER BY {_REPORT_ORDER}) FILTER (WHERE tier = 'recommended'), '') AS recommended
FROM mk GROUP BY pool"""

ORACLE["tailoring_gate"] = lambda: "WITH " + _LANG_SRC + keyword_ctes("src") + """,
d AS (SELECT doc_id, lang, regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS hay FROM documents),
h AS (SELECT d.doc_id, count(t.keyword) AS n,
             count(*) FILTER (WHERE (coalesce(t.keyword, '') <> '' AND contains(d.hay, lower(t.keyword)))
                                 OR (coalesce(t.display, '') <> '' AND contains(d.hay, lower(t.display)))) AS hits
      FROM d LEFT JOIN mk t ON t.pool = d.lang AND t.tier IN ('critical', 'recommended') GROUP BY d.doc_id)
SELECT doc_id, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE """ + _rhu("hits / n", 4) + """ END AS coverage,
       CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE """ + _rhu("hits / n", 4) + """ END < 0.9::DOUBLE AS needs_tailoring
FROM h"""

ORACLE["best_role"] = ORACLE["role_summary"].replace(
    "SELECT pool, count(*) AS n_ranked", "rs AS (SELECT pool, count(*) AS n_ranked", 1).replace(
    "FROM top GROUP BY pool", "FROM top GROUP BY pool)") + """
SELECT pool, best_composite FROM rs ORDER BY best_composite DESC, pool LIMIT 1"""
ORACLE["best_role"] = ORACLE["best_role"].replace("\nrs AS (SELECT pool", ",\nrs AS (SELECT pool", 1)

ORACLE["document_files"] = ("SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents"
                            " GROUP BY source")

ORACLE["app_snapshot"] = ORACLE["status_update"]

ORACLE["cover_letter_lines"] = "WITH " + _LI_RANKED + """,
f AS (SELECT l_orderkey, p_name, s_name FROM li WHERE role_rank = 1)
SELECT o.o_orderkey AS candidate_id, CAST(12 AS BIGINT) AS n_lines, c.c_mktsegment AS first_name, '02 August 2001' AS dated,
       array_to_string([c.c_mktsegment || ' ' || n.n_name, 'cand' || CAST(o.o_orderkey AS VARCHAR) || '@example.org', '02 August 2001', '',
         'Hiring Manager', coalesce(f.s_name, ''), '', 'Dear Hiring Manager,',
         'I am applying for the ' || coalesce(f.p_name, 'open') || ' role at ' || coalesce(f.s_name, 'your company') || '.',
         'Order ' || o.o_orderpriority || ' placed with status ' || o.o_orderstatus || '.', 'Sincerely,', c.c_mktsegment], chr(10)) AS letter
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN f ON f.l_orderkey = o.o_orderkey"""

ORACLE["screening_answers"] = """
WITH e AS (SELECT event_id, user_id, event_type, props, value, event_type <> 'error' AS ok FROM events)
SELECT event_id,
       CASE WHEN ok THEN coalesce(json_extract_string(props, '$.k'), '') ELSE '' END AS years,
       CASE WHEN user_id % 3 = 0 THEN '25.0' WHEN ok THEN coalesce(printf('%.2f', value), '') ELSE '' END AS current_ctc,
       CASE WHEN user_id % 3 = 0 THEN 'True' ELSE '' END AS relocate,
       CASE WHEN user_id % 3 = 0 THEN '2024-03-01' ELSE '' END AS join_date,
       '- **Core techniques**: ' || CASE WHEN ok THEN event_type ELSE '(none)' END AS techniques_line,
       '- **Why this role**: ' || CASE WHEN ok AND coalesce(props, '') <> '' THEN props ELSE '(blank)' END AS why_line,
       'User' AS first_name
FROM e"""

ORACLE["role_report"] = ORACLE["role_summary"].replace(
    "SELECT pool, count(*) AS n_ranked", "rs AS (SELECT pool, count(*) AS n_ranked", 1).replace(
    "FROM top GROUP BY pool", "FROM top GROUP BY pool)").replace("\nrs AS (SELECT pool", ",\nrs AS (SELECT pool", 1) + """
SELECT coalesce(lower(regexp_replace(n.n_name, '[^A-Za-z0-9]+', '_', 'g')) || '_quality_assurance_level_' || CAST(n.n_regionkey AS VARCHAR),
                'pool_' || rs.pool) AS role_slug,
       coalesce(CAST(n.n_nationkey AS VARCHAR), rs.pool) AS pool, CAST(coalesce(rs.n_ranked, 0) AS BIGINT) AS n_ranked,
       rs.best_salary_lpa, rs.best_composite, CASE WHEN rs.n_ranked IS NULL THEN 'no postings' ELSE '' END AS error
FROM nation n FULL OUTER JOIN rs ON rs.pool = CAST(n.n_nationkey AS VARCHAR)"""

ORACLE["verdict_check"] = """
WITH v AS (SELECT CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'offer' WHEN 2 THEN NULL ELSE 'viewed' END AS label FROM events)
SELECT label, coalesce(label IN ('viewed', 'screening', 'interviewing', 'offer', 'rejected', 'irrelevant'), false) AS valid, count(*) AS n
FROM v GROUP BY ALL"""

ORACLE["application_rows"] = ORACLE["top_per_pool"][:ORACLE["top_per_pool"].index("\nSELECT * FROM (SELECT *, row_number()")] + """
SELECT CAST(job_id AS VARCHAR) AS job_id, 'api' AS source, company, title, city AS location,
       CAST(posted_days_ago AS DOUBLE) AS posted_days_ago, """ + _rhu("salary_mid_lpa", 2) + """ AS salary_mid_lpa, fit_score,
       apply_link, 'queued' AS status, '2001-08-02 00:00:00' AS queued_at, 'artifacts/' || CAST(job_id AS VARCHAR) AS artifact_dir
FROM final"""

ORACLE["applied_rows"] = _UPSERT_CTE + "\nSELECT job_id, company, status FROM ups WHERE status = 'applied'"

ORACLE["rank_penalised"] = "WITH " + ",".join([
    POSTINGS_CTE, EMB_CTE, FILTER_CTE,
    "\np0 AS (SELECT p.* EXCLUDE (pool), e.label AS pool, e.emb, f.is_recruiter FROM postings p JOIN emb e ON e.vec_id = p.job_id"
    " JOIN fcr f ON f.job_id = p.job_id)",
    SALARY_CTE.format(src="p0"), STATS_CTE,
    "\ncand AS (SELECT label AS pool, min(vec_id) AS candidate_id, arg_min(emb, vec_id) AS cemb FROM emb GROUP BY label)",
    RANKED_SELECT.replace("sc.job_apply_link AS apply_link", "sc.job_apply_link AS apply_link, sc.is_recruiter")
                 .replace("/ 1.0::DOUBLE, 4) AS composite_score", "/ 1.0::DOUBLE - CASE WHEN is_recruiter THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 4) AS composite_score")]) + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, pool ORDER BY composite_score DESC, job_id) AS rank FROM final)
WHERE rank <= 3"""

ORACLE["keyword_gap_text"] = lambda: "WITH " + _LANG_SRC + keyword_ctes("src") + """,
ct AS (SELECT conv_id * 1000 + turn AS conv_id, (['en', 'fr', 'de', 'es'])[CAST(conv_id % 4 AS INTEGER) + 1] AS pool,
              regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS hay FROM conversations),
g AS (SELECT ct.conv_id, k.keyword,
             CASE WHEN k.keyword IS NULL THEN NULL
                  WHEN (k.keyword <> '' AND contains(ct.hay, lower(k.keyword))) OR (k.display <> '' AND contains(ct.hay, lower(k.display)))
                  THEN 'already_have' WHEN k.tier = 'critical' THEN 'must_add' ELSE 'should_emphasize' END AS bucket
      FROM ct LEFT JOIN mk k ON k.pool = ct.pool)
SELECT conv_id, count(*) FILTER (WHERE bucket = 'already_have') AS n_already_have,
       count(*) FILTER (WHERE bucket = 'must_add') AS n_must_add,
       count(*) FILTER (WHERE bucket = 'should_emphasize') AS n_should_emphasize,
       coalesce(array_to_string(list_sort(list(keyword) FILTER (WHERE bucket = 'must_add')), '|'), '') AS must_add
FROM g GROUP BY conv_id"""

ORACLE["role_dashboard"] = lambda: ("WITH " + ",".join([
    POSTINGS_CTE, EMB_CTE,
    "\np0 AS (SELECT p.* EXCLUDE (pool), d.lang AS pool, e.emb FROM postings p JOIN emb e ON e.vec_id = p.job_id JOIN documents d ON d.doc_id = p.job_id)",
    SALARY_CTE.format(src="p0"), STATS_CTE,
    "\ncand AS (SELECT d.lang AS pool, min(vec_id) AS candidate_id, arg_min(emb, vec_id) AS cemb FROM emb JOIN documents d ON d.doc_id = vec_id GROUP BY d.lang)",
    RANKED_SELECT, """
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, pool ORDER BY composite_score DESC, job_id) AS rank FROM final) WHERE rank <= 3)""",
    _LANG_SRC.rstrip(",") + "," + keyword_ctes("src"), _doc_report_ctes("text", ""), _doc_report_ctes(_AFTER_TEXT, "a"), """
rtk AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(coalesce(text, '')), """ + _q(_tx.TOKEN_PATTERN) + """)) AS tokens FROM documents),
must AS (SELECT rtk.doc_id, rtk.lang, count(*) FILTER (k.tier = 'critical' AND len(list_filter(rtk.tokens, lambda t: contains(t, k.keyword)
                OR contains(t, lower(k.display)))) = 0) AS n FROM rtk LEFT JOIN mk k ON k.pool = rtk.lang GROUP BY rtk.doc_id, rtk.lang),
ga AS (SELECT lang AS pool, """ + _rhu("avg(n)", 2) + """ AS mean_must_add FROM must GROUP BY lang),
rp AS (SELECT d.lang AS pool, """ + _rhu("avg(b.overall)", 1) + " AS before_pct, " + _rhu("avg(a.overall)", 1) + """ AS after_pct
       FROM rep b JOIN repa a ON a.doc_id = b.doc_id JOIN documents d ON d.doc_id = b.doc_id GROUP BY d.lang),
cr AS (SELECT pool, count(*) FILTER (tier = 'critical') AS n_critical FROM mk GROUP BY pool)
SELECT top.pool, count(*) AS n_ranked, coalesce(max(salary_mid_lpa), 0.0::DOUBLE) AS best_salary_lpa,
       median(salary_mid_lpa) AS median_top_salary_lpa, max(composite_score) AS best_composite,
       arg_max(job_id, (composite_score, -job_id)) AS best_job_id, round(avg(fit_score), 4) AS avg_fit,
       any_value(cr.n_critical) AS n_critical, any_value(ga.mean_must_add) AS mean_must_add, any_value(rp.before_pct) AS before_pct,
       any_value(rp.after_pct) AS after_pct, any_value(""" + _rhu("rp.after_pct - rp.before_pct", 1) + """) AS delta
FROM top LEFT JOIN cr ON cr.pool = top.pool LEFT JOIN ga ON ga.pool = top.pool LEFT JOIN rp ON rp.pool = top.pool GROUP BY top.pool"""]))

ORACLE["queue_drops"] = _UPSERT_CTE + "," + FILTER_CTE + """,
q AS (SELECT *, substr(queued_at, 1, 10) AS queue_day, job_id IN (SELECT CAST(f.job_id AS VARCHAR) FROM fc f WHERE f.drop_reason IS NOT NULL) AS gone
      FROM ups WHERE """ + _CUR + """ = 'queued'),
cap AS (SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY queue_day ORDER BY queued_at, job_id) AS rn FROM q
                            WHERE NOT gone AND coalesce(artifact_dir, '') <> '') WHERE rn <= 2)
SELECT CASE WHEN gone THEN 'dropped' WHEN coalesce(artifact_dir, '') = '' THEN 'skipped_no_artifacts'
            WHEN job_id IN (SELECT job_id FROM cap) THEN 'kept' ELSE 'deferred' END AS action, count(*) AS n
FROM q GROUP BY 1"""

ORACLE["keywords_artifact"] = lambda: "WITH " + _LANG_SRC + keyword_ctes("src", classified=True) + """
SELECT keyword, display, category, frequency, raw_count, tier FROM mk"""

ORACLE["answers_artifact"] = "SELECT event_id, coalesce(props, '') AS why, event_type AS techniques, '' AS shift FROM events"
