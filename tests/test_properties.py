"""Property checks on generated small frames (few examples each: every example is a Spark job)."""
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirestream.functions.status import STATUS_RANK
from hirestream.functions.timefn import as_of_epoch
from hirestream.operators import ats, filters, mail

AS_OF = "2026-07-04T00:00:00Z"
T0 = as_of_epoch(AS_OF)
SETTINGS = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))

posting = st.tuples(
    st.sampled_from(["Acme", "acme ", "Beta Staffing", "", None]),
    st.sampled_from(["QA", "qa  lead", "Dev", None]),
    st.sampled_from(["Pune", "pune", None]),
    st.one_of(st.none(), st.integers(0, 60)),
    st.one_of(st.none(), st.floats(1e5, 3e6)),
    st.sampled_from(["INR", "USD", None]),
    st.one_of(st.none(), st.integers(0, 400)),
    st.text(max_size=5))
SCHEMA = ("employer_name string, job_title string, job_city string, job_posted_at_timestamp long, "
          "job_min_salary double, job_salary_currency string, _applicant_count int, job_description string, "
          "job_id string, _ord long")


def _frame(spark, rows):
    out = [(e, t, c, None if d is None else T0 - d * 86400, s, cur, a, desc, str(i), i)
           for i, (e, t, c, d, s, cur, a, desc) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


PARAMS = dict(max_age_days=21, max_applicants=200, employer_blacklist=["staff"], salary_floor_lpa=15)


@SETTINGS
@given(st.lists(posting, min_size=1, max_size=25))
def test_filter_counts_sum_to_input(spark, rows):
    df = _frame(spark, rows)
    s = filters.filter_stats(df, as_of=AS_OF, **PARAMS).first()
    dropped = s.dropped_stale + s.dropped_crowded + s.dropped_blacklist + s.dropped_low_salary
    assert s.input == len(rows)
    assert s.output + s.collapsed_duplicates + dropped == s.input
    assert filters.filter_postings(df, as_of=AS_OF, **PARAMS).count() == s.output


@SETTINGS
@given(st.lists(posting, min_size=1, max_size=25))
def test_dedupe_is_idempotent(spark, rows):
    c = filters.filter_cascade(_frame(spark, rows), as_of=AS_OF)
    once = filters.dedupe_freshest(c)
    cols = [x for x in c.columns]
    twice = filters.dedupe_freshest(once.select(*cols))
    assert sorted(r.job_id for r in once.collect()) == sorted(r.job_id for r in twice.collect())


labels = st.sampled_from(["viewed", "screening", "interviewing", "offer", "rejected", "applied", "bogus"])


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), labels, st.integers(0, 50)), min_size=1, max_size=30),
       st.randoms(use_true_random=False))
def test_fold_is_order_independent_and_monotone(spark, events, rnd):
    apps = spark.createDataFrame([(str(i), s) for i, s in enumerate(["applied", "queued", "interviewing", ""])],
                                 "job_id string, status string")
    rows = [(str(j), lab, T0 + ts * 60, k) for k, (j, lab, ts) in enumerate(events)]
    shuffled = rows[:]
    random.Random(rnd.random()).shuffle(shuffled)

    def fold(rs):
        ev = spark.createDataFrame(rs, "job_id string, label string, t long, msg_id long") \
            .withColumn("received_at", F.timestamp_seconds("t"))
        return sorted(mail.fold_statuses(apps, ev, default_status="queued").collect(), key=lambda r: r.job_id)

    a, b = fold(rows), fold(shuffled)
    assert a == b
    for r in a:
        start = STATUS_RANK.get(r.start_status if r.start_status else "queued", -2)
        assert r.status_rank >= start


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["python", "sql", "data analysis", "", "etl"]),
                          st.sampled_from(["critical", "recommended", "nice_to_have"])), max_size=8),
       st.text(alphabet="pythonsqlda etl", max_size=40))
def test_coverage_within_unit_interval(spark, kws, text):
    kw = spark.createDataFrame([("p", k, k, t, "hard_skill", 0.5) for k, t in kws] or [("q", "x", "x", "critical", "hard_skill", 0.5)],
                               "pool string, keyword string, display string, tier string, category string, frequency double")
    docs = spark.createDataFrame([(1, "p", text)], "doc_id long, pool string, text string")
    for r in ats.keyword_coverage(docs, kw).collect():
        assert 0.0 <= r.coverage <= 1.0 and r.n_hits <= r.n_terms
