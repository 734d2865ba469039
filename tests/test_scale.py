"""Operators that do less than all of the work, against the plain way of doing it."""
import collections
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hirestream.functions import text as tx
from hirestream.operators import ats, dealt, embeddings, frequent, keywords, rank


# ------------------------------------------------- A3/A5 frequent keys per pool
def _posts(seed, n, words=400, pools=("a", "b", "c")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"w{int(rng.paretovariate(0.6)) % words}" + rng.choice(["", "s", "ing", "es"]) for _ in range(rng.randrange(1, 60))]
        rows.append((i, rng.choice(pools), " ".join(own) if i % 17 else None))
    return rows


def _plain_market(phrases, sizes, classes):
    """A4/A5 by the full count: every key of every document, and nothing left out."""
    docs, first, longest = collections.defaultdict(set), {}, {}
    for pool, doc, phrase, canonical, category in phrases:
        for key in {canonical, phrase}:
            docs[pool, key].add(doc)
        if category != "noise":
            k = pool, canonical
            first[k] = min(first.get(k, (phrase, category)), (phrase, category))
            longest[k] = min(longest.get(k, (-len(phrase), phrase)), (-len(phrase), phrase))
    out = set()
    for (pool, key), held in docs.items():
        share = len(held) / sizes[pool]
        if (pool, key) in first and share >= 0.10:
            tier = "critical" if share >= 0.6 else "recommended" if share >= 0.3 else "nice_to_have"
            out.add((pool, key, longest[pool, key][1], first[pool, key][1], len(held), tier))
    return out


@pytest.mark.parametrize("capacity", [frequent.CAPACITY, 3])
@pytest.mark.parametrize("classified", [False, True])
def test_market_keywords_equal_the_full_count(spark, monkeypatch, capacity, classified):
    full = frequent.candidates
    monkeypatch.setattr(frequent, "candidates", lambda *a: full(*a, capacity=capacity))
    docs = spark.createDataFrame(_posts(3, 240), "doc_id long, pool string, text string").repartition(6)
    sets, sizes = keywords.phrase_sets(docs), keywords.docs_per_pool(docs)
    answers = None
    if classified:
        n = F.length("phrase")
        answers = (keywords.held_phrases(sets).select("phrase").distinct().filter(n % 3 > 0)
                   .select(F.col("phrase").alias("keyword"), F.when(n % 3 == 1, "noise").otherwise("tool").alias("category"),
                           F.substring_index("phrase", " ", 1).alias("canonical")))
    cls = keywords.classify(keywords.held_phrases(sets), answers).select("pool", "doc_id", "phrase", "canonical", "category").collect()
    want = _plain_market([tuple(r) for r in cls], {r["pool"]: r["n_docs"] for r in sizes.collect()}, answers)
    for held in (sets, keywords.held_phrases(sets).repartition(5)):
        got = keywords.market_keywords(held, sizes, answers)
        assert {(r.pool, r.keyword, r.display, r.category, r.raw_count, r.tier) for r in got.collect()} == want
    assert len(want) > 20


def test_few_counters_lose_no_frequent_key(spark):
    """Whatever the capacity, rows of keys with the share stay; with room few others do."""
    rows = [(i, "p", k) for i in range(300) for k in {f"rare{i}", f"rare{i + 1}", *(["often"] if i % 8 == 0 else []), "always"}]
    keys = spark.createDataFrame([(p, i, k) for i, p, k in rows], "pool string, doc_id long, key string").repartition(4)
    sizes = spark.createDataFrame([("p", 300)], "pool string, n_docs long")
    for capacity in (2, 10, 400, 10_000):
        for adjacent in (True, False):
            found = frequent.candidates(keys, sizes, 0.10, adjacent, capacity=capacity)
            left = {r.key for r in frequent.only(keys, found).collect()}
            assert {"often", "always"} <= left
    assert left == {"often", "always"}


def test_summary_errors_bound_its_counters():
    rng = random.Random(2)
    held, true = frequent.Summary(8), collections.Counter()
    for n in range(40):
        keys = [f"k{int(rng.paretovariate(0.8)) % 90}" for _ in range(50)]
        true.update(keys)
        held.add(pa.RecordBatch.from_pydict({"pool": ["x"] * 50, "doc_id": list(range(n * 50, n * 50 + 50)), "key": keys}))
    out = held.result(0.0).to_pylist()
    off = next(r["n"] for r in out if r["key"] is None)
    counters = {r["key"]: r["n"] for r in out if r["key"] is not None}
    assert len(counters) <= 8 and all(true[k] - off <= counters.get(k, 0) <= true[k] for k in true)


def test_phrases_are_not_shuffled(spark, tmp_path):
    """A table with a task for each core stays where it is; one small file is dealt out first."""
    docs = spark.createDataFrame(_posts(1, 200), "doc_id long, pool string, text string")
    for files, dealt in ((16, False), (1, True)):
        docs.repartition(files).write.parquet(f"{tmp_path}/{files}")
        plan = keywords.phrases(spark.read.parquet(f"{tmp_path}/{files}"))._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == dealt


@pytest.mark.parametrize("phrase,want", [("building buses", "build bus"), ("ties", "ti"), ("cities city", "cit city"), ("class", "clas"),
                                         ("bus", "bus"), ("ing sing", "ing sing"), ("going", "go"), ("uses use", "us use"), ("a  a\tb", "a b"),
                                         ("tests test tested", "test tested"), ("", ""), (None, ""), ("x x x y y x", "x y x"), ("es ies", "es ies"),
                                         ("Running SINGS", "runn sing")])
def test_naive_canonical_words(spark, phrase, want):
    row = spark.createDataFrame([(phrase,)], "p string").select(tx.naive_canonical(F.col("p")).alias("c")).first()
    assert row.c == want


# ------------------------------------------------------------- J3 one scan of a text
@pytest.mark.parametrize("max_chars", [1 << 20, 0])
def test_one_scan_finds_what_single_searches_find(spark, max_chars):
    kw = spark.createDataFrame([("a", "sql", "SQL", "critical"), ("a", "data", "Big  data", "recommended"), ("a", " ", "", "nice_to_have"),
                                ("a", "ql s", "x", "nice_to_have"), ("b", "étl", "ÉTL", "critical")], "pool string, keyword string, display string, tier string")
    docs = spark.createDataFrame([(1, "a", "We use SQL\n\nserver"), (2, "a", None), (3, "b", "Ein ÉTL"), (4, "c", "sql"), (5, "a", "big\tdata"), (6, None, "sql")],
                                 "doc_id long, pool string, text string")
    plain = ats.with_coverage(ats.with_keywords(docs, kw), F.col("text")).select("doc_id", "coverage")
    terms = ats.Terms(kw, max_chars=max_chars)
    assert (terms.sent is None) == (max_chars == 0)
    once = ats.with_coverage(ats.with_keywords(docs, terms), F.col("text"), terms=terms).select("doc_id", "coverage")
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))


def test_scored_rows_hold_no_keywords(spark):
    """Keywords that tasks have do not lie in the rows that wait for Python, and no join brings them there."""
    kw = spark.createDataFrame([("a", "sql", "SQL", "critical"), ("b", "etl", "ETL", "recommended")], "pool string, keyword string, display string, tier string")
    docs = spark.createDataFrame([(1, "a", "SQL\nand ETL"), (2, "b", "none"), (3, None, "sql")], "doc_id long, pool string, text string")
    terms = ats.Terms(kw)
    scored = ats.score_documents(ats.with_keywords(docs, terms), name="before", terms=terms, lists=("misses",))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "kws" not in plan and "Join" not in plan and "ArrowEvalPython" not in plan
    rows = {r.doc_id: r for r in scored.collect()}
    assert [c.n_hits for c in rows[1].before_coverage] == [1, 0, 0, 1] and [c.misses for c in rows[2].before_coverage] == [[], ["ETL"], [], ["ETL"]]
    assert rows[3].before_coverage[3].n_terms == 0 and rows[3].before_keyword_score == 0.0


def test_gap_by_one_scan_equals_single_searches(spark):
    kw = spark.createDataFrame([("a", "sql", "SQL", "critical"), ("a", "data lake", "x", "critical"), ("a", "", "zzz", "recommended"), ("a", "qq", None, "critical"),
                                ("a", "Up", "Down", "recommended"), ("b", "e\x00f", "e", "critical"), (None, "sql", "sql", "critical")],
                               "pool string, keyword string, display string, tier string")
    cands = spark.createDataFrame([("a", 1, ["mysql", "data", "lake"]), ("a", 2, []), ("a", 3, None), ("b", 4, ["e", "f"]), ("c", 5, ["sql"]), (None, 6, ["sql"]),
                                   ("a", 7, ["down", "Up", "aqq"])], "pool string, candidate_id long, tokens array<string>")
    once, each = (keywords.gap_analysis(cands, kw, max_chars=n) for n in (1 << 20, 0))
    assert "Join" not in once._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, once.collect())) == sorted(map(str, each.collect()))


def test_texts_give_the_records_of_their_phrase_sets(spark):
    docs = spark.createDataFrame([*_posts(5, 150), (900, "p", None), (901, None, "sql data")], "doc_id long, pool string, text string")
    sizes = keywords.docs_per_pool(docs)
    plain, direct = (sorted(map(str, keywords.market_keywords(x, sizes).collect())) for x in (keywords.phrase_sets(docs), docs))
    assert direct == plain and len(direct) > 10
    wanted = frequent.sent(frequent.common(docs.filter("pool is not null"), sizes, 0.1, words=keywords.text_tokens))
    few = frequent.text_records(docs.filter("pool is not null"), wanted, keywords.kept_phrases, keywords.text_tokens, most=20)
    all_ = frequent.text_records(docs.filter("pool is not null"), wanted, keywords.kept_phrases, keywords.text_tokens)
    assert sorted(map(str, few.collect())) == sorted(map(str, all_.collect()))


# --------------------------------------------------------- J1/F1 without all pairs
def _ranking(spark, seed, n, dim=4):
    rng = random.Random(seed)

    def vec():
        v = [rng.gauss(0, 1) for _ in range(dim)]
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v]
    posts = spark.createDataFrame([(i, rng.choice("ab"), f"t{i}", "e", rng.choice([None, rng.uniform(1e5, 9e6)]), "INR", "yearly",
                                    rng.choice([None, 1_600_000_000 - rng.randrange(90 * 86400)]), vec()) for i in range(n)],
                                  "job_id long, pool string, job_title string, employer_name string, job_min_salary double, job_salary_currency string, "
                                  "job_salary_period string, job_posted_at_timestamp long, embedding array<double>")
    cands = spark.createDataFrame([(i, rng.choice("abz"), vec()) for i in range(30)], "candidate_id long, pool string, cand_embedding array<double>")
    return posts, cands


@pytest.mark.parametrize("n,head,weights", [(3, 20, (0.45, 0.35, 0.20)), (3, 5, (0.1, 0.5, 0.4)), (40, 1, (0.45, 0.35, 0.20)), (500, 10, (0.45, 0.35, 0.2)),
                                            (2, 10, (1.0, 0.0, 0.0))])
def test_best_per_candidate_equals_all_pairs(spark, n, head, weights):
    posts, cands = _ranking(spark, 7, 300)
    at = "2020-09-13T12:26:40Z"
    want = rank.top_n_per_candidate(rank.rank_postings(posts, cands, as_of=at, weights=weights), n)
    got = rank.best_per_candidate(posts, cands, as_of=at, n=n, weights=weights, head_rows=head, splits=3)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_levels_that_cannot_reach_the_best_are_not_scored(spark):
    posts, cands = _ranking(spark, 9, 600)
    at, weights, n = "2020-09-13T12:26:40Z", (0.2, 0.5, 0.3), 3
    scored = rank.score_postings(posts, as_of=at)
    rows = rank.levelled(scored, weights, "embedding").cache()
    levels = rank.head_levels(rows, 60).cache()
    best = rank.top_n_per_candidate(rank.rank_postings(posts, cands, as_of=at, weights=weights), n)
    more = rank.open_levels(best, cands, levels, weights, n)
    pairs = (more.join(levels, ["pool", "level"]).agg(F.sum("n")).first()[0] or 0)
    head = cands.join(levels.filter("head"), "pool").agg(F.sum("n")).first()[0]
    every = cands.join(posts, "pool").count()
    assert head + pairs < every / 2


# ------------------------------------------------------ S7/J7 bucketed snapshots
def _buckets_of(path, version):
    import os
    at = f"{path}/snapshot={version}"
    return sorted(d for d in os.listdir(at) if d.startswith("bucket=")) if os.path.isdir(at) else []


def test_a_change_of_one_key_writes_one_bucket(spark, tmp_path):
    from hirestream.sources import sinks
    path, schema = str(tmp_path / "t"), "job_id string, status string"
    rows = spark.createDataFrame([(str(i), "queued") for i in range(300)], schema)
    assert sinks.save_snapshot(spark, rows, path, key="job_id", buckets=16) == 1 and len(_buckets_of(path, 1)) == 16
    keys = spark.createDataFrame([("7",)], "job_id string")
    change = lambda d: d.withColumn("status", F.when(F.col("job_id") == "7", "applied").otherwise(F.col("status")))
    assert sinks.save_changes(spark, path, schema, change, keys, key="job_id") == 2 and len(_buckets_of(path, 2)) == 1
    now = {r.job_id: r.status for r in sinks.load_snapshot(spark, path, schema).collect()}
    assert now == {str(i): "applied" if i == 7 else "queued" for i in range(300)}
    # the same version again changes nothing; no keys write no bucket; a new column is null elsewhere
    assert sinks.save_changes(spark, path, schema, change, keys, key="job_id", version=2) == 2
    assert sinks.save_changes(spark, path, schema, lambda d: d, keys.limit(0), key="job_id") == 3 and _buckets_of(path, 3) == []
    sinks.save_changes(spark, path, schema, lambda d: d.withColumn("extra", F.lit(1)), keys, key="job_id")
    got = sinks.load_snapshot(spark, path, schema)
    assert got.count() == 300 and got.filter("extra = 1 and job_id = '7'").count() == 1 and got.filter("extra is null").count() > 200
    # all rows of a bucket may go, and rows may come
    sinks.save_changes(spark, path, schema, lambda d: d.filter("false"), keys, key="job_id")
    left = sinks.load_snapshot(spark, path, schema)
    assert left.filter("job_id = '7'").isEmpty() and 200 < left.count() < 300
    with pytest.raises(ValueError):
        sinks.save_snapshot(spark, rows, path, key="job_id", buckets=8, touched=[1])


def test_a_plain_table_becomes_bucketed(spark, tmp_path):
    from hirestream.sources import sinks
    path, schema = str(tmp_path / "t"), "job_id long, n long"
    sinks.save_snapshot(spark, spark.range(50).selectExpr("id as job_id", "0L as n"), path)
    sinks.save_changes(spark, path, schema, lambda d: d.withColumn("n", F.lit(5).cast("long")), spark.range(1).selectExpr("id as job_id"), key="job_id", buckets=4)
    assert sinks.manifest(spark, path)[2] == 4 and sinks.load_snapshot(spark, path, schema).filter("n = 5").count() == 50


def test_watcher_writes_the_buckets_of_its_messages_and_observes_its_counters(spark, tmp_path):
    """Small batches touch few buckets; counters observed on the way equal those that
    two snapshots compared would give."""
    from hirestream.sources import sinks
    from hirestream.streaming import status_stream as ss
    table, schema = str(tmp_path / "table"), "job_id long, label string, msg_id long, _event_time timestamp"
    apps = spark.range(400).selectExpr("id as job_id", "'applied' as status")
    sinks.save_snapshot(spark, ss.initial_state(apps), table, 1, key="job_id", buckets=32)
    labels = ["interview", "screening", "rejected", "applied", "viewed", None]
    rng, msg = random.Random(3), 0
    for batch in range(3):
        rows = []
        for _ in range(4):
            msg += 1
            rows.append((rng.randrange(400), rng.choice(labels), msg, f"2024-01-0{batch + 1} 00:00:0{msg % 10}"))
        spark.createDataFrame(rows, "job_id long, label string, msg_id long, at string").selectExpr(
            "job_id", "label", "msg_id", "cast(at as timestamp) as _event_time").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ss.start_watch(stream, table, checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert sinks.current_version(spark, table) == 4
    assert all(0 < len(_buckets_of(table, v)) <= 4 for v in (2, 3, 4))
    final = sinks.load_snapshot(spark, table, ss.STATE_SCHEMA)
    whole = ss.fold_batch(ss.initial_state(apps), spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(str, ss.statuses(final).collect())) == sorted(map(str, ss.statuses(whole).collect()))
    counts = spark.read.parquet(f"{table}/counts/*").agg(F.sum("checked"), F.sum("classified")).first()
    once = ss.poll_counts(ss.initial_state(apps), whole).first()
    assert tuple(counts) == (once.checked, once.classified) and once.checked == 12


# ------------------------------------------------------------- J6 substring index
def _match(verdicts, known):
    out = {}
    for v in {x.strip(" ").lower() for x in verdicts if x is not None} - {""}:
        hits = [(o, c.strip(" ").lower()) for c, o in known if c is not None and c.strip(" ") and (v in c.strip(" ").lower() or c.strip(" ").lower() in v)]
        if hits:
            out[v] = min(hits)[1]
    return out


def test_companies_match_as_by_all_pairs(spark):
    from hirestream.operators import mail
    rng = random.Random(11)
    names = ["".join(rng.choices("abc ", k=rng.randrange(1, 9))) for _ in range(150)] + ["", None, "  ", "Acme", "acme corp", "a"]
    verdicts = ["".join(rng.choices("abc ", k=rng.randrange(1, 12))) for _ in range(150)] + ["", None, "ACME Corporation", "zzz", "zz", "z", "ab" * 3000]
    known = [(n, i) for i, n in enumerate(names)]
    got = mail.match_companies(spark.createDataFrame([(v,) for v in verdicts], "matched_company string"),
                               spark.createDataFrame(known, "company string, company_order int"))
    assert {r.verdict: r.company for r in got.collect()} == _match(verdicts, known)


# ------------------------------------------------------ K1 producers, K3 by vectors
class Lengths:
    """A toy producer: a text's length and how often its task has opened it."""
    width = 2

    def open(self):
        import numpy as np
        opened = []
        opened.append(1)
        return lambda texts: np.array([[len(t), len(opened)] for t in texts], float)


class Wrong(Lengths):
    width = 3


def test_a_producer_embeds_texts(spark):
    from pyspark import cloudpickle
    import sys
    from hirestream.operators import embeddings
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (None, "äö")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.vector for r in embeddings.embed(docs, Lengths()).collect()}
    assert got == {1: [3, 1], 2: [0, 0], 3: [0, 1], None: [2, 1]}
    assert embeddings.embed(docs.limit(0), Lengths()).collect() == []
    with pytest.raises(Exception, match="the producer gave"):
        embeddings.embed(docs, Wrong()).collect()


def test_phrase_cosines(spark):
    import numpy as np
    from hirestream.operators import embeddings
    rng = np.random.default_rng(1)
    dv = {i: rng.normal(size=5).tolist() for i in range(4)}
    pv = {p: rng.normal(size=5).tolist() for p in "abc"} | {"zero": [0.0] * 5}
    rows = [(i, p, n) for i in range(5) for n, p in enumerate(["a", "c", "zero", "unknown"])]
    got = embeddings.cosine_scores(spark.createDataFrame(rows, "doc_id long, phrase string, n long"),
                                   spark.createDataFrame(list(dv.items()), "doc_id long, vector array<double>"),
                                   spark.createDataFrame(list(pv.items()), "phrase string, vector array<double>"))
    want = {}
    for i, p, n in rows:
        if i in dv and p in pv:
            a, b = np.array(dv[i]), np.array(pv[p])
            want[i, p, n] = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if p != "zero" else 0.0
    assert {(r.doc_id, r.phrase, r.n): pytest.approx(r.score) for r in got.collect()} == want


# ------------------------------------------------- findings of round 3
_ODD_TEXTS = [None, "", " ", "a", "Big data https://x.org/a b@c.de data's", "@a b@ @@c d@@ e@f", "x@y@z mail é@ü ünïcode K2 K9", "A-b/c+d.e#f the THE 1 22",
              "tests testing test the of test", "one\ttwo\x0bthree\x1cfour five", "https://a@b c http://", "ing sing sings " + "w" * 60 + " job description"]


def test_byte_tokens_equal_the_patterns(spark):
    docs = spark.createDataFrame([(i, "p", t) for i, t in enumerate(_ODD_TEXTS)], "doc_id long, pool string, text string")
    got = docs.select("doc_id", keywords.doc_tokens(docs).alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == {i: keywords.text_tokens(t and t.encode()) for i, t in enumerate(_ODD_TEXTS)}


@pytest.mark.parametrize("phrase", ["building buses", "cities city", "going", "a  a\tb", " x", "x ", "", "x x x y y x", "Running SINGS", "tests test tested"])
def test_canonical_in_tasks_equals_the_column(spark, phrase):
    want = spark.createDataFrame([(phrase,)], "p string").select(tx.naive_canonical(F.col("p")).alias("c")).first().c
    stems = {}
    assert [tx.naive_canonical_text(phrase, stems) for _ in range(2)] == [want, want]


def test_keyword_mining_makes_no_row_per_phrase(spark, monkeypatch):
    """Sets are counted in their rows, and a few counters lose nothing."""
    docs = spark.createDataFrame(_posts(5, 150), "doc_id long, pool string, text string").repartition(4)
    sets, sizes = keywords.phrase_sets(docs), keywords.docs_per_pool(docs)
    want = {tuple(r) for r in keywords.market_keywords(keywords.held_phrases(sets), sizes).collect()}
    monkeypatch.setattr(keywords, "held_phrases", lambda *a: pytest.fail("a row per phrase"))
    common, records = frequent.common, frequent.set_records
    monkeypatch.setattr(frequent, "common", lambda *a: common(*a, most=40))
    monkeypatch.setattr(frequent, "set_records", lambda *a: records(*a, most=40))
    assert {tuple(r) for r in keywords.market_keywords(sets, sizes).collect()} == want and len(want) > 20


def test_phrases_of_rows_with_one_id_count_together(spark):
    docs = spark.createDataFrame([(1, "p", "cats dogs"), (1, "p", "cats"), (1, "q", "cats"), (None, "p", "owls"), (None, "p", "owls"), (2, None, "owls")],
                                 "doc_id long, pool string, text string").repartition(3)
    got = {(r.pool, r.doc_id, r.n, r.phrase): r.tf for r in keywords.phrase_counts(docs).collect()}
    assert got == {("p", 1, 1, "cats"): 2, ("p", 1, 1, "dogs"): 1, ("p", 1, 2, "cats dogs"): 1, ("q", 1, 1, "cats"): 1, ("p", None, 1, "owls"): 2,
                   (None, 2, 1, "owls"): 1}


def test_gap_searches_no_token_one_by_one(spark):
    """One search per term in a row, with the results of the search in every token."""
    kw = spark.createDataFrame([("p", t, t.upper(), "critical") for t in ("ab", "abc", "c d", "", "z\x00q", "q")], "pool string, keyword string, display string, tier string")
    rows = spark.createDataFrame([("p", 1, ["xabx", "c", "d"]), ("p", 2, []), ("p", 3, None), ("n", 4, ["ab"]), ("p", 5, ["z", "q"])],
                                 "pool string, candidate_id long, tokens array<string>")
    gap = keywords.gap_analysis(rows, kw)
    assert "exists(" not in gap._jdf.queryExecution().optimizedPlan().toString()
    got = {r.candidate_id: {g.keyword for g in r.gap if g.bucket == "already_have"} for r in gap.collect()}
    assert got == {1: {"ab", ""}, 2: set(), 3: set(), 4: set(), 5: {"q", ""}}


def test_document_vectors_compute_their_norm_once(spark):
    """below the loop over terms, the norm made the work grow with the square of a document."""
    docs = spark.createDataFrame([(1, "cats dogs cats"), (2, "dogs"), (3, None)], "doc_id long, text string")
    v = embeddings.doc_vectors(docs)
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "Generate" in plan
    got = {r.doc_id: {x.term: x.weight for x in r.vector} for r in v.collect()}
    assert set(got[1]) == {"cats", "dogs"} and got[2] == {"dogs": 1.0} and got[3] == {}
    assert abs(sum(w * w for w in got[1].values()) - 1) < 1e-12


def test_phrases_without_a_document_vector_meet_no_phrase_vectors(spark):
    """phrases of documents that have no vector are left out before their vectors are joined."""
    phrases = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "a")], "doc_id long, phrase string")
    docs = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vector array<float>")
    of = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "phrase string, vector array<float>")
    scored = embeddings.cosine_scores(phrases, docs, of)
    assert "LeftSemi" in scored._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in scored.collect()] == [(1, "a", 1.0)]


def test_a_null_phrase_vector_shifts_no_score(spark):
    phrases = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "doc_id long, phrase string")
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "doc_id long, vector array<float>")
    of = spark.createDataFrame([("a", None), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "phrase string, vector array<float>")
    assert {tuple(r) for r in embeddings.cosine_scores(phrases, docs, of).collect()} == {(1, "a", None), (1, "b", 1.0), (1, "c", 0.0), (2, "a", None)}


# ------------------------------------------------- phrases dealt in packed form
def _odd_posts(spark):
    rows = _posts(7, 120, words=60) + [(3, "b", "cats dogs cats"), (3, "a", "cats"), (5, None, "owls cats"), (None, "a", "cats owls"), (None, "a", "cats"), (900, "a\x1fx", "cats owls")]
    return spark.createDataFrame(rows, "doc_id long, pool string, text string").repartition(5)


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_document_frequency_of_texts_equals_that_of_rows(spark, monkeypatch, most):
    """no row per phrase and document."""
    monkeypatch.setattr(dealt, "MOST_HELD", most)
    docs = _odd_posts(spark)
    want = {tuple(r) for r in keywords.document_frequency(keywords.phrases(docs)).collect()}
    got = keywords.document_frequency(docs)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 200
    assert {r.phrase for r in keywords.vocabulary(docs).collect()} == {p for _, p, _ in want}


def test_scores_meet_their_documents_in_packed_form(spark, monkeypatch):
    """top phrases and MMR picks as by joining a row per phrase with its weight."""
    docs = _odd_posts(spark).filter("doc_id is null or doc_id <> 3")  # ties between pools have no order
    sizes = keywords.docs_per_pool(docs)
    plain = keywords.phrase_scores(keywords.phrase_counts(docs), sizes)
    top = keywords.top_n_per_group(plain, ["doc_id", "n"], [F.col("score").desc(), F.col("phrase").asc()], 4).filter(keywords.kept_phrase(F.col("phrase")))
    want = {tuple(r) for r in top.select("pool", "doc_id", "n", "phrase", "tf", "score", "rank").collect()}
    picks = {by: {tuple(r) for r in embeddings.mmr_rerank(plain, top_n=3, by=by).collect()} for by in (("doc_id",), ("pool", "doc_id", "n"))}
    monkeypatch.setattr(keywords, "phrase_counts", lambda *a, **k: pytest.fail("a row per phrase"))
    assert {tuple(r) for r in keywords.top_phrases(docs, top_per_doc=4).collect()} == want and len(want) > 200
    for by, rows in picks.items():
        assert {tuple(r) for r in embeddings.mmr_documents(docs, sizes, top_n=3, by=by).collect()} == rows


def test_classes_meet_documents_in_packed_form(spark, monkeypatch):
    """Keyword records under answers as by joining a row per phrase with its answer."""
    docs = _odd_posts(spark)
    n, sizes = F.length("phrase"), keywords.docs_per_pool(docs)
    answers = (keywords.vocabulary(docs).filter(n % 3 > 0)
               .select(F.col("phrase").alias("keyword"), F.when(n % 3 == 1, "noise").when(n % 5 > 0, "tool").alias("category"),
                       F.when(n % 2 == 0, F.substring_index("phrase", " ", 1)).alias("canonical")))
    want = {tuple(r) for r in keywords.market_keywords(keywords.phrases(docs), sizes, answers).collect()}
    monkeypatch.setattr(keywords, "held_phrases", lambda *a: pytest.fail("a row per phrase"))
    assert {tuple(r) for r in keywords.market_keywords(docs, sizes, answers).collect()} == want and len(want) > 20
    monkeypatch.setattr(frequent, "sent", lambda *a: None)  # too many keys to be sent
    assert {tuple(r) for r in keywords.market_keywords(docs, sizes, answers).collect()} == want


def test_answers_that_repeat_a_keyword_are_sorted_out_where_they_are_dealt(spark):
    """the smallest answer holds, nulls first, without a shuffle of the answers before that one."""
    docs = _odd_posts(spark)
    sizes, known = keywords.docs_per_pool(docs), [r.phrase for r in keywords.vocabulary(docs).collect()]
    forms = [("tool", "z"), ("tool", None), ("noise", "\x01"), (None, "one"), ("tool", "\x01two"), (None, None), ("tool", "same")]
    rng, rows = random.Random(3), []
    for k in sorted(known):
        for category, canonical in rng.sample(forms, rng.choice([0, 1, 1, 2, 3])):
            rows.append((json.dumps([{"keyword": k, "category": category, "canonical": k if canonical == "same" else canonical}]),))
    raw = spark.createDataFrame(rows, "raw string").repartition(5)
    each = keywords.landed_classification(raw, single=False)
    assert "Exchange" in each._jdf.queryExecution().executedPlan().toString() and each.count() == len(rows)
    assert each._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the test's own repartition
    want = sorted(map(str, keywords.market_keywords(keywords.phrases(docs), sizes, keywords.landed_classification(raw)).collect()))
    assert sorted(map(str, keywords.market_keywords(docs, sizes, each).collect())) == want and len(want) > 20


def test_packed_values_are_compressed(spark):
    """what is dealt is smaller than what lz4, as the shuffle has it, makes of it."""
    keys = [f"word{i % 997} other{i % 1009}" for i in range(20_000)]
    packed = dealt._asked(keys, np.ones(len(keys)), 4)
    size = sum(len(x) for c in ("lengths", "data", "n") for x in packed.column(c).to_pylist())
    assert size < 0.8 * len(pa.compress("".join(keys).encode(), codec="lz4_raw", asbytes=True))
    assert sorted(dealt._plain(dealt._unpacked(packed.column("lengths"), packed.column("data"))[0])) == sorted(keys)


def test_mmr_picks_look_at_few_candidates_and_are_those_of_all():
    """candidates are made as far as they can still be picked."""
    rng = random.Random(4)
    for _ in range(600):
        own = {" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 2, 2, 3]))): rng.choice([0.0, 1.0, 1.5, 2.25, rng.uniform(-1, 3)]) for _ in range(rng.randint(1, 40))}
        ranked = sorted((-s, p) for p, s in own.items())
        n, diversity = rng.randint(0, 50), rng.choice([0, 0.3, 0.5, 0.7, 1])
        want = embeddings.mmr_order([p for _, p in ranked], -np.array([s for s, _ in ranked]), n, diversity)
        got = embeddings.mmr_picks(((-s, p) for s, p in ranked), -ranked[0][0], n, diversity)
        assert got == [(-ranked[j][0], ranked[j][1]) for j in want]
    made = []
    many = ((made.append(i) or 1.0 - i / 1000, f"w{i} v{i % 7}") for i in range(1000))
    assert len(embeddings.mmr_picks(many, 1.0, 10, 0.3)) == 10 and len(made) < 300


@pytest.mark.parametrize("raw,want", [("```json[1]```x```", "[1]"), ("````", "````"), ("``` JSON```", "JSON"), ("```JsOn\n [1]```", "[1]"), ("a```json```", "")])
def test_fences_are_found_by_position(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(tx.strip_code_fences(F.col("r")).alias("b")).first().b == want


@pytest.mark.parametrize("raw,want", [("[1]", "[1]"), (" \t[1]\n", "[1]"), ("x ```json\n[1] \n``` y", "[1]"), ("``` [2]", "``` [2]"), ("", ""), (None, ""), ("\xa0a", "\xa0a"), (" ", "")])
def test_fences_and_blanks_are_stripped(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(tx.strip_code_fences(F.col("r")).alias("b")).first().b == want


def test_texts_are_cut_once_in_resumes(spark):
    """no lambda or case works out a date range or a trimmed text for each of its uses."""
    from hirestream.functions import text as tx
    from hirestream.operators import resume
    docs = spark.createDataFrame([(1, "Jane Doe\nEducation\nB.Sc. Physics, Example College Jan 2001 - May 2004")], "doc_id long, text string")
    parsed = resume.parse_resumes(docs)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Present|Current") <= 6 * 2  # a match and two groups of it, for jobs and for schools
    school = parsed.select("resume.education").first()[0][0]
    assert (school.degree, school.institution, school.start_date, school.end_date) == ("B.Sc. Physics", "Example College", "Jan 2001", "May 2004")
    odd = ["", " a ", "\t- a -\n", "a  ", "a \u0085", " ", " a ", "é ", "•· x ·", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    for row in rows.select(tx.pytrim(F.col("t")).alias("a"), tx.trim_blanks(F.col("t")).alias("b"),
                           tx.strip_chars(F.col("t"), " -·•").alias("c"), tx.trim_chars(F.col("t"), " -·•").alias("d")).collect():
        assert (row.a, row.c) == (row.b, row.d)


def test_tailoring_texts_are_put_together_once(spark):
    """the texts of both résumés are built once each, and a token that another line of the new text has is not lost."""
    from hirestream.operators import resume
    role = "struct<title:string,company:string,location:string,start_date:string,end_date:string,bullets:array<string>>"
    school = "struct<degree:string,institution:string,location:string,start_date:string,end_date:string,details:string>"
    r = (f"struct<summary:string,experience:array<{role}>,skills:array<string>,education:array<{school}>,"
         "certifications:array<struct<name:string,issuer:string,date:string>>,"
         "projects:array<struct<name:string,description:string,bullets:array<string>>>,"
         "publications:array<string>,languages:array<string>,awards:array<string>>")

    def made(bullets):
        return ("Led Apollo", [("Dev", "Acme", "", "", "", bullets)], ["sql"], [], [], [], [], [], [])
    frame = spark.createDataFrame([(made(["Cut 40% at Initech", "Ran 7 teams"]), made(["Led 40% of Apollo", "Ran 7 teams"])),
                                   (made(None), made(["New"]))], f"a {r}, b {r}")
    out = frame.select(F.inline(F.array(resume.tailoring_changes(F.col("a"), F.col("b")))))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(") <= 2 * 5
    assert [(x.numbers_lost, x.names_lost) for x in out.collect()] == [([], ["Cut", "Initech"]), ([], [])]


def test_letters_take_the_first_role_without_lists_of_roles(spark, tmp_path):
    """line items were formatted and collected per order for the title and company of one of them."""
    from hirestream.plans import catalog
    rows = {
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
        "nation": ([(0, "INDIA", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(1, "BUILDING", 0)], "c_custkey long, c_mktsegment string, c_nationkey long"),
        "supplier": ([(1, "Acme"), (2, None), (2, "Beta"), (3, "Gamma")], "s_suppkey long, s_name string"),
        "part": ([(1, "bolt", "A"), (2, "nut", "B"), (2, "cog", "B"), (3, None, "C")], "p_partkey long, p_name string, p_type string"),
        "orders": ([(i, 1, "O", "1-URGENT") for i in range(1, 8)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, 2), (1, 2, 3, 1),          # the lowest line number is the first role
                      (2, 9, 1, 1), (2, 1, 9, 2), (2, 1, 3, 3),  # lines of no part or no supplier do not count
                      (3, 2, 2, 1), (3, 2, 2, 1),          # keys that repeat
                      (4, 1, 1, None), (4, 2, 1, 1),       # no line number comes first
                      (5, 3, 2, 1), (6, None, 1, 1), (None, 1, 1, 1)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
    }
    for name, (data, schema) in rows.items():
        t = spark.createDataFrame(data, schema)
        if name == "orders":
            t = t.withColumn("o_orderdate", F.lit("1996-01-02").cast("timestamp"))
        if name == "lineitem":
            t = t.select("*", F.lit("1996-03-13").cast("timestamp").alias("l_shipdate"), F.lit(3.0).alias("l_quantity"), F.lit(10.0).alias("l_extendedprice"),
                         F.lit(0.1).alias("l_discount"), F.lit("O").alias("l_linestatus"), F.lit("R").alias("l_returnflag"))
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = catalog.QUERIES["cover_letter_lines"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    first = {r.candidate_id: r.e for r in catalog.candidates(spark, str(tmp_path)).select("candidate_id", F.get("resume.experience", 0).alias("e")).collect()}
    got = {r.candidate_id: r.letter.split("\n") for r in out.collect()}
    assert set(got) == set(first) == set(range(1, 8))
    for k, lines in got.items():
        title, company = (first[k].title, first[k].company) if first[k] else (None, None)
        assert f"I am applying for the {title or 'open'} role at {company or 'your company'}." in lines
        assert lines[5] == (company or "")
    assert [(first[k].title, first[k].company) if first[k] else None for k in range(1, 8)] == [
        ("cog", "Gamma"), ("bolt", "Gamma"), ("cog", None), ("bolt", "Acme"), (None, None), None, None]
