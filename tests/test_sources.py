"""Sources, sinks and helpers on small inputs written to a scratch folder."""
import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hirestream.operators import embeddings, requests, resume
from hirestream.sources import postings as postings_src
from hirestream.sources import sinks
from hirestream.sources.documents import read_documents


def _tmp():
    return tempfile.mkdtemp(prefix="hs-src-")


def test_read_postings_envelope_bare_and_non_objects(spark):
    d = _tmp()
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump({"_about": "x", "data": [{"job_id": "e1", "job_title": "QA", "_source_location": "Pune"},
                                           {"job_id": "e2", "job_min_salary": 5}]}, f)
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump([{"job_id": "b1", "job_is_remote": True}, "not an object", {"job_id": "b2"}], f)
    got = {r.job_id: r for r in postings_src.read_postings(spark, d, source_location="fixture").collect()}
    assert set(got) == {"e1", "e2", "b1", "b2"}
    assert got["e1"]._source_location == "Pune" and got["b1"]._source_location == "fixture"
    assert got["e2"].job_min_salary == 5.0 and got["b1"].job_is_remote


def test_read_keywords_ignores_unknown_fields(spark):
    d = _tmp()
    with open(os.path.join(d, "k.json"), "w") as f:
        json.dump([{"keyword": "gmp", "display": "GMP", "tier": "critical", "frequency": 0.7, "extra": 1}], f)
    r = postings_src.read_keywords(spark, d).first()
    assert (r.keyword, r.tier, r.frequency) == ("gmp", "critical", 0.7) and "extra" not in r.asDict()


def test_board_rows_epochs_and_defaults(spark):
    rows = [("s", None, "QA", "Acme", None, "Pune", None, "India", None, "d", None, "https://x/1", None,
             "2026-06-01T10:00:00+05:30", 1.0, None, None, None, None, "7", None, None)]
    from hirestream.schemas import BOARD_ROW_DDL
    df = spark.createDataFrame(rows, BOARD_ROW_DDL)
    r = postings_src.normalise_board_rows(df, "boardx", "Pune").first()
    assert r.job_posted_at_timestamp == 1780288200 and r.job_salary_currency == "INR"
    assert r.job_salary_period == "yearly" and r._applicant_count == 7 and r.job_city == "Pune"
    assert r.job_id.startswith("board:boardx:") and len(r.job_id) == len("board:boardx:") + 16


def test_snapshot_versions(spark):
    path = os.path.join(_tmp(), "apps")
    assert sinks.current_version(spark, path) is None
    v1 = sinks.save_snapshot(spark, spark.createDataFrame([("1", "queued")], "job_id string, status string"), path)
    v2 = sinks.save_snapshot(spark, spark.createDataFrame([("1", "applied")], "job_id string, status string"), path)
    assert (v1, v2) == (1, 2)
    assert sinks.load_snapshot(spark, path, "job_id string, status string").first().status == "applied"


def test_read_documents_rejects_unknown_extensions(spark):
    d = _tmp()
    for name, body in [("a.txt", "line 1\nline 2\n"), ("b.md", "# t"), ("c.pdf", "%PDF")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    ok, rej = read_documents(spark, d)
    assert sorted(len(r.text) for r in ok.collect()) == [3, 14] and rej.count() == 1


def test_fill_template_single_pass_and_limits(spark):
    df = spark.createDataFrame([("{b}", "xyz123")], "a string, b string")
    c = requests.fill_template("A={a} B={b} {{lit}}", {"a": F.col("a"), "b": F.col("b")}, {"b": 3})
    assert df.select(c.alias("p")).first().p == "A={b} B=xyz {lit}"


def test_chunk_ids(spark):
    df = spark.createDataFrame([("p", f"k{i:03d}") for i in range(125)], "pool string, kw string")
    got = sorted((r.chunk_id, r.n) for r in requests.chunk_ids(df, "pool", "kw", 60, num_partitions=4)
                 .groupBy("chunk_id").agg(F.count("*").alias("n")).collect())
    assert got == [(0, 60), (1, 60), (2, 5)]


def test_merge_parsed_prefers_non_empty_extracted(spark):
    from hirestream.schemas import RESUME_DDL
    empty = {"contact": {k: "" for k in ["name", "email", "phone", "location", "linkedin", "github", "portfolio"]},
             "summary": "", "experience": [], "skills": [], "education": [], "certifications": [], "projects": [],
             "publications": [], "languages": [], "awards": []}
    heur = dict(empty, summary="heuristic", skills=["a"], contact=dict(empty["contact"], email="h@x.org"))
    ext = dict(empty, summary="", skills=["b", "c"], contact=dict(empty["contact"], name="Jane"))
    t = _ddl_fields(RESUME_DDL)
    j = spark.createDataFrame([(ext, heur)], f"e struct<{t}>, h struct<{t}>")
    m = j.select(resume.merge_parsed(F.col("e"), F.col("h")).alias("m")).first().m
    assert (m.summary, m.skills, m.contact.name, m.contact.email) == ("heuristic", ["b", "c"], "Jane", "h@x.org")


def _ddl_fields(ddl: str) -> str:
    """'a string, b array<..>' -> 'a: string, b: array<..>' for a struct type string."""
    out, depth, cur = [], 0, ""
    for ch in ddl:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    out.append(cur.strip())
    return ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1]}" for p in out)


def test_mmr_prefers_diverse_phrases(spark):
    ph = spark.createDataFrame([(1, "quality control", 3.0), (1, "quality assurance", 2.9), (1, "quality", 2.8),
                                (1, "sterility test", 2.0)], "doc_id long, phrase string, score double")
    got = [r.phrase for r in embeddings.mmr_rerank(ph, top_n=3, diversity=0.7).orderBy("mmr_rank").collect()]
    assert got[0] == "quality control" and got[1] == "sterility test"


def test_parse_resume_text(spark):
    text = "\n".join(["Jane Doe", "Pune | +91 98450 12345 | jane@x.org", "Professional Summary",
                      "QC microbiologist.", "Work Experience",
                      "Senior Microbiologist | Anthem    Jun 2022 – Present", "- Ran QC", "Skills", "GMP, HPLC",
                      "Education", "M.Sc. Microbiology, Pune University    2015 – 2017", "Certifications",
                      "- GMP Basics", "Projects", "Media fill", "- Designed runs", "Languages", "- English"])
    r = resume.parse_resumes(spark.createDataFrame([(7, text)], "doc_id long, text string")).first().resume
    assert r.contact.name == "Jane Doe" and r.contact.email == "jane@x.org"
    assert r.summary == "QC microbiologist." and r.skills == ["GMP", "HPLC"]
    e = r.experience[0]
    assert (e.title, e.start_date, e.end_date, e.bullets) == ("Senior Microbiologist | Anthem", "Jun 2022", "Present", ["Ran QC"])
    assert (r.education[0].degree, r.education[0].institution, r.education[0].end_date) == ("M.Sc. Microbiology", "Pune University", "2017")
    assert r.certifications[0].name == "GMP Basics" and r.projects[0].name == "Media fill"
    assert r.projects[0].bullets == ["Designed runs"] and r.languages == ["English"]


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    sf = "/root/testdata/sf0.001"
    a = sorted(tuple(r) for r in q["status_fold"](spark, sf).collect())
    b = sorted(tuple(r) for r in q["status_fold_stream"](spark, sf).collect())
    assert a == b and len(a) > 0
    assert isinstance(pd.__version__, str)


def _message_folder(spark, files):
    """Events cut into several files of one folder, as messages are landed."""
    base = _tmp()
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(files).write.parquet(f"{base}/events.parquet")
    return base


def test_watch_over_several_batches_and_a_replay(spark):
    # Many micro-batches give what one batch gives; replaying them changes nothing
    from hirestream.plans import catalog as C
    from hirestream.sources import sinks
    from hirestream.streaming import status_stream
    sf = _message_folder(spark, 5)
    want = sorted(tuple(r) for r in C.status_fold(spark, "/root/testdata/sf0.001").collect())
    table = C._watched(spark, sf, max_files=1, lookback="60 days")  # the files are not in order of time
    assert sinks.current_version(spark, table) == 6
    read = lambda: sorted(tuple(r) for r in status_stream.statuses(sinks.load_snapshot(spark, table, status_stream.STATE_SCHEMA)).collect())
    assert read() == want
    msgs = status_stream.dedupe_messages(C._message_rows(status_stream.message_stream(spark, sf, C.EVENT_SCHEMA, table="events")),
                                         id_col="msg_id", time_col="ts", lookback="60 days")
    status_stream.start_watch(msgs, table, checkpoint=_tmp() + "/again").awaitTermination()  # a lost checkpoint replays batch 0
    assert read() == want and sinks.current_version(spark, table) == 6


def test_watch_processing_time_trigger(spark):
    # The long-running watcher processes what has landed, then is stopped by its owner
    from hirestream.plans import catalog as C
    from hirestream.sources import sinks
    from hirestream.streaming import status_stream
    sf, table = "/root/testdata/sf0.001", _tmp() + "/table"
    appl = C._event_applications(spark, sf)
    sinks.save_snapshot(spark, status_stream.initial_state(appl), table, 1)
    msgs = status_stream.dedupe_messages(C._message_rows(status_stream.message_stream(spark, sf, C.EVENT_SCHEMA, table="events")),
                                         id_col="msg_id", time_col="ts")
    q = status_stream.start_watch(msgs, table, checkpoint=_tmp() + "/stream", interval="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = status_stream.statuses(sinks.load_snapshot(spark, table, status_stream.STATE_SCHEMA))
    assert out.count() == appl.count() and out.agg(F.sum("n_messages")).first()[0] > 0


def test_empty_stream_gives_an_empty_table(spark):
    from hirestream.plans import catalog as C
    from hirestream.streaming import status_stream
    base = _tmp()
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(f"{base}/events.parquet")
    s = status_stream.message_stream(spark, base, C.EVENT_SCHEMA, table="events").select("event_id")
    assert status_stream.append_batches(s, _tmp() + "/out", checkpoint=_tmp() + "/stream").collect() == []


def test_a_failing_read_is_not_an_empty_table(spark):
    from hirestream.sources import sinks
    base = _tmp()
    assert sinks.load_snapshot(spark, base + "/none", "a long").collect() == []
    spark.range(1).selectExpr("'x' as version").write.parquet(base + "/t/committed/1")
    with pytest.raises(Exception):
        sinks.load_snapshot(spark, base + "/t", "a long")


def test_snapshots_grow_columns(spark):
    # Columns that an older snapshot lacks are null, new ones are kept
    from hirestream.sources import sinks
    path = _tmp() + "/t"
    sinks.save_snapshot(spark, spark.createDataFrame([("1", 5)], "job_id string, extra long"), path)
    r = sinks.load_snapshot(spark, path, "job_id string, status string").first()
    assert (r.job_id, r.status, r.extra) == ("1", None, 5)
    assert sinks.save_snapshot(spark, spark.createDataFrame([("9", 9)], "job_id string, extra long"), path, version=1) == 1
    assert sinks.load_snapshot(spark, path, "job_id string").first().job_id == "1"
