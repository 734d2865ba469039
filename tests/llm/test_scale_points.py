"""Inputs that a cluster brings: rows in any order, repeated rows, hot rows, odd columns."""
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hirestream.llm import bpe, chat, common, jaccard_join, mixing, packing, sharding, toxicity
from hirestream.llm.queries import QUERIES, tokenizer_path
from hirestream.session import ensure_checkpoint_dir
from test_llm_operators import frame, odd_rows, prose


@pytest.fixture(scope="module")
def library():
    t = bpe.open_tokenizer(bpe.read_tokenizer(tokenizer_path()))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("spool", [False, True])
def test_bpe_of_rows_in_another_order_at_each_read(spark, library, spool):
    """The input is a shuffle that is run again for each read."""
    rows = odd_rows() + [(1000 + i, prose(i, 30 + i % 7), "s") for i in range(200)]
    docs = frame(spark, rows).repartition(7, F.xxhash64("doc_id")).sortWithinPartitions(F.rand())
    got = bpe.encode(docs, tokenizer_path(), block_bytes=3000, spool=spool).collect()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=str) == sorted(((i, np.array(library(t), "<u4").tobytes()) for i, t, _ in rows), key=str)


def test_token_ids_are_packed_with_end_marks(spark, library):
    rows = odd_rows() + [(77, "the same row", "s")] * 40
    path = tokenizer_path()
    end = bpe.end_id(path)
    packed = packing.pack_ids(bpe.encode(frame(spark, rows), path, spool=True), end, capacity=64, block_bytes=2000)
    for r in packed.collect():
        line, place = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(line) == len(place) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and not line[r.n_tokens:].any()
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert place[a:b].tolist() == list(range(b - a))
    back = sorted(((r.doc_id, bytes(r.ids)) for r in packing.unpack_rows(packed).collect()), key=str)
    assert back == sorted(((i, np.array([*library(t), end], "<u4").tobytes()) for i, t, _ in rows), key=str)


def test_packing_neither_shuffles_nor_writes_ids(spark, library, tmp_path):
    """Ids once went through a written table and two shuffles, for more disk than the query has."""
    rows = odd_rows() + [(77, "the same row", "s")] * 40 + [(500 + i, prose(i, 30 + i % 7), "s") for i in range(300)]
    frame(spark, rows).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    held = os.path.join(ensure_checkpoint_dir(spark), "written")
    before = set(os.listdir(held)) if os.path.isdir(held) else set()
    packed = QUERIES["op2_packing"](spark, str(tmp_path))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan and "FlatMapGroups" not in plan
    end = bpe.end_id(tokenizer_path())
    back = sorted(((r.doc_id, bytes(r.ids)) for r in packing.unpack_rows(packed).collect()), key=str)
    assert back == sorted(((i, np.array([*library(t), end], "<u4").tobytes()) for i, t, _ in rows), key=str)
    assert (set(os.listdir(held)) if os.path.isdir(held) else set()) == before


@pytest.mark.parametrize("size, kept", [(1 << 20, 1 << 20), (3000, 1 << 20), (3000, 50), (1, 0)])
def test_bpe_without_a_shuffle(spark, library, size, kept):
    """Runs of rows, words kept from earlier ones, and no room for words."""
    rows = odd_rows() + [(1000 + i, prose(i, 30 + i % 7), "s") for i in range(100)]
    rows += [(2000, " \t\n\x0b\x0c\r", "s"), (2001, "\x1fa\x85b\u00a0c\u2003d\x1c", "s"), (2002, "e\u0301 \u0301 E", "s"), (None, "no id", "s")]
    got = bpe.encode(frame(spark, rows).repartition(3), tokenizer_path(), block_bytes=size, shuffle=False, kept_words=kept).collect()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=str) == sorted(((i, np.array(library(t), "<u4").tobytes()) for i, t, _ in rows), key=str)
    assert bpe.encode(frame(spark, []), tokenizer_path(), shuffle=False).collect() == []


def test_toxicity_models_do_not_depend_on_row_order(spark):
    """An id with several texts, and labels that disagree, have one defined reading."""
    rng = random.Random(1)
    rows = [(i, f"{'bad nasty' if i % 3 == 0 else 'good kind'} " + prose(i, 20, 60), "s") for i in range(150)]
    rows += [(i, f"{'good kind' if i % 3 == 0 else 'bad nasty'} " + prose(1000 + i, 20, 60), "s") for i in range(0, 150, 2)]
    said = [(i, 1 - i % 2, int(i % 3 == 0)) for i in range(150)] + [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 7)]
    cats = {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chains = []
    for _ in range(2):
        rng.shuffle(rows)
        rng.shuffle(said)
        labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int").repartition(3)
        chains.append(toxicity.train(frame(spark, rows).repartition(5), labels, cats))
    for a, b in zip(*chains):
        assert a.bias == b.bias and a.threshold == b.threshold and np.array_equal(a.words, b.words) and np.array_equal(a.earlier, b.earlier)


def test_sets_that_share_a_node_number(spark, monkeypatch):
    """First halves of digests that collide all the time change no component."""
    rows = [(i, prose(i % 9, 60) + (" tail" * (i % 3)), "s") for i in range(60)] + [(100 + i, prose(500 + i, 40), "s") for i in range(30)]
    docs = frame(spark, rows).repartition(4)
    want = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    full = jaccard_join._digest
    monkeypatch.setattr(jaccard_join, "_digest", lambda h: bytes([full(h)[0] % 5]) * 8 + full(h)[8:])
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == want


def test_rows_that_are_alike_do_not_share_a_range(spark):
    rows = [(5, "same text here", "s")] * 600 + [(i, prose(i, 9), "s") for i in range(300)]
    out = sharding.shard_by_bytes(frame(spark, rows).repartition(6), 24, ranges=12).collect()
    assert len(out) == 900
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(24)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert all(abs(sum(r.size for r in v) - total / 24) <= max(r.size for r in out) for v in by.values())


def test_chat_of_extra_columns_and_a_very_long_text(spark):
    long_text = "[INST] \\ </s> word " * 200_000
    turns = spark.createDataFrame([(1, 0, "user", "hi", 5, "x", [1]), (1, 1, "assistant", long_text, 5, "x", [1]), (None, 0, "user", None, 5, "x", None)],
                                  "conv_id long, turn long, role string, text string, segment int, formatted string, loss_spans array<int>")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert set(got) == {1, None} and got[1].loss_chars == len(long_text) and got[1].n_turns == 2 and got[None].loss_chars == 0


def test_rounding_keeps_mass_and_expectation():
    """Pivotal rounding: whole copies but for one row, total mass kept, and each row taken as
    often as its probability says."""
    rng = random.Random(3)
    p0, size = [rng.random() for _ in range(7)] + [0.0, 1.0], [rng.randrange(1, 9) for _ in range(9)]
    mean, rounds = np.zeros(9), 6000
    for n in range(rounds):
        p = list(p0)
        held = mixing.pivot(p, size, random.Random(n))
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != held)
        assert sum(a * b for a, b in zip(p, size)) == pytest.approx(sum(a * b for a, b in zip(p0, size)))
        mean += p
    assert np.abs(mean / rounds - p0).max() < 5 * 0.5 / rounds ** 0.5


def test_trimmed_functions_do_what_they_wrap():
    assert list(common.trimmed(_twice)([1, 2])) == [1, 1, 2, 2]
    assert common.trimmed(lambda a: a + 1)(1) == 2 and common.trimmed(lambda a, b: a + b)(1, 2) == 3
    with pytest.raises(ZeroDivisionError):
        common.trimmed(lambda a: a // 0)(1)


def _twice(items):
    for x in items:
        yield x
        yield x


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, label string, keep_id long, Bucket int"


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and extra columns pass every stage; all
    but the last return the input's columns, and what goes is what a stage rejects."""
    clean = prose(1, 400)
    rows = [(i, t, None, s, None, "x", 1, 2) for i, t, s in odd_rows()]
    rows += [(50 + i, prose(60 + i, 300), "en", f"s{i % 3}", 9, None, None, None) for i in range(12)] + [(90, clean, "en", "s1", 1, "a", 0, 0)] * 3
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 3:
            assert after.columns == docs.columns and after.filter("doc_id between 50 and 61").count() == 12
        docs = after
    assert docs.count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOCUMENTS)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.count() == 0
