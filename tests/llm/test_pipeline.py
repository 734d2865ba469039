"""The corpus pipeline, stage by stage, against plain Python."""
import collections
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from hirestream.llm import bpe, mixing
from hirestream.llm.queries import tokenizer_path
from test_llm_operators import brute_stats, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        got = stage(spark, docs, SF)
        columns = got.columns
        got.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after, columns))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_return_documents(spark, stages):
    given = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert len(stages) == 5 and all(columns == given for *_, columns in stages[:-1])


def test_quality_keeps_what_breaks_no_rule(stages):
    _, before, after, _ = stages[0]
    want = set()
    for i, t in texts(before).items():
        n, chars, symbols, dup, repeat = brute_stats(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        if n >= 50 and 100 * repeat <= 50 * n and 10 * symbols <= n and 3 * dup <= lines and 2 * n <= chars <= 20 * n:
            want.add(i)
    assert set(texts(after)) == want and 0 < len(want) < before.count()


def test_exact_copies_keep_the_smallest_id(stages):
    _, before, after, _ = stages[1]
    first = {}
    for i, t in sorted(texts(before).items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert set(texts(after)) == set(first.values())


def test_near_copies_keep_the_smallest_id(stages):
    _, before, after, _ = stages[2]
    sets = sorted((i, shingles(t)) for i, t in texts(before).items())
    group = {i: i for i, _ in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                group[q] = p
    assert set(texts(after)) == {i for i in group if root(i) == i}


def test_mix_takes_rows_as_planned(stages):
    _, before, after, _ = stages[3]
    plan = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.size and r.copies}
    assert collections.Counter(r.doc_id for r in after.collect()) == collections.Counter(plan)


def test_bpe_of_the_mix(spark, stages):
    _, before, after, _ = stages[4]
    t = bpe.open_tokenizer(bpe.read_tokenizer(tokenizer_path()))
    want = []
    for r in before.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_run_is_its_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][2].collect()))
