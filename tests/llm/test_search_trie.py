"""Ranked lexical search and the conversation trie against brute force, with odd rows."""
import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hirestream.llm import lexical_search, prefix_trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    texts = [(i, collections.Counter(terms(t))) for i, t in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    docs_n, all_terms = len(texts), sum(n for _, _, n in texts)
    df = collections.Counter(t for _, c, _ in texts for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, c, n in texts:
            m = 50 + 50 * n * docs_n // all_terms
            s = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                    for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


DOCS = [(1, "Alpha beta, ALPHA! gamma-7 _x_ Ünï 日本 x"), (2, None), (3, ""), (4, "?? -- \x00"), (5, "alpha"), (None, "alpha"), (6, "alpha"), (6, "alpha"),
        (7, "beta gamma 7 gamma"), (8, "alphabet alpha1 日本x"), (9, "alpha beta " * 3000 + "tail"), (-4, "İstanbul ÀB àb x x x"), (10, "it's it s")]
ITEMS = [(0, "alpha gamma 7 日本"), (1, None), (2, "!!!"), (None, "x ÀB"), (3, "beta"), (3, "it's beta"), (4, "nowhere"), (5, "alpha gamma 7 日本")]
EXTRA = ", n long, terms string, rank string, score string, item string"


def doc_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string" + EXTRA)


def item_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", "b", "c", "d") for i, t in rows], "item_id long, text string" + EXTRA)


@pytest.mark.parametrize("k,limit", [(50, 1 << 20), (3, 1 << 20), (50, 12)])
def test_search_matches_brute_force(spark, k, limit):
    got = lexical_search.rank_documents(doc_frame(spark, DOCS).repartition(3), item_frame(spark, ITEMS), k=k, max_term_bytes=limit)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(DOCS, ITEMS, k)


def test_search_over_many_documents_keeps_the_best(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(800)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(30)]
    got = lexical_search.rank_documents(doc_frame(spark, docs).repartition(5), item_frame(spark, items), k=7)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 7)


def test_best_settles_often():
    import numpy as np
    rng, best, all_ = random.Random(1), lexical_search.Best(4, 3), []
    for _ in range(50):
        rows = [(rng.randrange(4), rng.randrange(1, 9), rng.randrange(100)) for _ in range(20)]
        all_ += rows
        item, score, doc = (np.array(x) for x in zip(*rows))
        keep = score >= best.least[item]
        best.offer(item[keep], score[keep], doc[keep], np.zeros(keep.sum(), bool))
        best.settle()
    want = [sorted(((-s, d) for i, s, d in all_ if i == item))[:3] for item in range(4)]
    held = list(zip(*(x.tolist() for x in best.held[:3])))
    assert [[(-s, d) for i, s, d in held if i == item] for item in range(4)] == want


def test_search_of_empty_tables(spark):
    assert lexical_search.rank_documents(doc_frame(spark, []), item_frame(spark, ITEMS)).collect() == []
    assert lexical_search.rank_documents(doc_frame(spark, DOCS), item_frame(spark, [])).collect() == []


# ------------------------------------------------------------------------ trie
def rebuilt(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in by.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(convs):
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    rows = []
    for node, own in members.items():
        under = [n for n in members if n[:len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in under if n)
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(node))
        rows.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), kids[node], sum(not kids[n] for n in under), saved,
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def turns_frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "a", "b", 1) for c, t, r, x in rows],
                                 "conv_id long, turn long, role string, text string, head string, ids string, depth long")


def talk(seed, n, kinds):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        opening = rng.randrange(kinds)
        for t in range(rng.randrange(1, 7)):
            said = f"said {opening} {t}" if rng.random() < 0.8 else f"other {rng.randrange(3)} words here"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", said))
    return rows


ODD = [(0, 0, "user", "hi there"), (0, 1, "assistant", None), (0, None, "system", "first"), (1, 0, None, "hi there"), (1, 1, "user", ""),
       (2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, 0, "user", "lost"), (-1, 0, "user", "hi"), (-21, 5, "user", "hi"), (-41, 0, None, None),
       (45, 0, "user", "only"), (46, 0, "user", "only"), (47, 0, "user", "only"), (48, 0, "user", "only"), (20, 0, "a", "bc"), (21, 0, "ab", "c"),
       (60, 0, "user", "w " * 20000), (60, 1, "user", "x"), (61, 0, "user", "w " * 20000), (10 ** 15, 0, "user", "far")]


@pytest.mark.parametrize("rows,limit", [(ODD, 1 << 14), (ODD, 1), (talk(1, 120, 3), 1 << 14), (talk(1, 120, 3), 20), (talk(2, 150, 2), 1),
                                        ([(c, t, "user", f"same {t}") for c in range(40) for t in range(5)], 8)])
def test_trie_matches_brute_force(spark, rows, limit):
    seqs = prefix_trie.share_openings(prefix_trie.sequences(turns_frame(spark, rows).repartition(4)))
    got = prefix_trie.build_trie(seqs, container_turns=limit).drop("turn_id")
    assert sorted(map(tuple, got.collect()), key=str) == trie(rebuilt(rows))


def test_trie_keeps_turn_ids(spark):
    rows = talk(3, 30, 2)
    nodes = prefix_trie.build_trie(prefix_trie.sequences(turns_frame(spark, rows)), container_turns=10)
    assert nodes.filter("turn_id is null").count() == 1
    said = turns_frame(spark, rows).select(prefix_trie.turn_id(F.col("role"), F.col("text")).alias("turn_id")).distinct()
    assert nodes.filter("depth > 0").join(said, "turn_id", "left_anti").isEmpty()


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.build_trie(prefix_trie.share_openings(prefix_trie.sequences(turns_frame(spark, [])))).collect() == []


def test_turnless_conversations_are_at_the_root(spark):
    rows = [(c, 0, "user", "x") for c in (21, 22, 23, 24, 25)]
    got = prefix_trie.build_trie(prefix_trie.share_openings(prefix_trie.sequences(turns_frame(spark, rows)))).filter("depth = 0").first()
    ended = [c for c in (21, 22, 23, 24, 25) if zlib.crc32(str(c).encode()) % 4]
    assert ended and got["ends_sha256"] == hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()
