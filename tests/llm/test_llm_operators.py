"""Training-data operators against brute force, on small tables with odd rows."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirestream.llm import (bpe, chat, components, exact_dedup, jaccard_join, mixing, packing, quality, sharding,
                            substring_dedup, toxicity)
from hirestream.llm.queries import QUERIES, tokenizer_path
from hirestream.llm.shingles import sliding_min
from hirestream.llm.template import Escaper, TemplateError, compile_template, fold, filters, parse

SF = "/root/testdata/sf0.001"
#: Extra columns are named like columns that the operators use themselves.
SCHEMA = ("doc_id long, text string, source string, keep_id long, kept string, size string, block string, node string, "
          "h string, n long, bucket string, ids string, label string, content_hash string, row_key string, copies string")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", "x", "x", "x", "x", 1, "x", "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    a, b = prose(1, 120), prose(2, 90)
    return [(5, a, "s1"), (3, a, "s1"), (9, a.replace(" ", "\t\n", 3), None), (9, a.replace(" ", "\t\n", 3), None),
            (1, None, "s2"), (2, "", "s2"), (4, "   \n", None), (None, b, "s3"), (8, b, "s3"), (None, None, None),
            (6, "one two", "s1"), (7, "One two", "s1"), (10, "<|endoftext|> Ünï İstanbul's ΑΣ  x y 日本 'll", "s2"),
            (11, prose(3, 30000), "s1"), (12, b + " tail words " + a, "s2"), (13, "x" * 5000, "s1")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# ---------------------------------------------------------------- exact dedup
def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()


def expected_groups(rows):
    by = collections.defaultdict(list)
    for i, t, _ in rows:
        by[norm(t)].append(i)
    out = []
    for text, ids in by.items():
        known = [i for i in ids if i is not None]
        keep, first = (min(known) if known else None), True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text).hexdigest()))
            first = first and i != keep
    return sorted(out, key=str)


def test_exact_dedup_matches_brute_force(odd):
    assert sorted(map(tuple, exact_dedup.exact_dedup(odd).collect()), key=str) == expected_groups(odd_rows())


def test_exact_dedup_tells_colliding_hashes_apart(odd):
    weak = lambda c: F.unhex(F.md5((F.length(c) % 3).cast("string").cast("binary")))
    got = exact_dedup.exact_dedup(odd, content_hash=weak).collect()
    assert sorted(map(tuple, got), key=str) == expected_groups(odd_rows())


def test_exact_dedup_keeps_one_whole_row_per_group(odd, none):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    want = sorted(((k, s) for _, k, _, stays, s in expected_groups(odd_rows()) if stays), key=str)
    got = sorted(((r.doc_id, hashlib.sha256(norm(r.text)).hexdigest()) for r in kept.collect()), key=str)
    assert got == want
    assert exact_dedup.exact_dedup(none).collect() == [] and exact_dedup.keep_first(none).collect() == []


def test_kept_rows_of_colliding_hashes(odd):
    want = sorted(((k, s) for _, k, _, stays, s in expected_groups(odd_rows()) if stays), key=str)
    weak = lambda c: F.unhex(F.md5((F.length(c) % 3).cast("string").cast("binary")))
    kept = exact_dedup.keep_first(odd, content_hash=weak)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, hashlib.sha256(norm(r.text)).hexdigest()) for r in kept.collect()), key=str) == want


# ---------------------------------------------------------------- sharding
@pytest.mark.parametrize("ranges", [1, 5])
def test_shards_are_contiguous_balanced_and_gapless(odd, ranges):
    got = sharding.shard_by_bytes(odd, 4, ranges=ranges).collect()
    assert len(got) == len(odd_rows())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.prefix)
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in order]
    assert ids == sorted(ids) and [r.shard for r in order] == sorted(r.shard for r in order)
    before = 0
    for r in order:
        assert r.prefix == before
        before += r.size
    largest = max(r.size for r in got)
    for s in {r.shard for r in got}:
        rows = [r for r in order if r.shard == s]
        assert [r.slot for r in rows] == list(range(len(rows)))
        assert sum(r.size for r in rows) <= before / 4 + largest


def test_shards_of_many_documents_are_near_equal(spark, none):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 97).cast("int")).alias("text"))
    sizes = collections.Counter()
    for r in sharding.shard_by_bytes(docs, 24, ranges=7).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * 105
    assert sharding.shard_by_bytes(none, 24).collect() == []


# ---------------------------------------------------------------- mixing
def expected_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(capped.values()), [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s: 3.0 * sizes[s] for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(i, rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    rows += [(1000, prose(5, 4), "tiny"), (1001, None, "empty")]
    got = mixing.mix(frame(spark, rows), per_bucket=50, fan_in=3).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = expected_targets(dict(sizes))
    texts = {i: t for i, t, _ in rows}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").split())
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_mix_does_not_depend_on_partitions(spark):
    rows = [(i, prose(i, i % 40), f"s{i % 3}") for i in range(300)] + [(5, prose(5, 5), "s2")] * 3
    first = mixing.mix(frame(spark, rows).repartition(2), per_bucket=40)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(9), per_bucket=40)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_taken_rows_are_the_mix(spark, odd, none):
    want = collections.Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id, r.source] += r.copies * (r.size > 0)
    rows = mixing.take_mix(odd)
    assert rows.columns == odd.columns
    got = collections.Counter((r.doc_id, r.source) for r in rows.collect())
    assert got == collections.Counter({k: v for k, v in want.items() if v})
    assert mixing.mix(none).collect() == [] and mixing.take_mix(none).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 50)), max_size=30))
def test_pivot_keeps_the_mass(pairs):
    p, size = [x for x, _ in pairs], [n for _, n in pairs]
    mass = sum(a * b for a, b in zip(p, size))
    held = mixing.pivot(p, size, random.Random(1))
    assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != held)
    assert sum(a * b for a, b in zip(p, size)) == pytest.approx(mass, abs=1e-5)


# ---------------------------------------------------------------- quality
def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cov = {i + k for i in range(len(w) - 2) if win[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cov)


def test_quality_statistics_and_verdict(spark, odd):
    extra = [(20, "a b c " * 40, "s"), (21, prose(9, 80) + " ***" * 20, "s"), (22, (prose(8, 12) + "\n") * 9, "s"), (23, prose(7, 60), "s")]
    rows = odd_rows() + extra
    got = quality.quality(frame(spark, rows), stats=True).collect()
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    assert len(got) == len(rows)
    for r in got:
        stats = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert stats in [brute_stats(t) for t in texts[r.doc_id]]
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and not (base and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert 23 in kept and not kept & {20, 21, 22}


def test_quality_verdict_does_not_depend_on_the_order(odd, none):
    rules = list(quality.RULES)
    one = quality.quality(odd, order=rules).select("doc_id", "kept").collect()
    two = quality.quality(odd, order=rules[::-1]).select("doc_id", "kept").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in one)
    assert quality.quality(none, stats=True).collect() == [] and quality.keep_good(none).collect() == []


def test_greedy_order_counts_what_is_left():
    # rule 0 rejects most but costs much; rule 2 rejects only what rule 1 rejects already
    assert quality.greedy_order({0b000: 10, 0b001: 50, 0b110: 30}, [10.0, 1.0, 1.0]) == [1, 0, 2]


# ---------------------------------------------------------------- chat
def test_template_language():
    p = compile_template("{% set n = 2 * 3 %}{{ n ~ '!' }}{% for m in ms -%}  {{ loop.index }}{{ m.a | upper }}"
                         "{% if loop.last %}.{% elif m.a == 'x' %}?{% else %},{% endif %}{%- endfor %}")
    assert p.render({"ms": [{"a": "x"}, {"a": "y"}, {"a": "z"}]})[0] == "6!1X?2Y,3Z."
    text, spans = compile_template("a{% generation %}{{ x }}{% endgeneration %}b").render({"x": "12"})
    assert (text, spans) == ("a12b", [(1, 3)])
    known = filters()
    assert fold(parse("{{ 'a' ~ 1 + 1 }}b{% if 1 > 2 %}c{% endif %}"), known) == fold(parse("a2b"), known)
    for bad in ("{{ x.__class__ }}", "{% for x in %}{% endfor %}", "{{ f() }}", "{% if x %}", "{{ x | open }}", "{% nope %}", "{{ x %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    assert compile_template("{{ x.upper }}").render({"x": "abc"})[0] == ""  # no attributes, keys only


@given(st.text(alphabet="<>s/[]INT\\ a", max_size=40))
def test_escapes_are_reversible(text):
    e = Escaper(chat.CONTROLS)
    assert e.unescape(e.escape(text)) == text
    assert list(chat.read_turns("<s>[INST]" + e.escape(text) + "[/INST]" + e.escape(text) + "</s>", e)) == [(text, text)]


@pytest.mark.parametrize("segment", [1, 1 << 20])
def test_conversations_are_read_back(spark, segment):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 2, "assistant", "b\\"), (1, 1, "user", None), (1, 3, None, "[x"),
            (2, 1, "assistant", "q"), (2, 1, "assistant", "q"), (None, None, "system", "s"), (3, 0, "assistant", "z" * 5000)]
    rows += [(7, i, ("user", "assistant")[i % 2], f"turn {i} <s>") for i in range(500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, segment_chars=segment)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    e = Escaper(chat.CONTROLS)
    for c, turns_ in by.items():
        turns_.sort()
        r = got[c]
        loss = "".join(x for *_, role, x in turns_ if role == "assistant")
        assert r.n_turns == len(turns_)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in turns_).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(f"<s>[INST]{e.escape(a)}[/INST]{e.escape(b)}</s>") for *_, a, b in turns_)
    assert chat.read_back(chat.format_conversations(turns.limit(0))).collect() == []


# ---------------------------------------------------------------- BPE
def test_bpe_equals_the_library(spark, odd, none):
    t = bpe.open_tokenizer(bpe.read_tokenizer(tokenizer_path()))
    weird = [(50, "a<|startoftext|>b  ć ́d e  f g\u0085h '̃s Don't 12.5€ ẞİ " + chr(0x1F600), "s")]
    rows = odd_rows() + weird
    for size in (200, 1 << 22):  # many blocks, one block
        back = bpe.decode(bpe.encode(frame(spark, rows).repartition(2).cache(), tokenizer_path(), block_bytes=size), bpe.piece_table(spark, tokenizer_path()))
        got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in back.collect()), key=str)
        want = []
        for i, text, _ in rows:
            ids = t.encode(text or "", add_special_tokens=False).ids
            want.append((i, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
        assert got == sorted(want, key=str)
    assert bpe.encode_digests(none, tokenizer_path()).collect() == []


# ---------------------------------------------------------------- packing
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_decreasing(lengths):
    rows, free = packing.best_fit_decreasing(lengths, 40), []
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    for n in sorted(lengths, reverse=True):  # plain search for the tightest row
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(40 - n)
    assert sorted(40 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_packed_rows_hold_everything(odd, none):
    packed = packing.pack_rows(odd, capacity=64)
    for r in packed.collect():
        assert len(r.ids) == len(r.positions) == 4 * 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        place = np.frombuffer(r.positions, "<u4")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert place[a:b].tolist() == list(range(b - a))
        assert not np.frombuffer(r.ids, "<u4")[r.n_tokens:].any()
    back = sorted(((r.doc_id, bytes(r.ids)) for r in packing.unpack_rows(packed).collect()), key=str)
    assert back == sorted(((i, packing.byte_ids(t).astype("<u4").tobytes()) for i, t, _ in odd_rows()), key=str)
    assert packing.pack_rows(none).collect() == []


# ---------------------------------------------------------------- substring dedup
def brute_removed(rows, window):
    last = (1 << 63) - 1
    words = [((last if i is None else i), i, (t or "").encode().split()) for i, t, _ in rows]
    first = {}
    for k, _, w in words:
        for s in range(len(w) - window + 1):
            x = tuple(w[s:s + window])
            first[x] = min(first.get(x, k), k)
    out = []
    for k, i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < k:
                gone.update(range(s, s + window))
        left = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(w) - len(left), b" ".join(left).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,anchor,vocabulary", [(5, 2, 6), (9, 8, 4), (50, 8, 400), (3, 8, 50)])
def test_substring_dedup_matches_brute_force(spark, window, anchor, vocabulary):
    rng = random.Random(window)
    rows = [(i, prose(rng.randrange(99), rng.randrange(0, 150), vocabulary), "s") for i in range(80)]
    passage = prose(1000, window + 4, vocabulary)
    rows += [(100 + i, prose(2000 + i, 20, vocabulary) + " " + passage + " " + prose(3000 + i, 9, vocabulary), "s") for i in range(40)]
    rows += odd_rows()[:-3]
    got = substring_dedup.remove_repeats(frame(spark, rows).repartition(4), window=window, anchor=anchor, block_bytes=3000)
    assert sorted(map(tuple, got.collect()), key=str) == brute_removed(rows, window)


def test_rows_without_an_id_are_dealt_over_blocks(spark):
    passage = prose(77, 12)
    rows = [(None, prose(i, 20) + " " + passage, "s") for i in range(60)] + [(5, passage, "s")]
    docs = frame(spark, rows).repartition(3)
    assert substring_dedup.dealt(docs, "doc_id", "text", 8).filter("doc_id is null").select("block").distinct().count() == 8
    got = substring_dedup.remove_repeats(docs, window=9, block_bytes=1000)
    assert sorted(map(tuple, got.collect()), key=str) == brute_removed(rows, 9)


def test_substring_dedup_of_nothing(none):
    assert substring_dedup.remove_repeats(none).collect() == []


@given(st.lists(st.integers(0, 99), max_size=60), st.integers(1, 20))
def test_sliding_min(x, size):
    assert sliding_min(np.array(x, np.int64), size).tolist() == [min(x[i:i + size]) for i in range(len(x) - size + 1)]


# ---------------------------------------------------------------- Jaccard join
def shingles(t):
    w = tuple((t or "").encode().lower().split())
    return frozenset(w[i:i + 5] for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([w] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, _ in rows]
    group = list(range(len(sets)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                group[root(a)] = root(b)
    last = (1 << 63) - 1
    least = {}
    for n, (i, _) in enumerate(sets):
        least[root(n)] = min(least.get(root(n), last), last if i is None else i)
    return sorted(((i, len(s), (least[root(n)] if least[root(n)] != last else None)) for n, (i, s) in enumerate(sets)), key=str)


def near_rows(seed, n=140):
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, max(2, len(w) // 14))):
                k = rng.randrange(len(w) + 1)
                rng.choice([lambda: w.insert(k, f"n{rng.randrange(9)}"), lambda: w.pop(k % len(w)) if len(w) > 1 else None,
                            lambda: w.__setitem__(k % len(w), f"r{rng.randrange(9)}")])()
        else:
            w = prose(seed * 1000 + i, rng.choice([1, 3, 5, 6, 7, 9, 12, 30, 63, 64, 65, 200])).split()
        texts.append(" ".join(w))
        rows.append((rng.randrange(10 ** 6), texts[-1].upper() if rng.random() < 0.1 else texts[-1], "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed):
    rows = near_rows(seed) + odd_rows()
    got = jaccard_join.jaccard_components(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_holders_of_a_shingle_meet_across_labels_only(spark):
    rng = random.Random(4)
    rows = [(n, 9, e, 0, n % k) for e, k in ((1, 1), (2, 2), (3, 3), (4, 7), (5, 8), (6, 40)) for n in range(40) if rng.random() < 0.8]
    made = jaccard_join.crossing(spark.createDataFrame(rows, "node long, size long, element long, place long, label long")).collect()
    got = sorted((r.element, min(r.node, r.node_y), max(r.node, r.node_y)) for r in made)
    assert got == sorted((x[2], x[0], y[0]) for x in rows for y in rows if x[2] == y[2] and x[0] < y[0] and x[4] != y[4])


def test_nodes_without_an_id_read_their_own_text_once(spark):
    last = (1 << 63) - 1
    texts = spark.createDataFrame([(last, f"text {i % 30}") for i in range(90)], "key long, text string").withColumn("row_key", F.xxhash64("text"))
    asked = texts.distinct().select(F.col("row_key").alias("node"), F.col("key").alias("rep"), F.col("row_key").alias("rep_key"))
    got = jaccard_join._texts_of_nodes(asked, texts)
    assert got.count() == 30 and got.filter(F.col("node") != F.xxhash64("text")).isEmpty()
    rows = [(None, t, s) for _, t, s in near_rows(3, 60)] + [(None, t, s) for _, t, s in near_rows(3, 60)]
    found = jaccard_join.jaccard_components(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, found), key=str) == brute_components(rows)


def test_rows_without_words_stay_whatever_else_repeats(spark):
    empty = [(None, None, "s"), (None, None, "s"), (4, " ", "s"), (4, " ", "s")]
    for rows in (empty, empty + [(9, "one two three", "s")] * 2):
        kept = jaccard_join.keep_representatives(frame(spark, rows)).collect()
        want = [r[:2] for r in empty] + list({r[:2] for r in rows[4:]})
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)


def test_representatives_stay(spark, odd, none):
    kept = jaccard_join.keep_representatives(odd)
    assert kept.columns == odd.columns
    # of the rows with id 9, 12 and so on one text is left each; empty sets all stay
    want = {i for i, _, c in brute_components(odd_rows()) if i == c}
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)
    assert jaccard_join.jaccard_components(none).collect() == [] and jaccard_join.keep_representatives(none).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.integers(3, 300), st.floats(0, 1), st.integers(0, 10 ** 6))
def test_similar_sets_share_enough_signatures(size, mix, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2 ** 64, size + size // 2 + 4, dtype=np.uint64)
    a = np.unique(pool[:size])
    drop = int(mix * (len(a) // 4))
    b = a[drop:]
    room = int(len(b) / 0.75 - len(a)) if len(b) / 0.75 > len(a) else 0
    b = np.unique(np.concatenate((b, pool[size:size + max(0, room)])))
    common = len(np.intersect1d(a, b))
    if 100 * common < 75 * (len(a) + len(b) - common) or np.array_equal(a, b):
        return
    x, y = jaccard_join.signatures(a), jaccard_join.signatures(b)
    shared = {}
    for f, need, s in x:
        for g, need2, s2 in y:
            if f == g:
                shared[f] = (len(np.intersect1d(s, s2)), need, need2)
    assert any(n >= max(need, need2) for n, need, need2 in shared.values())


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 180)] + [(5, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)}


# ---------------------------------------------------------------- toxicity
def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet")
    cats = {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    seen = labels.filter(F.col("doc_id") % 2 == 0)
    scored = toxicity.predict(docs, toxicity.train(docs, seen, cats), list(cats))
    assert scored.count() == docs.count()
    held = scored.join(labels.filter(F.col("doc_id") % 2 == 1).withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    right = sum(r.toxic == (r.is_toxic == 1) for r in held)
    assert right / len(held) > 0.95
    caught = [r.toxic for r in held if r.is_toxic == 1]
    assert sum(caught) / len(caught) >= 0.9


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, None), (3, 0, 1), (6, 1, 0), (3, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    cats = {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    got = toxicity.score_documents(odd, labels, cats).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.p_toxic <= 1 for r in got)
    assert toxicity.score_documents(none, labels, cats).collect() == []
    assert not any(r.toxic for r in toxicity.score_documents(odd, labels.limit(0), cats).collect())


def test_later_links_see_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 1 << toxicity.BITS, 20)).astype(np.int32) for _ in range(300)]
    first = rng.integers(0, 2, 300)
    docs = [np.unique(np.append(d, 7)).astype(np.int32) if y else d for d, y in zip(docs, first)]
    at, start = toxicity._ragged(docs)
    chain, oof = toxicity.fit_chain(at, start, np.stack([first, first], 1), np.arange(300) % 3)
    assert ((oof[:, 0] > 0.5) == first).mean() > 0.95 and chain[1].earlier[0] > 0


# ---------------------------------------------------------------- queries
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_whole(spark, name):
    df = QUERIES[name](spark, SF)
    n = df.count()
    assert n > 0
    if "doc_id" in df.columns and "item_id" not in df.columns:  # a search has the best documents per item
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()
