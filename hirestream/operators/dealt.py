"""Phrases of documents dealt by their hash in packed form, so that what is known of a phrase
(how many documents have it, its landed class) is found without a shuffled row per phrase.

Documents lie in blocks (by the hash of their id, of bounded size). A block names its distinct
phrases once, as one binary value per bucket of phrases; a bucket answers in the order in
which it was asked, and the block's documents, cut up again, take the answers by position.
Rows of one id share a block.
"""
from __future__ import annotations

import decimal
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import naive_canonical_text
from ..session import spooled, spread
from .batches import small_batches, string_lists

#: Text of a block and of a bucket, and phrases that a task counts before it hands them on.
BLOCK_BYTES, MOST_HELD = 4 << 20, 1_000_000
#: Between a pool and a phrase, and between the phrases of a document.
SEP, BETWEEN = "\x1f", "\x00"

_ASKED = "block long, bucket long, lengths binary, data binary, n binary"


def pieces(df: DataFrame, text_col: str) -> int:
    """Blocks, or buckets, for the texts of a table."""
    size = df.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) + 64)).first()[0] or 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BLOCK_BYTES))


def _zipped(data: bytes) -> bytes:
    """Packed values compress to about half of what the shuffle's own codec makes of them."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """Lengths, offsets and bytes of an array of strings."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    return np.diff(ends).astype(np.int32), ends, memoryview(strings.buffers()[2] or b"")


def _unpacked(lengths: pa.ChunkedArray | pa.Array, data: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, list[int]]:
    """All strings of some packed values, and how many each value has; a length of -1 is null."""
    sizes = [np.frombuffer(_unzipped(x), np.int32) for x in lengths.to_pylist()]
    flat = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
    ends = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(np.maximum(flat, 0), out=ends[1:])
    bits = pa.array(flat >= 0).buffers()[1] if len(flat) and flat.min() < 0 else None
    return (pa.LargeStringArray.from_buffers(len(flat), pa.py_buffer(ends), pa.py_buffer(b"".join(map(_unzipped, data.to_pylist()))), bits),
            [len(s) for s in sizes])


def _plain(strings: pa.Array) -> list:
    """As ``to_pylist``, which would make an object of Arrow's for each value first."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _order(keys: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of ``keys`` in order, and the order."""
    of = (pd.util.hash_array(np.array(keys, object), categorize=False) % np.uint64(buckets)).astype(np.int64) if keys else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    return of[order], order


def _asked(keys: list[str], n: np.ndarray, buckets: int, block: int = 0) -> pa.Table:
    """``keys`` (with a number each) as one row per bucket."""
    of, order = _order(keys, buckets)
    lengths, ends, data = _packed(pa.array(keys, pa.string()).take(pa.array(order)))
    n = n.astype(np.int64)[order]
    starts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
    cuts = list(zip(starts, [*starts[1:], len(of)]))
    return pa.table([pa.array([block] * len(cuts), pa.int64()), pa.array([int(of[a]) for a, _ in cuts], pa.int64()),
                     pa.array([_zipped(lengths[a:b].tobytes()) for a, b in cuts], pa.binary()), pa.array([_zipped(bytes(data[ends[a]:ends[b]])) for a, b in cuts], pa.binary()),
                     pa.array([_zipped(n[a:b].tobytes()) for a, b in cuts], pa.binary())], names=["block", "bucket", "lengths", "data", "n"])


def _totals(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of a bucket, their totals, the key number of each that was asked, and how many each row asked."""
    keys, sizes = _unpacked(table.column("lengths"), table.column("data"))
    coded, n = keys.dictionary_encode(), np.frombuffer(b"".join(map(_unzipped, table.column("n").to_pylist())), np.int64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, np.bincount(index, weights=n, minlength=len(coded.dictionary)).astype(np.int64), index, sizes


def pool_prefix(pool: str | None) -> str:
    return SEP if pool is None else "p" + pool + SEP


def document_frequency(docs: DataFrame, phrases: Callable[[bytes | None], list[str]], kept: Callable[[list[str]], list[bool] | None]) -> DataFrame:
    """``pool, phrase, n_docs``: rows of ``docs`` (``pool, text``) whose text has the phrase."""
    buckets = pieces(docs, "text")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, Counter] = {}
        held = 0

        def handed_on() -> list[pa.RecordBatch]:
            keys = [k for pool, own in counts.items() for pre in (pool_prefix(pool),) for k in map(pre.__add__, own)]
            n = np.fromiter((n for own in counts.values() for n in own.values()), np.int64, len(keys))
            return _asked(keys, n, buckets).to_batches(4096)

        for part in small_batches(batches):
            for pool, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                own = counts.setdefault(pool, Counter())
                held -= len(own)
                own.update(set(phrases(text)))
                held += len(own)
            if held > MOST_HELD:
                yield from handed_on()
                counts, held = {}, 0
        yield from handed_on()

    def count(table: pa.Table) -> pa.Table:
        keys, n, _, _ = _totals(table)
        cut = pc.list_flatten(pc.split_pattern(keys, SEP, max_splits=1, reverse=True))
        pool, phrase = cut.take(pa.array(np.arange(0, len(cut), 2))), cut.take(pa.array(np.arange(1, len(cut), 2)))
        pool = pc.if_else(pc.equal(pool, ""), pa.scalar(None, pool.type), pc.utf8_slice_codeunits(pool, 1))
        out = pa.table([pool.cast(pa.string()), phrase.cast(pa.string()), pa.array(n)], names=["pool", "phrase", "n_docs"])
        keep = kept(_plain(phrase))
        return out if keep is None else out.filter(pa.array(keep, pa.bool_()))

    slim = spread(docs.select(F.col("pool").cast("string").alias("pool"), F.col("text").cast("string").alias("text")))
    asked = slim.mapInArrow(deal, _ASKED)
    return asked.groupBy("bucket").applyInArrow(count, "pool string, phrase string, n_docs long")


# ------------------------------------------------------- answers by position
def _in_order(keys: list[str], buckets: int, *answers: dict[int, list]) -> Iterator[tuple]:
    """``keys`` with what the buckets answered (``answers`` by bucket, each as long as it was asked)."""
    of, order = _order(keys, buckets)
    numbers = np.unique(of).tolist()
    return zip([keys[i] for i in order.tolist()], *[[x for b in numbers for x in said[b]] for said in answers])


def _by_document(table: pa.Table, cut: Callable[[object], list[str]]) -> list[tuple]:
    """``id, pool, n_docs`` and counted phrases of the documents of a block in a fixed order; rows
    of one id and pool are one document."""
    found: dict[tuple, Counter] = {}
    rows = zip(*(table.column(c).to_pylist() for c in ("doc_id", "pool", "n_docs")), table.column("text").cast(pa.binary()).to_pylist())
    for doc_id, pool, n_docs, text in sorted(rows, key=lambda r: tuple((v is None, 0 if v is None else v) for v in (r[0], r[1], r[3]))):
        found.setdefault((doc_id, pool, n_docs), Counter()).update(cut(text))
    return [(*k, own) for k, own in found.items()]


class Scores(dict):
    """K3's ``tf * (ln((1 + N) / (1 + df)) + 1)`` with nine places, half up as Spark rounds, by
    ``df, tf`` for a pool of ``N`` documents."""

    def __init__(self, n_docs: int):
        super().__init__()
        self.n_docs = n_docs

    def __missing__(self, key: tuple[int, int]) -> float:
        df, tf = key
        if len(self) > 500_000:
            self.clear()
        exact = decimal.Decimal(repr(tf * (math.log((1.0 + self.n_docs) / (1.0 + df)) + 1.0)))
        self[key] = found = float(exact.quantize(decimal.Decimal("1e-9"), decimal.ROUND_HALF_UP))
        return found


def scored(docs: DataFrame, pool_sizes: DataFrame, phrases: Callable[[bytes | None], list[str]], finish: Callable[[list[tuple]], pa.Table],
           columns: Callable[[StructType], StructType]) -> DataFrame:
    """What ``finish`` makes of the documents of each block: ``doc_id, pool, {phrase: (tf, score)}``
    each, those of one id side by side. ``columns`` makes its schema from that of ``docs``
    (``doc_id, pool, text``). A document frequency counts ids and not rows; a null pool has no scores."""
    blocks = buckets = pieces(docs, "text")
    # the pool is joined by its value and keeps its type; the sizes are written first, or Spark would
    # shuffle the texts by pool before it knows how few pools there are
    slim = (docs.select("doc_id", "pool", F.col("text").cast("string").alias("text")).join(spooled(pool_sizes.select("pool", "n_docs")), "pool")
                .select("doc_id", "pool", "n_docs", "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")))
    schema = columns(StructType([slim.schema["doc_id"], slim.schema["pool"]]))
    values: dict[int, Scores] = {}  # kept by a task for all its blocks

    def counted(found: list[tuple]) -> dict[str, Counter]:
        counts: dict[str, Counter] = {}
        for _, pool, _, own in found:
            counts.setdefault(pool_prefix(str(pool)), Counter()).update(own.keys())
        return counts

    def keys_of(counts: dict[str, Counter]) -> list[str]:
        return [k for pre, own in counts.items() for k in map(pre.__add__, own)]

    def ask(table: pa.Table) -> pa.Table:
        counts = counted(_by_document(table, phrases))
        keys = keys_of(counts)
        n = np.fromiter((n for own in counts.values() for n in own.values()), np.int64, len(keys))
        return _asked(keys, n, buckets, table.column("block")[0].as_py())

    def answer(table: pa.Table) -> pa.Table:
        _, totals, index, sizes = _totals(table)
        said = np.split(totals[index], np.cumsum(sizes)[:-1])
        return pa.table([table.column("block"), table.column("bucket"), pa.array([_zipped(s.tobytes()) for s in said], pa.binary())], names=["block", "bucket", "df"])

    def score(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finish([])
        found = _by_document(table, phrases)
        counts, out, at = counted(found), [], 0
        of, order = _order(keys_of(counts), buckets)
        answers = {b: np.frombuffer(_unzipped(x), np.int64) for b, x in zip(said.column("bucket").to_pylist(), said.column("df").to_pylist())}
        df = np.zeros(len(order), np.int64)
        df[order] = np.concatenate([answers[b] for b in np.unique(of).tolist()]) if len(order) else df
        frequencies = {}
        for pre, own in counts.items():
            frequencies[pre] = dict(zip(own, df[at:at + len(own)].tolist()))
            at += len(own)
        for doc_id, pool, n_docs, own in found:
            known, value = frequencies[pool_prefix(str(pool))], values.get(n_docs)
            if value is None:
                if len(values) > 1000:
                    values.clear()
                value = values[n_docs] = Scores(n_docs)
            out.append((doc_id, pool, {p: (tf, value[known[p], tf]) for p, tf in own.items()}))
        return finish(out)

    asked = slim.groupBy("block").applyInArrow(ask, _ASKED)
    said = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, df binary")
    return slim.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(score, schema)


#: Stands for a canonical form that is the keyword itself, and before one that begins with it.
_SAME = "\x01"


def _marked(canonical: pa.Array, keyword: pa.Array) -> pa.Array:
    escaped = pc.if_else(pc.starts_with(canonical, _SAME), pc.binary_join_element_wise(pa.scalar(_SAME), canonical, ""), canonical)
    return pc.if_else(pc.equal(canonical, keyword), _SAME, escaped)


def _values(strings: pa.Array, cuts: list[tuple[int, int]]) -> tuple[pa.Array, pa.Array]:
    """Runs of an array of strings as packed values; a length of -1 is null."""
    lengths, ends, data = _packed(pa.array(strings.fill_null("")))
    lengths = np.where(strings.is_valid().to_numpy(zero_copy_only=False), lengths, -1).astype(np.int32)
    return (pa.array([_zipped(lengths[a:b].tobytes()) for a, b in cuts], pa.binary()),
            pa.array([_zipped(bytes(data[ends[a]:ends[b]])) for a, b in cuts], pa.binary()))


def _least(answers: pa.Table) -> pa.Table:
    """Of the answers to a keyword the one with the smallest category and then canonical form, null before all."""
    plain = pc.if_else(pc.equal(answers.column("canonical"), _SAME), answers.column("keyword"), answers.column("canonical"))
    order = pc.sort_indices(answers.set_column(2, "canonical", plain), [(c, "ascending") for c in answers.column_names], null_placement="at_start")
    answers = answers.take(order)
    keys = answers.column("keyword").combine_chunks()
    first = np.concatenate([[True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
    return answers.filter(pa.array(first))


def classified(sets: DataFrame, classification: DataFrame, phrases: Callable[[bytes | None], list[str]],
               kept: Callable[[list[str]], list[bool] | None], *, brief: bool = False) -> DataFrame:
    """``pool, doc_id, phrases, canonicals, categories`` of ``sets`` (``pool, doc_id`` and ``phrases`` or
    their ``text``) after R17, one row per id and pool: the classes of the answer that names a
    phrase (of several, the smallest category and canonical form), else ``hard_skill`` and the naive
    canonical form. If ``brief``, a canonical form that is the phrase itself is null."""
    given = "phrases" in sets.columns
    joined = sets.select("pool", "doc_id", (F.array_join("phrases", BETWEEN) if given else F.col("text").cast("string")).alias("text"))
    blocks = buckets = pieces(joined, "text")
    slim = joined.select("doc_id", "pool", F.lit(0).alias("n_docs"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))

    def cut(text: bytes | None) -> list[str]:
        all_ = list(dict.fromkeys(phrases(text))) if not given else text.decode().split(BETWEEN) if text else []
        keep = kept(all_)
        return all_ if keep is None else [p for p, k in zip(all_, keep) if k]

    def keys_of(found: list[tuple]) -> list[str]:
        return list(dict.fromkeys(p for *_, own in found for p in own))

    def ask(table: pa.Table) -> pa.Table:
        keys = keys_of(_by_document(table, cut))
        return _asked(keys, np.zeros(len(keys)), buckets, table.column("block")[0].as_py()).drop_columns("n")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of the answers: what a bucket gets of a batch is one row
            of, order = _order(_plain(batch.column(0)), buckets)
            starts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
            cuts = list(zip(starts, [*starts[1:], len(of)]))
            keyword, category, canonical = batch.take(pa.array(order)).columns
            packed = [x for c in (keyword, category, _marked(canonical, keyword)) for x in _values(c, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(of[starts]), *packed], names=["bucket", "kl", "kd", "cl", "cd", "nl", "nd"])

    def answer(asked: pa.Table, said: pa.Table) -> pa.Table:
        keys, sizes = _unpacked(asked.column("lengths"), asked.column("data"))
        flat = pa.table([_unpacked(said.column(f"{c}l"), said.column(f"{c}d"))[0].cast(pa.string()) for c in "kcn"], names=["keyword", "category", "canonical"])
        if len(flat) != pc.count_distinct(flat.column("keyword")).as_py():
            flat = _least(flat)
        flat = flat.combine_chunks()
        at = pc.index_in(keys.cast(pa.string()), value_set=flat.column("keyword").combine_chunks())
        places = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        cuts = list(zip(places, places[1:]))
        out = [x for c in ("category", "canonical") for x in _values(flat.column(c).combine_chunks().take(at), cuts)]
        return pa.table([asked.column("block"), asked.column("bucket"), *out], names=["block", "bucket", "cl", "cd", "nl", "nd"])

    def attach(table: pa.Table, said: pa.Table) -> pa.Table:
        found, stems = _by_document(table, cut) if table.num_rows else [], {}
        at, both = said.column("bucket").to_pylist(), []
        for a, b in (("cl", "cd"), ("nl", "nd")):
            values, sizes = _unpacked(said.column(a), said.column(b))
            ends, values = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist(), _plain(values)
            both.append({k: values[x:y] for k, x, y in zip(at, ends, ends[1:])})
        classes = {}
        for p, category, canonical in _in_order(keys_of(found), buckets, *both):
            form = naive_canonical_text(p, stems) if canonical is None else p if canonical == _SAME else canonical.removeprefix(_SAME)
            classes[p] = category or "hard_skill", None if brief and form == p else form
        rows = [list(own) for *_, own in found]
        return pa.table([pa.array([r[1] for r in found], table.schema.field("pool").type), pa.array([r[0] for r in found], table.schema.field("doc_id").type),
                         string_lists(rows), string_lists([[classes[p][1] for p in r] for r in rows]), string_lists([[classes[p][0] for p in r] for r in rows])],
                        names=["pool", "doc_id", "phrases", "canonicals", "categories"])

    asked = slim.groupBy("block").applyInArrow(ask, "block long, bucket long, lengths binary, data binary")
    dealt = (classification.select(*[F.col(c).cast("string").alias(c) for c in ("keyword", "category", "canonical")])
             .mapInArrow(deal, "bucket long, kl binary, kd binary, cl binary, cd binary, nl binary, nd binary"))
    said = asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(answer, "block long, bucket long, cl binary, cd binary, nl binary, nd binary")
    lists = "phrases array<string>, canonicals array<string>, categories array<string>"
    schema = StructType([slim.schema["pool"], slim.schema["doc_id"], *StructType.fromDDL(lists).fields])
    return slim.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(attach, schema)


def rows(values: list[tuple], schema: StructType) -> pa.Table:
    """Tuples as a table of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    types = to_arrow_schema(schema)
    return pa.table([pa.array(v, f.type) for v, f in zip(zip(*values) if values else [[]] * len(types), types)], schema=types)
