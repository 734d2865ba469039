"""Ranked lexical search: an Aho-Corasick scan of the documents, without an index of them.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, with
A-Z lower-cased. The terms of all items are the patterns of one automaton, each guarded
by a boundary on both sides; a document becomes its bytes with every other character as a
boundary, and one pass over it gives the frequencies of all terms of all items. The
automaton's outputs are term numbers, and a posting list of term -> items takes them to
items.

*First pass.* Per document: its number of terms, and the item terms in it with their
frequencies. It is written once; document frequencies and totals are counted from it.

*Second pass.* Scores of a batch are integer sums over the posting lists; a task keeps the
best ``k`` of every item and no more, then the best of all tasks are ranked.

What is broadcast is the terms of a block of items, of at most ``MAX_TERM_BYTES``; more
items are taken in more blocks, each with a scan of its own.

Defined results: null text has no terms; a null document id ranks after every id of equal
score; repeated rows are documents of their own; rows of one item id are one item; an item
without terms has no rows; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 50
MAX_TERM_BYTES = 8 << 20
CELLS = 1 << 19
SALTS = 64

#: Bytes of a text: letters in lower case, and a space for what is in no term.
FOLD = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms(text: Column) -> Column:
    """The terms of a text, in order and with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> list[list[tuple]]:
    """``(item_id, terms)`` in lists whose terms have about ``limit`` bytes; a list goes to
    every task, so it is the operator's unit of work."""
    found = (items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(terms(F.col(text_col))).alias("term"))
                  .distinct().groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    blocks, held = [[]], 0
    for row in found.orderBy("item_id").toLocalIterator():
        size = sum(len(t.encode()) + 2 for t in row["terms"])
        if held and held + size > limit:
            blocks.append([])
            held = 0
        blocks[-1].append((row["item_id"], row["terms"]))
        held += size
    return [b for b in blocks if b]


def _automaton(vocabulary: list[str]):
    import ahocorasick
    found = ahocorasick.Automaton()
    for n, t in enumerate(vocabulary):
        found.add_word(f" {t} ".encode().decode("latin-1"), n)
    found.make_automaton()
    return found


_SCANNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])


def scan(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs`` per row: the number of its terms, and those of the
    ``vocabulary`` (by place in it) with their frequencies."""
    spark = small_batches(docs.sparkSession)
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            automaton = automaton or _automaton(sent.value)
            ids, n, found, tfs = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                raw = b" " + (text or "").encode("utf-8", "surrogatepass").translate(FOLD) + b" "
                gap = np.frombuffer(raw, np.uint8) == 32
                n.append(int(np.count_nonzero(gap[:-1] & ~gap[1:])))
                seen = Counter(map(itemgetter(1), automaton.iter(raw.decode("latin-1"))))
                found.append(list(seen))
                tfs.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, f.type) for x, f in zip((n, found, tfs), list(_SCANNED)[1:]))], schema=_SCANNED)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def document_frequencies(scanned: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary of ``size`` terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "df": pa.array(df[at], pa.int64())})

    out = np.zeros(size, np.int64)
    for r in scanned.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Best:
    """The ``k`` best documents of every item, from candidates in any order."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # scores above 0 only
        self.held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        self.fresh: list = []
        self.n = 0

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        self.fresh.append((item, score, doc, null))
        self.n += len(item)
        if self.n > max(1 << 18, 2 * self.k * len(self.least)):
            self.settle()

    def settle(self) -> None:
        item, score, doc, null = (np.concatenate(x) for x in zip(self.held, *self.fresh))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
        keep = place < self.k
        self.held = [item[keep], score[order][keep], doc[order][keep], null[order][keep]]
        full = place == self.k - 1
        self.least[item[full]] = score[order][full]
        self.fresh, self.n = [], 0


_SCORED = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _score(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, weight, start, posting, docs_n, terms_n = sent.value
        items, lens = len(item_ids), np.diff(start)
        best, step = Best(items, k), max(1, CELLS // items)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids, rows = batch.column(0), batch.num_rows
                m = np.array([50 + 50 * n * docs_n // terms_n for n in batch.column(1).to_pylist()], np.int64)
                term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                row = np.repeat(np.arange(rows), batch.column(2).value_lengths().to_numpy())
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                n = lens[term]
                ends = np.cumsum(n)
                if not len(ends) or not ends[-1]:
                    continue
                to = posting[np.repeat(start[term] - ends + n, n) + np.arange(ends[-1])]
                score = np.zeros(rows * items, np.int64)
                np.add.at(score, np.repeat(row, n) * items + to, np.repeat(part, n))
                score = score.reshape(rows, items)
                who, item = np.nonzero(score >= best.least)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                best.offer(item, score[who, item], ids.fill_null(0).to_numpy()[who], null[who])
        best.settle()
        item, score, doc, null = best.held
        yield pa.RecordBatch.from_arrays([pa.array([item_ids[i] for i in item.tolist()], pa.int64()), pa.array(doc, pa.int64(), mask=null),
                                          pa.array(score, pa.int64())], schema=_SCORED)
    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", max_term_bytes: int = MAX_TERM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    found = [_rank_block(docs, block, k, id_col, text_col) for block in item_blocks(items, item_col, item_text_col, max_term_bytes)]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _rank_block(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, own in items for t in own})
    place = {t: n for n, t in enumerate(vocabulary)}
    scanned = written(scan(docs, vocabulary, id_col, text_col))
    total = scanned.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    docs_n, terms_n = total["docs"], total["terms"] or 1
    weight = np.array([floor(1000 * log((2 * docs_n + 2) / (2 * int(df) + 1))) for df in document_frequencies(scanned, len(vocabulary))], np.int64)
    pairs = sorted((place[t], n) for n, (_, own) in enumerate(items) for t in own)
    start = np.searchsorted(np.array([p for p, _ in pairs]), np.arange(len(vocabulary) + 1))
    sent = spark.sparkContext.broadcast(([i for i, _ in items], weight, start, np.array([n for _, n in pairs], np.int64), docs_n, terms_n))
    scored = scanned.select("doc_id", "n", "terms", "tfs").mapInArrow(_score(sent, k), "item_id long, doc_id long, score long")
    first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = scored.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    near = salted.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*first))).filter(F.col("place") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*first))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
