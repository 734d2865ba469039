"""Removal of repeated passages, with a count-min prefilter.

A window is ``WINDOW`` consecutive words of a document. Words are removed that stand in
a window which also starts in a document with a smaller id.

*First pass.* Every window has an anchor: the run of ``ANCHOR`` words inside it with the
smallest hash. Equal windows have equal anchors, and neighbours mostly share theirs, so
there are about twenty times fewer anchors than windows. Tasks count the anchors of their
documents in a count-min sketch (``DEPTH`` rows of 2^``WIDTH_BITS`` cells, kept sparse);
partition sketches are merged by adding cells. An anchor's estimate, the least of its
cells, is never below the number of documents that have it, and so never below the number
that have any of its windows.

*Second pass.* Only windows whose anchor is estimated to be in two documents or more are
grouped, by 128 bits of their words. Blocks of documents send each distinct window once,
with their smallest id, to the window's bucket; what is known in more than one document
comes back to the block with the smallest id of all. No window that repeats is lost, and
nothing is broadcast: sketch, windows and answers are all dealt by key. A passage in a
third of all documents is one row per block.

Defined results: null text has no words; a null id counts as larger than any id; rows
that repeat an id are one document's; fewer words than a window leave a text as it is; an
empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import chunks, n_buckets, pack, small_batches, text_or_empty, unpack
from .shingles import LANES, Block, mix, sliding_min

WINDOW = 50
ANCHOR = 8
DEPTH = 2
WIDTH_BITS = 40
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 2 << 20
_LAST = (1 << 63) - 1


def _anchors(block: Block, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window places, their documents and their anchors."""
    at, doc = block.places(window)
    low = sliding_min(mix(block.runs(anchor, 0)), window - anchor + 1)
    return at, doc, low[at]


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return (mix(h * np.uint64(LANES[row % 2]) + np.uint64(row)) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)


def _send_anchors(window: int, anchor: int):
    schema = pa.schema([("block", pa.int32()), ("anchors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, CHUNK_BYTES):
            home = np.array([r[0] for r in rows], np.int64)
            b = Block([r[1] for r in rows])
            _, doc, h = _anchors(b, window, anchor)
            if not len(h):
                continue
            turn = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
            doc, h = doc[turn], h[turn]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))  # once per document
            to, h = home[doc[new]], h[new]
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            parts = np.split(h[order], cuts)
            heads = to[order][np.concatenate(([0], cuts))]
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)
    return run


def _partition_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        for row in range(DEPTH):
            cell, n = np.unique(_cells(h, row), return_counts=True)
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(cell), row), pa.int32()), "cell": pa.array(cell, pa.int64()),
                                              "n": pa.array(n, pa.int64())})


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for home, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = np.unique(np.frombuffer(data, np.uint64))
            cols = {"block": pa.array(np.full(len(h), home), pa.int32()), "anchor": pa.array(h.view(np.int64))}
            yield pa.RecordBatch.from_pydict(cols | {f"cell{r}": pa.array(_cells(h, r)) for r in range(DEPTH)})


def estimated_repeats(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``block, anchor``: anchors whose estimate is two or more, by block of documents."""
    sent = docs.select("block", "text").mapInArrow(_send_anchors(window, anchor), "block int, anchors binary").checkpoint()
    sketch = (sent.select("anchors").mapInArrow(_partition_sketch, "row int, cell long, n long")
                  .groupBy("row", "cell").agg(F.sum("n").alias("n")).filter("n > 1"))
    left = sent.mapInArrow(_look_up, "block int, anchor long" + "".join(f", cell{r} long" for r in range(DEPTH)))
    for r in range(DEPTH):
        row = sketch.filter(F.col("row") == r).select(F.col("cell").alias(f"cell{r}"))
        left = left.join(row, f"cell{r}", "left_semi")
    return left.select("block", "anchor").distinct()


def _texts(table: pa.Table, keep_words: bool = False) -> tuple[list, np.ndarray, Block]:
    """Rows of a block in one order, whatever order they came in; ids as sort keys."""
    rows = sorted(zip(table.column("key").to_pylist(), table.column("doc_id").to_pylist(), table.column("text").to_pylist()),
                  key=lambda r: (r[0], r[2] or ""))
    return rows, np.array([r[0] for r in rows], np.int64), Block([r[2] for r in rows], keep_words=keep_words)


_WINDOWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hi", pa.binary()), ("lo", pa.binary()),
                      ("least", pa.binary()), ("more", pa.binary())])


def _send_windows(window: int, anchor: int, buckets: int):
    def run(docs: pa.Table, flagged: pa.Table) -> pa.Table:
        wanted = np.sort(flagged.column("anchor").to_numpy().astype(np.int64).view(np.uint64))
        if not docs.num_rows or not len(wanted):
            return _WINDOWS.empty_table()
        _, keys, b = _texts(docs)
        at, doc, h = _anchors(b, window, anchor)
        turn = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        hit = wanted[np.minimum(np.searchsorted(wanted, h[turn]), len(wanted) - 1)] == h[turn]
        keep = np.repeat(hit, np.diff(np.append(turn, len(h))))
        hi, lo, key = b.runs(window, 0)[at[keep]], b.runs(window, 1)[at[keep]], keys[doc[keep]]
        if not len(hi):
            return _WINDOWS.empty_table()
        order = np.lexsort((key, lo, hi))
        hi, lo, key = hi[order], lo[order], key[order]
        head = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
        most = key[np.append(head[1:], len(key)) - 1]
        hi, lo, least = hi[head], lo[head], key[head]
        more = (most > least).astype(np.uint8)
        bucket = (mix(lo) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # inside a bucket the hashes stay sorted
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        home = docs.column("block")[0].as_py()
        out = {n: [] for n in _WINDOWS.names}
        for k in range(buckets):
            own = order[cuts[k]:cuts[k + 1]]
            if len(own):
                for name, v in zip(_WINDOWS.names, (k, home, pack(hi[own]), pack(lo[own]), pack(least[own]), pack(more[own]))):
                    out[name].append(v)
        return pa.Table.from_pydict(out, schema=_WINDOWS)
    return run


_ANSWERS = pa.schema([("block", pa.int32()), ("hi", pa.binary()), ("lo", pa.binary()), ("least", pa.binary())])


def _group_windows(table: pa.Table) -> pa.Table:
    """For every block the windows of a bucket that also start in an earlier document."""
    rows = table.to_pylist()
    cols = [np.concatenate([unpack(r[c], t) for r in rows]) for c, t in (("hi", np.uint64), ("lo", np.uint64), ("least", np.int64), ("more", np.uint8))]
    hi, lo, least, more = cols
    home = np.repeat([r["block"] for r in rows], [len(unpack(r["more"], np.uint8)) for r in rows])
    order = np.lexsort((least, lo, hi))
    hi, lo, least, more, home = hi[order], lo[order], least[order], more[order], home[order]
    head = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
    first = least[np.flatnonzero(head)][np.cumsum(head) - 1]
    tell = (first < least) | (more > 0)
    order = np.argsort(home[tell], kind="stable")
    home, hi, lo, first = (x[tell][order] for x in (home, hi, lo, first))
    cuts = np.flatnonzero(np.diff(home)) + 1
    out = {"block": home[np.concatenate(([0], cuts))] if len(home) else home,
           **{n: [pack(p) for p in np.split(x, cuts)] if len(x) else [] for n, x in (("hi", hi), ("lo", lo), ("least", first))}}
    return pa.Table.from_pydict(out, schema=_ANSWERS)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _remove(window: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _RESULT.empty_table()
        rows, keys, b = _texts(docs, keep_words=True)
        gone = np.zeros(len(b.id) + 1, np.int64)
        told = answers.to_pylist()
        if told and len(b.id) >= window:
            hi, lo, least = (np.concatenate([unpack(r[c], t) for r in told]) for c, t in (("hi", np.uint64), ("lo", np.uint64), ("least", np.int64)))
            order = np.lexsort((lo, hi))
            hi, lo, least = hi[order], lo[order], least[order]
            at, doc = b.places(window)
            x, y = b.runs(window, 0)[at], b.runs(window, 1)[at]
            seen = np.zeros(1 << 20, bool)
            seen[(hi >> np.uint64(44)).astype(np.int64)] = True
            maybe = np.flatnonzero(seen[(x >> np.uint64(44)).astype(np.int64)])
            x, y, at, doc = x[maybe], y[maybe], at[maybe], doc[maybe]
            place = np.searchsorted(hi, x)
            twins = int(np.max(np.diff(np.append(np.flatnonzero(np.concatenate(([True], hi[1:] != hi[:-1]))), len(hi)))))
            for step in range(twins):  # windows that share one lane lie side by side
                p = np.minimum(place + step, len(hi) - 1)
                hit = (hi[p] == x) & (lo[p] == y) & (least[p] < keys[doc])
                np.add.at(gone, at[hit], 1)
                np.add.at(gone, np.minimum(at[hit] + window, len(b.id)), -1)
        covered = np.cumsum(gone[:-1]) > 0
        out = {"doc_id": [r[1] for r in rows], "n_words": b.n.tolist(), "n_removed": [], "kept_text": []}
        for words, s, n in zip(b.words, b.start.tolist(), b.n.tolist()):
            cut = covered[s:s + n]
            left = [w for w, c in zip(words, cut.tolist()) if not c] if cut.any() else words
            out["n_removed"].append(n - len(left))
            out["kept_text"].append(b" ".join(left).decode("utf-8", "surrogatepass"))
        return pa.Table.from_pydict(out, schema=_RESULT)
    return run


def dealt(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """``doc_id, key, text, block``: a block is a function of id and text, so that rows of
    one id (such as null) do not all meet in one task."""
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), text.alias("text"),
                       F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias("block"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` per row: the text without repeated words,
    what is kept joined by single spaces."""
    spark = small_batches(docs.sparkSession)
    ensure_checkpoint_dir(spark)
    size = docs.agg(F.sum(F.octet_length(text_or_empty(F.col(text_col))) + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    slim = dealt(docs, id_col, text_col, blocks)
    flagged = estimated_repeats(slim, window, min(anchor, window))
    sent = (slim.groupBy("block").cogroup(flagged.groupBy("block"))
                .applyInArrow(_send_windows(window, min(anchor, window), n_buckets(spark, size)),
                              "bucket int, block int, hi binary, lo binary, least binary, more binary"))
    answers = sent.groupBy("bucket").applyInArrow(_group_windows, "block int, hi binary, lo binary, least binary")
    return (slim.groupBy("block").cogroup(answers.groupBy("block"))
                .applyInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_text string"))
