"""Packing token ids into fixed-length rows, best fit decreasing.

Documents are dealt into blocks of bounded size (of texts by hash, of ids by their place in
the table); a block's task turns texts into ids, cuts documents longer than a row into
pieces (losing none) and packs the pieces: longest first, each into the row whose free
space is the smallest that still holds it. A segment tree over free-space values finds
that row in logarithmic time. Every packed row has its id matrix line, cumulative segment lengths, and positions that start again at
each segment. Only the last rows of a block are not full, a thousandth of them.

Ids come from an encoded table (:func:`pack_ids`; ``bpe.encode`` makes one) and get an end
mark, or are any function of a text (:func:`pack_rows`; ``byte_ids`` are UTF-8 bytes, plus
three, and an end mark).

Defined results: null text counts as empty and gives the end mark alone; repeated rows
are packed each, told apart by ``copies``; a null id stays null; an empty table gives no
rows; other columns are ignored; a very long text is cut into full rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_or_empty, trimmed

ROW_TOKENS = 2048
BLOCK_BYTES = 8 << 20
PAD, END, FIRST_BYTE = 0, 1, 3  # fixed values of the public byte-id scheme


def byte_ids(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.empty(len(raw) + 1, np.uint32)
    out[:-1] = raw
    out[:-1] += FIRST_BYTE
    out[-1] = END
    return out


class FreeSpace:
    """Rows by free space, with a segment tree that says where there are any."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        at = space + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the smallest free space of ``least`` or more, and that space."""
        at = least + self.size
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):  # up until a right neighbour has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        space = at - self.size
        row = self.rows[space].pop()
        if not self.rows[space]:
            self.any[at] = 0
            while at > 1 and not self.any[at ^ 1]:
                at >>= 1
                self.any[at] = 0
        return row, space


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of piece numbers; ties go in the pieces' order."""
    free, rows = FreeSpace(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        row, space = found if found else (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(i)
        if space > lengths[i]:
            free.put(space - lengths[i], row)
    return rows


_FIELDS = [("pack_id", pa.int64(), "long"), ("n_tokens", pa.int32(), "int"), ("ids", pa.binary(), "binary"),
           ("positions", pa.binary(), "binary"), ("cu_seqlens", pa.list_(pa.int32()), "array<int>"),
           ("doc_ids", pa.list_(pa.int64()), "array<long>"), ("copies", pa.list_(pa.int32()), "array<int>"),
           ("pieces", pa.list_(pa.int32()), "array<int>")]
_ARROW = pa.schema([(n, t) for n, t, _ in _FIELDS])


def _lines(block: int, docs: list[tuple], to_ids: Callable[[str | bytes | None], np.ndarray], capacity: int) -> pa.Table:
    """The packed lines of a block's documents (id, and text or ids)."""
    pieces, seen = [], {}
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1])):
        ids = to_ids(text)
        copy = seen[doc_id] = seen.get(doc_id, -1) + 1
        pieces.extend((doc_id, copy, n, ids[at:at + capacity]) for n, at in enumerate(range(0, len(ids), capacity)))
    out: dict[str, list] = {n: [] for n in _ARROW.names}
    for number, row in enumerate(best_fit_decreasing([len(p[3]) for p in pieces], capacity)):
        parts = [pieces[i] for i in row]
        ends = np.cumsum([len(p[3]) for p in parts])
        line, place = np.full(capacity, PAD, "<u4"), np.zeros(capacity, "<u4")
        for p, e in zip(parts, ends.tolist()):
            line[e - len(p[3]):e] = p[3]
            place[e - len(p[3]):e] = np.arange(len(p[3]))
        for n, v in zip(out, (block << 32 | number, int(ends[-1]), line.tobytes(), place.tobytes(), [0, *ends.tolist()],
                              [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts])):
            out[n].append(v)
    return pa.Table.from_pydict(out, schema=_ARROW)


def _packer(to_ids: Callable[[str | None], np.ndarray], capacity: int):
    def run(table: pa.Table) -> pa.Table:
        docs = list(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))
        return _lines(table.column("block")[0].as_py(), docs, to_ids, capacity)
    return run


def pack_rows(docs: DataFrame, capacity: int = ROW_TOKENS, to_ids: Callable[[str | None], np.ndarray] = byte_ids,
              id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per packed line: ``pack_id, n_tokens, ids`` and ``positions`` (``capacity``
    little-endian unsigned 32-bit integers), ``cu_seqlens``, and of each segment its
    ``doc_ids``, ``copies`` (number among rows of that id) and ``pieces`` (number in the
    document)."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text_or_empty(F.col(text_col))) + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).alias("block"))
    # rows that repeat an id and a text share a block, so copies are numbered there
    return slim.groupBy("block").applyInArrow(_packer(to_ids, capacity), ", ".join(f"{n} {t}" for n, _, t in _FIELDS))


BLOCKS_BITS = 12  # of a block's number within its partition; 19 are left for the partition's


def pack_ids(encoded: DataFrame, end_id: int, capacity: int = ROW_TOKENS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:func:`pack_rows` of ``doc_id, ids`` (little-endian unsigned 32-bit integers; null
    counts as none), with ``end_id`` after each document's ids. A block is a run of rows of one
    partition, so ids are neither shuffled nor written, and rows that are alike need not
    share a block."""
    small_batches(encoded.sparkSession)
    slim = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids"),
                          F.spark_partition_id().alias("part"))

    def ended(ids: bytes) -> np.ndarray:
        return np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, rows in enumerate(chunks(batches, block_bytes)):
            part = rows[0][2]
            if n >> BLOCKS_BITS or part >> (31 - BLOCKS_BITS):
                raise ValueError(f"block {n} of partition {part} has no number; repartition the ids before packing")
            yield from _lines(part << BLOCKS_BITS | n, [r[:2] for r in rows], ended, capacity).to_batches()
    return slim.mapInArrow(trimmed(run), ", ".join(f"{n} {t}" for n, _, t in _FIELDS))


def unpack_rows(packed: DataFrame) -> DataFrame:
    """``doc_id, block, copy, ids`` (binary) back from packed lines: pieces in order."""
    segment = F.posexplode(F.arrays_zip("doc_ids", "copies", "pieces"))
    rows = packed.select(F.shiftright("pack_id", 32).alias("block"), "ids", "cu_seqlens", segment.alias("i", "s"))
    cut = F.expr("substring(ids, 4 * element_at(cu_seqlens, i + 1) + 1, 4 * (element_at(cu_seqlens, i + 2) - element_at(cu_seqlens, i + 1)))")
    return (rows.select(F.col("s.doc_ids").alias("doc_id"), "block", F.col("s.copies").alias("copy"), F.col("s.pieces").alias("piece"), cut.alias("part"))
                .groupBy("doc_id", "block", "copy").agg(F.sort_array(F.collect_list(F.struct("piece", "part"))).alias("p"))
                .select("doc_id", "block", "copy", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.part))").alias("ids")))
