"""BPE encoding and decoding through a distinct-word table.

A word (run without ASCII white space) is encoded alike wherever it stands: the
tokenizer's normaliser and splitter never look across white space. So texts are split,
and the distinct-word table is dealt into hash buckets; a bucket's task encodes each of
its words once. Words and ids travel per block of documents (a few MB of text): a block
sends each of its distinct words once to the word's bucket and gets the ids back in the
same order, and the block's documents, which are lists of positions in its words, are
joined with the ids by position. What is shuffled is smaller than the texts, no word is
hot (each block sends it once), and nothing is broadcast but the tokenizer file, whose
vocabulary bounds it.

Decoding joins ids with the id-to-piece table (bounded by the vocabulary, checked) and
sets the pieces together as the tokenizer's file says (no decoder: one space between).

Blocks are made twice from the input, once for words and once for positions, from rows that
are sorted within their partition, so the order in which a shuffle delivers them does not
matter. A digest tells if a partition gave other rows the second time (a random filter, say),
and the job then fails with advice instead of returning wrong ids. With ``spool`` blocks are
made once and written, which takes disk instead of time and works with any input.

Without ``shuffle`` nothing leaves its task: a task cuts its texts into a dictionary and
codes, encodes the words that its Python worker has not met, and keeps them (a bounded
number, in the worker's copy of a broadcast value) for its later tasks. It reads the input
once and takes no disk, but a word is encoded once per worker instead of once in all.

Defined results: null and empty text give no ids and an empty decoded text; repeated
rows each give a row; an empty table gives an empty result; other columns are ignored;
a very long text is one block.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, n_buckets, pack, pack_words, small_batches, text_bytes, trimmed, unpack, unpack_words, written

BLOCK_BYTES = 4 << 20
KEPT_WORDS = 1 << 20
MAX_PIECES = 2_000_000
MAX_TOKENIZER_BYTES = 64 << 20


def read_tokenizer(path: str) -> str:
    """The tokenizer file, for tasks that may not see the driver's disk."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"the tokenizer file has {len(text)} bytes; at most {MAX_TOKENIZER_BYTES} are broadcast")
    return text


def open_tokenizer(text: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


def _index(rows: list[tuple], buckets: int):
    """Words of a block by falling frequency, their buckets, every document's words as
    ranks, words per document, and a digest of all of it."""
    first: dict[bytes, int] = {}
    per_doc, at = [], []
    for _, text, _ in rows:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        per_doc.append(len(words))
        at.append(np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words)))
    seen = np.concatenate(at) if at else np.zeros(0, np.int64)
    order = np.argsort(-np.bincount(seen, minlength=len(first)), kind="stable")
    rank = np.empty(len(first), np.uint32)
    rank[order] = np.arange(len(first), dtype=np.uint32)
    listed = list(first)
    words = [listed[i] for i in order]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
    digest = zlib.crc32(b"\n".join(words)) & 0x7FFFFFFF
    return words, bucket, rank[seen], np.array(per_doc, np.uint32), digest


def _block_of(rows: list[tuple], n: int) -> int:
    return rows[0][2] << 32 | n  # the input's partition, and the block's number in it


_WORDS = "bucket int, block long, digest int, words binary"
_PARTS = "block long, bucket int, digest int, doc_ids array<long>, a binary, b binary, c binary"
_PARTS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("digest", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                          ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _send_words(buckets: int, block_bytes: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("digest", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, rows in enumerate(chunks(batches, block_bytes)):
            words, bucket, _, _, digest = _index(rows, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(b, _block_of(rows, n), digest, pack_words([words[i] for i in order[cuts[b]:cuts[b + 1]]]))
                   for b in range(buckets) if cuts[b] < cuts[b + 1]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
    return run


def _send_positions(buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, rows in enumerate(chunks(batches, block_bytes)):
            words, bucket, ranks, per_doc, digest = _index(rows, buckets)
            row = (_block_of(rows, n), -1, digest, [r[0] for r in rows], pack(per_doc), pack(ranks), pack(bucket))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PARTS_ARROW)], schema=_PARTS_ARROW)
    return run


def _send_both(buckets: int, block_bytes: int):
    schema = pa.schema([*_PARTS_ARROW, ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, rows in enumerate(chunks(batches, block_bytes)):
            words, bucket, ranks, per_doc, digest = _index(rows, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            block = _block_of(rows, n)
            out = [(block, b, digest, None, None, None, None, pack_words([words[i] for i in order[cuts[b]:cuts[b + 1]]]))
                   for b in range(buckets) if cuts[b] < cuts[b + 1]]
            out.append((block, -1, digest, [r[0] for r in rows], pack(per_doc), pack(ranks), pack(bucket), None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
    return run


def gather(flat: np.ndarray, lens: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``flat[starts[w]:starts[w] + lens[w]]`` for each w of ``which``, end to end."""
    n = lens[which]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1])]


def encode_words(tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and how many each has."""
    ids, lens = [], np.zeros(len(words), np.int64)
    for at in range(0, len(words), 4096):
        part = [w.decode("utf-8", "surrogatepass") for w in words[at:at + 4096]]
        got = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        lens[at:at + len(got)] = [len(x) for x in got]
        ids.extend(np.array(x, np.uint32) for x in got)
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), lens


def _encode_bucket(tokenizer_text):
    def run(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        rows = table.select(["block", "bucket", "digest", "words"]).to_pylist()
        which = [np.fromiter((known.setdefault(w, len(known)) for w in unpack_words(r.pop("words"))), np.int64) for r in rows]
        flat, lens = encode_words(open_tokenizer(tokenizer_text.value), list(known))
        starts = np.cumsum(lens) - lens
        out = {"block": [r["block"] for r in rows], "bucket": [r["bucket"] for r in rows], "digest": [r["digest"] for r in rows],
               "doc_ids": [None] * len(rows), "a": [pack(lens[w].astype(np.uint32)) for w in which],
               "b": [pack(gather(flat, lens, starts, w)) for w in which], "c": [None] * len(rows)}
        return pa.Table.from_pydict(out, schema=_PARTS_ARROW)
    return run


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows of Arrow batches as tables of about ``limit`` text bytes; a row is never split."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < len(ends):
            done = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, done + limit - size)) + 1, len(ends))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - done
            at = to
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _encode_here(sent, block_bytes: int, kept_words: int):
    """``sent`` is a broadcast dict with the tokenizer's ``text``; a worker's copy holds the
    open tokenizer too, the first ``kept_words`` words that it met, their ids and lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        if "open" not in own:
            own |= {"open": open_tokenizer(own["text"]), "words": pa.array([], pa.binary()),
                    "ids": np.zeros(0, np.uint32), "lens": np.zeros(0, np.int64)}
        for rows in _runs(batches, block_bytes):
            cut = pc.ascii_split_whitespace(pc.fill_null(_one(rows.column(1)), ""))
            coded = cut.flatten().cast(pa.binary())
            full = pc.greater(pc.binary_length(coded), 0)  # a text without words may be cut into empty ones
            if len(coded) and not pc.all(full).as_py():
                per_doc = np.add.reduceat(np.append(full.to_numpy(zero_copy_only=False).astype(np.int64), 0), cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py())
                per_doc[pc.list_value_length(cut).to_numpy() == 0] = 0
                coded = coded.filter(full)
            else:
                per_doc = pc.list_value_length(cut).to_numpy().astype(np.int64)
            coded = coded.dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=own["words"])
            new = coded.dictionary.filter(place.is_null())
            ids, lens, words = [own["ids"]], [own["lens"]], own["words"]
            for at in range(0, len(new), 1 << 16):
                got = encode_words(own["open"], new.slice(at, 1 << 16).to_pylist())
                ids.append(got[0])
                lens.append(got[1])
            ids, lens = np.concatenate(ids), np.concatenate(lens)
            which = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            which[place.is_null().to_numpy(zero_copy_only=False)] = len(words) + np.arange(len(new))
            which = which[coded.indices.to_numpy()]
            flat = gather(ids, lens, np.cumsum(lens) - lens, which).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lens[which])])[np.cumsum(per_doc)]
            if len(words) < kept_words:
                n = min(len(lens), kept_words)
                own |= {"words": pa.concat_arrays([words, new.slice(0, n - len(words))]), "ids": ids[:lens[:n].sum()].copy(), "lens": lens[:n].copy()}
            out = [flat[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([_one(rows.column(0)), pa.array(out, pa.binary())], names=["doc_id", "ids"])
    return run


def join_pieces(ids: np.ndarray, piece: dict[int, str], separator: str = " ") -> str:
    return separator.join(map(piece.__getitem__, ids.tolist()))


def _assemble(pieces):
    """Documents of a block, from their positions and the answers of all buckets; decoded
    too if there are ``pieces``."""
    def run(table: pa.Table) -> pa.Table:
        doc_ids, ids = _ids_of_block(table)
        out = {"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
        if pieces is not None:
            out["decoded"] = pa.array([join_pieces(x, pieces.value) for x in ids], pa.string())
        return pa.table(out)
    return run


def _ids_of_block(table: pa.Table) -> tuple[list, list[np.ndarray]]:
    rows = table.to_pylist()
    own = [r for r in rows if r["bucket"] < 0]
    answers = {r["bucket"]: r for r in rows if r["bucket"] >= 0}
    bad = "the input gave other rows when it was read again; checkpoint or write it before encoding"
    if len(own) != 1:
        raise ValueError(bad)
    doc = own[0]
    per_doc, ranks, bucket = unpack(doc["a"], np.uint32), unpack(doc["b"], np.uint32), unpack(doc["c"], np.uint32)
    lens, parts = np.zeros(len(bucket), np.int64), []
    order = np.argsort(bucket, kind="stable")
    cuts, n = np.unique(bucket, return_counts=True)
    if set(cuts.tolist()) != set(answers) or any(r["digest"] != doc["digest"] for r in answers.values()):
        raise ValueError(bad)
    at = 0
    for b, k in zip(cuts.tolist(), n.tolist()):
        lens[at:at + k] = unpack(answers[b]["a"], np.uint32)
        parts.append(unpack(answers[b]["b"], np.uint32))
        at += k
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    starts = np.cumsum(lens) - lens
    by_rank_lens, by_rank_starts = np.zeros_like(lens), np.zeros_like(starts)
    by_rank_lens[order], by_rank_starts[order] = lens, starts
    ends = np.cumsum(per_doc, dtype=np.int64)
    return doc["doc_ids"], [gather(flat, by_rank_lens, by_rank_starts, ranks[e - k:e]).astype("<u4") for e, k in zip(ends.tolist(), per_doc.tolist())]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES, pieces: DataFrame | None = None, spool: bool = False, shuffle: bool = True,
           kept_words: int = KEPT_WORDS) -> DataFrame:
    """``doc_id, ids`` per row; ``ids`` are little-endian unsigned 32-bit integers. With
    ``pieces`` (``id, piece``) there is a column ``decoded`` too, joined in the same task,
    where :func:`decode` would keep a second Python process busy. Without ``shuffle`` rows stay
    in their partitions, and a worker keeps up to ``kept_words`` words."""
    spark = small_batches(docs.sparkSession)
    if not shuffle:
        if spool or pieces is not None:
            raise ValueError("spool and pieces need the shuffle; decode() adds the pieces to any ids")
        sent = spark.sparkContext.broadcast({"text": read_tokenizer(tokenizer_path)})
        slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return slim.mapInArrow(trimmed(_encode_here(sent, block_bytes, kept_words)), "doc_id long, ids binary")
    buckets = n_buckets(spark, text_bytes(docs, text_col))
    tokenizer = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.spark_partition_id().alias("part"))
    if spool:
        sent = written(slim.mapInArrow(trimmed(_send_both(buckets, block_bytes)), f"{_PARTS}, words binary"))
        words, positions = sent.filter("bucket >= 0").select("bucket", "block", "digest", "words"), sent.filter("bucket < 0").drop("words")
    else:
        slim = slim.sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text")
        words = slim.mapInArrow(trimmed(_send_words(buckets, block_bytes)), _WORDS)
        positions = slim.mapInArrow(trimmed(_send_positions(buckets, block_bytes)), _PARTS)
    encoded = words.groupBy("bucket").applyInArrow(trimmed(_encode_bucket(tokenizer)), _PARTS)
    fields = "doc_id long, ids binary" + (", decoded string" if pieces is not None else "")
    sent = None if pieces is None else _sent_pieces(pieces)
    return encoded.unionByName(positions).groupBy("block").applyInArrow(trimmed(_assemble(sent)), fields)


def end_id(tokenizer_path: str) -> int:
    """The id of the tokenizer's end-of-text mark, or the first that it does not use."""
    vocab = open_tokenizer(read_tokenizer(tokenizer_path)).get_vocab(with_added_tokens=True)
    return vocab.get("<|endoftext|>", max(vocab.values()) + 1)


def piece_table(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """``id, piece`` of a tokenizer file."""
    vocab = open_tokenizer(read_tokenizer(tokenizer_path)).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, p) for p, i in vocab.items()), "id long, piece string")


def _sent_pieces(pieces: DataFrame):
    """The id-to-piece table, broadcast once it is known to be of bounded size."""
    n = pieces.count()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces; at most {MAX_PIECES} are broadcast")
    return pieces.sparkSession.sparkContext.broadcast({r["id"]: r["piece"] for r in pieces.collect()})


def decode(encoded: DataFrame, pieces: DataFrame, separator: str = " ") -> DataFrame:
    """``encoded`` with a column ``decoded``: its ids joined with ``pieces`` (``id, piece``)
    and set together."""
    small_batches(encoded.sparkSession)
    joined = _sent_pieces(pieces)
    columns, at = encoded.columns, encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [join_pieces(np.frombuffer(x, "<u4"), joined.value, separator) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*columns, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row's ids and decoded text."""
    back = encode(docs, tokenizer_path, id_col, text_col, pieces=piece_table(docs.sparkSession, tokenizer_path))
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
