"""Shared helpers of the training-data operators.

A *word* is a maximal run of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``), unchanged. ``bytes.split()`` cuts at exactly those
characters, so JVM expressions and Arrow tasks agree on it.
"""
from __future__ import annotations

import ctypes
import inspect
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by path; Spark's reader only, so any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def n_words(c: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def free_name(taken: Sequence[str], base: str) -> str:
    """``base``, lengthened until no column in ``taken`` has that name in any case."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base += "_"
    return base


BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> SparkSession:
    """Sends at most ``BATCH_ROWS`` texts at once to a Python task (Spark's own limit is
    10,000 rows, a great deal for long texts). The session keeps the setting, as plans
    read it when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


BUCKET_BYTES = 16 << 20


def n_buckets(spark: SparkSession, size: int = 0) -> int:
    """Hash buckets of an exchange: the session's shuffle partitions, and as many more as
    ``size`` bytes of text need for ``BUCKET_BYTES`` in each."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts, with some for each row."""
    return int(docs.agg(F.sum(F.octet_length(text_or_empty(F.col(text_col))) + 64)).first()[0] or 0)


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a Parquet table below ``spark.checkpoint.dir``: lineage ends there, also for
    the optimizer (a checkpointed frame keeps its constraints, which pile up in a loop).
    The table of ``instead_of``, an earlier result of this function, is removed."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, 'written')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if (old := getattr(instead_of, "_written_at", None)) is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


def chunks(batches: Iterator, limit: int, text_at: int = 1) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as tuples, in lists of about ``limit`` text bytes.

    A row is never split; a text longer than ``limit`` is a list of its own size. The
    cut depends on the row order alone, not on how rows were batched, so a repeated
    read of the same partition gives the same lists.
    """
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(col.to_pylist() for col in batch.columns)):
            rows.append(row)
            held += len(row[text_at] or "") + 64
            if held >= limit:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def give_back() -> None:
    """Memory that is free in this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which keeps what it has


def trimmed(run: Callable) -> Callable:
    """The task function ``run``, after which its Python worker keeps no free memory. Spark
    keeps workers for later tasks, so several would sit on their peaks side by side."""
    if inspect.isgeneratorfunction(run):
        def stream(batches):
            try:
                yield from run(batches)
            finally:
                give_back()
        return stream
    if len(inspect.signature(run).parameters) == 2:
        def pair(left, right):
            try:
                return run(left, right)
            finally:
                give_back()
        return pair

    def single(group):
        try:
            return run(group)
        finally:
            give_back()
    return single


# ------------------------------------------------------------------ packed columns
# Large exchanges of numbers or words travel as one binary value per (block, bucket)
# instead of one row per item: Spark still partitions, shuffles and retries them.
def pack(a) -> bytes:
    """Unsigned integers as compressed byte planes (small numbers take few bytes)."""
    import numpy as np
    import zstandard
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((0,), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype):
    import numpy as np
    import zstandard
    raw, size = zstandard.ZstdDecompressor().decompress(data), np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1) if raw else np.zeros((size, 0), np.uint8)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_words(words: Sequence[bytes]) -> bytes:
    """Words, which hold no white space, in order."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b"\n") if raw else []
