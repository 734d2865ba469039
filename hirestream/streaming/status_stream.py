"""Structured Streaming form of the mail watcher.

``readStream`` over landed message files -> event-time watermark (the look-back window is
the lateness bound) -> ``dropDuplicatesWithinWatermark`` on the message id (processed
once, state bounded by the watermark) -> ``foreachBatch``: each micro-batch joins the
current snapshot of the applications (so a change made elsewhere is seen), folds its
messages into it and commits the next snapshot version. The snapshot is bucketed by
application: a batch reads and writes the buckets of its messages and no others, and its
counters are observed on the rows as they are written (W6).

A version belongs to a batch id. A batch that is replayed after a failure finds its
version committed and changes nothing, or writes the same version again; the streaming
state holds message ids inside the watermark and nothing else. Checkpoints, snapshots and
counters live under the shared folder named by ``spark.checkpoint.dir``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.status import current_status, status_rank
from ..sources import sinks

_BEST = "struct<rank: int, nts: bigint, nid: bigint, status: string, ts: timestamp>"
STATE_SCHEMA = f"job_id bigint, start_status string, best {_BEST}, n_messages bigint, n_candidates bigint"


def message_stream(spark: SparkSession, directory: str, schema, *, table: str,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """W1/S10 source: the parquet messages of ``table`` in ``directory``, which may be one
    file or a folder of files that more are landed in."""
    path = f"{directory.rstrip('/')}/{table}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path) if folder else r.option("pathGlobFilter", f"{table}.parquet").parquet(directory)


def dedupe_messages(stream: DataFrame, *, id_col: str, time_col: str, lookback: str = "7 days") -> DataFrame:
    """Drop replays of a message id seen within the look-back window."""
    return (stream.withColumn("_event_time", F.col(time_col).cast("timestamp"))
            .withWatermark("_event_time", lookback)
            .dropDuplicatesWithinWatermark([id_col]))


def initial_state(applications: DataFrame, default_status: str = "applied") -> DataFrame:
    """The state of ``applications`` (``job_id, status``) before any message."""
    return applications.select(
        F.col("job_id").cast("long").alias("job_id"), current_status(F.col("status"), default_status).alias("start_status"),
        F.lit(None).cast(_BEST).alias("best"), F.lit(0).cast("long").alias("n_messages"), F.lit(0).cast("long").alias("n_candidates"))


def fold_batch(state: DataFrame, messages: DataFrame, observed: Observation | None = None) -> DataFrame:
    """``state`` after a batch of ``messages`` (``job_id, label, msg_id,
    _event_time``): the same arithmetic as the batch fold, so any cut into batches gives
    what one batch gives. The join is left to Spark; an application with very many
    messages is combined before the shuffle. ``observed`` gets the counters of
    :func:`poll_counts` when the result is computed."""
    r = status_rank(F.col("label"))
    cand = F.when(r > status_rank(F.col("start_status")), F.struct(
        r.alias("rank"), (-F.unix_micros("_event_time")).alias("nts"), (-F.col("msg_id")).alias("nid"),
        F.col("label").alias("status"), F.col("_event_time").alias("ts")))
    new = (messages.join(state.select("job_id", "start_status"), "job_id").groupBy("job_id")
                   .agg(F.max(cand).alias("new_best"), F.count(F.lit(1)).alias("new_messages"), F.count(cand).alias("new_candidates")))
    j = state.join(new, "job_id", "left").withColumn("_best", F.greatest("best", F.col("new_best").cast(_BEST)))
    if observed is not None:
        moved = F.coalesce("_best.status", "start_status") != F.coalesce("best.status", "start_status")
        j = j.observe(observed, F.coalesce(F.sum("new_messages"), F.lit(0)).cast("long").alias("checked"),
                      F.coalesce(F.sum("new_candidates"), F.lit(0)).cast("long").alias("classified"), F.count_if(moved).cast("long").alias("advanced"))
    return j.select(
        "job_id", "start_status", F.col("_best").alias("best"),
        (F.col("n_messages") + F.coalesce("new_messages", F.lit(0))).alias("n_messages"),
        (F.col("n_candidates") + F.coalesce("new_candidates", F.lit(0))).alias("n_candidates"))


def statuses(state: DataFrame) -> DataFrame:
    """What :func:`mail.fold_statuses` returns, from the state."""
    return state.select("job_id", "start_status", F.coalesce("best.status", "start_status").alias("status"),
                        F.coalesce("best.rank", status_rank(F.col("start_status"))).alias("status_rank"),
                        F.unix_micros("best.ts").alias("advanced_at_us"), "n_messages", "n_candidates")


def poll_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Messages checked and classified, and applications advanced, between two
    states."""
    b, a = statuses(before), statuses(after)
    j = a.join(b.select("job_id", *[F.col(c).alias(f"{c}_b") for c in ("status", "n_messages", "n_candidates")]), "job_id")
    return j.agg(F.coalesce(F.sum(F.col("n_messages") - F.col("n_messages_b")), F.lit(0)).cast("long").alias("checked"),
                 F.coalesce(F.sum(F.col("n_candidates") - F.col("n_candidates_b")), F.lit(0)).cast("long").alias("classified"),
                 F.count_if(F.col("status") != F.col("status_b")).cast("long").alias("advanced"))


def start_watch(messages: DataFrame, table: str, *, checkpoint: str, interval: str | None = None, buckets: int = 64):
    """Start the watcher on ``messages`` (:func:`dedupe_messages` of ``job_id, label,
    msg_id``), writing the applications' state to the versioned table ``table``, whose
    version 1 must hold the initial state. ``interval`` is the polling interval of a
    long-running watcher; without it all that has landed is processed and the query ends.
    Counters of batch n are ``<table>/counts/batch=n``. A table that is not bucketed yet
    becomes so with the first batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, batch_id + 2
        now = sinks.current_version(spark, table)
        if now is not None and now >= version:
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state still has to be made
            return
        batch.persist()
        try:
            observed = Observation(f"batch {batch_id}")
            sinks.save_changes(spark, table, STATE_SCHEMA, lambda before: fold_batch(before, batch, observed), batch, key="job_id", buckets=buckets, version=version)
            counts = spark.createDataFrame([tuple(observed.get[n] for n in ("checked", "classified", "advanced"))], "checked long, classified long, advanced long")
            counts.coalesce(1).write.mode("overwrite").parquet(f"{table}/counts/batch={batch_id}")
        finally:
            batch.unpersist()

    w = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def append_batches(stream: DataFrame, sink: str, *, checkpoint: str) -> DataFrame:
    """Run ``stream`` over all that has landed; every batch is a folder of its own, so a
    replayed one replaces itself. Returns the rows written so far; none give an empty
    frame with the stream's columns."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{sink}/batch=-1")
    q = (stream.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{sink}/batch={i}"))
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink).select(*stream.columns)
