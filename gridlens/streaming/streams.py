"""Structured Streaming jobs.

* T1 ``stream_ingest``: raw messages -> typed readings, the first write of a
  document id wins, for good: ids are kept in the state store (RocksDB, on the
  executors' disks), like the unique index of a document store, not for the
  length of a watermark.  Ids stored before the stream began are given as a table.
* T2 ``stream_hourly_mean``: hourly mean power as a tumbling event-time
  window, append mode (a window is emitted once the watermark passes it).
  ``stream_hourly_totals`` adds up per batch instead, keeps the rows that come
  behind a closed hour in a table of their own and merges them as corrections.
* T3 ``stream_audit``: every micro-batch of new documents is joined with the
  ledger snapshot in ``foreachBatch``; progress lives in the checkpoint, so a
  restarted query resumes after the last committed batch.
  ``stream_audit_feeds`` joins the feeds of documents and ledger rows: a
  document is an ERROR only after its ledger row had ``wait`` to come.
* S10 ``ingest_stream``: one input stream feeds the document sink and the
  ledger sink; each batch writes under ``batch_id=<n>`` with overwrite, so a
  replayed batch replaces its own output (idempotent per sink).

Sinks and checkpoints live under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import exact_sum
from ..operators import integrity as H
from ..session import ensure_checkpoint_dir
from ..sources import ingest as I

DEFAULT_AUDIT_TRIGGER = "5 minutes"   # the reference's audit timer period


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return posixpath.join(ensure_checkpoint_dir(spark), "gridlens-streams", f"{name}-{uuid.uuid4().hex[:12]}")


def land_files(df: DataFrame, path: str, ts_col: str, files: int = 8, drop: tuple = ()) -> str:
    """Land a batch frame as time-ordered Parquet files for a file-stream source, without the columns ``drop``.

    One job deals the rows to ``files`` time ranges, a sorted file each, in
    parallel.  The source reads files in the order of their file times, which are
    set to the order of the ranges, so it replays the data in time order, as
    devices would have sent it.  (A test-harness helper; a real stream arrives in order.)
    """
    parts = df.repartitionByRange(files, ts_col).sortWithinPartitions(ts_col)
    parts.drop(*drop).write.mode("error").parquet(path)
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, p in enumerate(found):  # names count the ranges
        fs.setTimes(p, 1_700_000_000_000 + 60_000 * i, -1)
    return path


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def _wm(df: DataFrame, col: str, delay: str) -> DataFrame:
    # streaming watermarks need TIMESTAMP (not NTZ); the session zone is UTC
    return df.withColumn("_wm_ts", F.col(col).cast("timestamp")).withWatermark("_wm_ts", delay)


def first_writes(stream: DataFrame, key: str, stored: DataFrame | None = None) -> DataFrame:
    """Rows whose ``key`` neither came before on the stream nor stands in ``stored``.

    Keys are state of the query without a time limit: a redelivery is rejected
    however late it comes, and a first delivery is kept however late.  State is one
    key per document, hash-partitioned and changelogged by the state store.
    ``stored`` holds the keys written before this query's checkpoint began
    (batch loads, an older query); it is read anew in every batch, so leave it out
    where the checkpoint has seen everything.
    """
    if stored is not None:
        stream = stream.join(stored.select(F.col(key).alias("_stored")).distinct(), F.col(key) == F.col("_stored"), "left_anti")
    return stream.dropDuplicates([key])


def stream_ingest(raw_stream: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """S2-S6 on a stream plus first-write-wins on ``doc_id``.

    Messages are dealt by their enqueue millisecond, a part of ``doc_id``, before
    they are parsed: a batch of one file would be parsed by one task, however
    large.  Messages of one id stay in the order they were read in.

    Per-batch input metrics (rows, newest processing time) are published as
    observed metrics ``ingest_input``.
    """
    docs = I.normalize_messages(raw_stream.repartition(F.unix_millis(F.col("enqueued_ts").cast("timestamp")))).observe(
        "ingest_input", F.count(F.lit(1)).alias("rows"), F.max("processing_ts").alias("max_processing_ts"))
    return first_writes(docs, "doc_id", stored)


def stream_hourly_mean(readings_stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Mean power and count per processing hour, emitted when the hour closes."""
    r = _wm(readings_stream.filter(F.col("power_w").isNotNull()), "processing_ts", delay)
    g = r.groupBy(F.window("_wm_ts", "1 hour")).agg(
        exact_sum("power_w").alias("_s"), F.count("power_w").alias("count"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("timestamp"),
                    (F.col("_s") / F.col("count").cast("double")).alias("value"), "count")


def stream_hourly_totals(readings_stream: DataFrame, sink: str, checkpoint: str, delay: str = "1 hour",
                         available_now: bool = False, processing_time: str = DEFAULT_AUDIT_TRIGGER):
    """T2 with corrections: exact sums and counts per processing hour and batch, late rows also kept as they are.

    A row is late if its hour ended ``delay`` or more before the newest row of
    the batches before (the watermark).  Each batch writes three small tables
    below ``sink``: ``totals`` (hour, late, sum, count), ``late_rows`` and
    ``marks`` (rows in, newest time).  Sums add up, so :func:`hourly_totals`
    gives the means with or without corrections, and no state grows.
    """
    to = lambda name, batch_id: posixpath.join(sink, name, f"batch_id={batch_id}")
    marks_schema = "rows_in long, newest timestamp_ntz, batch_id long"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = F.lit(None).cast("timestamp_ntz")
        if batch_id > 0:  # a replayed batch sees the batches before it only
            marks = spark.read.schema(marks_schema).parquet(posixpath.join(sink, "marks")).filter(F.col("batch_id") < batch_id)
            before = marks.agg(F.max("newest")).scalar()
        hour = F.date_trunc("hour", "processing_ts").cast("timestamp_ntz")
        rows = batch.filter(F.col("power_w").isNotNull()).withColumn("hour", hour)
        closed = before - F.expr(f"interval {delay}")
        late = F.coalesce(F.col("hour") + F.expr("interval 1 hour") <= closed, F.lit(False))
        rows = rows.withColumn("late", late)
        rows.groupBy("hour", "late").agg(F.sum(F.col("power_w").cast("decimal(38,10)")).alias("total"), F.count("power_w").alias("count")) \
            .write.mode("overwrite").parquet(to("totals", batch_id))
        rows.filter("late").drop("late").write.mode("overwrite").parquet(to("late_rows", batch_id))
        rows.agg(F.count(F.lit(1)).alias("rows_in"), F.max("processing_ts").alias("newest")) \
            .write.mode("overwrite").parquet(to("marks", batch_id))

    q = _run(readings_stream, write, checkpoint, available_now, processing_time)
    if available_now:
        q.awaitTermination()
    return q


def hourly_totals(spark: SparkSession, sink: str, corrected: bool = True) -> DataFrame:
    """(timestamp, value, count, late): hourly means from :func:`stream_hourly_totals`, late rows merged or left out."""
    t = spark.read.parquet(posixpath.join(sink, "totals"))
    if not corrected:
        t = t.filter(~F.col("late"))
    g = t.groupBy("hour").agg(F.sum("total").cast("double").alias("s"), F.sum("count").alias("count"),
                              F.sum(F.when(F.col("late"), F.col("count")).otherwise(0)).alias("late"))
    return g.select(F.col("hour").alias("timestamp"), (F.col("s") / F.col("count").cast("double")).alias("value"), "count", "late")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 available_now: bool = True, processing_time: str | None = None):
    """Run a streaming frame into a Parquet sink (``availableNow`` drains the input and stops)."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode(mode)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def _run(frame: DataFrame, write, checkpoint: str, available_now: bool, processing_time: str):
    """One foreachBatch query; ``write(batch, batch_id)`` must be idempotent per batch."""
    w = frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def stream_audit(docs_stream: DataFrame, ledger, sink: str, checkpoint: str,
                 message_source: str = H.AUDIT_SOURCE, available_now: bool = False,
                 processing_time: str = DEFAULT_AUDIT_TRIGGER):
    """Audit each micro-batch of new documents against the ledger as it is then.

    ``ledger`` is a table path, or a function of the session that reads the
    ledger; it is read anew in every batch.
    """

    def audit_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = spark.read.parquet(ledger) if isinstance(ledger, str) else ledger(spark)
        out = H.audit_full(batch, now, message_source=message_source) \
            .withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").parquet(posixpath.join(sink, f"batch_id={batch_id}"))

    q = _run(docs_stream, audit_batch, checkpoint, available_now, processing_time)
    if available_now:
        q.awaitTermination()
    return q


def stream_audit_feeds(docs_stream: DataFrame, ledger_stream: DataFrame, wait: str = "10 minutes", delay: str = "0 seconds",
                       message_source: str = H.AUDIT_SOURCE) -> DataFrame:
    """T3 on two feeds: ``(id, insert_ts, current_hash, ledger_hash, status)``, each document once.

    Documents (``insert_ts``) meet ledger rows (``id, hash_value, created_at``)
    that were created at most ``wait`` before or after them.  SUCCESS and TAMPER
    come as soon as both are there; ERROR once the watermark has passed the
    document by ``wait``.  State of both sides is bounded by ``wait``.
    """
    # dealt by the join's key before the hashing: all tasks hash, and the join needs no other shuffle
    docs = H.hash_documents(docs_stream.repartition("id"), message_source=message_source).select("id", "current_hash", "insert_ts")
    docs = docs.withColumn("_doc_ts", F.col("insert_ts").cast("timestamp")).withWatermark("_doc_ts", delay)
    rows = ledger_stream.select(F.col("id").alias("_id"), F.col("hash_value").alias("ledger_hash"), F.col("created_at").cast("timestamp").alias("_row_ts"))
    rows = rows.withWatermark("_row_ts", delay)
    span = F.expr(f"interval {wait}")
    near = (F.col("id") == F.col("_id")) & (F.col("_row_ts") >= F.col("_doc_ts") - span) & (F.col("_row_ts") <= F.col("_doc_ts") + span)
    return docs.join(rows, near, "left_outer").select("id", "insert_ts", "current_hash", "ledger_hash", H.audit_status().alias("status"))


def ingest_stream(raw_stream: DataFrame, docs_sink: str, ledger_sink: str, checkpoint: str,
                  stored: DataFrame | None = None, available_now: bool = False, processing_time: str = "1 minute",
                  quarantine_sink: str | None = None, feeds: tuple = ("documents", "ledger", "quarantine")):
    """Envelopes of one stream feed document store, ledger and quarantine by three queries of their own.

    Each query has its own checkpoint, so a sink that fails doesn't hold up
    the others.  Envelopes failing S9 go to the quarantine before any
    de-duplication, all of them.  Documents and ledger: the first write of an id
    (:func:`first_writes`; ``stored`` has the column ``id``).
    Ledger: SHA-256 of each envelope's canonical text; rows that fail the
    ledger's own validation (H2) go to its ``_rejected`` folder with a reason.
    Returns the queries of the ``feeds`` asked for.
    """
    # dealt by a part of the id before the parsing: all tasks parse, messages of one id stay in the order they were read in
    checked = I.reject_invalid(I.wrap_messages(raw_stream.repartition("seq")))
    good = first_writes(checked.filter(F.col("reason").isNull()).drop("reason"), "id", stored)
    to = lambda sink, batch_id: posixpath.join(sink, f"batch_id={batch_id}")

    def write_documents(batch: DataFrame, batch_id: int) -> None:
        I.store_messages(batch).write.mode("overwrite").parquet(to(docs_sink, batch_id))

    def write_ledger(batch: DataFrame, batch_id: int) -> None:
        hashed = H.hash_documents(batch.withColumnRenamed("original_payload", "payload"), payload="payload")
        rows = H.validate_ledger_rows(hashed.select(
            "id", F.col("current_hash").alias("hash_value"),
            F.regexp_replace("processing_timestamp", r"\+00:00$", "Z").alias("timestamp"),
            "device_id", F.lit(H.LEGACY_DATA_TYPE).alias("data_type"))).persist()
        rows.filter(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(to(ledger_sink, batch_id))
        rows.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(to(posixpath.join(ledger_sink, "_rejected"), batch_id))
        rows.unpersist()

    def write_quarantine(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(to(quarantine_sink or posixpath.join(docs_sink, "_quarantine"), batch_id))

    all_feeds = (("documents", good, write_documents), ("ledger", good, write_ledger),
                 ("quarantine", checked.filter(F.col("reason").isNotNull()), write_quarantine))
    queries = [_run(frame, write, posixpath.join(checkpoint, name), available_now, processing_time) for name, frame, write in all_feeds if name in feeds]
    if available_now:
        for q in queries:
            q.awaitTermination()
    return queries
