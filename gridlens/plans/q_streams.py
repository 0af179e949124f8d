"""Registered streaming queries (T1-T3, S10): run with ``availableNow``, read the sink back."""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources.ingest import RAW_SCHEMA
from ..streaming import streams as ST
from . import oracle as O
from .q_ingest import _NORMALIZE_SQL, _RAW, flat_phases
from .q_integrity import _AUDIT, _LEDGER
from .registry import register

W = O.with_fixtures


#: Raw messages with redeliveries a day later, as they were and with a new enqueue time.
_AGAIN = _RAW.replace("SELECT topic, body, enqueued_ts, seq FROM rawm0 WHERE seq % 43 = 0)", """SELECT topic, body, enqueued_ts, seq FROM rawm0 WHERE seq % 43 = 0),
rawm1 AS (SELECT * FROM rawm UNION ALL SELECT * FROM rawm WHERE seq % 47 = 0 UNION ALL
          SELECT topic, body, enqueued_ts + INTERVAL 1 DAY + INTERVAL 7123 MILLISECOND, seq FROM rawm WHERE seq % 53 = 0)""").replace("ELSE 'unknown' END AS device_type FROM rawm)", "ELSE 'unknown' END AS device_type FROM rawm1)")


def _landed(spark, name, df, ts_col, files=8, drop=()):
    d = ST.work_dir(spark, name)
    src = ST.land_files(df, posixpath.join(d, "input"), ts_col, files, drop)
    return d, df.drop(*drop).schema, src


def _messages(spark, sf, name):
    return _landed(spark, name, fx.redelivered_messages(spark, sf), "arrived_ts", drop=("arrived_ts",))


@register("stream_ingest", W("""
SELECT * FROM ({sql}) t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY processing_ts, reading_id) = 1""".format(sql=_NORMALIZE_SQL), _AGAIN), "streams")
def q_stream_ingest(spark, sf):
    d, _, src = _messages(spark, sf, "ingest")
    out = ST.stream_ingest(ST.read_stream(spark, src, RAW_SCHEMA))
    ST.run_to_table(out, posixpath.join(d, "out"), posixpath.join(d, "chk"))
    return flat_phases(spark.read.parquet(posixpath.join(d, "out")))


@register("stream_hourly_mean", W("""
SELECT * FROM (
  SELECT CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp, {avg} AS value, count(*) AS count
  FROM readings WHERE power_w IS NOT NULL GROUP BY 1) t
WHERE timestamp + INTERVAL 1 HOUR <= (SELECT max(processing_ts) FROM readings WHERE power_w IS NOT NULL)""".format(
    avg=O.exact_avg("power_w"))), "streams")
def q_stream_hourly_mean(spark, sf):
    r = fx.readings(spark, sf)
    d, schema, src = _landed(spark, "hourly", r, "processing_ts")
    out = ST.stream_hourly_mean(ST.read_stream(spark, src, schema))
    ST.run_to_table(out, posixpath.join(d, "out"), posixpath.join(d, "chk"))
    return spark.read.parquet(posixpath.join(d, "out"))


@register("stream_audit", W(_AUDIT.format(extra="", where=""), _LEDGER), "streams")
def q_stream_audit(spark, sf):
    docs = fx.stored_documents(spark, sf)
    d, schema, src = _landed(spark, "audit", docs, "insert_ts")
    fx.ledger(spark, sf).write.parquet(posixpath.join(d, "ledger"))
    ST.stream_audit(ST.read_stream(spark, src, schema), posixpath.join(d, "ledger"), posixpath.join(d, "out"),
                    posixpath.join(d, "chk"), message_source="fixture", available_now=True)
    return spark.read.parquet(posixpath.join(d, "out")).select("id", "current_hash", "ledger_hash", "status")


#: Arrival: every 31st reading comes five hours after its time.
LATE_MOD, LATE_HOURS = 31, 5
_HOURS = """SELECT CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp, {avg} AS value, count(*) AS count
FROM readings WHERE power_w IS NOT NULL GROUP BY 1""".format(avg=O.exact_avg("power_w"))


def _totals(spark, sf):
    r = fx.readings(spark, sf).select("reading_id", "device_id", "processing_ts", "power_w")
    late = F.when(F.col("reading_id") % LATE_MOD == 0, LATE_HOURS).otherwise(0)
    r = r.withColumn("arrived_ts", F.col("processing_ts") + F.make_dt_interval(hours=late))
    d, schema, src = _landed(spark, "totals", r, "arrived_ts", drop=("arrived_ts",))
    ST.stream_hourly_totals(ST.read_stream(spark, src, schema), posixpath.join(d, "out"), posixpath.join(d, "chk"), available_now=True)
    return posixpath.join(d, "out")


register("stream_hourly_corrected", W(_HOURS), "streams")(
    lambda spark, sf: ST.hourly_totals(spark, _totals(spark, sf)).drop("late"))


@register("stream_hourly_late_rows", W("""SELECT count(*) AS rows_in, count(*) AS rows_accounted, true AS some_late, true AS late_rows_are_the_late
FROM readings WHERE power_w IS NOT NULL"""), "streams")
def q_stream_late(spark, sf):
    """Rows in = rows added up on time + late rows, and only rows that came late are late."""
    out = _totals(spark, sf)
    late = spark.read.parquet(posixpath.join(out, "late_rows"))
    kept = ST.hourly_totals(spark, out, corrected=False)
    n_late = late.agg(F.count(F.lit(1))).scalar()
    rows_in = spark.read.parquet(posixpath.join(out, "marks")).agg(F.sum("rows_in")).scalar()
    strange = late.agg(F.count_if(F.col("reading_id") % LATE_MOD != 0)).scalar()
    return kept.agg(rows_in.alias("rows_in"), (F.sum("count") + n_late).alias("rows_accounted"), (n_late > 0).alias("some_late"),
                    (strange == 0).alias("late_rows_are_the_late"))


#: Ledger rows come with a lag of up to seven minutes; the audit waits ten.
LAG_MINUTES, WAIT = 7, "10 minutes"


@register("stream_audit_feeds", W(_AUDIT.format(
    extra="", where="WHERE l.id IS NOT NULL OR c.insert_ts < (SELECT max(insert_ts) FROM canon) - INTERVAL 1 HOUR"), _LEDGER), "streams")
def q_stream_audit_feeds(spark, sf):
    """Documents against ledger rows that come minutes later; the last hour's documents without one are still waiting."""
    docs = fx.stored_documents(spark, sf)
    ledger = fx.ledger(spark, sf)
    lag = F.make_dt_interval(mins=F.pmod(F.xxhash64("id"), F.lit(LAG_MINUTES + 1)).cast("int"))
    ledger = ledger.withColumn("created_at", F.col("created_at") + lag)
    d, schema, src = _landed(spark, "audit-docs", docs, "insert_ts")
    d2, schema2, src2 = _landed(spark, "audit-ledger", ledger, "created_at")
    out = ST.stream_audit_feeds(ST.read_stream(spark, src, schema), ST.read_stream(spark, src2, schema2), WAIT, message_source="fixture")
    ST.run_to_table(out, posixpath.join(d, "out"), posixpath.join(d, "chk"))
    found = spark.read.parquet(posixpath.join(d, "out"))
    last = docs.agg(F.max("insert_ts")).scalar()
    settled = F.col("ledger_hash").isNotNull() | (F.col("insert_ts") < last - F.expr("interval 1 hour"))
    return found.filter(settled).select("id", "current_hash", "ledger_hash", "status")


_VALID = "device_id IS NOT NULL AND device_id <> '' AND original_payload IS NOT NULL"


def _ingested(spark, sf, sink, feed):
    d, _, src = _messages(spark, sf, "s10")
    ST.ingest_stream(ST.read_stream(spark, src, RAW_SCHEMA), posixpath.join(d, "docs"), posixpath.join(d, "ledger"),
                     posixpath.join(d, "chk"), available_now=True, quarantine_sink=posixpath.join(d, "quarantine"), feeds=(feed,))
    return spark.read.parquet(posixpath.join(d, sink)).drop("batch_id")


register("ingest_stream", W(f"""
SELECT id AS _id, device_id, original_payload AS payload, processing_timestamp,
       enqueued_ts AS insert_ts, coalesce(status, 'processed') AS status
FROM env WHERE {_VALID}
QUALIFY row_number() OVER (PARTITION BY id ORDER BY enqueued_ts, seq) = 1""", _AGAIN), "streams")(
    lambda spark, sf: _ingested(spark, sf, "docs", "documents"))

register("ingest_stream_ledger", W(f"""
SELECT id, strftime(enqueued_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(enqueued_ts) % 1000000 = 0 THEN ''
         ELSE '.' || lpad(CAST(epoch_us(enqueued_ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS timestamp,
       device_id, 'consumption' AS data_type, length(id) > 0 AS hashed
FROM env WHERE {_VALID}
QUALIFY row_number() OVER (PARTITION BY id ORDER BY enqueued_ts, seq) = 1""", _AGAIN), "streams")(
    lambda spark, sf: _ingested(spark, sf, "ledger", "ledger").selectExpr("id", "timestamp", "device_id", "data_type", "length(hash_value) = 64 AS hashed"))

register("ingest_stream_quarantine", W(f"""
SELECT id, seq, device_id, original_payload IS NULL AS no_payload FROM env WHERE NOT ({_VALID})""", _AGAIN), "streams")(
    lambda spark, sf: _ingested(spark, sf, "quarantine", "quarantine").selectExpr("id", "seq", "device_id", "original_payload IS NULL AS no_payload"))
