"""Sources and sinks: Parquet/JSON round trip (S1), CSV export (S11), dual-sink stream."""

import csv
import glob
import os
import posixpath

from pyspark.sql import functions as F

from conftest import SMALL
from gridlens.operators import integrity as H
from gridlens.operators import reports as R
from gridlens.schema import READING_COLUMNS
from gridlens.sources import fixtures as fx
from gridlens.sources import ingest as I
from gridlens.sources.ingest import RAW_SCHEMA, read_readings
from gridlens.sources.sinks import export_report_csv, write_table
from gridlens.streaming import streams as ST


def _same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_readings_parquet_and_json_round_trip(spark):
    base = ST.work_dir(spark, "s1")
    r = fx.readings(spark, SMALL)
    write_table(r, posixpath.join(base, "pq"))
    back = read_readings(spark, posixpath.join(base, "pq")).select(*READING_COLUMNS)
    assert _same(back, r)
    r.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(posixpath.join(base, "js"))
    assert _same(read_readings(spark, posixpath.join(base, "js"), fmt="json").select(*READING_COLUMNS), r)


def test_report_csv_file(spark):
    base = ST.work_dir(spark, "s11")
    rep = R.daily_report(fx.readings(spark, SMALL))
    export_report_csv(rep, posixpath.join(base, "csv"))
    files = glob.glob(os.path.join(base, "csv", "period_start=2024-01-15", "*.csv"))
    assert len(files) == 1
    with open(files[0], newline="") as fh:
        rows = list(csv.reader(fh))
    assert rows[0] == ["Time", "Energy (kWh)", "Peak Power (W)", "Cost", "TariffType"]
    assert all(r[0].endswith(":00") and len(r[0]) == 5 for r in rows[1:])
    expected = rep.filter(F.col("period_start") == "2024-01-15").count()
    assert len(rows) - 1 == expected


def test_dual_sink_stream_matches_batch(spark):
    base = ST.work_dir(spark, "s10")
    raw = fx.raw_messages(spark, SMALL)
    src = ST.land_files(raw, posixpath.join(base, "in"), "enqueued_ts", files=3)
    ST.ingest_stream(ST.read_stream(spark, src, RAW_SCHEMA), posixpath.join(base, "docs"),
                     posixpath.join(base, "ledger"), posixpath.join(base, "chk"), available_now=True)
    ledger = spark.read.parquet(posixpath.join(base, "ledger")).drop("batch_id")
    env = I.reject_invalid(I.wrap_messages(raw)).filter("reason IS NULL").dropDuplicates(["id"])
    batch = H.hash_documents(env.withColumnRenamed("original_payload", "payload"))
    assert _same(ledger.select("id", "hash_value"), batch.select("id", F.col("current_hash").alias("hash_value")))
    q = spark.read.parquet(posixpath.join(base, "docs", "_quarantine"))
    checked = I.reject_invalid(I.wrap_messages(raw))
    assert q.count() == checked.filter("reason IS NOT NULL").count() > 0 and q.filter("reason IS NULL").count() == 0
    # every message is stored, a redelivery of a stored one, or quarantined
    docs = spark.read.parquet(posixpath.join(base, "docs"))
    valid = checked.filter("reason IS NULL")
    assert docs.count() == valid.select("id").distinct().count() and raw.count() == q.count() + valid.count()


def test_cloud_path_documents_feed_reports(spark):
    docs = I.store_messages(I.wrap_messages(fx.raw_messages(spark, SMALL)))
    readings = I.documents_to_readings(docs)
    assert readings.columns == READING_COLUMNS
    rep = R.daily_report(readings).collect()
    assert rep and all(r.energy >= 0 and r.tariff_type in ("low", "high") for r in rep)
    # plug payloads without device time fall back to processing time
    assert readings.filter("payload_ts IS NULL AND has_energy").filter("event_ts <> processing_ts").count() == 0


def test_stream_ingest_publishes_input_metrics(spark):
    base = ST.work_dir(spark, "t1")
    src = ST.land_files(fx.raw_messages(spark, SMALL), posixpath.join(base, "in"), "enqueued_ts", files=2)
    q = ST.run_to_table(ST.stream_ingest(ST.read_stream(spark, src, RAW_SCHEMA)), posixpath.join(base, "out"),
                        posixpath.join(base, "chk"))
    seen = [p["observedMetrics"]["ingest_input"]["rows"] for p in q.recentProgress
            if "ingest_input" in p.get("observedMetrics", {})]
    assert sum(seen) == I.normalize_messages(fx.raw_messages(spark, SMALL)).count()


def _messages(spark, rows):
    """(seq, minute, power) device messages."""
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    body = '{"Time":"2024-01-01T00:00:00","ENERGY":{"Power":%s,"Today":1,"Voltage":230}}'
    return spark.createDataFrame([("tele/dev_1/SENSOR", body % p, base + dt.timedelta(minutes=m), s) for s, m, p in rows], RAW_SCHEMA)


def test_first_write_wins_after_any_watermark_and_against_the_store(spark):
    """Redeliveries hours later, in later runs of the query, and ids stored before it began."""
    base = ST.work_dir(spark, "first")
    batches = [[(1, 0, 10), (2, 1, 20)], [(1, 300, 11), (3, 301, 30)], [(2, 900, 21), (4, -500, 40), (9, 901, 90)]]
    known = spark.createDataFrame([("dev_1-9",)], "id string")
    src = posixpath.join(base, "in")
    for rows in batches:  # each batch is a run of its own from the same checkpoint
        _messages(spark, rows).coalesce(1).write.mode("append").parquet(src)
        ST.ingest_stream(ST.read_stream(spark, src, RAW_SCHEMA), posixpath.join(base, "docs"), posixpath.join(base, "ledger"), posixpath.join(base, "chk"),
                         stored=known, available_now=True)
    docs = {r._id: r.payload for r in spark.read.parquet(posixpath.join(base, "docs")).collect()}
    assert {k: v.split('"Power":')[1].split(",")[0] for k, v in docs.items()} == {"dev_1-1": "10", "dev_1-2": "20", "dev_1-3": "30", "dev_1-4": "40"}
    assert sorted(r.id for r in spark.read.parquet(posixpath.join(base, "ledger")).select("id").collect()) == sorted(docs)


def test_late_rows_are_kept_and_merged(spark):
    import datetime as dt
    base = ST.work_dir(spark, "late")
    start = dt.datetime(2024, 1, 1)
    batches = [[(0, 100.0), (30, 300.0)], [(90, 50.0), (200, 70.0)], [(20, 500.0), (210, 90.0), (205, None)]]
    src = posixpath.join(base, "in")
    for rows in batches:
        spark.createDataFrame([(start + dt.timedelta(minutes=m), p) for m, p in rows], "processing_ts timestamp_ntz, power_w double").coalesce(1).write.mode("append").parquet(src)
        stream = ST.read_stream(spark, src, spark.read.parquet(src).schema)
        ST.stream_hourly_totals(stream, posixpath.join(base, "out"), posixpath.join(base, "chk"), delay="1 hour", available_now=True)
    hour = lambda h: start + dt.timedelta(hours=h)
    rows = lambda corrected: {r.timestamp: (r.value, r["count"], r.late) for r in ST.hourly_totals(spark, posixpath.join(base, "out"), corrected).collect()}
    assert rows(False) == {hour(0): (200.0, 2, 0), hour(1): (50.0, 1, 0), hour(3): (80.0, 2, 0)}
    assert rows(True) == {hour(0): (300.0, 3, 1), hour(1): (50.0, 1, 0), hour(3): (80.0, 2, 0)}
    assert [r.power_w for r in spark.read.parquet(posixpath.join(base, "out", "late_rows")).collect()] == [500.0]


def test_audit_of_feeds_waits_for_the_ledger(spark):
    """A ledger row that comes three minutes after its document gives SUCCESS; one that never comes an ERROR, after the wait."""
    import datetime as dt
    base = ST.work_dir(spark, "feeds")
    docs = fx.stored_documents(spark, SMALL, False).orderBy("insert_ts").limit(40)
    hashes = H.hash_documents(docs, message_source="fixture").select("id", F.col("current_hash").alias("hash_value"), F.col("insert_ts").alias("created_at"))
    ids = [r.id for r in docs.select("id").orderBy("insert_ts").collect()]
    ledger = hashes.filter(F.col("id") != ids[3]).withColumn("hash_value", F.when(F.col("id") == ids[5], F.lit("0" * 64)).otherwise(F.col("hash_value"))) \
        .withColumn("created_at", F.col("created_at") + F.expr("interval 3 minutes"))
    ST.land_files(docs, posixpath.join(base, "docs"), "insert_ts", 4)
    ST.land_files(ledger, posixpath.join(base, "ledger"), "created_at", 4)
    read = lambda name, df: ST.read_stream(spark, posixpath.join(base, name), df.schema)
    out = ST.stream_audit_feeds(read("docs", docs), read("ledger", ledger), "10 minutes", message_source="fixture")
    ST.run_to_table(out, posixpath.join(base, "out"), posixpath.join(base, "chk"))
    got = {r.id: r.status for r in spark.read.parquet(posixpath.join(base, "out")).collect()}
    assert got[ids[3]] == H.STATUS_MISSING and got[ids[5]] == H.STATUS_TAMPER
    assert {i for i, s in got.items() if s == H.STATUS_OK} == set(ids) - {ids[3], ids[5]}


def test_a_body_with_leading_white_space_is_a_json_object(spark):
    import datetime as dt
    rows = [("tele/d/SENSOR", b, dt.datetime(2024, 1, 1), i) for i, b in enumerate([' \n{"a":1}', "[1]", " x", '{"a":'])]
    env = I.wrap_messages(spark.createDataFrame(rows, RAW_SCHEMA)).orderBy("seq").collect()
    assert [r.original_payload is not None for r in env] == [True, False, False, False]


def test_streams_deal_their_rows_before_parsing_and_hashing(spark):
    """A micro-batch of one file is read by one task; parsing and hashing run behind a shuffle, in all of them."""
    base = ST.work_dir(spark, "dealt")
    raw, docs = _messages(spark, [(1, 0, 10)]), fx.stored_documents(spark, SMALL, False).limit(1)
    ledger = docs.select("id", F.lit("0" * 64).alias("hash_value"), F.col("insert_ts").alias("created_at"))
    for name, df in (("raw", raw), ("docs", docs), ("ledger", ledger)):
        df.write.parquet(posixpath.join(base, name))
    read = lambda name, df: ST.read_stream(spark, posixpath.join(base, name), df.schema)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    below = lambda text, mark: "RepartitionByExpression" in text[text.rindex(mark):]
    assert below(plan(ST.stream_ingest(read("raw", raw))), "from_json")
    assert below(plan(ST.stream_audit_feeds(read("docs", docs), read("ledger", ledger))), "sha2")


def test_redelivered_messages_build_the_messages_once(spark):
    out = fx.redelivered_messages(spark, SMALL)
    raw = fx.raw_messages(spark, SMALL)
    again, anew = raw.filter("seq % 47 = 0").count(), raw.filter("seq % 53 = 0").count()
    assert out.count() == raw.count() + again + anew
    assert out.filter("arrived_ts > enqueued_ts").count() == again
    once = raw._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == once
