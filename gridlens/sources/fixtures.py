"""Deterministic metering tables derived from the driver's tables.

``events`` becomes the ``readings`` table (one plug or meter reading per
event), ``orders`` becomes ``meter_days`` (one daily counter per customer over
several years), and the audit fixtures add a ledger and a tampered document
store.  Every derived column is a pure function of the source row (or of a
per-device-day running sum), so the same rows come out of any engine; the
matching SQL lives in :mod:`gridlens.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import READING_COLUMNS, READINGS_SCHEMA
from .tables import read_table

# Fixed values of the fixture rules.
METER_USER_MOD = 5          # user_id % 5 == 0 -> three-phase meter (no ENERGY)
NO_DEVICE_TIME_MOD = 7      # event_id % 7 == 0 -> payload without device time
PROCESSING_DELAY_S = 2
INSERT_DELAY_S = 5
LEDGER_MISSING_MOD = 101    # reading_id % 101 == 0 -> hash never reached the ledger
TAMPERED_MOD = 97           # reading_id % 97 == 0 -> stored Power changed by +1
DATA_TYPES = ["consumption", "production", "storage", "transmission"]
FIXTURE_SOURCE = "fixture"


TIME_UTC_MOD = 11           # reading_id % 11 == 0 -> payload with its own UTC time
TOTAL_START = "2023-01-01T00:00:00"


def _other_energy() -> dict:
    """The plug's further ENERGY fields, with few digits so that their text is the same in every engine."""
    p, t, r = F.col("power_dw"), F.col("today_ch"), F.col("reading_id")
    part = lambda x, n: x.cast("double") / n
    return {"current_a": part(p % 1000, 100), "power_factor": part(50 + r % 50, 100), "apparent_power_va": part(p + 50, 10),
            "reactive_power_var": part(p % 700, 10), "total_kwh": part(t + 100000, 100), "yesterday_kwh": part(r % 900, 100),
            "period_wh": (r % 60).cast("double"), "total_start_time": F.lit(TOTAL_START)}


def reading_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the integer units ``power_dw`` (0.1 W) and ``today_ch`` (0.01 kWh)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "props")
    base = ev.select(
        "event_id", "user_id", "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    # Synthesise the device's own midnight-resetting counter (ENERGY.Today) as a
    # running sum per device-day (real readings carry it from the device).  A
    # hot device-day is split by hour: hour totals (partial aggregate), their
    # prefix per device-day (<= 24 rows), plus a running sum inside each
    # device-hour -- no task ever holds a whole device-day.
    base = base.withColumn("_day", F.to_date("ts")).withColumn("_hour", F.hour("ts"))
    hours = base.groupBy("user_id", "_day", "_hour").agg(F.sum("cents").alias("_hsum"))
    before = Window.partitionBy("user_id", "_day").orderBy("_hour") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = hours.select("user_id", "_day", "_hour",
                           F.coalesce(F.sum("_hsum").over(before), F.lit(0)).alias("_offset"))
    base = base.join(offsets, ["user_id", "_day", "_hour"])
    day = Window.partitionBy("user_id", "_day", "_hour").orderBy("ts", "event_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    no_dev_time = (F.col("event_id") % NO_DEVICE_TIME_MOD) == 0
    processing = F.col("ts") + F.expr(f"INTERVAL {PROCESSING_DELAY_S} SECOND")
    event_ts = F.when(no_dev_time, processing).otherwise(F.col("ts"))
    has_energy = (F.col("user_id") % METER_USER_MOD) != 0
    fx = base.select(
        F.col("event_id").alias("reading_id"),
        "user_id",
        F.concat(F.lit("dev_"), F.col("user_id").cast("string")).alias("device_id"),
        F.when(F.col("user_id") % METER_USER_MOD == 0, "shelly_pro_3em").otherwise("tasmota").alias("device_type"),
        ((F.col("user_id") % 2) == 0).alias("is_simulated"),
        has_energy.alias("has_energy"),
        F.when(no_dev_time, F.lit(None)).otherwise(F.col("ts")).alias("payload_ts"),
        processing.alias("processing_ts"),
        (F.col("ts") + F.expr(f"INTERVAL {INSERT_DELAY_S} SECOND")).alias("insert_ts"),
        event_ts.alias("event_ts"),
        F.col("cents").alias("power_dw"),
        (F.col("_offset") + F.sum("cents").over(day)).cast("bigint").alias("today_ch"),
        (F.lit(220) + F.col("k") % 20).alias("voltage"),
    )
    he = F.col("has_energy")
    return fx.select(
        "reading_id",
        F.concat_ws("-", "device_id", F.col("reading_id").cast("string")).alias("doc_id"),
        "device_id", "device_type", "is_simulated", "has_energy", "user_id",
        "payload_ts", "processing_ts", "insert_ts", "event_ts",
        F.to_date("event_ts").alias("event_date"),
        F.when(he, F.col("power_dw").cast("double") / 10).alias("power_w"),
        F.when(he, F.col("today_ch").cast("double") / 100).alias("today_kwh"),
        F.when(he, F.col("voltage").cast("double")).alias("voltage_v"),
        F.when(~he, F.col("power_dw").cast("double") / 10).alias("meter_power_w"),
        *[F.when(he, v).alias(c) for c, v in _other_energy().items()],
        F.when(F.col("reading_id") % TIME_UTC_MOD == 0, F.col("processing_ts") - F.expr("INTERVAL 1 SECOND")).alias("time_utc"),
        F.when(F.col("is_simulated"), F.lit('{"simulated":true}')).alias("metadata"),
        "power_dw", "today_ch",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed ``readings`` table (see :mod:`gridlens.schema`)."""
    return reading_base(spark, sf_dir).select(*READING_COLUMNS)


def meter_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters over 1995-2001 from ``orders``; typed like ``readings``."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    device = F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"))
    today_ch = F.floor(F.col("o_totalprice") / 500).cast("bigint") * 100
    power_dw = F.floor(F.col("o_totalprice") / 100).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("reading_id"),
        F.concat_ws("-", device, F.col("o_orderkey").cast("string")).alias("doc_id"),
        device.alias("device_id"),
        F.lit("tasmota").alias("device_type"),
        F.lit(False).alias("is_simulated"),
        F.lit(True).alias("has_energy"),
        F.col("o_orderdate").alias("payload_ts"),
        F.col("o_orderdate").alias("processing_ts"),
        F.col("o_orderdate").alias("insert_ts"),
        F.col("o_orderdate").alias("event_ts"),
        F.to_date("o_orderdate").alias("event_date"),
        (power_dw.cast("double") / 10).alias("power_w"),
        (today_ch.cast("double") / 100).alias("today_kwh"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in READINGS_SCHEMA.fields[READING_COLUMNS.index("voltage_v"):]],
    )


def stored_documents(spark: SparkSession, sf_dir: str, tampered: bool = True) -> DataFrame:
    """Reading documents as the store holds them (typed envelope fields).

    With ``tampered`` every reading with ``reading_id % 97 == 0`` has its
    stored Power raised by one unit after hashing.
    """
    b = reading_base(spark, sf_dir)
    power = F.col("power_dw")
    if tampered:
        power = F.when(F.col("reading_id") % TAMPERED_MOD == 0, power + 1).otherwise(power)
    return b.select(
        F.col("doc_id").alias("id"),
        "device_id",
        F.lit(FIXTURE_SOURCE).alias("message_source"),
        F.struct(F.struct(power.cast("double").alias("Power"),
                          F.col("today_ch").cast("double").alias("Today")).alias("ENERGY")).alias("payload"),
        F.substring(F.col("processing_ts").cast("string"), 1, 19).alias("processing_timestamp"),
        F.lit("processed").alias("status"),
        "insert_ts",
        "user_id",
        "reading_id",
        "processing_ts",
    )


def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untampered documents with their canonical text and SHA-256 (``current_hash``)."""
    from ..operators.integrity import hash_documents
    return hash_documents(stored_documents(spark, sf_dir, tampered=False))


def ledger(spark: SparkSession, sf_dir: str, hashed: DataFrame | None = None) -> DataFrame:
    """Ledger of hashes of the untampered documents, minus ``reading_id % 101 == 0``."""
    docs = hashed if hashed is not None else hashed_documents(spark, sf_dir)
    types = F.array(*[F.lit(t) for t in DATA_TYPES])
    return docs.filter(F.col("reading_id") % LEDGER_MISSING_MOD != 0).select(
        "id", F.col("current_hash").alias("hash_value"), F.col("processing_ts").alias("ts"), "device_id",
        F.element_at(types, (F.col("user_id") % 4 + 1).cast("int")).alias("data_type"),
        F.col("insert_ts").alias("created_at"))


# Fixed values of the append-batch fixture: which rows get which defect.
BATCH_BLANK_ID_MOD, BATCH_SHORT_HASH_MOD, BATCH_BAD_TIME_MOD = 53, 59, 61
BATCH_BAD_DEVICE_MOD, BATCH_BAD_TYPE_MOD, BATCH_DUP_MOD = 67, 71, 43


def ledger_batch(spark: SparkSession, sf_dir: str, hashed: DataFrame | None = None) -> DataFrame:
    """Hash submissions for every document, with injected contract violations."""
    d = hashed if hashed is not None else hashed_documents(spark, sf_dir)
    rid = F.col("reading_id")
    types = F.array(*[F.lit(t) for t in DATA_TYPES])
    dtype = F.element_at(types, (F.col("user_id") % 4 + 1).cast("int"))
    dtype = F.when(F.col("user_id") % 3 == 0, F.upper(dtype)).otherwise(dtype)
    ts_text = F.concat(F.regexp_replace("processing_timestamp", " ", "T"), F.lit("Z"))
    return d.select(
        F.when(rid % BATCH_BLANK_ID_MOD == 0, F.lit(" "))
         .when(rid % BATCH_DUP_MOD == 0, F.concat(F.col("device_id"), F.lit("-dup")))
         .otherwise(F.col("id")).alias("id"),
        F.when(rid % BATCH_SHORT_HASH_MOD == 0, F.substring("current_hash", 1, 63))
         .otherwise(F.col("current_hash")).alias("hash_value"),
        F.when(rid % BATCH_BAD_TIME_MOD == 0, F.col("processing_timestamp")).otherwise(ts_text).alias("timestamp"),
        F.when(rid % BATCH_BAD_DEVICE_MOD == 0, F.concat(F.col("device_id"), F.lit("!")))
         .otherwise(F.col("device_id")).alias("device_id"),
        F.when(rid % BATCH_BAD_TYPE_MOD == 0, F.lit("energy_reading")).otherwise(dtype).alias("data_type"),
        rid.alias("seq"),
    )


# Fixed values of the raw-message fixture.
RAW_AGAIN_MOD, RAW_ANEW_MOD = 47, 53
RAW_OTHER_TOPIC_MOD, RAW_NO_ENERGY_MOD, RAW_DUPLICATE_MOD, RAW_METER_ENERGY_MOD = 50, 41, 43, 3


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device messages ``(topic, body, enqueued_ts, seq)`` built as JSON text from the readings.

    Meters (user_id % 5 == 0) publish power, every 3rd event energy totals;
    user_id % 5 == 1 uses the old lower-case ``energy`` body; every 50th event
    has an unknown topic, every 41st plug body has no energy, every 43rd is
    delivered twice (an exact redelivery).
    """
    b = reading_base(spark, sf_dir)
    rid, uid = F.col("reading_id"), F.col("user_id")
    t19 = F.substring(F.col("processing_ts").cast("string"), 1, 19)
    meter = uid % METER_USER_MOD == 0
    meter_energy = meter & (rid % RAW_METER_ENERGY_MOD == 0)
    topic = (F.when(rid % RAW_OTHER_TOPIC_MOD == 0, F.lit("other/x"))
             .when(meter_energy, F.concat(F.lit("shellypro3em-"), "device_id", F.lit("/status/emdata:0")))
             .when(meter, F.concat(F.lit("shellypro3em-"), "device_id", F.lit("/status/em:0")))
             .otherwise(F.concat(F.lit("tele/"), "device_id", F.lit("/SENSOR"))))
    p, t, v = (F.col(c).cast("string") for c in ("power_dw", "today_ch", "voltage_i"))
    energy_obj = F.concat(F.lit('{"Power":'), p, F.lit(',"Today":'), t, F.lit(',"Voltage":'), v, F.lit(',"Total":'), t,
                          F.lit(',"Current":1,"Factor":0.5,"ApparentPower":'), p, F.lit(',"ReactivePower":2,"Yesterday":3,"Period":4,"TotalStartTime":"'),
                          F.lit(TOTAL_START), F.lit('"}'))
    sim = F.when(uid % 2 == 0, F.lit("true")).otherwise(F.lit("false"))
    plug = (F.when(rid % RAW_NO_ENERGY_MOD == 0,
                   F.concat(F.lit('{"Time":"'), t19, F.lit('","Wifi":{"RSSI":'), v, F.lit("}}")))
            .when(uid % METER_USER_MOD == 1,
                  F.concat(F.lit('{"timestamp":"'), t19, F.lit('","energy":'), energy_obj, F.lit("}")))
            .otherwise(F.concat(F.lit('{"Time":"'), t19, F.lit('","ENERGY":'), energy_obj,
                                F.lit(',"_meta":{"simulated":'), sim, F.lit("}}"))))
    power_body = F.concat(F.lit('{"a_act_power":'), p, F.lit(',"b_act_power":0,"c_act_power":0,"a_voltage":'), v,
                          F.lit(',"total_act_power":'), p, F.lit(',"total_current":0,"n_current":0,"total_aprt_power":'),
                          p, F.lit("}"))
    energy_body = F.concat(F.lit('{"a_total_act_energy":'), t, F.lit(',"total_act":'), t, F.lit(',"total_act_ret":0}'))
    body = F.when(meter_energy, energy_body).when(meter, power_body).otherwise(plug)
    copies = F.when(rid % RAW_DUPLICATE_MOD == 0, F.lit(2)).otherwise(F.lit(1))   # redelivered as-is
    return (b.withColumn("voltage_i", F.coalesce(F.col("voltage_v").cast("bigint"), F.lit(230)))
            .select(topic.alias("topic"), body.alias("body"), F.col("processing_ts").alias("enqueued_ts"),
                    rid.alias("seq"), F.explode(F.sequence(F.lit(1), copies)).alias("_copy"))
            .drop("_copy"))


def redelivered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`raw_messages` with ``arrived_ts`` and redeliveries long after any watermark.

    Every 47th message comes again a day later as it was; every 53rd comes
    again with a new enqueue time (the same sequence number, so the same
    envelope id).  All others arrive when they are enqueued.
    """
    raw = raw_messages(spark, sf_dir)
    enqueued, later = F.col("enqueued_ts"), F.col("enqueued_ts") + F.make_dt_interval(days=F.lit(1), secs=F.lit(7.123))
    delivery = lambda enq, arr: F.struct(enq.alias("enqueued_ts"), arr.alias("arrived_ts"))
    # one pass over the messages: each gives one to three deliveries
    deliveries = F.array_compact(F.array(
        delivery(enqueued, enqueued),
        F.when(F.col("seq") % RAW_AGAIN_MOD == 0, delivery(enqueued, later)),
        F.when(F.col("seq") % RAW_ANEW_MOD == 0, delivery(later, later))))
    out = raw.withColumn("_d", F.explode(deliveries))
    return out.select("topic", "body", F.col("_d.enqueued_ts").alias("enqueued_ts"), "seq", F.col("_d.arrived_ts").alias("arrived_ts"))
