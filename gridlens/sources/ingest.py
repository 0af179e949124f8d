"""Ingest: raw device messages -> envelopes -> stored documents -> readings.

All parsing is ``from_json`` with declared schemas (no inference, no UDF);
dispatch by device type is a union of per-type projections; duplicates are
resolved per id with a window partitioned by id (first write wins), which
stays bounded per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ENERGY_COLUMNS, READING_COLUMNS, READINGS_SCHEMA

# Topic patterns, device types and source names.
PLUG_TOPIC_PREFIX, PLUG_TOPIC_SUFFIX = "tele/", "/SENSOR"
METER_TOPIC_MARK, METER_ENERGY_MARK = "shellypro3em", "emdata"
TYPE_PLUG, TYPE_METER_POWER, TYPE_METER_ENERGY, TYPE_UNKNOWN = "tasmota", "shelly_power", "shelly_energy_totals", "unknown"
STORED_TYPE = {TYPE_PLUG: "tasmota", TYPE_METER_POWER: "shelly_pro_3em", TYPE_METER_ENERGY: "shelly_pro_3em_energy"}
LOCAL_SOURCE = "LocalMQTTProcessor"
HUB_SOURCE = "AzureFunction-IoTHubProcessor"
DEFAULT_STATUS = "processed"

ENERGY_FIELDS = ["TotalStartTime", "Total", "Yesterday", "Today", "Period", "Power", "ApparentPower",
                 "ReactivePower", "Factor", "Voltage", "Current"]
_ENERGY = T.StructType([T.StructField(f, T.StringType() if f == "TotalStartTime" else T.DoubleType())
                        for f in ENERGY_FIELDS])
_PHASE_POWER = {"voltage": "voltage", "current": "current", "power": "act_power",
                "apparentPower": "aprt_power", "powerFactor": "pf", "frequency": "freq"}
METER_POWER_BODY = T.StructType(
    [T.StructField(f"{p}_{src}", T.DoubleType()) for p in "abc" for src in _PHASE_POWER.values()]
    + [T.StructField(n, T.DoubleType()) for n in ("n_current", "total_current", "total_act_power", "total_aprt_power")])
METER_ENERGY_BODY = T.StructType(
    [T.StructField(f"{p}_{k}", T.DoubleType()) for p in "abc" for k in ("total_act_energy", "total_act_ret_energy")]
    + [T.StructField(n, T.DoubleType()) for n in ("total_act", "total_act_ret")])
RAW_SCHEMA = "topic STRING, body STRING, enqueued_ts TIMESTAMP_NTZ, seq BIGINT"


def read_readings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan stored readings with the declared schema (Parquet or JSON lines)."""
    reader = spark.read.schema(READINGS_SCHEMA)
    return reader.parquet(path) if fmt == "parquet" else reader.json(path)


def device_from_topic(df: DataFrame, topic: str = "topic") -> DataFrame:
    """``device_type`` and ``device_id`` from the message topic."""
    t = F.col(topic)
    dtype = (F.when(t.startswith(PLUG_TOPIC_PREFIX) & t.endswith(PLUG_TOPIC_SUFFIX), F.lit(TYPE_PLUG))
             .when(t.contains(METER_TOPIC_MARK),
                   F.when(t.contains(METER_ENERGY_MARK), F.lit(TYPE_METER_ENERGY)).otherwise(F.lit(TYPE_METER_POWER)))
             .otherwise(F.lit(TYPE_UNKNOWN)))
    parts = F.split(t, "/")
    seg = F.when(dtype == TYPE_PLUG, F.get(parts, 1)).when(dtype != TYPE_UNKNOWN, F.get(parts, 0))
    dev = F.when(dtype == TYPE_UNKNOWN, F.lit("unknown")).otherwise(
        F.when(F.coalesce(seg, F.lit("")) == "", F.lit("unknown")).otherwise(seg))
    return df.withColumn("device_type", dtype).withColumn("device_id", dev)


def normalize_plug(df: DataFrame, body: str = "body") -> DataFrame:
    """S3: plug body -> ``time_text``, the 11 ENERGY fields, ``metadata``; rows without energy dropped.

    ``ENERGY`` and the older lower-case ``energy`` differ only in case, so the
    top level is read as a text map and the chosen object parsed with its schema.
    """
    top = F.from_json(F.col(body), "map<string,string>")
    return (df.withColumn("_top", top).withColumn("_et", F.coalesce(F.col("_top")["ENERGY"], F.col("_top")["energy"]))
              .filter(F.col("_et").isNotNull())
              .withColumn("_e", F.from_json(F.col("_et"), _ENERGY))
              .select(*[c for c in df.columns if c != body],
                      F.coalesce(F.col("_top")["Time"], F.col("_top")["timestamp"]).alias("time_text"),
                      *[F.col(f"_e.{f}").alias(f) for f in ENERGY_FIELDS],
                      F.col("_top")["_meta"].alias("metadata")))


def normalize_phase_power(df: DataFrame, body: str = "body") -> DataFrame:
    """Flat ``a_* b_* c_*`` meter fields -> nested ``phases`` plus four totals."""
    b = F.from_json(F.col(body), METER_POWER_BODY)
    phases = F.struct(*[F.struct(*[b[f"{p}_{src}"].alias(k) for k, src in _PHASE_POWER.items()]).alias(p)
                        for p in "abc"])
    return df.select(*[c for c in df.columns if c != body], phases.alias("phases"),
                     b["total_act_power"].alias("totalPower"), b["total_current"].alias("totalCurrent"),
                     b["total_aprt_power"].alias("totalApparentPower"), b["n_current"].alias("neutralCurrent"))


def normalize_phase_energy(df: DataFrame, body: str = "body") -> DataFrame:
    """Per-phase energy totals and returned energy, plus the two totals."""
    b = F.from_json(F.col(body), METER_ENERGY_BODY)
    phases = F.struct(*[F.struct(b[f"{p}_total_act_energy"].alias("total"),
                                 b[f"{p}_total_act_ret_energy"].alias("returned")).alias(p) for p in "abc"])
    return df.select(*[c for c in df.columns if c != body], phases.alias("phases"),
                     b["total_act"].alias("total"), b["total_act_ret"].alias("totalReturned"))


def _millis(ts):
    return F.unix_millis(ts.cast("timestamp"))


def _phases() -> F.Column:
    """Per phase the six power fields and both energy counters, NULL where the message has none."""
    power = lambda p: [F.col(f"_pw.{p}_{src}").alias(k) for k, src in _PHASE_POWER.items()]
    energy = lambda p: [F.col(f"_en.{p}_total_act_energy").alias("total"), F.col(f"_en.{p}_total_act_ret_energy").alias("returned")]
    return F.struct(*[F.struct(*power(p), *energy(p)).alias(p) for p in "abc"])


def normalize_messages(raw: DataFrame) -> DataFrame:
    """Dispatch by type, drop unknown and energy-less plug messages, add document fields.

    One pass over the input: each body is parsed only by the schema of its
    device type (``CASE WHEN`` short-circuits ``from_json``), so there is no
    per-type branch and no union.  ``_id`` is ``<device>-<epoch millis of
    processing>``; processing and insert time are the message's enqueue time.
    Output is typed like ``readings`` plus ``topic``, ``status``,
    ``message_source``, ``time_text``, the meter's energy totals and its phases.
    """
    d = device_from_topic(raw)
    kind = F.col("device_type")
    top = F.when(kind == TYPE_PLUG, F.from_json(F.col("body"), "map<string,string>"))
    d = d.withColumn("_top", top)
    e_text = F.coalesce(F.col("_top")["ENERGY"], F.col("_top")["energy"])
    d = (d.withColumn("_e", F.when(kind == TYPE_PLUG, F.from_json(e_text, _ENERGY)))
          .withColumn("_pw", F.when(kind == TYPE_METER_POWER, F.from_json(F.col("body"), METER_POWER_BODY)))
          .withColumn("_en", F.when(kind == TYPE_METER_ENERGY, F.from_json(F.col("body"), METER_ENERGY_BODY)))
          .filter((kind != TYPE_UNKNOWN) & ((kind != TYPE_PLUG) | e_text.isNotNull())))
    stored = F.create_map(*[x for k, v in STORED_TYPE.items() for x in (F.lit(k), F.lit(v))])
    sim = F.get_json_object(F.col("_top")["_meta"], "$.simulated").try_cast("boolean")
    return d.select(
        F.col("seq").alias("reading_id"),
        F.concat_ws("-", "device_id", _millis(F.col("enqueued_ts")).cast("string")).alias("doc_id"),
        "device_id", F.element_at(stored, kind).alias("device_type"),
        F.coalesce(sim, F.lit(False)).alias("is_simulated"), (kind == TYPE_PLUG).alias("has_energy"),
        F.lit(None).cast("timestamp_ntz").alias("payload_ts"),
        F.col("enqueued_ts").alias("processing_ts"), F.col("enqueued_ts").alias("insert_ts"),
        F.col("enqueued_ts").alias("event_ts"), F.to_date("enqueued_ts").alias("event_date"),
        *[F.col(f"_e.{f}").alias(c) for c, f in ENERGY_COLUMNS.items()],
        F.col("_pw.total_act_power").alias("meter_power_w"), F.col("_en.total_act").alias("meter_energy_total"),
        F.col("_en.total_act_ret").alias("meter_energy_returned"), _phases().alias("phases"),
        _utc_ntz(F.get_json_object(F.col("_top")["TIME"], "$.UTC")).alias("time_utc"), F.col("_top")["_meta"].alias("metadata"),
        F.coalesce(F.col("_top")["Time"], F.col("_top")["timestamp"]).alias("time_text"),
        "topic", F.lit(DEFAULT_STATUS).alias("status"), F.lit(LOCAL_SOURCE).alias("message_source"))


def iso_text(ts) -> F.Column:
    """Python ``isoformat()`` of a UTC instant: fraction only when micros != 0, ``+00:00``."""
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    frac = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))


def wrap_messages(raw: DataFrame) -> DataFrame:
    """Hub envelope ``(id = device-seq, deviceId, originalPayload, processingTimestamp, status, messageSource)``.

    The device comes from the transport (column ``transport_device_id``) where
    the input has it, else from the topic.  The id is always built, with
    ``None`` for a missing device, so no two messages share one.  A body that
    isn't a JSON object gives no payload.
    """
    d = device_from_topic(raw)
    dev = F.when(F.col("device_id") == "unknown", F.lit(None)).otherwise(F.col("device_id"))
    if "transport_device_id" in raw.columns:
        dev = F.col("transport_device_id")
    json_object = F.col("body").rlike(r"^[ \t\r\n]*\{") & F.expr("try_parse_json(body)").isNotNull()
    return d.select(
        F.concat_ws("-", F.coalesce(dev, F.lit("None")), F.col("seq").cast("string")).alias("id"),
        dev.alias("device_id"),
        F.when(json_object, F.col("body")).alias("original_payload"),
        iso_text(F.col("enqueued_ts")).alias("processing_timestamp"),
        F.lit(DEFAULT_STATUS).alias("status"), F.lit(HUB_SOURCE).alias("message_source"),
        "enqueued_ts", "seq")


def reject_invalid(envelopes: DataFrame) -> DataFrame:
    """``reason`` for envelopes missing a required property (NULL = good)."""
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(n))  # one look at each: a filter on ``reason`` repeats the column's parsing
               for c, n in (("id", "id"), ("device_id", "deviceId"),
                            ("processing_timestamp", "processingTimestamp"), ("original_payload", "originalPayload"))]
    miss = F.concat_ws(",", *missing)
    return envelopes.withColumn("reason", F.when(miss != "", F.concat(F.lit("missing: "), miss)))


def store_messages(envelopes: DataFrame, order_col: str = "enqueued_ts") -> DataFrame:
    """Envelope -> stored document; a duplicate ``_id`` is rejected (first write wins)."""
    docs = envelopes.withColumn("_id", F.col("id"))
    w = Window.partitionBy("_id").orderBy(order_col, "seq")
    first = docs.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return first.select("_id", "device_id", F.col("original_payload").alias("payload"),
                        "processing_timestamp", F.col("enqueued_ts").alias("insert_ts"),
                        F.coalesce("status", F.lit(DEFAULT_STATUS)).alias("status"))


def _utc_ntz(text_col) -> F.Column:
    """ISO-8601 text (with or without zone; 'T' or space) -> UTC TIMESTAMP_NTZ, NULL when unparsable."""
    return F.to_utc_timestamp(F.try_to_timestamp(text_col), "UTC").cast("timestamp_ntz")


def documents_to_readings(docs: DataFrame) -> DataFrame:
    """Stored documents (S8: raw JSON payload) -> the typed ``readings`` table.

    ``payload.timestamp`` (device time, optional) and the processing time are
    ISO text; the energy object is ``ENERGY`` or the older ``energy``.  The
    store's documents carry no device type, so it is left NULL (device lists
    default it); three-phase payloads keep ``totalPower``.
    """
    top = F.from_json(F.col("payload"), "map<string,string>")
    d = docs.withColumn("_top", top)
    e_text = F.coalesce(F.col("_top")["ENERGY"], F.col("_top")["energy"])
    d = d.withColumn("_e", F.from_json(e_text, _ENERGY))
    processing = _utc_ntz(F.col("processing_timestamp"))
    payload_ts = _utc_ntz(F.col("_top")["timestamp"])
    event_ts = F.coalesce(payload_ts, processing)
    seq = F.regexp_extract(F.col("_id"), r"-(\d+)$", 1)
    return d.select(
        F.when(seq != "", seq.cast("bigint")).alias("reading_id"),
        F.col("_id").alias("doc_id"), "device_id", F.lit(None).cast("string").alias("device_type"),
        F.lit(False).alias("is_simulated"), e_text.isNotNull().alias("has_energy"),
        payload_ts.alias("payload_ts"), processing.alias("processing_ts"), F.col("insert_ts"),
        event_ts.alias("event_ts"), F.to_date(event_ts).alias("event_date"),
        *[F.col(f"_e.{f}").alias(c) for c, f in ENERGY_COLUMNS.items()],
        F.get_json_object(F.col("payload"), "$.total_act_power").try_cast("double").alias("meter_power_w"),
        _utc_ntz(F.get_json_object(F.col("_top")["TIME"], "$.UTC")).alias("time_utc"), F.col("_top")["_meta"].alias("metadata"),
    ).select(*READING_COLUMNS)
