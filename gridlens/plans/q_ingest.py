"""Registered ingest queries (S2-S9) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources import ingest as I
from . import oracle as O
from .registry import register

W = O.with_fixtures

_RAW = """
rsrc AS (SELECT *, substr(CAST(processing_ts AS VARCHAR), 1, 19) AS t19,
                CAST(coalesce(CAST(voltage_v AS BIGINT), 230) AS VARCHAR) AS v,
                CAST(power_dw AS VARCHAR) AS p, CAST(today_ch AS VARCHAR) AS t FROM rbase),
rsrc2 AS (SELECT *, '{"Power":' || p || ',"Today":' || t || ',"Voltage":' || v || ',"Total":' || t
                      || ',"Current":1,"Factor":0.5,"ApparentPower":' || p
                      || ',"ReactivePower":2,"Yesterday":3,"Period":4,"TotalStartTime":"2023-01-01T00:00:00"}' AS eobj,
                 CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS sim FROM rsrc),
rawm0 AS (
  SELECT CASE WHEN reading_id % 50 = 0 THEN 'other/x'
              WHEN user_id % 5 = 0 AND reading_id % 3 = 0 THEN 'shellypro3em-' || device_id || '/status/emdata:0'
              WHEN user_id % 5 = 0 THEN 'shellypro3em-' || device_id || '/status/em:0'
              ELSE 'tele/' || device_id || '/SENSOR' END AS topic,
         CASE WHEN user_id % 5 = 0 AND reading_id % 3 = 0
                THEN '{"a_total_act_energy":' || t || ',"total_act":' || t || ',"total_act_ret":0}'
              WHEN user_id % 5 = 0
                THEN '{"a_act_power":' || p || ',"b_act_power":0,"c_act_power":0,"a_voltage":' || v
                     || ',"total_act_power":' || p || ',"total_current":0,"n_current":0,"total_aprt_power":' || p || '}'
              WHEN reading_id % 41 = 0 THEN '{"Time":"' || t19 || '","Wifi":{"RSSI":' || v || '}}'
              WHEN user_id % 5 = 1 THEN '{"timestamp":"' || t19 || '","energy":' || eobj || '}'
              ELSE '{"Time":"' || t19 || '","ENERGY":' || eobj || ',"_meta":{"simulated":' || sim || '}}' END AS body,
         processing_ts AS enqueued_ts, reading_id AS seq
  FROM rsrc2),
rawm AS (SELECT * FROM rawm0 UNION ALL
         SELECT topic, body, enqueued_ts, seq FROM rawm0 WHERE seq % 43 = 0),
dt AS (SELECT *, CASE WHEN starts_with(topic, 'tele/') AND ends_with(topic, '/SENSOR') THEN 'tasmota'
                      WHEN contains(topic, 'shellypro3em') THEN
                        CASE WHEN contains(topic, 'emdata') THEN 'shelly_energy_totals' ELSE 'shelly_power' END
                      ELSE 'unknown' END AS device_type FROM rawm),
typed AS (SELECT *, CASE WHEN device_type = 'unknown' THEN 'unknown'
                         ELSE coalesce(nullif(CASE WHEN device_type = 'tasmota' THEN split_part(topic, '/', 2)
                                                   ELSE split_part(topic, '/', 1) END, ''), 'unknown') END AS device_id
          FROM dt),
plug AS (
  SELECT seq, topic, enqueued_ts, device_type, device_id,
         coalesce(body->>'$.Time', body->>'$.timestamp') AS time_text,
         CAST(json_extract(et, '$.Power') AS DOUBLE) AS Power, CAST(json_extract(et, '$.Today') AS DOUBLE) AS Today,
         CAST(json_extract(et, '$.Voltage') AS DOUBLE) AS Voltage, CAST(json_extract(et, '$.Total') AS DOUBLE) AS Total,
         CAST(json_extract(et, '$.Current') AS DOUBLE) AS Current, CAST(json_extract(et, '$.Factor') AS DOUBLE) AS Factor,
         CAST(json_extract(et, '$.ApparentPower') AS DOUBLE) AS ApparentPower, CAST(json_extract(et, '$.ReactivePower') AS DOUBLE) AS ReactivePower,
         CAST(json_extract(et, '$.Yesterday') AS DOUBLE) AS Yesterday, CAST(json_extract(et, '$.Period') AS DOUBLE) AS Period,
         et->>'$.TotalStartTime' AS TotalStartTime,
         CAST(json_extract(body, '$._meta') AS VARCHAR) AS metadata
  FROM (SELECT *, coalesce(json_extract(body, '$.ENERGY'), json_extract(body, '$.energy')) AS et
        FROM typed WHERE device_type = 'tasmota') x
  WHERE et IS NOT NULL),
mpow AS (
  SELECT seq, topic, enqueued_ts, device_type, device_id,
         CAST(json_extract(body, '$.a_voltage') AS DOUBLE) AS a_voltage, CAST(json_extract(body, '$.a_act_power') AS DOUBLE) AS a_power,
         CAST(json_extract(body, '$.b_act_power') AS DOUBLE) AS b_power, CAST(json_extract(body, '$.c_act_power') AS DOUBLE) AS c_power,
         CAST(json_extract(body, '$.b_voltage') AS DOUBLE) AS b_voltage,
         CAST(json_extract(body, '$.total_act_power') AS DOUBLE) AS total_power,
         CAST(json_extract(body, '$.total_current') AS DOUBLE) AS total_current,
         CAST(json_extract(body, '$.total_aprt_power') AS DOUBLE) AS total_apparent_power,
         CAST(json_extract(body, '$.n_current') AS DOUBLE) AS neutral_current
  FROM typed WHERE device_type = 'shelly_power'),
menergy AS (
  SELECT seq, topic, enqueued_ts, device_type, device_id,
         CAST(json_extract(body, '$.a_total_act_energy') AS DOUBLE) AS a_total,
         CAST(json_extract(body, '$.a_total_act_ret_energy') AS DOUBLE) AS a_returned,
         CAST(json_extract(body, '$.total_act') AS DOUBLE) AS total,
         CAST(json_extract(body, '$.total_act_ret') AS DOUBLE) AS total_returned
  FROM typed WHERE device_type = 'shelly_energy_totals'),
env AS (
  SELECT CASE WHEN device_id = 'unknown' THEN 'None' ELSE device_id END || '-' || CAST(seq AS VARCHAR) AS id,
         CASE WHEN device_id = 'unknown' THEN NULL ELSE device_id END AS device_id,
         CASE WHEN starts_with(body, '{') AND json_valid(body) THEN body END AS original_payload,
         strftime(enqueued_ts, '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN epoch_us(enqueued_ts) % 1000000 = 0 THEN ''
                   ELSE '.' || lpad(CAST(epoch_us(enqueued_ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'
           AS processing_timestamp,
         'processed' AS status, 'AzureFunction-IoTHubProcessor' AS message_source, enqueued_ts, seq
  FROM typed)"""

register("device_from_topic", W("SELECT seq, topic, device_type, device_id FROM typed", _RAW), "ingest")(
    lambda spark, sf: I.device_from_topic(fx.raw_messages(spark, sf)).select("seq", "topic", "device_type", "device_id"))

register("normalize_plug", W("""SELECT seq, device_id, time_text, Power, Today, Voltage, Total, "Current", Factor, ApparentPower, ReactivePower,
                                   Yesterday, Period, TotalStartTime, metadata FROM plug""", _RAW),
         "ingest")(
    lambda spark, sf: I.normalize_plug(I.device_from_topic(fx.raw_messages(spark, sf)).filter("device_type = 'tasmota'"))
    .select("seq", "device_id", "time_text", *I.ENERGY_FIELDS, "metadata"))


@register("normalize_phase_power", W("""
SELECT seq, device_id, a_voltage, a_power, b_power, c_power, b_voltage, total_power, total_current,
       total_apparent_power, neutral_current FROM mpow""", _RAW), "ingest")
def q_phase_power(spark, sf):
    d = I.normalize_phase_power(I.device_from_topic(fx.raw_messages(spark, sf)).filter("device_type = 'shelly_power'"))
    return d.select("seq", "device_id", F.col("phases.a.voltage").alias("a_voltage"), F.col("phases.a.power").alias("a_power"),
                    F.col("phases.b.power").alias("b_power"), F.col("phases.c.power").alias("c_power"),
                    F.col("phases.b.voltage").alias("b_voltage"), F.col("totalPower").alias("total_power"),
                    F.col("totalCurrent").alias("total_current"), F.col("totalApparentPower").alias("total_apparent_power"),
                    F.col("neutralCurrent").alias("neutral_current"))


@register("normalize_phase_energy", W("SELECT seq, device_id, a_total, a_returned, total, total_returned FROM menergy", _RAW),
          "ingest")
def q_phase_energy(spark, sf):
    d = I.normalize_phase_energy(I.device_from_topic(fx.raw_messages(spark, sf)).filter("device_type = 'shelly_energy_totals'"))
    return d.select("seq", "device_id", F.col("phases.a.total").alias("a_total"), F.col("phases.a.returned").alias("a_returned"),
                    "total", F.col("totalReturned").alias("total_returned"))


_NORMALIZE_SQL = """
SELECT seq AS reading_id, device_id || '-' || CAST(epoch_us(enqueued_ts) // 1000 AS VARCHAR) AS doc_id, device_id,
       CASE device_type WHEN 'tasmota' THEN 'tasmota' WHEN 'shelly_power' THEN 'shelly_pro_3em'
                        ELSE 'shelly_pro_3em_energy' END AS device_type,
       coalesce(is_simulated, false) AS is_simulated, has_energy, CAST(NULL AS TIMESTAMP) AS payload_ts,
       enqueued_ts AS processing_ts, enqueued_ts AS insert_ts, enqueued_ts AS event_ts,
       CAST(enqueued_ts AS DATE) AS event_date, power_w, today_kwh, voltage_v, meter_power_w, meter_energy_total,
       current_a, power_factor, apparent_power_va, reactive_power_var, total_kwh, yesterday_kwh, period_wh, total_start_time,
       CAST(NULL AS TIMESTAMP) AS time_utc, metadata, a_power, a_voltage, b_power, a_total, total_returned, time_text, topic, 'processed' AS status, 'LocalMQTTProcessor' AS message_source
FROM (
  SELECT seq, topic, enqueued_ts, device_id, device_type, true AS has_energy, time_text, Power AS power_w,
         Today AS today_kwh, Voltage AS voltage_v, coalesce(CAST(json_extract(metadata, '$.simulated') AS BOOLEAN), false)
         AS is_simulated, CAST(NULL AS DOUBLE) AS meter_power_w, CAST(NULL AS DOUBLE) AS meter_energy_total,
         "Current" AS current_a, Factor AS power_factor, ApparentPower AS apparent_power_va, ReactivePower AS reactive_power_var, Total AS total_kwh,
         Yesterday AS yesterday_kwh, Period AS period_wh, TotalStartTime AS total_start_time, metadata,
         CAST(NULL AS DOUBLE) AS a_power, CAST(NULL AS DOUBLE) AS a_voltage, CAST(NULL AS DOUBLE) AS b_power, CAST(NULL AS DOUBLE) AS a_total,
         CAST(NULL AS DOUBLE) AS total_returned FROM plug
  UNION ALL
  SELECT seq, topic, enqueued_ts, device_id, device_type, false, NULL, NULL, NULL, NULL, NULL, total_power, NULL,
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, a_power, a_voltage, b_power, NULL, NULL FROM mpow
  UNION ALL
  SELECT seq, topic, enqueued_ts, device_id, device_type, false, NULL, NULL, NULL, NULL, NULL, NULL, total,
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, a_total, total_returned FROM menergy) u
"""


@register("normalize_messages", W(_NORMALIZE_SQL, _RAW), "ingest")
def q_normalize_messages(spark, sf):
    return flat_phases(I.normalize_messages(fx.raw_messages(spark, sf)))


def flat_phases(df):
    """The nested phases as the columns that the oracle compares."""
    p = "phases"
    return df.select(*[c for c in df.columns if c not in (p, "meter_energy_returned")], F.col("meter_energy_returned").alias("total_returned"),
                     F.col(f"{p}.a.power").alias("a_power"), F.col(f"{p}.a.voltage").alias("a_voltage"), F.col(f"{p}.b.power").alias("b_power"),
                     F.col(f"{p}.a.total").alias("a_total"))


register("wrap_messages", W("SELECT id, device_id, original_payload, processing_timestamp, status, message_source, seq FROM env",
                            _RAW), "ingest")(
    lambda spark, sf: I.wrap_messages(fx.raw_messages(spark, sf)).drop("enqueued_ts"))

register("store_messages", W("""
SELECT id AS _id, device_id, original_payload AS payload, processing_timestamp,
       enqueued_ts AS insert_ts, coalesce(status, 'processed') AS status
FROM env QUALIFY row_number() OVER (PARTITION BY id ORDER BY enqueued_ts, seq) = 1""", _RAW), "ingest")(
    lambda spark, sf: I.store_messages(I.wrap_messages(fx.raw_messages(spark, sf))))

register("reject_invalid", W("""
SELECT id, seq, CASE WHEN m <> '' THEN 'missing: ' || m END AS reason FROM (
  SELECT id, seq, concat_ws(',', CASE WHEN id IS NULL OR id = '' THEN 'id' END,
                                 CASE WHEN device_id IS NULL OR device_id = '' THEN 'deviceId' END,
                                 CASE WHEN processing_timestamp IS NULL OR processing_timestamp = '' THEN 'processingTimestamp' END,
                                 CASE WHEN original_payload IS NULL OR original_payload = '' THEN 'originalPayload' END) AS m
  FROM env) t""", _RAW), "ingest")(
    lambda spark, sf: I.reject_invalid(I.wrap_messages(fx.raw_messages(spark, sf))).select("id", "seq", "reason"))


@register("documents_to_readings", W("""
SELECT CASE WHEN regexp_extract(_id, '-(\\d+)$', 1) <> '' THEN CAST(regexp_extract(_id, '-(\\d+)$', 1) AS BIGINT) END
         AS reading_id,
       _id AS doc_id, device_id, CAST(NULL AS VARCHAR) AS device_type, false AS is_simulated,
       et IS NOT NULL AS has_energy, pts AS payload_ts, prc AS processing_ts, insert_ts,
       coalesce(pts, prc) AS event_ts, CAST(coalesce(pts, prc) AS DATE) AS event_date,
       CAST(json_extract(et, '$.Power') AS DOUBLE) AS power_w, CAST(json_extract(et, '$.Today') AS DOUBLE) AS today_kwh,
       CAST(json_extract(et, '$.Voltage') AS DOUBLE) AS voltage_v,
       CAST(json_extract(payload, '$.total_act_power') AS DOUBLE) AS meter_power_w,
       CAST(json_extract(et, '$.Current') AS DOUBLE) AS current_a, CAST(json_extract(et, '$.Factor') AS DOUBLE) AS power_factor,
       CAST(json_extract(et, '$.ApparentPower') AS DOUBLE) AS apparent_power_va, CAST(json_extract(et, '$.ReactivePower') AS DOUBLE) AS reactive_power_var,
       CAST(json_extract(et, '$.Total') AS DOUBLE) AS total_kwh, CAST(json_extract(et, '$.Yesterday') AS DOUBLE) AS yesterday_kwh,
       CAST(json_extract(et, '$.Period') AS DOUBLE) AS period_wh, et->>'$.TotalStartTime' AS total_start_time,
       CAST(NULL AS TIMESTAMP) AS time_utc, CAST(json_extract(payload, '$._meta') AS VARCHAR) AS metadata
FROM (
  SELECT *, coalesce(json_extract(payload, '$.ENERGY'), json_extract(payload, '$.energy')) AS et,
         CAST(timezone('UTC', TRY_CAST(payload->>'$.timestamp' AS TIMESTAMPTZ)) AS TIMESTAMP) AS pts,
         CAST(timezone('UTC', TRY_CAST(processing_timestamp AS TIMESTAMPTZ)) AS TIMESTAMP) AS prc
  FROM (SELECT id AS _id, device_id, original_payload AS payload, processing_timestamp,
               enqueued_ts AS insert_ts
        FROM env QUALIFY row_number() OVER (PARTITION BY id ORDER BY enqueued_ts, seq) = 1) s) t
""", _RAW), "ingest")
def q_documents_to_readings(spark, sf):
    return I.documents_to_readings(I.store_messages(I.wrap_messages(fx.raw_messages(spark, sf))))
