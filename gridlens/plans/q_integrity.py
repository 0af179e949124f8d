"""Registered integrity queries (H1-H8) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity as H
from ..session import shared_folder
from ..sources import fixtures as fx
from . import oracle as O
from .registry import register

W = O.with_fixtures
BATCH_TIME = "2024-02-01 00:00:00"


def _canon(power: str) -> str:
    return ("""'{"deviceId":"' || device_id || '","id":"' || doc_id || '","messageSource":"fixture","originalPayload":{"ENERGY":{"Power":'"""
            f" || CAST({power} AS VARCHAR) || "
            """',"Today":' || CAST(today_ch AS VARCHAR) || '}},"processingTimestamp":"' || substr(CAST(processing_ts AS VARCHAR), 1, 19) || '","status":"processed"}'""")


_LEDGER = f"""
docs AS (SELECT *, CASE WHEN reading_id % 97 = 0 THEN power_dw + 1 ELSE power_dw END AS power_t FROM rbase),
canon AS (SELECT *, {_canon('power_dw')} AS orig_text, {_canon('power_t')} AS cur_text FROM docs),
ledger AS (SELECT doc_id AS id, sha256(orig_text) AS hash_value, processing_ts AS ts, device_id,
                  (['consumption','production','storage','transmission'])[user_id % 4 + 1] AS data_type,
                  insert_ts AS created_at
           FROM canon WHERE reading_id % 101 <> 0)"""

_BATCH = _LEDGER + """,
batch AS (
  SELECT CASE WHEN reading_id % 53 = 0 THEN ' ' WHEN reading_id % 43 = 0 THEN device_id || '-dup' ELSE doc_id END AS id,
         CASE WHEN reading_id % 59 = 0 THEN substr(sha256(orig_text), 1, 63) ELSE sha256(orig_text) END AS hash_value,
         CASE WHEN reading_id % 61 = 0 THEN substr(CAST(processing_ts AS VARCHAR), 1, 19)
              ELSE replace(substr(CAST(processing_ts AS VARCHAR), 1, 19), ' ', 'T') || 'Z' END AS timestamp,
         CASE WHEN reading_id % 67 = 0 THEN device_id || '!' ELSE device_id END AS device_id,
         CASE WHEN reading_id % 71 = 0 THEN 'energy_reading'
              WHEN user_id % 3 = 0 THEN upper((['consumption','production','storage','transmission'])[user_id % 4 + 1])
              ELSE (['consumption','production','storage','transmission'])[user_id % 4 + 1] END AS data_type,
         reading_id AS seq
  FROM canon),
checked AS (
  SELECT *, CASE
    WHEN trim(id) = '' THEN 'validation error in field ''id'': cannot be empty'
    WHEN octet_length(encode(id)) > 64 THEN 'validation error in field ''id'': must be 64 characters or less'
    WHEN NOT regexp_full_match(hash_value, '[a-fA-F0-9]{64}') THEN 'validation error in field ''hashValue'': must be a valid 64-character hex string (SHA256)'
    WHEN NOT (regexp_full_match(timestamp, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})')
              AND try_strptime(substr(timestamp, 1, 19), '%Y-%m-%dT%H:%M:%S') IS NOT NULL)
      THEN 'validation error in field ''timestamp'': must be in RFC3339 format (e.g., 2024-01-15T10:30:00Z)'
    WHEN trim(device_id) = '' THEN 'validation error in field ''deviceID'': cannot be empty'
    WHEN NOT regexp_full_match(device_id, '[a-zA-Z0-9_-]{1,32}') THEN 'validation error in field ''deviceID'': must contain only alphanumeric characters, hyphens, and underscores (1-32 chars)'
    WHEN lower(data_type) NOT IN ('consumption','production','storage','transmission') THEN 'validation error in field ''dataType'': must be one of: consumption, production, storage, transmission'
  END AS reason FROM batch),
accepted AS (
  SELECT c.id, c.hash_value, CAST(strptime(replace(c.timestamp, 'Z', ''), '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS ts,
         c.device_id, c.data_type, TIMESTAMP '""" + BATCH_TIME + """' AS created_at
  FROM (SELECT * FROM checked WHERE reason IS NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1) c
  WHERE c.id NOT IN (SELECT id FROM ledger))"""


def _docs(spark, sf, tampered=True):
    return fx.stored_documents(spark, sf, tampered)


@register("hash_readings", W("SELECT doc_id AS id, sha256(orig_text) AS current_hash FROM canon", _LEDGER), "integrity")
def q_hash_readings(spark, sf):
    return H.hash_documents(_docs(spark, sf, False)).select("id", "current_hash")


@register("hash_readings_free_form", W("SELECT doc_id AS id, sha256(orig_text) AS current_hash FROM canon", _LEDGER),
          "integrity")
def q_hash_readings_free_form(spark, sf):
    d = _docs(spark, sf, False).withColumn("payload", F.to_json("payload"))
    return H.hash_documents(d).select("id", "current_hash")


register("validate_ledger_rows", W("SELECT id, seq, reason FROM checked", _BATCH), "integrity")(
    lambda spark, sf: H.validate_ledger_rows(fx.ledger_batch(spark, sf)).select("id", "seq", "reason"))


def _accepted(spark, sf):
    hashed = fx.hashed_documents(spark, sf).persist()   # ledger and batch share one hashing pass
    return H.append_ledger(fx.ledger(spark, sf, hashed), fx.ledger_batch(spark, sf, hashed), BATCH_TIME)


register("append_ledger", W("SELECT * FROM accepted", _BATCH), "integrity")(_accepted)
register("append_ledger_counts", W("SELECT (SELECT count(*) FROM accepted) AS accepted, (SELECT count(*) FROM batch) AS total",
                                   _BATCH), "integrity")(
    lambda spark, sf: H.append_ledger_counts(fx.ledger_batch(spark, sf), _accepted(spark, sf)))

register("ledger_lookup", W("SELECT * FROM ledger WHERE id IN (SELECT doc_id FROM readings WHERE has_energy)", _LEDGER),
         "integrity")(
    lambda spark, sf: H.ledger_lookup(fx.ledger(spark, sf),
                                      fx.readings(spark, sf).filter("has_energy").select(F.col("doc_id").alias("id"))))
register("ledger_exists", W("SELECT r.doc_id AS id, (l.id IS NOT NULL AND trim(r.doc_id) <> '') AS exists "
                            "FROM readings r LEFT JOIN ledger l ON l.id = r.doc_id", _LEDGER), "integrity")(
    lambda spark, sf: H.ledger_exists(fx.ledger(spark, sf), fx.readings(spark, sf).select(F.col("doc_id").alias("id"))))
register("ledger_by_device", W("SELECT * FROM ledger WHERE device_id = 'dev_7'", _LEDGER), "integrity")(
    lambda spark, sf: H.ledger_by_device(fx.ledger(spark, sf), "dev_7"))
register("ledger_by_type", W("SELECT * FROM ledger WHERE data_type = 'storage'", _LEDGER), "integrity")(
    lambda spark, sf: H.ledger_by_type(fx.ledger(spark, sf), "Storage"))
register("ledger_by_time", W("SELECT * FROM ledger WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' "
                             "AND ts <= TIMESTAMP '2024-01-12 00:00:00'", _LEDGER), "integrity")(
    lambda spark, sf: H.ledger_by_time(fx.ledger(spark, sf), "2024-01-10 00:00:00", "2024-01-12 00:00:00"))
register("ledger_all", W("SELECT * FROM ledger", _LEDGER), "integrity")(
    lambda spark, sf: H.ledger_all(fx.ledger(spark, sf)))
register("ledger_count_by_type", W("SELECT data_type, count(*) AS n FROM ledger GROUP BY 1", _LEDGER), "integrity")(
    lambda spark, sf: H.ledger_count_by_type(fx.ledger(spark, sf)))
register("ledger_count_by_time", W("SELECT count(*) AS n FROM ledger WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' "
                                   "AND ts <= TIMESTAMP '2024-01-12 00:00:00'", _LEDGER), "integrity")(
    lambda spark, sf: H.ledger_count_by_time(fx.ledger(spark, sf), "2024-01-10 00:00:00", "2024-01-12 00:00:00"))

_AUDIT = """
SELECT c.doc_id AS id, sha256(c.cur_text) AS current_hash, l.hash_value AS ledger_hash,
       CASE WHEN l.hash_value IS NULL THEN 'ERROR' WHEN l.hash_value = sha256(c.cur_text) THEN 'SUCCESS'
            ELSE 'TAMPER DETECTED' END AS status{extra}
FROM canon c LEFT JOIN ledger l ON l.id = c.doc_id {where}"""

register("audit_full", W(_AUDIT.format(extra="", where=""), _LEDGER), "integrity")(
    lambda spark, sf: H.audit_full(_docs(spark, sf).drop("insert_ts"), fx.ledger(spark, sf), message_source="fixture")
    .select("id", "current_hash", "ledger_hash", "status"))



@register("audit_bucketed", W(_AUDIT.format(extra="", where=""), _LEDGER), "integrity")
def q_audit_bucketed(spark, sf):
    """H7 on documents and ledger stored in equal buckets of their ids."""
    folder = shared_folder(spark, "audit")
    tag = folder.rsplit("-", 1)[-1]
    H.write_bucketed(_docs(spark, sf).drop("insert_ts"), f"audit_docs_{tag}", f"{folder}/docs")
    H.write_bucketed(fx.ledger(spark, sf), f"audit_ledger_{tag}", f"{folder}/ledger")
    out = H.audit_bucketed(spark, f"audit_docs_{tag}", f"audit_ledger_{tag}", message_source="fixture")
    return out.select("id", "current_hash", "ledger_hash", "status")


SINCE = "2024-01-28 00:00:00"
register("audit_incremental", W(_AUDIT.format(
    extra=", c.insert_ts, (SELECT max(insert_ts) FROM canon WHERE insert_ts > TIMESTAMP '" + SINCE + "') AS high_water_mark",
    where="WHERE c.insert_ts > TIMESTAMP '" + SINCE + "'"), _LEDGER), "integrity")(
    lambda spark, sf: H.audit_incremental(_docs(spark, sf), fx.ledger(spark, sf), SINCE, message_source="fixture")
    .select("id", "current_hash", "ledger_hash", "status", "insert_ts", "high_water_mark"))
