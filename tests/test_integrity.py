"""Golden hash, typed vs free-form canonical text, tamper injection."""

import hashlib
import json

from pyspark.sql import functions as F

from conftest import SMALL
from canonical_rows import canonical_json_text
from gridlens.operators import integrity as H
from gridlens.sources import fixtures as fx

# One canonical envelope with its published SHA-256 (fixed test vector).
GOLDEN = ('{"deviceId":"mosquitto-bridge-01","id":"mosquitto-bridge-01-1145","messageSource":"AzureFunction-IoTHubProcessor",'
          '"originalPayload":{"ENERGY":{"ApparentPower":185,"Current":0.792,"Factor":0.91,"Period":13,"Power":169,'
          '"ReactivePower":75,"Today":2.514,"Total":12.978,"TotalStartTime":"2025-08-22T00:00:00","Voltage":234,'
          '"Yesterday":4.56},"Heap":29,"LoadAvg":18,"MqttCount":282,"Sleep":50,"SleepMode":"Dynamic","Uptime":"1T00:25:00",'
          '"UptimeSec":87900,"Vcc":3.548,"Wifi":{"AP":1,"BSSId":"AA:BB:CC:DD:EE:FF","Channel":6,"Downtime":"0T00:00:03",'
          '"LinkCount":1,"Mode":"11n","RSSI":92,"SSId":"TEST_WIFI","Signal":-52},"timestamp":"2025-08-22T17:48:28.067Z"},'
          '"processingTimestamp":"2025-08-22T18:24:03.655","status":"processed"}')
GOLDEN_SHA = "49f6be0eb4a51bb7b4d12da28fef3fb0fd4a67b7510bc81c9c0101a897994d06"


def test_golden_hash_python_path():
    shuffled = json.dumps(dict(reversed(list(json.loads(GOLDEN).items()))), indent=2)
    assert hashlib.sha256(canonical_json_text(shuffled).encode()).hexdigest() == GOLDEN_SHA


def test_golden_hash_spark_free_form(spark):
    env = json.loads(GOLDEN)
    df = spark.createDataFrame([(env["id"], env["deviceId"], env["messageSource"], json.dumps(env["originalPayload"]),
                                 env["processingTimestamp"], env["status"])],
                               "id string, device_id string, message_source string, payload string, "
                               "processing_timestamp string, status string")
    assert H.hash_documents(df).first().current_hash == GOLDEN_SHA


def test_tamper_injection_three_statuses(spark):
    docs = fx.stored_documents(spark, SMALL)
    audit = H.audit_full(docs, fx.ledger(spark, SMALL), message_source="fixture")
    got = {r.id: r.status for r in audit.collect()}
    rid = {r.id: r.reading_id for r in docs.select("id", "reading_id").collect()}
    for i, status in got.items():
        r = rid[i]
        if r % 101 == 0:
            assert status == "ERROR"
        elif r % 97 == 0:
            assert status == "TAMPER DETECTED"
        else:
            assert status == "SUCCESS"
    assert set(got.values()) == {"ERROR", "TAMPER DETECTED", "SUCCESS"}


def test_append_rejects_existing_and_duplicate(spark):
    led = fx.ledger(spark, SMALL)
    batch = fx.ledger_batch(spark, SMALL)
    acc = H.append_ledger(led, batch, "2024-02-01 00:00:00")
    assert acc.join(led, "id", "left_semi").count() == 0
    assert acc.groupBy("id").count().filter("count > 1").count() == 0
    assert H.validate_ledger_rows(acc.select("id", "hash_value", F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
                                             "device_id", "data_type")).filter("reason IS NOT NULL").count() == 0
