"""Hashing, the ledger table and the tamper audit (H1-H8).

The ledger is an ordinary table ``(id, hash_value, ts, device_id, data_type,
created_at)``.  Appends are a ``left_anti`` join against it; the audit is one
equi-join of the document store with the ledger on ``id`` (instead of one
ledger read per document), so it partitions by id and AQE can switch to a
broadcast or split skewed partitions at runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, canonical_struct

# Ledger contract rules and messages.
MAX_ID_BYTES = 64
HASH_PATTERN = "^[a-fA-F0-9]{64}$"
DEVICE_PATTERN = "^[a-zA-Z0-9_-]{1,32}$"
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
DATA_TYPES = ("consumption", "production", "storage", "transmission")
LEGACY_DATA_TYPE = "consumption"
AUDIT_SOURCE = "AzureFunction-IoTHubProcessor"   # source name the auditors rebuild messages with
STATUS_OK = "SUCCESS"
STATUS_TAMPER = "TAMPER DETECTED"
STATUS_MISSING = "ERROR"


def _verr(field: str, message: str):
    return F.lit(f"validation error in field '{field}': {message}")


# ---------------------------------------------------------------- H1
def hash_documents(docs: DataFrame, payload: str = "payload", message_source: str | None = None) -> DataFrame:
    """H1: ``current_hash`` = SHA-256 of the canonical original message of each document.

    ``docs`` has ``id, device_id, processing_timestamp (text), status`` and a
    typed ``payload`` struct (or a JSON string of any shape).  ``message_source`` overrides the document's own ``message_source``
    (the auditors rebuild messages with a constant source name).
    """
    d = docs if message_source is None else docs.withColumn("message_source", F.lit(message_source))
    fields = {"deviceId": "device_id", "id": "id", "messageSource": "message_source",
              "originalPayload": payload, "processingTimestamp": "processing_timestamp", "status": "status"}
    if dict(d.dtypes)[payload] == "string":
        d = d.withColumn("_payload_canon", canonical_json(F.col(payload)))
        # the canonical payload text is spliced in as raw JSON
        head = canonical_struct(d, {"deviceId": "device_id", "id": "id", "messageSource": "message_source"})
        tail = canonical_struct(d, {"processingTimestamp": "processing_timestamp", "status": "status"})
        text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"originalPayload":'),
                        F.coalesce(F.col("_payload_canon"), F.lit("null")), F.lit(","),
                        F.substring(tail, F.lit(2), F.length(tail)))
        return d.withColumn("canonical", text).withColumn("current_hash", F.sha2("canonical", 256)) \
                .drop("_payload_canon")
    text = canonical_struct(d, fields)
    return d.withColumn("canonical", text).withColumn("current_hash", F.sha2(F.col("canonical"), 256))


# ---------------------------------------------------------------- H2
def _rfc3339_to_ts(col):
    """RFC 3339 text -> UTC TIMESTAMP_NTZ, NULL if it isn't one: pattern, calendar date, offset below 24:00.

    A fraction may have any number of digits; those beyond microseconds are cut.
    """
    second = F.try_to_timestamp(F.substring(col, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    micros = F.rpad(F.substring(F.regexp_extract(col, r"\.(\d+)", 1), 1, 6), 6, "0").try_cast("bigint")
    sign = F.when(F.regexp_extract(col, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    hours = F.coalesce(F.regexp_extract(col, r"[+-](\d{2}):\d{2}$", 1).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.regexp_extract(col, r"[+-]\d{2}:(\d{2})$", 1).try_cast("int"), F.lit(0))
    utc = F.unix_micros(second) + F.coalesce(micros, F.lit(0)) - sign * (hours * 60 + minutes).cast("bigint") * 60_000_000
    ok = col.rlike(RFC3339_PATTERN) & second.isNotNull() & (hours < 24) & (minutes < 60)
    return F.when(ok, F.timestamp_micros(utc).cast("timestamp_ntz"))


def validate_ledger_rows(rows: DataFrame) -> DataFrame:
    """H2: ``reason`` of the first failing contract rule (NULL when valid).

    ``rows``: ``id, hash_value, timestamp (text), device_id, data_type``.
    """
    ts = F.col("timestamp")
    ts_ok = _rfc3339_to_ts(ts).isNotNull()
    reason = (
        F.when(F.col("id").isNull() | F.col("hash_value").isNull() | ts.isNull() | F.col("device_id").isNull()
               | F.col("data_type").isNull(), F.lit("missing required fields"))
        .when(F.trim("id") == "", _verr("id", "cannot be empty"))
        .when(F.octet_length("id") > MAX_ID_BYTES, _verr("id", "must be 64 characters or less"))
        .when(~F.col("hash_value").rlike(HASH_PATTERN),
              _verr("hashValue", "must be a valid 64-character hex string (SHA256)"))
        .when(~ts_ok, _verr("timestamp", "must be in RFC3339 format (e.g., 2024-01-15T10:30:00Z)"))
        .when(F.trim("device_id") == "", _verr("deviceID", "cannot be empty"))
        .when(~F.col("device_id").rlike(DEVICE_PATTERN),
              _verr("deviceID", "must contain only alphanumeric characters, hyphens, and underscores (1-32 chars)"))
        .when(~F.lower("data_type").isin(*DATA_TYPES),
              _verr("dataType", "must be one of: consumption, production, storage, transmission"))
    )
    return rows.withColumn("reason", reason)


# ---------------------------------------------------------------- H3
def append_ledger(ledger: DataFrame, batch: DataFrame, created_at, order_col: str = "seq",
                  legacy: bool = False) -> DataFrame:
    """H3: rows of ``batch`` accepted into the ledger, as ledger rows.

    Accepted = valid (H2), id not already on the ledger, and the first
    occurrence of its id in the batch (by ``order_col``).  ``legacy`` sets the
    data type to ``consumption`` (the older 4-argument call).
    """
    b = batch if not legacy else batch.withColumn("data_type", F.lit(LEGACY_DATA_TYPE))
    v = validate_ledger_rows(b).filter(F.col("reason").isNull())
    first = Window.partitionBy("id").orderBy(order_col)
    v = v.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    new = v.join(ledger.select("id"), "id", "left_anti")
    ts = created_at if isinstance(created_at, F.Column) else F.lit(created_at).cast("timestamp_ntz")
    return new.select("id", "hash_value", _rfc3339_to_ts(F.col("timestamp")).alias("ts"), "device_id",
                      "data_type", ts.alias("created_at"))


def append_ledger_counts(batch: DataFrame, accepted: DataFrame) -> DataFrame:
    """H3 result: accepted count of total (two global counts, scalar subqueries)."""
    return accepted.agg(F.count(F.lit(1)).alias("accepted")) \
        .select("accepted", batch.agg(F.count(F.lit(1))).scalar().alias("total"))


# ---------------------------------------------------------------- H4 / H5 / H6
def ledger_lookup(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """H4: ledger rows for the requested ids (blank ids never match)."""
    want = ids.select("id").filter(F.trim("id") != "")
    return ledger.join(want, "id", "left_semi")


def ledger_exists(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """H4: ``(id, exists)`` for every requested id; blank ids are false."""
    have = ledger.select("id").distinct().withColumn("_hit", F.lit(True))
    j = ids.select("id").join(have, "id", "left")
    return j.select("id", (F.coalesce("_hit", F.lit(False)) & (F.trim("id") != "")).alias("exists"))


def ledger_by_device(ledger: DataFrame, device_id: str) -> DataFrame:
    if not device_id or not device_id.strip():
        raise ValueError("validation error in field 'deviceID': cannot be empty")
    return ledger.filter(F.col("device_id") == device_id)


def ledger_by_type(ledger: DataFrame, data_type: str) -> DataFrame:
    if data_type.lower() not in DATA_TYPES:
        raise ValueError("validation error in field 'dataType': must be one of: consumption, production, storage, transmission")
    return ledger.filter(F.col("data_type") == data_type.lower())


def ledger_by_time(ledger: DataFrame, start, end) -> DataFrame:
    """Inclusive at both ends."""
    s = F.lit(start).cast("timestamp_ntz")
    e = F.lit(end).cast("timestamp_ntz")
    return ledger.filter((F.col("ts") >= s) & (F.col("ts") <= e))


def ledger_all(ledger: DataFrame) -> DataFrame:
    return ledger


def ledger_count_by_type(ledger: DataFrame) -> DataFrame:
    """H6: rows per (exactly stored) data type among the four valid ones."""
    return ledger.filter(F.col("data_type").isin(*DATA_TYPES)).groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))


def ledger_count_by_time(ledger: DataFrame, start, end) -> DataFrame:
    return ledger_by_time(ledger, start, end).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- H7 / H8
def audit_status() -> F.Column:
    """Status of a document's ``current_hash`` against its ``ledger_hash``."""
    return (F.when(F.col("ledger_hash").isNull(), F.lit(STATUS_MISSING))
            .when(F.col("ledger_hash") == F.col("current_hash"), F.lit(STATUS_OK))
            .otherwise(F.lit(STATUS_TAMPER)))


def audit_full(docs: DataFrame, ledger: DataFrame, payload: str = "payload",
               message_source: str = AUDIT_SOURCE) -> DataFrame:
    """H7: every document re-hashed and compared with the ledger."""
    h = hash_documents(docs, payload, message_source).select("id", "current_hash", *(
        [c for c in ("insert_ts",) if c in docs.columns]))
    j = h.join(ledger.select("id", F.col("hash_value").alias("ledger_hash")), "id", "left")
    return j.withColumn("status", audit_status())


#: Buckets of stored documents and ledger; both tables must have equally many.
AUDIT_BUCKETS = 64


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int = AUDIT_BUCKETS) -> DataFrame:
    """Store a table with an ``id`` in buckets of its id, each sorted by it, and read it back.

    Documents and ledger written so meet bucket by bucket: the audit's join
    neither shuffles nor sorts them.
    """
    one_each = df.repartition(buckets, "id")  # a bucket is one file
    one_each.write.mode("errorifexists").bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def audit_bucketed(spark, docs_table: str, ledger_table: str, payload: str = "payload", message_source: str = AUDIT_SOURCE) -> DataFrame:
    """H7 over two tables of :func:`write_bucketed`; a merge join by bucket, whatever their sizes."""
    ledger = spark.table(ledger_table).select("id", "hash_value").hint("merge")
    return audit_full(spark.table(docs_table), ledger, payload, message_source)


def audit_incremental(docs: DataFrame, ledger: DataFrame, since, payload: str = "payload",
                      message_source: str = AUDIT_SOURCE) -> DataFrame:
    """H8: audit of documents inserted after ``since``, oldest first, plus the new high-water mark."""
    s = F.lit(since).cast("timestamp_ntz")
    new = docs.filter(F.col("insert_ts") > s)
    a = audit_full(new, ledger, payload, message_source)
    mark = new.agg(F.max("insert_ts")).scalar()
    return a.withColumn("high_water_mark", F.greatest(F.coalesce(mark, s), s)).orderBy("insert_ts", "id")
