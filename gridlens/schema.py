"""The typed ``readings`` table every operator reads.

One row per stored reading document.  Plug energy fields are flat columns
(NULL when the document has no ``ENERGY`` object, ``has_energy`` false);
three-phase meter power is kept in ``meter_power_w``.  ``event_ts`` is the
device time falling back to processing time, materialised at ingest together
with ``event_date`` so that range filters reach the Parquet scan.
"""

from pyspark.sql import types as T

READINGS_SCHEMA = T.StructType([
    T.StructField("reading_id", T.LongType()),        # ingest sequence, tie-breaker
    T.StructField("doc_id", T.StringType()),          # document id "<device>-<seq>"
    T.StructField("device_id", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("is_simulated", T.BooleanType()),
    T.StructField("has_energy", T.BooleanType()),
    T.StructField("payload_ts", T.TimestampNTZType()),    # device time, may be NULL
    T.StructField("processing_ts", T.TimestampNTZType()),
    T.StructField("insert_ts", T.TimestampNTZType()),
    T.StructField("event_ts", T.TimestampNTZType()),      # coalesce(payload_ts, processing_ts)
    T.StructField("event_date", T.DateType()),
    T.StructField("power_w", T.DoubleType()),             # ENERGY.Power
    T.StructField("today_kwh", T.DoubleType()),           # ENERGY.Today (resets at midnight)
    T.StructField("voltage_v", T.DoubleType()),           # ENERGY.Voltage
    T.StructField("meter_power_w", T.DoubleType()),       # three-phase totalPower
    T.StructField("current_a", T.DoubleType()),           # ENERGY.Current
    T.StructField("power_factor", T.DoubleType()),        # ENERGY.Factor
    T.StructField("apparent_power_va", T.DoubleType()),   # ENERGY.ApparentPower
    T.StructField("reactive_power_var", T.DoubleType()),  # ENERGY.ReactivePower
    T.StructField("total_kwh", T.DoubleType()),           # ENERGY.Total
    T.StructField("yesterday_kwh", T.DoubleType()),       # ENERGY.Yesterday
    T.StructField("period_wh", T.DoubleType()),           # ENERGY.Period
    T.StructField("total_start_time", T.StringType()),    # ENERGY.TotalStartTime
    T.StructField("time_utc", T.TimestampNTZType()),      # TIME.UTC, may be NULL
    T.StructField("metadata", T.StringType()),            # _meta as JSON text
])

#: Columns of the plug's ENERGY object and the field each is read from.
ENERGY_COLUMNS = {"power_w": "Power", "today_kwh": "Today", "voltage_v": "Voltage", "current_a": "Current", "power_factor": "Factor",
                  "apparent_power_va": "ApparentPower", "reactive_power_var": "ReactivePower", "total_kwh": "Total",
                  "yesterday_kwh": "Yesterday", "period_wh": "Period", "total_start_time": "TotalStartTime"}

READING_COLUMNS = [f.name for f in READINGS_SCHEMA.fields]
