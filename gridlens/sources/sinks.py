"""Sinks: report CSV export (S11) and Parquet table writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formatting import js_number_text

# Friendly CSV headers of report fields.
CSV_HEADERS = {
    "peak_power": "Peak Power (W)",
    "energy": "Energy (kWh)",
    "voltage": "Voltage (V)",
    "current": "Current (A)",
    "factor": "Power Factor",
    "hour": "Time",
}
# Report field -> the field name whose first letter is capitalised otherwise.
FIELD_NAMES = {"tariff_type": "tariffType", "day_name": "dayName", "month_name": "monthName"}


def _header(col: str) -> str:
    if col in CSV_HEADERS:
        return CSV_HEADERS[col]
    name = FIELD_NAMES.get(col, col)
    return name[:1].upper() + name[1:]


def report_csv_frame(report: DataFrame, keep=("period_start",)) -> DataFrame:
    """S11 formatted frame: friendly headers, ``hour`` as ``HH:00``, text values, NULL as empty."""
    out = []
    for f in report.schema.fields:
        c = F.col(f.name)
        if f.name in keep:
            out.append(c)
            continue
        if f.name == "hour":
            v = F.concat(F.lpad(c.cast("string"), 2, "0"), F.lit(":00"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = js_number_text(c)
        else:
            v = c.cast("string")
        out.append(F.coalesce(v, F.lit("")).alias(_header(f.name)))
    return report.select(*out)


def export_report_csv(report: DataFrame, path: str, partition_col: str = "period_start", files_per_period: int = 8) -> None:
    """Write each period as CSV (header + rows, in order); minimal RFC-4180 quoting, doubled quotes.

    A report of one household is one file per period.  One by device has up to
    ``files_per_period``, each with all rows of its devices, so that a fleet's period isn't one task.
    """
    by_device = "device_id" in report.columns
    order = [partition_col] + [c for c in ("device_id", "hour", "day", "month") if c in report.columns]
    part = [F.pmod(F.xxhash64("device_id"), F.lit(files_per_period))] if by_device else []
    frame = report_csv_frame(report.repartition(partition_col, *part).sortWithinPartitions(*order))
    (frame.write.mode("overwrite")
     .partitionBy(partition_col)
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "")
     .csv(path))


def write_table(df: DataFrame, path: str, partition_by=("event_date",), sort_within=("device_id", "event_ts"),
                spread_by: str = "device_id", files_per_partition: int = 8) -> None:
    """Readings layout: partitioned by date, sorted by device and time inside files
    so that row-group min/max statistics prune device and time ranges.

    A partition is written by ``files_per_partition`` tasks, dealt by a hash of
    ``spread_by``; rows of one device and day stay in one file.
    """
    part = F.pmod(F.xxhash64(spread_by), F.lit(files_per_partition))
    (df.repartition(*partition_by, part).sortWithinPartitions(*partition_by, *sort_within)
     .write.mode("overwrite").partitionBy(*partition_by).parquet(path))
