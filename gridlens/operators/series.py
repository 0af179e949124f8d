"""Training series and time-series features.

Row-window features follow the reference (rows, not time), per series.  Over
raw readings a window has ``block_rows``: each series is cut into blocks of so
many rows, and the few rows next to a block that its windows reach come along,
so a device with a large share of all rows doesn't fill one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import exact_avg, exact_sum_over
from .periods import _ts

# Fixed values.
ROLLING_ROWS = 5            # trailing window of the anomaly features
EXPECTED_WINDOW = 24        # centred window of the expected value
TWO_PI = 2 * math.pi


def hourly_mean(readings: DataFrame, start=None, by_device: bool = False) -> DataFrame:
    """Mean Power and count per processing hour, ascending."""
    df = readings.filter(F.col("power_w").isNotNull())
    if start is not None:
        df = df.filter(F.col("processing_ts") >= _ts(start))
    keys = ["device_id"] if by_device else []
    return (df.groupBy(*keys, F.date_trunc("hour", "processing_ts").cast("timestamp_ntz").alias("timestamp"))
              .agg(exact_avg("power_w").alias("value"), F.count(F.lit(1)).alias("count"))
              .filter(F.col("value").isNotNull()))


def _window(order_cols, partition_cols=()):
    return Window.partitionBy(*partition_cols).orderBy(*order_cols)


#: Rows of a block of one series when raw readings are windowed.
BLOCK_ROWS = 100_000


def over_blocks(df: DataFrame, add, order_cols, partition_cols, before: int, after: int, block_rows: int = BLOCK_ROWS,
                ts: str = "timestamp") -> DataFrame:
    """``add(rows, partition, order)`` (columns over ROWS BETWEEN before PRECEDING AND after FOLLOWING) by blocks of a series.

    A row's place in its series is its place within the day plus the rows of
    the days before, so no window spans a whole series.  The block of a row and
    the blocks of rows that look at it get a copy; only the own one's result stays.
    """
    keys = list(partition_cols)
    days = df.withColumn("_day", F.to_date(ts))
    counts = days.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_day").alias("_s_day"),
                           F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    same = F.col("_day").eqNullSafe(F.col("_s_day"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(*order_cols)) - 1
    rows = days.withColumn("_place", place).join(starts, same).withColumn("_place", F.col("_place") + F.col("_start"))
    block = lambda p: F.floor(F.greatest(p, F.lit(0)) / block_rows)
    rows = (rows.withColumn("_home", block(F.col("_place")))
                .withColumn("_block", F.explode(F.sequence(block(F.col("_place") - after), block(F.col("_place") + before)))))
    out = add(rows, (*keys, "_block"), ("_place",)).filter(F.col("_block") == F.col("_home"))
    return out.drop("_day", "_place", "_start", "_home", "_block", "_s_day", *[f"_s_{k}" for k in keys])


def rolling_features(df: DataFrame, value: str = "value", order_cols=("timestamp",), partition_cols=(),
                     n: int = ROLLING_ROWS, block_rows: int | None = None) -> DataFrame:
    """Trailing mean, sample std (0 for a single row) and value - mean over ``n`` rows.

    Sums are exact (decimal) so the mean and the variance
    ``(sum(x^2) - sum(x)^2 / k) / (k - 1)`` do not depend on evaluation order.
    """
    if block_rows:
        return over_blocks(df, lambda d, p, o: rolling_features(d, value, o, p, n), order_cols, partition_cols, n - 1, 0, block_rows)
    w = _window(order_cols, partition_cols).rowsBetween(-(n - 1), 0)
    x = F.col(value)
    k = F.count(x).over(w).cast("double")
    s1 = exact_sum_over(x, w)
    s2 = exact_sum_over(x * x, w)
    mean = s1 / k
    var = F.greatest(F.lit(0.0), (s2 - s1 * s1 / k) / (k - F.lit(1.0)))
    return (df.withColumn("rolling_mean", mean)
              .withColumn("rolling_std", F.when(k > 1, F.sqrt(var)).otherwise(F.lit(0.0)))
              .withColumn("diff_from_mean", x - F.col("rolling_mean")))


def expected_value(df: DataFrame, value: str = "value", order_cols=("timestamp",), partition_cols=(),
                   n: int = EXPECTED_WINDOW, out: str = "expected", block_rows: int | None = None) -> DataFrame:
    """Centred row mean, partial at the edges (an even window spans -n/2 .. n/2-1)."""
    before = n // 2
    after = n - before - 1
    if block_rows:
        return over_blocks(df, lambda d, p, o: expected_value(d, value, o, p, n, out), order_cols, partition_cols, before, after, block_rows)
    w = _window(order_cols, partition_cols).rowsBetween(-before, after)
    return df.withColumn(out, exact_sum_over(value, w) / F.count(value).over(w).cast("double"))


def cyclic_time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """sin/cos of hour/24 and of weekday/7 (Monday = 0)."""
    h = F.hour(ts).cast("double")
    d = F.weekday(ts).cast("double")
    two_pi = F.lit(TWO_PI)
    return (df.withColumn("hour_sin", F.sin(two_pi * h / 24))
              .withColumn("hour_cos", F.cos(two_pi * h / 24))
              .withColumn("dow_sin", F.sin(two_pi * d / 7))
              .withColumn("dow_cos", F.cos(two_pi * d / 7)))


def expanding_splits(series: DataFrame, n_splits: int = 4, min_train_days: int = 3, validation_days: int = 1,
                     ts: str = "timestamp") -> DataFrame:
    """Expanding-window folds as a long frame ``(fold, role, <series columns>)``.

    Fold i trains on ``ts < t0 + (min_train + i*v) days`` and validates on the
    next ``v`` days.  When the span is short the fold count drops to
    ``max(1, (days - min_train) // v)``.  Each row is expanded to the folds it
    belongs to with array arithmetic (no join); the span bounds are scalar
    subqueries.  Folds with an empty side are dropped and the rest renumbered.
    """
    cols = series.columns
    # the bounds in one column, so that the subquery stands in the plan once
    span = series.agg(F.struct(F.min(ts).alias("t0"), F.max(ts).alias("t1"))).scalar()
    series = series.withColumn("_span", span)
    t0, t1 = F.col("_span.t0"), F.col("_span.t1")
    us_day = 86_400_000_000
    span_days = F.floor((F.unix_micros(t1.cast("timestamp")) - F.unix_micros(t0.cast("timestamp"))) / us_day)
    need = min_train_days + n_splits * validation_days
    k = F.when(span_days < need, F.greatest(F.lit(1), F.floor((span_days - min_train_days) / validation_days))) \
        .otherwise(F.lit(n_splits)).cast("int")
    # position of the row in days since t0 (exact in microseconds)
    pos_us = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(t0.cast("timestamp"))
    train_end = lambda i: (F.lit(min_train_days) + i * validation_days) * us_day
    # training folds: every i in [first_i, k-1] with pos < train_end(i)
    first_i = F.greatest(F.lit(0), F.floor((pos_us - min_train_days * us_day) / (validation_days * us_day)) + 1)
    val_i = F.floor((pos_us - min_train_days * us_day) / (validation_days * us_day))
    empty = F.array().cast("array<int>")
    train_folds = F.when(first_i <= k - 1, F.sequence(first_i.cast("int"), (k - 1).cast("int"))).otherwise(empty)
    val_folds = F.when((val_i >= 0) & (val_i <= k - 1), F.array(val_i.cast("int"))).otherwise(empty)
    series = series.withColumns({"_train": train_folds, "_val": val_folds, "_us": pos_us})
    long = (series.select(*cols, "_us", F.size("_train").alias("_nt"),
                          F.posexplode(F.concat("_train", "_val")).alias("_pos", "fold0"))
            .withColumn("role", F.when(F.col("_pos") < F.col("_nt"), "train").otherwise("validation"))
            .select("fold0", "role", *cols))
    # guard: train rows strictly before train_end (the floor arithmetic already ensures it)
    long = long.filter((F.col("role") == "validation") | (F.col("_us") < train_end(F.col("fold0"))))
    # folds with both sides non-empty, renumbered 1..m (tiny aggregate, joined back)
    sides = long.groupBy("fold0").agg(F.count_if(F.col("role") == "train").alias("nt"),
                                      F.count_if(F.col("role") == "validation").alias("nv"))
    good = sides.filter((F.col("nt") > 0) & (F.col("nv") > 0)).select(
        "fold0", F.dense_rank().over(Window.orderBy("fold0")).alias("fold"))
    return long.join(good, "fold0").select("fold", "role", *cols)


def fold_info(splits: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per fold: sizes and first/last timestamp of both sides."""
    tr = F.col("role") == "train"
    va = F.col("role") == "validation"
    return splits.groupBy("fold").agg(
        F.count_if(tr).alias("train_size"), F.count_if(va).alias("val_size"),
        F.min(F.when(tr, F.col(ts))).alias("train_start"), F.max(F.when(tr, F.col(ts))).alias("train_end"),
        F.min(F.when(va, F.col(ts))).alias("val_start"), F.max(F.when(va, F.col(ts))).alias("val_end"))


def first_per_hour(df: DataFrame, ts: str = "timestamp", keys=()) -> DataFrame:
    """Floor to the hour and keep the earliest row of each hour."""
    cols = [c for c in df.columns if c not in (ts, *keys)]
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    g = df.groupBy(*keys, hour.alias("hour")).agg(
        F.min_by(F.struct(*cols), F.col(ts)).alias("r"))
    return g.select(*keys, F.col("hour").alias(ts), *[F.col(f"r.{c}").alias(c) for c in cols])
