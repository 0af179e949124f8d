"""Exact percentiles without one buffer of all values.

The built-in exact ``percentile`` keeps every distinct value in one aggregation
buffer.  Here equal-width buckets are counted first (a grouped count of at most
``BUCKETS`` rows), and only the values of the one or two buckets that hold the
wanted ranks are counted one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def exact_percentile(df: DataFrame, col: str, q: float) -> DataFrame:
    """One row ``value``: the ``q`` quantile with linear interpolation, NULL for no values (as ``percentile``)."""
    rows = df.select(F.col(col).cast("double").alias("x")).filter("x is not null")
    facts = rows.agg(F.struct(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    # the bounds in one column: the subquery stands in the plan once
    rows = rows.withColumn("f", facts)
    lo, hi = F.col("f.lo"), F.col("f.hi")
    share = F.when(hi > lo, (F.col("x") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    rows = rows.withColumn("b", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
    at = (F.col("f.n") - 1) * F.lit(float(q))
    low, high = F.floor(at), F.ceil(at)

    def ranked(counts: DataFrame, key: str) -> DataFrame:
        """Ranks [first, stop) of each key's values, from its count ``c``."""
        upto = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("stop", F.sum("c").over(upto)).withColumn("first", F.col("stop") - F.col("c"))

    holds = lambda rank: (F.col("first") <= rank) & (rank < F.col("stop"))
    buckets = ranked(rows.groupBy("b").agg(F.count("x").alias("c"), F.first("f").alias("f")), "b").filter(holds(low) | holds(high))
    inside = rows.join(buckets.select(F.col("b").alias("t_b"), F.col("first").alias("before")), F.col("b") == F.col("t_b"))
    values = inside.groupBy("b", "x").agg(F.count("x").alias("c"), F.first("f").alias("f"), F.first("before").alias("before"))
    in_bucket = Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("stop", F.col("before") + F.sum("c").over(in_bucket)).withColumn("first", F.col("stop") - F.col("c"))
    ends = values.agg(F.max(F.when(holds(low), F.col("x"))).alias("a"), F.max(F.when(holds(high), F.col("x"))).alias("z"),
                      F.max(at).alias("at"))
    low, high = F.floor("at"), F.ceil("at")
    value = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("z"))
    return ends.select(value.alias("value"))


def exact_percentiles(df: DataFrame, col: str, qs: list, keys: list) -> DataFrame:
    """(keys, q, value): the ``qs`` quantiles of every key's values, as :func:`exact_percentile` gives them.

    Ranks of all keys and quantiles are selected together: buckets are counted by
    (key, bucket), and of each key only the buckets that hold a wanted rank are
    counted by value.  Keys of NULL are left out.
    """
    rows = df.select(*keys, F.col(col).cast("double").alias("x")).filter("x is not null")
    facts = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    rows = rows.join(facts, keys).withColumn("b", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
    at = (F.col("n") - 1) * F.col("q")
    holds = lambda rank: (F.col("first") <= rank) & (rank < F.col("stop"))
    wanted = holds(F.floor("at")) | holds(F.ceil("at"))

    def ranked(counts: DataFrame, part: list, order: str, before) -> DataFrame:
        upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("stop", before + F.sum("c").over(upto)).withColumn("first", F.col("stop") - F.col("c"))

    buckets = ranked(rows.groupBy(*keys, "b").agg(F.count("x").alias("c"), F.first("n").alias("n")), keys, "b", F.lit(0))
    targets = buckets.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("at", at).filter(wanted)
    targets = targets.select(*keys, "b", "q", "at", F.col("first").alias("before"))
    values = rows.select(*keys, "b", "x").join(targets.select(*keys, "b", "before").distinct(), [*keys, "b"])
    values = values.groupBy(*keys, "b", "x").agg(F.count("x").alias("c"), F.first("before").alias("before"))
    values = ranked(values, [*keys, "b"], "x", F.col("before")).select(*keys, "b", "x", "first", "stop")
    ends = values.join(targets.select(*keys, "b", "q", "at"), [*keys, "b"]).filter(wanted).groupBy(*keys, "q").agg(
        F.max(F.when(holds(F.floor("at")), F.col("x"))).alias("a"), F.max(F.when(holds(F.ceil("at")), F.col("x"))).alias("z"), F.max("at").alias("at"))
    value = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("z"))
    return ends.select(*keys, "q", value.alias("value"))
