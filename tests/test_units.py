"""Hand-written unit rows (FIXTURES section 2.5) and tariff edges."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlens.functions import calendar as cal
from gridlens.functions.tariff import DEFAULT_TARIFF, block_cost, is_low_tariff, reading_cost
from gridlens.operators import dashboard as D
from gridlens.operators import reports as R


def _cost(spark, kwh, ts):
    df = spark.createDataFrame([(float(kwh), ts)], "kwh double, ts timestamp_ntz")
    c = reading_cost(F.col("kwh"), is_low_tariff(F.col("ts")))
    return df.select(c["cost"].alias("c"), c["tariff_type"].alias("t")).first()


@pytest.mark.parametrize("kwh,expected", [(210, 931.90), (211, 931.90), (300, 1427.31), (0, 0.0), (210.5, 931.90)])
def test_block_gap_is_not_billed(spark, kwh, expected):
    wed_noon = dt.datetime(2024, 1, 17, 12, 0)
    row = _cost(spark, kwh, wed_noon)
    assert row.t == "high" and row.c == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("ts,low", [
    (dt.datetime(2024, 1, 14, 12, 0), True),    # Sunday
    (dt.datetime(2024, 1, 13, 21, 59), False),  # Saturday 21:59
    (dt.datetime(2024, 1, 13, 22, 0), True),    # Saturday 22:00
    (dt.datetime(2024, 1, 15, 6, 59), True),    # Monday 06:59
    (dt.datetime(2024, 1, 15, 7, 0), False),    # Monday 07:00
    (dt.datetime(2024, 1, 17, 12, 59), False),
    (dt.datetime(2024, 1, 17, 13, 0), True),
    (dt.datetime(2024, 1, 17, 14, 59), True),
    (dt.datetime(2024, 1, 17, 15, 0), False),
])
def test_low_tariff_hours(spark, ts, low):
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    assert df.select(is_low_tariff(F.col("ts"))).first()[0] is low


def _cumulative_cost(x):
    """C(x): price of the first x kWh, the sum over blocks of rate times the part of [0, x] in the block."""
    return sum(b.rate * max(0.0, min(x, b.max_kwh) - b.min_kwh) for b in DEFAULT_TARIFF.blocks)


def _block_cost(kwh, cum=0.0):
    return math.floor((_cumulative_cost(cum + kwh) - _cumulative_cost(cum)) * 100 + 0.5) / 100


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 3000, allow_nan=False), st.floats(0, 2000, allow_nan=False)),
                min_size=200, max_size=200))
def test_block_cost_is_a_difference_of_cumulative_costs_and_monotone(spark, pairs):
    df = spark.createDataFrame(pairs, "kwh double, cum double")
    got = df.select("kwh", "cum", block_cost(F.col("kwh"), F.col("cum")).alias("c")).collect()
    for r in got:
        assert r.c == pytest.approx(_block_cost(r.kwh, r.cum), abs=0.011)
    xs = sorted(p[0] for p in pairs)
    mono = spark.createDataFrame([(x,) for x in xs], "kwh double").select(block_cost(F.col("kwh")).alias("c"))
    cs = [r.c for r in mono.collect()]
    assert all(a <= b + 1e-9 for a, b in zip(cs, cs[1:]))


def _readings(spark, rows):
    """rows: (device, ts, today_kwh, power_w)."""
    df = spark.createDataFrame(rows, "device_id string, event_ts timestamp_ntz, today_kwh double, power_w double")
    return (df.withColumn("event_date", F.to_date("event_ts")).withColumn("has_energy", F.lit(True))
              .withColumn("processing_ts", F.col("event_ts")).withColumn("payload_ts", F.col("event_ts"))
              .withColumn("reading_id", F.monotonically_increasing_id()))


def test_meter_reset_and_null_counter(spark):
    day = dt.datetime(2024, 1, 17)
    rows = [("d", day.replace(hour=1), 5.0, 10.0), ("d", day.replace(hour=2), 7.0, 10.0),
            ("d", day.replace(hour=3), 2.0, 10.0)]
    rep = R.daily_report(_readings(spark, rows)).orderBy("hour").collect()
    assert [r.energy for r in rep] == [5.0, 2.0, 2.0]
    nulls = [("d", day.replace(hour=1), 5.0, 1.0), ("d", day.replace(hour=2), None, 1.0),
             ("d", day.replace(hour=3), 6.0, 1.0)]
    rep = R.daily_report(_readings(spark, nulls)).orderBy("hour").collect()
    assert [r.energy for r in rep] == [5.0, 0.0, 6.0]


def test_dashboard_baseline_drops_first(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 2.0)], "t int, e double")
    out = D.meter_delta_baseline(df, "e", ["t"]).orderBy("t").collect()
    assert [r.consumption for r in out] == [2.0, 2.0]


def test_zero_previous_period(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 2), 5.0, 3.0), (dt.date(2024, 1, 1), 0.0, 0.0),
                               (dt.date(2024, 1, 3), 0.0, 0.0)],
                              "period_start date, total_energy double, peak_power double")
    out = {r.period_start: r for r in R.period_comparison(s, "daily").collect()}
    assert out[dt.date(2024, 1, 2)].energy_change == 100.0
    assert out[dt.date(2024, 1, 3)].energy_change == -100.0
    assert out[dt.date(2024, 1, 1)].label is None


def test_breakdown_needs_two_devices(spark):
    one = _readings(spark, [("d", dt.datetime(2024, 1, 17, 1), 5.0, 1.0)])
    assert R.device_breakdown(one, "daily").count() == 0
    two = _readings(spark, [("a", dt.datetime(2024, 1, 17, 1), 3.0, 1.0), ("b", dt.datetime(2024, 1, 17, 2), 1.0, 9.0)])
    got = {r.device_id: r.percentage for r in R.device_breakdown(two, "daily").collect()}
    assert got == {"a": 75.0, "b": 25.0}


def test_iso_week_53_previous(spark):
    df = spark.createDataFrame([(dt.date(1999, 1, 1),), (dt.date(1999, 1, 4),)], "d date")
    out = df.select(F.trunc("d", "week").alias("s"),
                    cal.previous_period_start(F.trunc("d", "week"), "weekly").alias("p"),
                    F.weekofyear(cal.previous_period_start(F.trunc("d", "week"), "weekly")).alias("pw")).collect()
    assert out[0].s == dt.date(1998, 12, 28) and out[0].pw == 52
    assert out[1].p == dt.date(1998, 12, 28) and out[1].pw == 53
    ws = spark.range(1).select(cal.iso_weeks_in_year(F.lit(1998)).alias("a"), cal.iso_weeks_in_year(F.lit(2023)).alias("b"))
    assert tuple(ws.first()) == (53, 52)


def test_even_window_centre(spark):
    from gridlens.operators.series import expected_value
    df = spark.createDataFrame([(i, float(i)) for i in range(48)], "t int, v double")
    got = {r.t: r.expected for r in expected_value(df, "v", ["t"]).collect()}
    assert got[20] == pytest.approx(sum(range(8, 32)) / 24)   # rows -12 .. +11
    assert got[0] == pytest.approx(sum(range(0, 12)) / 12)


def test_dashboard_cost_falls_back_to_estimate(spark):
    # one reading only -> one hourly bucket -> no delta rows -> 60/40 estimate of energy today
    rows = [("d", dt.datetime(2024, 1, 17, 9, 30), 10.0, 100.0)]
    r = _readings(spark, rows)
    as_of = "2024-01-17 10:00:00"
    hourly = D.dashboard_hourly(r, as_of)
    assert hourly.count() == 0
    cost = D.dashboard_cost(hourly, D.dashboard_latest(r, as_of), as_of).first()
    est = (10.0 * 0.6) * ((4.4376 + 5.5664) / 2) + (10.0 * 0.4) * 1.9765
    assert cost.value == pytest.approx(math.floor(est * 100 + 0.5) / 100)
    assert cost.confidence == "medium"                         # hour 10
    assert cost.projected_daily == pytest.approx(math.floor(est / 10 * 24 * 100 + 0.5) / 100)


def test_dashboard_cost_uses_hourly_deltas(spark):
    day = dt.datetime(2024, 1, 17)                              # Wednesday
    rows = [("d", day.replace(hour=8, minute=5), 1.0, 50.0), ("d", day.replace(hour=9, minute=5), 3.0, 60.0)]
    r = _readings(spark, rows)
    as_of = "2024-01-17 09:30:00"
    cost = D.dashboard_cost(D.dashboard_hourly(r, as_of), D.dashboard_latest(r, as_of), as_of).first()
    assert cost.value == pytest.approx(math.floor(2.0 * 4.4376 * 100 + 0.5) / 100)   # 2 kWh at 09:00, block 1
    assert cost.projected_daily == pytest.approx(math.floor(cost.value / 9 * 24 * 100 + 0.5) / 100, abs=0.011)


def test_summary_of_empty_report(spark):
    empty = spark.createDataFrame([], "period_start date, energy double, peak_power double, cost double")
    assert R.report_summary(empty).count() == 0                      # no period, no row
    one = R.report_summary(empty, keys=()).collect()                 # one requested period
    assert [(r.total_energy, r.peak_power, r.total_cost) for r in one] == [(0.0, 0.0, None)]


def test_js_number_text_equals_the_free_form_path(spark):
    from canonical_rows import js_number
    from gridlens.functions.formatting import js_number_text
    xs = [0.0, -0.0, 1e-7, 1.5e-7, 1e-6, 0.0005, -0.00012345, 0.001, 0.5, 1.0, 100.0, 1234567.5, 9999999.0, 1e7, 12345678.5, 123456789012.25,
          1e15, 1e20, 123456789012345680000.0, 1e21, -1.5e300, 0.1 + 0.2, 1 / 3]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", js_number_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got] == [(x, js_number(x)) for x in xs]


def test_windows_in_blocks_equal_whole_windows(spark):
    from gridlens.operators import series as S
    start = dt.datetime(2024, 1, 1)
    rows = [(f"d{i % 2}", start + dt.timedelta(hours=7 * i if i < 40 else 300 + i / 60), i, float(i * i % 17)) for i in range(160)]
    df = spark.createDataFrame(rows, "device_id string, timestamp timestamp_ntz, reading_id int, value double")
    how = dict(order_cols=("timestamp", "reading_id"), partition_cols=("device_id",))
    for f in (S.rolling_features, S.expected_value):
        assert sorted(map(tuple, f(df, block_rows=7, **how).collect())) == sorted(map(tuple, f(df, **how).collect()))


def test_rfc3339(spark):
    from gridlens.operators.integrity import _rfc3339_to_ts
    want = {"2024-01-15T10:30:00Z": "2024-01-15 10:30:00", "2024-01-15T10:30:00.123456789+02:30": "2024-01-15 08:00:00.123456",
            "2024-01-15T10:30:00.5-01:00": "2024-01-15 11:30:00.500000", "2024-01-15T10:30:00+25:00": None, "2024-01-15T10:30:00+01:75": None,
            "2024-13-15T10:30:00Z": None, "2024-01-15 10:30:00Z": None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", _rfc3339_to_ts(F.col("t")).alias("ts")).collect()
    assert {r.t: None if r.ts is None else str(r.ts) for r in rows} == want


def test_broken_messages_do_not_stop_the_job(spark):
    from gridlens.functions.canonical import canonical_json
    from gridlens.sources import ingest as I
    rows = [("tele/a/SENSOR", '{"Time":', 1), ("tele/a/SENSOR", '{"ENERGY":{"Power":1},"_meta":{"simulated":"maybe"}}', 2), ("nowhere", '{"a":1}', 3), ("nowhere", '{"a":2}', 4)]
    raw = spark.createDataFrame([(t, b, dt.datetime(2024, 1, 1), n) for t, b, n in rows], "topic string, body string, enqueued_ts timestamp_ntz, seq long")
    env = I.reject_invalid(I.wrap_messages(raw)).collect()
    assert len({r.id for r in env}) == 4 and env[0].original_payload is None
    assert I.store_messages(I.wrap_messages(raw)).count() == 4
    assert I.normalize_messages(raw).count() >= 0
    assert raw.select(canonical_json(F.col("body")).alias("c")).first().c is None


def test_generate_report_one_week(spark):
    from conftest import SMALL
    from gridlens.sources import fixtures as fx
    r = fx.readings(spark, SMALL)
    rep = R.generate_report(r, "weekly", year=2024, week=3)
    assert rep["data"].count() == 7
    s = rep["summary"].first()
    assert s.currency == "MKD" and s.total_energy >= 0
    c = rep["comparison"].first()
    assert c.label == "vs last week" and str(c.prev_period_start) == "2024-01-08"
    empty = R.generate_report(r, "weekly", year=2024, week=10)
    assert empty["data"].filter("energy IS NOT NULL").count() == 0
    e = empty["summary"].first()
    assert (e.total_energy, e.peak_power, e.total_cost) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        R.generate_report(r, "hourly")


def test_requests_scan_readings_once(spark):
    """The report's and the dashboard's answers read their stored cells, not the readings."""
    from conftest import SMALL
    from gridlens.session import saved
    from gridlens.sources import fixtures as fx
    r = saved(fx.readings(spark, SMALL), "only-readings")
    answers = list(R.generate_report(r, "weekly", year=2024, week=3).values())
    dash = D.generate_dashboard(r, "2024-01-30 18:00:00")
    answers += [dash[k] for k in ("latest", "hourly", "daily", "cost")]
    for df in answers:
        assert "only-readings" not in "".join(df.inputFiles())
    for by in (False, True):
        whole, cells = D.dashboard_latest(r, "2024-01-30 18:00:00", by), D.generate_dashboard(r, "2024-01-30 18:00:00", by_device=by)["latest"]
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cells.collect()))


def test_canonical_json_equals_the_plain_form(spark):
    """VARIANT text against a recursive writer: key order by UTF-16 units, numbers, escapes, equal keys, broken text."""
    import json
    import random
    from canonical_rows import canonical_json_text
    from gridlens.functions.canonical import canonical_json
    rng = random.Random(7)
    letters = ["a", "B", "z", "é", "ﬀ", "😀", "_", "1", "\"", "\\", "\n", "\u001f", "\u0000", "/", " ", "\u2028", "u00", "\x7f"]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))

    def value(depth):
        k = rng.randrange(8 if depth else 5)
        if k == 0:
            return word()
        if k == 1:
            return rng.choice([0, -1, 7, 10**15, 2**53, 123456789012345678, -5])
        if k == 2:
            return rng.choice([0.1, -0.0, 1.5, 100.0, 1e-7, 1.25e-5, 1e21, 12345678.25, 3e300, 0.30000000000000004, 99999999.0])
        if k == 3:
            return rng.choice([True, False, None])
        if k in (4, 5):
            return [value(depth - 1) for _ in range(rng.randint(0, 3))] if depth else word()
        return {word(): value(depth - 1) for _ in range(rng.randint(0, 5))}

    texts = [json.dumps(value(4), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(600)]
    texts += ['{"b":1,"a":2,"b":3}', "{", "", "nul", "[1,]", ' [1.50, 1E3, 2e-7, -0, 10.0] ', '{"k":"\\\\u001A \\u001a\\u001B\\u001B"}', None, '"x"', "12", "{}", "[]", "[[]]"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical_json(F.col("t")).alias("c")).collect()
    for r in got:
        want = None if texts[r.i] is None else canonical_json_text(texts[r.i])
        assert r.c == want, (texts[r.i], r.c, want)


def test_generate_dashboard_matches_parts(spark):
    from conftest import SMALL
    from gridlens.sources import fixtures as fx
    r = fx.readings(spark, SMALL)
    as_of = "2024-01-30 18:00:00"
    dash = D.generate_dashboard(r, as_of)
    for name, part in (("latest", D.dashboard_latest(r, as_of)), ("hourly", D.dashboard_hourly(r, as_of)),
                       ("daily", D.dashboard_daily(r, as_of)), ("today", D.dashboard_today(r, as_of))):
        assert sorted(map(tuple, dash[name].collect())) == sorted(map(tuple, part.collect())), name
    assert dash["cost"].count() == 1


def test_forest_needs_48_rows(spark):
    from gridlens.operators import anomaly as M
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i % 7), i) for i in range(30)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, value double, reading_id long")
    feats = M.anomaly_features(df).withColumnRenamed("reading_id", "row_key")
    assert M.fit_isolation_forest(feats, n_estimators=5).count() == 0
