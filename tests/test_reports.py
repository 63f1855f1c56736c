"""Totals, breakdowns, daily series and what the pages derive from them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlake import schema
from meterlake.functions import money
from meterlake.functions.clock import check_zone, local_day
from meterlake.functions.text import project_label
from meterlake.operators import breakdowns, daily, series, windows
from meterlake.plans import reports
from tests.conftest import by_key

UTC = dt.timezone.utc
NOW = dt.datetime(2026, 6, 18, 18, tzinfo=UTC)
TZ = "America/New_York"


def _event(id_, ts=NOW, provider="claude", cost=1.0, tokens=(10, 5, 0, 100), **changes):
    row = dict.fromkeys(schema.USAGE_EVENT.fieldNames())
    names = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    row |= {f.name: 0 for f in schema.USAGE_EVENT if f.dataType.typeName() == "long"}
    row |= dict(zip(names, tokens))
    row |= {"event_id": id_, "provider": provider, "tool": "t", "ts": ts, "cost_usd": cost}
    row |= {"session_id": "s1", "model": "m", "project": "/p", **changes}
    return tuple(row[name] for name in schema.USAGE_EVENT.fieldNames())


def _table(spark, *rows):
    return spark.createDataFrame(list(rows), schema.USAGE_EVENT)


def _ago(**delta):
    return NOW - dt.timedelta(**delta)


def test_window_edges(spark):
    """Windows start closed, have no end, and today is the local day."""
    events = _table(
        spark,
        _event("future", NOW + dt.timedelta(days=9)),
        _event("now"),
        _event("edge7", _ago(days=7)),
        _event("past7", _ago(days=7, microseconds=1)),
        _event("edge30", _ago(days=30)),
        _event("old", _ago(days=400)),
        _event("early", dt.datetime(2026, 6, 18, 4, tzinfo=UTC)),
        _event("yesterday", dt.datetime(2026, 6, 18, 3, 59, tzinfo=UTC)),
    )
    kpis = by_key(windows.summary_kpis(events, TZ, NOW).collect(), "window")
    assert {w: r.events for w, r in kpis.items()} == {
        "today": 2,
        "last_7d": 5,
        "last_30d": 7,
        "all_time": 8,
    }
    assert kpis["all_time"].tokens == 8 * 115
    assert kpis["last_7d"].cost == 5.0


def test_empty_table(spark):
    events = _table(spark)
    assert [(r.tokens, r.cost, r.events) for r in windows.summary_kpis(events, TZ, NOW).collect()] == [
        (0, 0.0, 0)
    ] * 4
    burn = windows.burn(events, NOW, 100, 100).first()
    assert burn.block_5h_utilization == 0 and burn.hours_to_limit is None
    assert windows.summary_meta(events).first().events == 0
    assert daily.daily_burn(events, TZ, 30, NOW).count() == 0
    assert series.calendar_grid(daily.daily_burn(events, TZ, 30, NOW), 30).count() == 0


def test_summary_of_two_providers(spark):
    events = _table(
        spark,
        _event("a", tokens=(1000, 500, 0, 4000), model="claude-opus-4-8", cost=2.0),
        _event("b", provider="openai", tokens=(2000, 800, 0, 0), model="gpt-5.3-codex", session_id=None),
    )
    report = reports.summary(events, TZ, NOW)
    assert by_key(report["kpis"].collect(), "window")["all_time"].tokens == 8300
    meta = report["meta"].first()
    assert (meta.events, meta.sessions) == (2, 1)
    assert [r.provider for r in report["providers"].collect()] == ["claude", "openai"]
    assert windows.summary_meta(events, approximate=True).first().sessions == 1
    assert {r.model for r in reports.models(events).collect()} == {"claude-opus-4-8", "gpt-5.3-codex"}


def test_burn_report(spark):
    events = _table(
        spark,
        _event("a", _ago(hours=5), tokens=(500, 0, 0, 0), cost=1.0),
        _event("b", _ago(hours=6), tokens=(700, 0, 0, 0), cost=2.0),
        _event("c", _ago(days=2), tokens=(1600, 0, 0, 0), cost=4.0),
        _event("d", _ago(days=8), tokens=(9000, 0, 0, 0), cost=8.0),
    )
    row = windows.burn(events, NOW, limit_5h=1000, limit_week=3000).first()
    assert (row.block_5h_tokens, row.day_tokens, row.week_tokens) == (500, 1200, 2800)
    assert row.block_5h_utilization == 0.5 and row.block_5h_fill == 50.0 and not row.block_5h_hot
    assert row.week_utilization == 2800 / 3000 and row.week_hot
    assert row.tokens_per_hour_24h == 50.0 and row.cost_per_hour_24h == 3.0 / 24
    assert row.forecast_tokens == 2800 / 7 * 30 and row.daily_avg_cost == 1.0
    assert row.hours_to_limit == 10.0
    over = windows.burn(events, NOW, limit_5h=400, limit_week=0).first()
    assert over.hours_to_limit == 0.0 and over.block_5h_fill == 100.0 and over.block_5h_hot
    assert over.week_utilization is None and over.week_fill is None and over.week_hot is None
    free = windows.burn(events, NOW).first()
    assert free.block_5h_utilization is None and free.hours_to_limit is None


def test_by_project_and_model_keep_null_apart(spark):
    events = _table(
        spark,
        _event("a", project=None, model=None),
        _event("b", project="(none)", model="(unknown)", cost=2.0),
        _event("c", project="/x", session_id="s2", cost=9.0),
        _event("d", project="/x", session_id="s3"),
        _event("e", project="/x", session_id=None),
    )
    projects = [(r.project, r.events, r.sessions, r.cost) for r in breakdowns.by_project(events).collect()]
    assert projects == [("/x", 3, 2, 11.0), ("(none)", 1, 1, 2.0), ("(none)", 1, 1, 1.0)]
    assert breakdowns.by_project(events, 1).count() == 1
    assert [r.model for r in breakdowns.by_model(events).collect()].count("(unknown)") == 2


def test_top_sessions(spark):
    events = _table(
        spark,
        _event("a", _ago(hours=1), session_id="s", model=None, project=None),
        _event("b", session_id="s", model="later", project="/later"),
        _event("c", _ago(minutes=30), session_id="s", model="first", project="/first"),
        _event("d", session_id="t", cost=3.0),
        _event("e", session_id="u", cost=3.0),
        _event("f", session_id=None, cost=99.0),
    )
    rows = breakdowns.top_sessions(events, 2).collect()
    assert [r.session_id for r in rows] == ["s", "t"]
    assert (rows[0].turns, rows[0].model, rows[0].project) == (3, "first", "/first")
    assert rows[0].first_ts == rows[0].last_ts - dt.timedelta(hours=1)


def test_top_turns_break_ties_by_id(spark):
    events = _table(spark, *[_event(i, cost=c) for i, c in (("c", 1.0), ("a", 1.0), ("b", 5.0))])
    rows = breakdowns.top_turns(events.withColumn("session_id", F.col("event_id")), 2).collect()
    assert [(r.session_id, r.cost, r.tokens) for r in rows] == [("b", 5.0, 115), ("a", 1.0, 115)]


def test_days_are_local_across_clock_changes(spark):
    at = {
        dt.datetime(2026, 3, 8, 4, 59, tzinfo=UTC): dt.date(2026, 3, 7),
        dt.datetime(2026, 3, 8, 5, 0, tzinfo=UTC): dt.date(2026, 3, 8),
        dt.datetime(2026, 3, 9, 3, 59, tzinfo=UTC): dt.date(2026, 3, 8),
        dt.datetime(2026, 3, 9, 4, 0, tzinfo=UTC): dt.date(2026, 3, 9),
        dt.datetime(2026, 11, 1, 5, 30, tzinfo=UTC): dt.date(2026, 11, 1),
        dt.datetime(2026, 11, 2, 4, 59, tzinfo=UTC): dt.date(2026, 11, 1),
        dt.datetime(2026, 11, 2, 5, 0, tzinfo=UTC): dt.date(2026, 11, 2),
    }
    rows = spark.createDataFrame([(t, d) for t, d in at.items()], "ts timestamp, day date")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            same = rows.filter(local_day(F.col("ts"), TZ) == F.col("day"))
            assert same.count() == len(at), zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_combined_is_the_sum_of_providers(spark):
    rows = [
        _event(f"e{i}", _ago(hours=7 * i), ("claude", "openai", "x")[i % 3], 0.1 * i)
        for i in range(60)
    ]
    events = _table(spark, *rows)
    burn = daily.daily_burn(events, TZ, 10, NOW).collect()
    single = daily.daily_by_provider(events, TZ, 10, NOW).collect()
    combined = daily.daily_combined(events, TZ, 10, NOW).collect()
    for row in combined:
        parts = [r for r in single if r.day == row.day]
        assert row.tokens == sum(r.tokens for r in parts)
        assert row.cost == pytest.approx(sum(r.cost for r in parts), abs=1e-12)
    assert len(burn) == len(single) + len(combined)
    assert sorted(r.day for r in burn if r.series == "combined") == sorted(r.day for r in combined)
    # The first day starts at a moment; aligned, it is left out.
    whole = daily.daily_combined(events, TZ, 10, NOW, align_days=True).collect()
    assert min(r.day for r in combined) == dt.date(2026, 6, 8)
    assert min(r.day for r in whole) == dt.date(2026, 6, 9)


def _series(spark, values):
    rows = [(s, dt.date(2026, 6, d), float(v)) for s, d, v in values]
    return spark.createDataFrame(rows, "series string, day date, value double")


def test_moving_average_counts_rows_or_days(spark):
    values = _series(spark, [("a", d, d) for d in (1, 2, 3, 10, 11, 12, 13, 14)] + [("b", 5, 9)])
    rows = by_key(series.moving_avg_7(values).filter("series = 'a'").collect(), "day")
    assert rows[dt.date(2026, 6, 1)].moving_avg == 1.0
    assert rows[dt.date(2026, 6, 14)].moving_avg == sum((2, 3, 10, 11, 12, 13, 14)) / 7
    dense = series.moving_avg_7(values, calendar_days=14).filter("series = 'a'").collect()
    assert len(dense) == 14
    assert by_key(dense, "day")[dt.date(2026, 6, 14)].moving_avg == (10 + 11 + 12 + 13 + 14) / 7


def test_color_buckets(spark):
    values = [("a", i + 1, 729 / 3**i) for i in range(8)] + [("z", 1, 0), ("z", 2, -3)]
    rows = series.color_bucket(_series(spark, values)).collect()
    found = {(r.series, r.day.day): r.bucket for r in rows}
    assert [found["a", i + 1] for i in range(8)] == [6, 5, 4, 3, 2, 1, 0, 0]
    assert found["z", 1] == found["z", 2] == 0


def test_calendar_grid(spark):
    rows = [("combined", 2, 3.0), ("combined", 9, 4.0), ("claude", 9, 4.0), ("old", 2, 1.0)]
    grid = _series(spark, rows).withColumnRenamed("value", "cost").withColumn("tokens", F.lit(7))
    cells = series.calendar_grid(grid, 7).collect()
    assert len(cells) == 21
    for name, last in (("combined", 4.0), ("claude", 4.0), ("old", 0.0)):
        mine = sorted((c for c in cells if c.series == name), key=lambda c: c.day)
        assert [c.day.day for c in mine] == list(range(3, 10))
        assert [c.cost for c in mine] == [0.0] * 6 + [last]
    # 3 June 2026 is a Wednesday, 7 June a Sunday.
    weeks = {c.day.day: (c.week, c.weekday) for c in cells}
    assert weeks[3] == (0, 4) and weeks[6] == (0, 7) and weeks[7] == (1, 1) and weeks[9] == (1, 3)


def test_panel_totals_and_metric(spark):
    events = _table(spark, _event("a"), _event("b", _ago(days=1), cost=0.5))
    burn = daily.daily_burn(events, TZ, 10, NOW)
    totals = by_key(series.panel_totals(burn).collect(), "series")
    assert totals["combined"].cost == 1.5 and totals["claude"].tokens == 230
    assert {r.value for r in series.select_metric(burn, "tokens").collect()} == {115.0}
    with pytest.raises(ValueError, match="metric"):
        series.select_metric(burn, "events")
    page = reports.heatmap(events, TZ, 10, "tokens", NOW)
    assert page["line"].count() == 2 and page["grid"].count() == 20 and page["heat"].count() == 4


def test_labels_and_ratios(spark):
    paths = {
        None: "(none)",
        "": "(none)",
        "/": "/",
        "/a": "/a",
        "a/b": "a/b",
        "/a/b/c": ".../b/c",
        "//a//b//c/": ".../b/c",
    }
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    for row in rows.select("p", project_label(F.col("p")).alias("label")).collect():
        assert row.label == paths[row.p]
    events = _table(
        spark, _event("a", tokens=(10, 5, 20, 70)), _event("b", model="none", tokens=(0, 5, 0, 0))
    )
    ratios = by_key(reports.models(events).collect(), "model")
    assert ratios["m"].cache_hit_ratio == 0.7 and ratios["none"].cache_hit_ratio == 0.0
    assert reports.projects(events).first().label == "/p"
    assert reports.sessions(events).first().label == "/p"
    assert reports.turns(events, 1).count() == 1


def test_money_is_exact_in_any_order(spark):
    amounts = spark.range(20_000).select((F.col("id") % 997 * 0.000000001 + 0.1).alias("x"))
    totals = set()
    for parts in (1, 3, 8):
        shuffled = amounts.repartition(parts).sortWithinPartitions(F.rand(parts))
        totals.add(shuffled.agg(money.exact_sum(F.col("x"))).first()[0])
    assert len(totals) == 1
    exact = amounts.agg(F.sum(F.col("x").cast("decimal(38,12)")).cast("double")).first()[0]
    assert totals == {exact}


def test_zone_names():
    assert check_zone("America/New_York") == "America/New_York"
    for bad in ("Not/AZone", "", "../etc"):
        with pytest.raises(ValueError, match="time zone"):
            check_zone(bad)
