"""Delta repricing and the totals that follow the facts."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from meterlake import schema
from meterlake.operators import breakdowns, daily, windows
from meterlake.operators.pricing import price
from meterlake.plans import reports
from meterlake.plans.reprice import reprice_if_needed
from meterlake.plans.store import PRICING_HASH, Warehouse
from meterlake.sources.rates import rates_from_dict

ZONES = ("America/New_York", "Asia/Kathmandu", "Australia/Lord_Howe")
AS_OF = dt.datetime(2026, 6, 10, 13, 7, 21, tzinfo=dt.timezone.utc)


def _rates(spark, **inputs):
    models = {name.replace("_", "-"): {"input": value} for name, value in inputs.items()}
    return rates_from_dict(spark, {"anthropic": {"default": {"input": 1.0}, "models": models}})


def _events(spark, numbers, rates):
    """Rows over ten days, one model on each of the first days alone, some without a time."""
    n = F.col("id")
    day = n % 10
    made = spark.createDataFrame([(i,) for i in numbers], "id bigint").select(
        F.concat(F.lit("e"), n).alias("event_id"),
        F.when(n % 3 == 0, "openai").otherwise("claude").alias("provider"),
        F.when(n % 13 != 0, F.concat(F.lit("s"), n % 17)).alias("session_id"),
        F.concat(F.lit("claude-day-"), day).alias("model"),
        F.when(n % 29 != 0, F.timestamp_seconds(F.lit(1780272000) + day * 86400 + (n * 7919) % 86400)).alias("ts"),
        (n * 1000).alias("input_tokens"),
        F.when(n % 4 != 0, F.concat(F.lit("/p/"), n % 4)).alias("project"),
    )
    empty = spark.createDataFrame([], schema.USAGE_EVENT).drop("cost_usd")
    return price(empty.unionByName(made, allowMissingColumns=True), rates)


def _files(root):
    return {
        p: (p.stat().st_mtime_ns, hashlib.sha256(p.read_bytes()).hexdigest())
        for p in root.rglob("*.parquet")
        if "events" in p.parts or "daily" in p.parts or "ledger" in p.parts
    }


def _costs(warehouse):
    return {r.event_id: r.cost_usd for r in warehouse.events().collect()}


@pytest.fixture
def store(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "tables"))
    rates = _rates(spark, claude_day_1=2.0)
    reprice_if_needed(warehouse, rates, "one")

    def append(numbers, name, rates=rates):
        path = str(tmp_path / f"batch-{name}-{len(list(tmp_path.iterdir()))}")
        _events(spark, numbers, rates).write.parquet(path)
        batch = spark.read.schema(schema.USAGE_EVENT).parquet(path)
        warehouse.append_events(warehouse.new_events(batch, name), name)

    warehouse.append = append
    return warehouse


def _same(store):
    events = store.events()
    for tz, days, align in zip(ZONES, (3, 8, 400), (False, True, False)):
        full = daily.daily_burn(events, tz, days, AS_OF, align).collect()
        kept = daily.daily_burn(events, tz, days, AS_OF, align, store.daily()).collect()
        assert sorted(map(tuple, kept)) == sorted(map(tuple, full)) != []
    exact = breakdowns.by_project(events)
    sketched = breakdowns.by_project_kept(store.projects())
    assert sketched.collect() == exact.select(sketched.columns).collect()  # few sessions: no error
    assert breakdowns.meta_kept(store.projects()).collect() == windows.summary_meta(events).collect()


def test_totals_follow_appends_repeats_and_reprices(spark, store, monkeypatch):
    store.append(range(100), "first")
    store.append(range(60, 200), "second")
    store.append(range(60, 200), "second")  # again
    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "_keep", lambda self, facts, version: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.append(range(200, 230), "third")
    store.append(range(190, 260), "third")
    assert store.events().count() == 260
    _same(store)
    dearer = _rates(spark, claude_day_1=7.0, claude_day_2=3.0)
    reprice_if_needed(store, dearer, "two")
    store.append(range(250, 300), "fourth", dearer)  # into rewritten dates and others
    store.append(range(250, 300), "fourth", dearer)
    _same(store)
    before = _costs(store)
    assert reprice_if_needed(store, dearer, "two", force=True).repriced == 300
    assert _costs(store) == before
    _same(store)


def test_reprice_rewrites_dates_with_changed_rates_alone(spark, store, tmp_path, monkeypatch):
    store.append(range(240), "first")
    files = _files(tmp_path / "tables")
    dearer = _rates(spark, claude_day_1=2.0, claude_day_2=5.0, unused=9.0)
    with monkeypatch.context() as patch:  # a failed rewrite leaves what was
        patch.setattr(Warehouse, "_keep", lambda self, facts, version: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            reprice_if_needed(store, dearer, "two")
    assert store.get(PRICING_HASH) == "one"
    assert _costs(store) == {r.event_id: r.cost_usd for r in _events(spark, range(240), _rates(spark, claude_day_1=2.0)).collect()}
    found = reprice_if_needed(store, dearer, "two")
    wanted = _events(spark, range(240), dearer)
    changed = [n for n in range(240) if n % 10 == 2 and n % 3]
    assert found.repriced == len(changed) and store.version() == 0
    assert _costs(store) == {r.event_id: r.cost_usd for r in wanted.collect()}
    after = _files(tmp_path / "tables")
    assert {p: after[p] for p in files} == files  # byte for byte
    added = {part for p in after.keys() - files.keys() for part in p.parts if part.startswith("event_date=")}
    assert added == {"event_date=2026-06-03", "event_date=__HIVE_DEFAULT_PARTITION__"}
    # The same rates in another text read and write nothing.
    same = reprice_if_needed(store, _rates(spark, claude_day_2=5.0, claude_day_1=2.0), "three")
    assert (same.changed, same.repriced) == (True, 0) and _files(tmp_path / "tables") == after
    # Rows at rates that nobody noted: everything is looked at again.
    store.forget_rates()
    assert reprice_if_needed(store, dearer, "four").repriced == 240 and store.version() > 0


def test_daily_reports_do_not_scan_the_facts(spark, store):
    store.append(range(100), "first")
    frames = reports.heatmap(store.events(), ZONES[0], 5, as_of=AS_OF, kept=store.daily())
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = frames["series"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    facts = [line for line in scans if "/events" in line]
    # Of the facts, only the dates in which the window may begin are read.
    assert len(scans) == 2 and len(facts) == 1
    filters = facts[0][facts[0].index("PartitionFilters") : facts[0].index("PushedFilters")]
    assert "event_date" in filters and ">=" in filters and "<=" in filters


def test_sketches_merge_in_any_order_and_stay_in_bound(spark):
    rows = spark.range(60_000).select(
        F.concat(F.lit("s"), F.col("id") % 25_000).alias("session_id"),
        F.when(F.col("id") % 2 == 0, "/a").alias("project"),
        F.lit("claude").alias("provider"),
        F.timestamp_seconds("id").alias("ts"),
        F.lit(0.5).alias("cost_usd"),
        F.col("id").alias("input_tokens"),
        *[F.lit(0).alias(c) for c in ("output_tokens", "cache_creation_tokens", "cache_read_tokens")],
        (F.col("id") % 7).alias("part"),
    )
    parts = breakdowns.project_sums(rows, "part")
    exact = breakdowns.by_project(rows).collect()
    for order in (F.col("part").asc(), F.col("part").desc()):
        found = breakdowns.by_project_kept(parts.orderBy(order)).collect()
        for a, b in zip(exact, found, strict=True):
            assert (a.project, a.events, a.tokens, a.cost, a.last_ts) == (b.project, b.events, b.tokens, b.cost, b.last_ts)
            assert abs(a.sessions - b.sessions) <= 3 * 1.04 / 2 ** (breakdowns.SKETCH_BITS / 2) * a.sessions
    assert breakdowns.meta_kept(parts.filter("false")).first()[:2] == (0, 0)
