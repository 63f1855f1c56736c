"""Physical plans: what must hold at any size."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from meterlake.operators import breakdowns, daily, merge, pricing, windows
from meterlake.operators.assistant import assistant_records, parse_assistant
from meterlake.operators.rollout import parse_rollout, rollout_records
from meterlake.plans.store import Warehouse
from meterlake.sources.files import read_log_lines
from meterlake.sources.listing import discover_files
from meterlake.sources.rates import default_rates
from tests.conftest import turn, write_lines

TZ = "America/New_York"
AS_OF = dt.datetime(2026, 6, 18, 18, tzinfo=dt.timezone.utc)


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def _exchanges(plan: str) -> int:
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single)", plan))


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A stored fact table of a few days."""
    root = tmp_path_factory.mktemp("plans")
    turns = [turn(f"r{i}", timestamp=f"2026-06-{1 + i % 20:02d}T12:00:00Z") for i in range(40)]
    write_lines(root / "logs" / "a.jsonl", turns)
    lines = read_log_lines(spark, str(root / "logs"))
    warehouse = Warehouse(spark, str(root / "tables"))
    batch = pricing.price(merge.dedup_first(parse_assistant(lines)), default_rates(spark))
    warehouse.append_events(batch, "first")
    return warehouse.events()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lines")
    write_lines(root / "rollout-a.jsonl", [turn("A")])
    return read_log_lines(spark, str(root))


def test_reports_read_the_facts_once(events):
    for report in (
        windows.summary_kpis(events, TZ, AS_OF),
        windows.burn(events, AS_OF, 10, 10),
        daily.daily_burn(events, TZ, 30, AS_OF),
        breakdowns.by_project(events),
    ):
        plan = _plan(report)
        assert plan.count("FileScan parquet") == 1
        assert "NestedLoop" not in plan and "Python" not in plan


def test_trailing_windows_prune_dates_and_columns(events):
    plan = _plan(windows.burn(events, AS_OF))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", plan)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan)
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert "ts#" in columns and "project" not in columns and "session_id" not in columns


def test_daily_series_do_not_expand_the_facts(events):
    """The grouping sets come after the first aggregation."""
    plan = _plan(daily.daily_burn(events, TZ, 30, AS_OF))
    assert plan.index("Expand") < plan.index("FileScan")
    assert re.search(r"Expand.*?HashAggregate.*?Exchange.*?HashAggregate.*?FileScan", plan, re.S)
    assert "SortAggregate" not in plan


def test_top_lists_are_cut_per_partition(events):
    for report in (breakdowns.top_turns(events), breakdowns.by_project(events)):
        assert "TakeOrderedAndProject" in _plan(report)
    plan = _plan(breakdowns.top_sessions(events))
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan


def test_pricing_needs_no_shuffle_of_the_facts(spark, events):
    plain = events.drop("cost_usd")
    plan = _plan(pricing.price(plain, default_rates(spark)))
    assert _exchanges(plan) == 0 and plan.count("FileScan") == 1
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    joined = _plan(pricing.rate_lookup(plain, default_rates(spark), 0))
    assert "NestedLoop" not in joined and "Cartesian" not in joined


def test_copies_are_cut_before_the_shuffle(lines):
    plan = _plan(merge.dedup_first(parse_assistant(lines)))
    assert _exchanges(plan) == 1
    final, partial = [m.start() for m in re.finditer("WindowGroupLimit", plan)][:2]
    assert final < plan.index("Exchange hashpartitioning") < partial


def test_lines_are_parsed_once_without_python(lines):
    for records in (assistant_records(lines), rollout_records(lines)):
        plan = _plan(records)
        assert plan.count("from_json(") == 1
        assert "Python" not in plan and _exchanges(plan) == 0


def test_no_task_sees_a_whole_file(lines):
    """Rows meet by file and block; only block summaries meet by file."""
    plan = _plan(parse_rollout(lines))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    by_file = [k for k in keys if "block_start" not in k]
    assert len(keys) - len(by_file) >= 2 and len(by_file) == 1
    assert "NestedLoop" not in plan


def test_listing_does_not_read_contents(spark, events, tmp_path):
    write_lines(tmp_path / "a.jsonl", [turn("A")])
    plan = _plan(discover_files(spark, "claude", str(tmp_path), "*.jsonl"))
    assert "content" not in plan


def test_new_events_shuffle_nothing_for_a_small_batch(events):
    batch = events.limit(0).unionByName(events.filter(F.col("ts") > F.lit(AS_OF)))
    plan = _plan(merge.new_events(batch, events))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
