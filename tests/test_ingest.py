"""Batch ingest, change detection, repricing and the stored tables, on real files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from meterlake.operators.windows import summary_kpis
from meterlake.plans.ingest import ingest
from meterlake.plans.reprice import reprice_if_needed
from meterlake.plans.store import PRICING_HASH, Warehouse
from meterlake.sources.files import changed_files
from meterlake.sources.listing import discover_files
from meterlake.sources.ranges import ByteRange, read_range
from meterlake.sources.rates import default_rates, rates_from_dict
from tests.conftest import USAGE, by_key, model, rollout_name, session, tokens, turn, write_lines


class Setup:
    def __init__(self, spark, root):
        self.spark = spark
        self.roots = {"claude": str(root / "claude"), "codex": str(root / "codex")}
        self.claude = root / "claude" / "project one"
        self.codex = root / "codex" / "2026" / "06"
        self.warehouse = Warehouse(spark, str(root / "tables"))
        self.rates = default_rates(spark)
        self.hash = "rates-1"

    def run(self):
        result = ingest(self.spark, self.warehouse, self.roots, self.rates, self.hash)
        self.last = result
        return {
            r.source: (r.files_scanned, r.files_with_new_rows, r.events_inserted)
            for r in result.summary.collect()
        }

    def ids(self):
        return sorted(r.event_id for r in self.warehouse.events().collect())


@pytest.fixture
def setup(spark, tmp_path):
    return Setup(spark, tmp_path)


def test_passes_over_growing_logs(setup):
    file = write_lines(setup.claude / "s.jsonl", [turn("A"), turn("A"), turn("B")])
    write_lines(setup.claude / "deep" / "er" / "t.jsonl", [turn("C"), turn("A"), "{torn"])
    write_lines(setup.claude / "notes.txt", [turn("no")])
    rollout = write_lines(setup.codex / rollout_name(), [session(), model(), tokens(), tokens(500)])
    write_lines(setup.codex / "other.jsonl", [session(), tokens()])

    assert setup.run() == {"claude": (2, 2, 3), "codex": (1, 1, 2)}
    assert setup.ids() == [
        "claude:A", "claude:B", "claude:C", "codex:night-run:1", "codex:night-run:2",
    ]
    rows = by_key(setup.warehouse.events().collect(), "event_id")
    # deep/er/t.jsonl comes before s.jsonl, so its copy of A is the one kept.
    assert rows["claude:A"].source_file.endswith("project one/deep/er/t.jsonl")
    assert rows["claude:B"].cost_usd == 0.04425
    assert rows["codex:night-run:1"].cost_usd == (800 * 1.75 + 300 * 14 + 200 * 0.175) / 1e6
    assert [(r.reason, r.value) for r in setup.last.rejects.collect()] == [("not_json", "{torn")]
    assert by_key(summary_kpis(setup.warehouse.events(), "UTC").collect(), "window")["all_time"].events == 5

    assert setup.run() == {"claude": (2, 0, 0), "codex": (1, 0, 0)}

    # A resumed session repeats an old turn; a rollout continues after its last model.
    write_lines(file, [turn("A"), turn("D")], "a")
    write_lines(rollout, [tokens(100), model("gpt-4o"), tokens(100)], "a")
    assert setup.run() == {"claude": (2, 1, 1), "codex": (1, 1, 2)}
    rows = by_key(setup.warehouse.events().collect(), "event_id")
    assert rows["codex:night-run:3"].model == "gpt-5.3-codex"
    assert rows["codex:night-run:4"].model == "gpt-4o"
    state = by_key(setup.warehouse.ingest_state().collect(), "source_file")
    assert state[str(file)].rows == 2
    assert state[str(file)].last_size == state[str(file)].last_offset == file.stat().st_size
    assert state[str(rollout)].rows == 4


def test_missing_roots_and_unterminated_lines(setup):
    assert setup.run() == {"claude": (0, 0, 0), "codex": (0, 0, 0)}
    file = write_lines(setup.claude / "s.jsonl", [turn("A"), json.dumps(turn("B"))[:-9]], end="")
    assert setup.run() == {"claude": (1, 1, 1), "codex": (0, 0, 0)}
    with file.open("a") as handle:
        handle.write(json.dumps(turn("B"))[-9:] + "\n")
    assert setup.run() == {"claude": (1, 1, 1), "codex": (0, 0, 0)}
    with pytest.raises(ValueError, match="no known source"):
        ingest(setup.spark, setup.warehouse, {"x": "/"}, setup.rates)


def test_change_detection(setup, tmp_path):
    a, b = (write_lines(setup.claude / n, [turn(n)]) for n in ("a.jsonl", "b.jsonl"))
    setup.run()

    def changed():
        listing = discover_files(setup.spark, "claude", setup.roots["claude"], "*.jsonl")
        rows = changed_files(listing, setup.warehouse.ingest_state()).collect()
        return sorted(os.path.basename(r.source_file) for r in rows)

    assert changed() == []
    os.utime(a, (1e9, 1e9))
    assert changed() == ["a.jsonl"]
    write_lines(b, [turn("x")], "a")
    write_lines(setup.claude / "c.jsonl", [turn("c")])
    assert changed() == ["a.jsonl", "b.jsonl", "c.jsonl"]


def test_a_pass_repeated_after_a_crash_adds_nothing(setup, monkeypatch):
    write_lines(setup.claude / "s.jsonl", [turn("A"), turn("B")])

    def crash(self, batch, ingest_pass, version=None):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "append_state", crash)
        with pytest.raises(RuntimeError, match="lost"):
            setup.run()
    assert setup.ids() == ["claude:A", "claude:B"]
    assert setup.run()["claude"] == (1, 0, 0)
    assert setup.ids() == ["claude:A", "claude:B"]


def test_an_unreadable_file_is_left_for_the_next_pass(setup, monkeypatch):
    """A file that is listed but cannot be read, here one that has gone since."""
    write_lines(setup.claude / "good.jsonl", [turn("A"), ""])
    write_lines(setup.claude / "end.jsonl", [turn("B")], end="")
    write_lines(setup.claude / "empty.jsonl", [], end="")
    bad = setup.claude / "bad.jsonl"
    listed = write_lines(bad, [turn("C"), turn("D")]).stat().st_size
    write_lines(bad, [turn("C")])

    def longer(*args):
        size = F.when(F.col("source_file").endswith("bad.jsonl"), listed).otherwise(F.col("size"))
        return discover_files(*args).withColumn("size", size.cast("bigint"))

    with monkeypatch.context() as patch:
        patch.setattr("meterlake.plans.ingest.discover_files", longer)
        assert setup.run()["claude"] == (4, 2, 2)
    assert setup.ids() == ["claude:A", "claude:B"]
    assert setup.warehouse.ingest_state().count() == 3
    assert setup.run()["claude"] == (4, 1, 1)
    assert setup.ids() == ["claude:A", "claude:B", "claude:C"]


def test_bytes_before_the_offset_are_not_read(setup):
    """Resumed files are read on from where the last pass ended, whatever now stands before."""
    file = write_lines(setup.claude / "s.jsonl", [turn("A"), turn("B")])
    rollout = write_lines(setup.codex / rollout_name(), [session(), model(), tokens(), tokens()])
    assert setup.run() == {"claude": (1, 1, 2), "codex": (1, 1, 2)}
    for path in (file, rollout):
        path.write_bytes(b"x" * (path.stat().st_size - 1) + b"\n")
    write_lines(file, [turn("C")], "a")
    write_lines(rollout, [tokens(700), session("later"), tokens(800)], "a")
    assert setup.run() == {"claude": (1, 1, 1), "codex": (1, 1, 2)}
    assert setup.last.rejects.count() == 0
    rows = by_key(setup.warehouse.events().collect(), "event_id")
    assert rows["codex:night-run:3"].model == "gpt-5.3-codex"
    assert "codex:later:4" in rows


def test_a_line_that_grows_over_passes(setup):
    """Cut anywhere, a line counts once it is whole; its number in a rollout does not move."""
    line, usage = json.dumps(turn("B")), json.dumps(tokens(900))
    file = write_lines(setup.claude / "s.jsonl", [turn("A"), line[:50]], end="")
    rollout = write_lines(setup.codex / rollout_name(), [session(), tokens(), usage[:70]], end="")
    assert setup.run() == {"claude": (1, 1, 1), "codex": (1, 1, 1)}
    for path, text, at in ((file, line, 50), (rollout, usage, 70)):
        with path.open("a") as handle:
            handle.write(text[at : at + 9])
    assert setup.run() == {"claude": (1, 0, 0), "codex": (1, 0, 0)}
    # Without a line end the last line is tried as it stands, and read again later.
    for path, text, at in ((file, line, 59), (rollout, usage, 79)):
        with path.open("a") as handle:
            handle.write(text[at:])
    assert setup.run() == {"claude": (1, 1, 1), "codex": (1, 1, 1)}
    write_lines(file, ["", turn("C")], "a")
    write_lines(rollout, ["", tokens(950)], "a")
    assert setup.run() == {"claude": (1, 1, 1), "codex": (1, 1, 1)}
    assert setup.ids() == ["claude:A", "claude:B", "claude:C", *[f"codex:night-run:{n}" for n in (1, 2, 3)]]


def test_a_rewritten_rollout_starts_over(setup):
    rollout = write_lines(setup.codex / rollout_name(), [session("old"), tokens(), tokens(), "#" * 4000])
    assert setup.run()["codex"] == (1, 1, 2)
    write_lines(rollout, [session("old"), tokens(), tokens(), tokens(700)])
    assert setup.run()["codex"] == (1, 1, 1)
    # In place, with the same size: read again, and known by its ids.
    text = rollout.read_text().replace('"old"', '"new"')
    rollout.write_text(text)
    os.utime(rollout, (1e9, 1e9))
    assert setup.run()["codex"] == (1, 1, 3)
    write_lines(rollout, [tokens(5)], "a")
    assert setup.run()["codex"] == (1, 1, 1)
    assert setup.ids() == [*[f"codex:new:{n}" for n in (1, 2, 3, 4)], *[f"codex:old:{n}" for n in (1, 2, 3)]]


def test_ranges_give_each_line_once(spark, tmp_path):
    lines = ["a" * n for n in (1, 2, 9, 0, 3, 30, 1, 1, 5)] + ["é" * 7]
    path = write_lines(tmp_path / "a b#%.jsonl", lines)
    size = path.stat().st_size
    starts = [0] + [i + 1 for i, b in enumerate(path.read_bytes()[:-1]) if b == 10]
    for step in (1, 2, 3, 7, 10, 64):
        for first in (0, 5, 12, 30):
            ranges = [(b, min(b + step, size)) for b in range(first, size, step)]
            rows = [
                row
                for start, end in ranges
                for batch in read_range(ByteRange(str(path), start, end, first == 0))
                for row in batch.to_pylist()
            ]
            found = [(r["line_id"], r["value"]) for r in rows if r["mark"] is None]
            ends = [s + len(v.encode()) for s, v in zip(starts, lines)]
            assert found == [(s, v) for s, v, e in zip(starts, lines, ends) if e >= first]
            marks = [r["mark"] for r in rows if r["mark"]]
            assert [m["read_to"] for m in marks] == [end for _, end in ranges]
            assert {m["restarted"] for m in marks} == {first == 0}
    gone = [b.to_pylist() for b in read_range(ByteRange(str(tmp_path / "no"), 0, 9, True))]
    assert "FileNotFound" in gone[0][0]["mark"]["failure"]
    broken = tmp_path / "b.jsonl"
    broken.write_bytes(b"ok\n\xff\xfe\nrest")
    rows = [r for b in read_range(ByteRange(str(broken), 0, 10, True, True)) for r in b.to_pylist()]
    assert [(r["value"], r["is_open"]) for r in rows] == [("ok", False), ("\ufffd\ufffd", False), ("rest", True), (None, False)]


def test_listing_of_odd_and_deep_trees(spark, tmp_path):
    names = ["[x]", "{y},*", "_hidden", ".dot", "a b", "%41", "é#?"]
    wanted = set()
    for i, name in enumerate(names):
        file = tmp_path / "root" / name / f"d{i}" / f"{name}.jsonl"
        file.parent.mkdir(parents=True)
        file.write_text("x" * i)
        (file.parent / "no.txt").write_text("no")
        wanted.add((str(file), i))
    for folders in (1, 3, 256):
        found = discover_files(spark, "s", f"{tmp_path}/root/", "*.jsonl", folders)
        assert {(r.source_file, r.size) for r in found.collect()} == wanted
    odd = discover_files(spark, "s", str(tmp_path / "root" / "[x]"), "*.jsonl").collect()
    assert [r.source_file for r in odd] == [str(tmp_path / "root/[x]/d0/[x].jsonl")]
    assert discover_files(spark, "s", str(tmp_path / "none"), "*").count() == 0
    assert discover_files(spark, "s", f"file://{tmp_path}/root", "*.jsonl").count() == len(names)


def _flat(spark, rate):
    return rates_from_dict(spark, {"anthropic": {"default": {"input": rate}}})


def test_reprice_when_the_rates_change(setup, monkeypatch):
    million = {**USAGE, "output_tokens": 0, "cache_creation_input_tokens": 0}
    million |= {"input_tokens": 10**6, "cache_read_input_tokens": 0, "cache_creation": None}
    write_lines(setup.claude / "s.jsonl", [turn("A", usage=million)])
    setup.rates = _flat(setup.spark, 1.0)

    def cost():
        return [r.cost_usd for r in setup.warehouse.events().collect()]

    setup.run()
    assert cost() == [1.0] and setup.last.pricing.changed and setup.last.pricing.repriced == 0

    setup.rates, setup.hash = _flat(setup.spark, 2.5), "rates-2"
    with monkeypatch.context() as patch:  # a failed rewrite leaves the old version valid
        patch.setattr(Warehouse, "_keep", lambda self, facts, version: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            setup.run()
    assert cost() == [1.0] and setup.warehouse.get(PRICING_HASH) == "rates-1"

    assert setup.run()["claude"] == (1, 0, 0)
    assert cost() == [2.5]
    assert (setup.last.pricing.changed, setup.last.pricing.repriced) == (True, 1)
    assert setup.last.pricing.previous_pricing_hash == "rates-1"

    setup.run()
    assert (setup.last.pricing.changed, setup.last.pricing.repriced) == (False, 0)

    before = setup.warehouse.events().drop("ingest_pass").collect()
    forced = reprice_if_needed(setup.warehouse, setup.rates, "rates-2", force=True)
    assert (forced.changed, forced.repriced) == (False, 1)
    assert setup.warehouse.events().drop("ingest_pass").collect() == before
    assert setup.warehouse.version() > 0
    nameless = reprice_if_needed(setup.warehouse, _flat(setup.spark, 9.0), None)
    assert (nameless.changed, nameless.repriced) == (False, 0)


def test_metadata(setup):
    warehouse = setup.warehouse
    assert warehouse.get("a") is None and warehouse.version() == 0
    warehouse.put({"a": "1", "b": "2"})
    warehouse.put({"a": "3"})
    assert (warehouse.get("a"), warehouse.get("b")) == ("3", "2")
    assert warehouse.metadata().count() == 2


def test_odd_paths_and_vanished_files(setup):
    odd = setup.claude / "app[id]" / "{x},*"
    write_lines(odd / "b.jsonl", [turn("B")])
    write_lines(setup.claude / "a.jsonl", [turn("A")])
    assert setup.run()["claude"] == (2, 2, 2)
    assert setup.ids() == ["claude:A", "claude:B"]
    assert setup.run()["claude"] == (2, 0, 0)


def test_absurd_counts_are_rejects(setup):
    usage = {**USAGE, "input_tokens": 2**63 - 1, "output_tokens": 1}
    write_lines(setup.claude / "s.jsonl", [turn("A", usage=usage), turn("B")])
    assert setup.run()["claude"] == (1, 1, 1)
    assert [r.reason for r in setup.last.rejects.collect()] == ["bad_number"]
