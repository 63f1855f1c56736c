import pytest
from pyspark.sql import functions as F

from meterlake.operators.pricing import price, pricing_key, rate_lookup
from meterlake.sources.rates import default_rates, load_rates, rates_from_dict

M = 1_000_000
COLUMNS = (
    "provider string, model string, input_tokens bigint, output_tokens bigint, "
    "cache_read_tokens bigint, cache_create_5m bigint, cache_create_1h bigint"
)
BOUNDS = [{}, {"max_broadcast": 0}]


def _rate(spark, provider, model, bounds):
    row = spark.createDataFrame([(provider, model, 0, 0, 0, 0, 0)], COLUMNS)
    return rate_lookup(row, default_rates(spark), **bounds).first().rate


def _cost(spark, provider, model, *tokens):
    row = spark.createDataFrame([(provider, model, *tokens)], COLUMNS)
    return price(row, default_rates(spark)).first().cost_usd


@pytest.mark.parametrize("bounds", BOUNDS)
def test_rates(spark, bounds):
    opus = _rate(spark, "claude", "claude-opus-4-8", bounds)
    assert (opus.input, opus.output, opus.cache_read) == (5.0, 25.0, 0.5)
    assert (opus.cache_write_5m, opus.cache_write_1h) == (6.25, 10.0)
    codex = _rate(spark, "openai", "gpt-5.3-codex", bounds)
    assert (codex.input, codex.output, codex.cache_read) == (1.75, 14.0, 0.175)
    assert _rate(spark, "openai", "gpt-5.4-mini-2026-01-01", bounds).input == 0.75
    assert _rate(spark, "openai", "gpt-5.4-other", bounds).input == 2.5
    assert _rate(spark, "claude", "claude-something-new", bounds).input == 5.0
    for empty in (None, ""):
        assert _rate(spark, "openai", empty, bounds).input == 1.75
        assert _rate(spark, "claude", empty, bounds).input == 0.0
    assert _rate(spark, "claude", "llama3", bounds).output == 0.0
    assert _rate(spark, "elsewhere", "gpt-4o", bounds).output == 0.0


@pytest.mark.parametrize("bounds", BOUNDS)
def test_odd_rate_tables(spark, bounds):
    """No default, an empty prefix, quotes in a prefix, no rates at all."""
    rates = rates_from_dict(
        spark,
        {"openai": {"models": {"o'3\\x": {"input": 1.0}, "": {"input": 2.0}}}, "other": None},
    )
    rows = spark.createDataFrame(
        [("openai", m, 0, 0, 0, 0, 0) for m in ("o'3\\x-mini", "o3", "", None)]
        + [("other", "a", 0, 0, 0, 0, 0)],
        COLUMNS,
    )
    found = rate_lookup(rows, rates.filter("model_prefix <> '' or input <> 0"), **bounds)
    assert sorted((r.model or "", r.rate.input) for r in found.collect()) == [
        ("", 0.0),
        ("", 0.0),
        ("a", 0.0),
        ("o'3\\x-mini", 1.0),
        ("o3", 2.0),
    ]
    none = rate_lookup(rows, rates.limit(0), **bounds)
    assert {r.rate.input for r in none.collect()} == {0.0}


def test_each_token_class_has_its_own_rate(spark):
    assert _cost(spark, "claude", "claude-opus-4-8", M, M, M, M, 0) == 36.75
    assert _cost(spark, "claude", "claude-opus-4-8", 1000, 500, 8000, 2000, 0) == 0.034
    assert _cost(spark, "claude", "claude-opus-4-8", 0, 0, 0, 0, M) == 10.0


def test_cache_reads_are_not_billed_as_input(spark):
    cost = _cost(spark, "claude", "claude-opus-4-8", 10_000, 5_000, 2_000_000, 0, 0)
    assert cost < (2_010_000 * 5.0 / M + 5_000 * 25.0 / M) / 5


def test_pricing_key(spark):
    rows = spark.createDataFrame(
        [("claude", "claude-x"), ("claude", "llama3"), ("claude", None), ("openai", "claude-x")],
        "provider string, model string",
    )
    assert [r[0] for r in rows.select(pricing_key()).collect()] == [
        "anthropic",
        "local",
        "local",
        "openai",
    ]


def test_rate_files(spark, tmp_path):
    text = "anthropic:\n  default: {input: 1.5}\n  models:\n    a-1: {output: 2}\n"
    yaml_file = tmp_path / "rates.yaml"
    yaml_file.write_text(text)
    json_file = tmp_path / "rates.json"
    json_file.write_text('{"anthropic": {"default": {"input": 1.5}, "models": {"a-1": {"output": 2}}}}')
    csv_file = tmp_path / "rates.csv"
    csv_file.write_text(
        "provider,model_prefix,input,output,cache_write_5m,cache_write_1h,cache_read\n"
        "anthropic,,1.5,,,,\nanthropic,a-1,,2,,,\n"
    )
    import hashlib

    for path in (yaml_file, json_file, csv_file):
        rates, digest = load_rates(spark, str(path))
        rows = {r.model_prefix: r for r in rates.collect()}
        assert (rows[None].input, rows[None].output) == (1.5, 0.0)
        assert (rows["a-1"].input, rows["a-1"].output, rows["a-1"].cache_read) == (0.0, 2.0, 0.0)
        assert digest == hashlib.sha256(path.read_bytes()).hexdigest()


def test_prices_survive_nulls(spark):
    row = spark.createDataFrame([("claude", "claude-opus-4-8", None, M, None, None, None)], COLUMNS)
    assert price(row, default_rates(spark)).select(F.round("cost_usd", 6)).first()[0] == 25.0


def test_duplicate_rates_have_one_answer(spark):
    from meterlake import schema

    zeros = (0.0, 0.0, 0.0, 0.0)
    rows = [("openai", "gpt", float(n), *zeros) for n in (2, 1, 3)]
    rates = spark.createDataFrame(rows, schema.RATES)
    event = spark.createDataFrame([("openai", "gpt-9")], "provider string, model string")
    for bounds in BOUNDS:
        assert rate_lookup(event, rates, **bounds).first().rate.input == 3.0


def test_intervals_give_the_longest_prefix():
    """All texts over a small alphabet, its ends included, against a plain search."""
    import itertools
    import random

    from meterlake.operators.intervals import after, combine, flatten

    letters = ["a", "b", "\ud7ff", "\ue000", "\U0010ffff"]
    texts = ["".join(t) for n in range(5) for t in itertools.product(letters, repeat=n)]
    assert after("a") == "b" and after("\ud7ff") == "\ue000" and after("a\U0010ffff") == "b"
    assert after("\U0010ffff") is None

    def best(prefixes, text):
        fits = [p for p in prefixes if text.startswith(p)]
        return prefixes[max(fits, key=len)] if fits else -1

    def look(book, text):
        return [v for start, v in book.marks if start <= text][-1]

    random.seed(5)
    for size in (0, 1, 3, 20, 100):
        one, two = ({p: n for n, p in enumerate(random.sample(texts, size))} for _ in range(2))
        books = flatten(one, -1), flatten(two, -1)
        for prefixes, book in zip((one, two), books):
            assert [s for s, _ in book.marks] == sorted({s for s, _ in book.marks})
            assert all(look(book, t) == best(prefixes, t) for t in texts)
        both = combine(*books, lambda a, b: a != b)
        assert all(look(both, t) == (best(one, t) != best(two, t)) for t in texts)
    assert len(combine(books[0], books[0], lambda a, b: a != b).marks) == 1


def test_many_rates(spark):
    """A hundred thousand prefixes: both ways find the same, the longest."""
    from meterlake import schema

    rows = [("openai", f"m{n}", float(n), 0.0, 0.0, 0.0, 0.0) for n in range(100_000)]
    rates = spark.createDataFrame(rows, schema.RATES)
    models = [(f"m{n * 977 % 200_000}-x",) for n in range(500)]
    events = spark.createDataFrame(models, "model string").withColumn("provider", F.lit("openai"))
    for bounds in BOUNDS:
        for row in rate_lookup(events, rates, **bounds).collect():
            digits = row.model[1:-2]
            assert row.rate.input == float(digits if int(digits) < 100_000 else digits[:-1])
