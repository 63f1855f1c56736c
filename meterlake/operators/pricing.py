"""Pricing events from a rate table with longest-prefix model matching."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from meterlake.operators.intervals import Book, combine, find, flatten

#: Rate tables up to this many rows are searched in the tasks, see :mod:`.intervals` (at most 200
#: bytes a row and a half of names as long as those of models); larger ones are matched by
#: shuffled joins on the distinct models.
MAX_BROADCAST_RATES = 1 << 18

_RATE_FIELDS = ("input", "output", "cache_write_5m", "cache_write_1h", "cache_read")
_KEY, _MODEL = "_rate_key", "_rate_model"

# Which rate list a provider's models are priced from.
TRANSCRIPT_PROVIDER = "claude"
TRANSCRIPT_RATES = "anthropic"
FREE_RATES = "local"
TRANSCRIPT_MODEL_PREFIX = "claude"


def pricing_key() -> Column:
    """Rate list of an event: transcripts of foreign models are local, hence free."""
    own_model = F.coalesce(F.col("model"), F.lit("")).startswith(TRANSCRIPT_MODEL_PREFIX)
    return F.when(
        F.col("provider") == TRANSCRIPT_PROVIDER,
        F.when(own_model, F.lit(TRANSCRIPT_RATES)).otherwise(F.lit(FREE_RATES)),
    ).otherwise(F.col("provider"))


def _one_each(rates: DataFrame) -> DataFrame:
    """One row per provider and prefix: of several the one with the largest rates, compared
    in the order of the fields, whatever the way the facts meet them."""
    best = F.max(_rate_struct()).alias("best")
    return rates.groupBy("provider", "model_prefix").agg(best).select(
        "provider", "model_prefix", "best.*"
    )


def _settled(rates: list[Row]) -> list[Row]:
    """The same for rows on the driver."""

    def size(row: Row) -> tuple:
        return tuple(row[name] or 0.0 for name in _RATE_FIELDS)

    best: dict[tuple, Row] = {}
    for row in rates:
        key = (row["provider"], row["model_prefix"])
        if key not in best or size(row) > size(best[key]):
            best[key] = row
    return list(best.values())


def _rate_struct() -> Column:
    return F.struct(*[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in _RATE_FIELDS])


def _no_rate() -> Column:
    return F.struct(*[F.lit(0.0).alias(n) for n in _RATE_FIELDS])


_RATE = StructType([StructField(n, DoubleType()) for n in _RATE_FIELDS])
_NONE = dict.fromkeys(_RATE_FIELDS, 0.0)


def rate_books(rates: list[Row]) -> dict[str, Book]:
    """The rates of each provider as intervals of model names."""
    defaults: dict[str, dict] = {}
    named: dict[str, dict[str, dict]] = defaultdict(dict)
    for row in _settled(rates):
        rate = {n: float(row[n] or 0.0) for n in _RATE_FIELDS}
        if row["model_prefix"] is None:
            defaults[row["provider"]] = rate
        else:
            named[row["provider"]][row["model_prefix"]] = rate
    providers = [p for p in {**defaults, **named} if p is not None]
    return {p: flatten(named.get(p, {}), defaults.get(p, _NONE)) for p in providers}


def changed_rates(before: list[Row], now: list[Row]) -> dict[str, Book]:
    """By provider, which model names have another rate; providers without a change are left out."""
    old, new, nothing = rate_books(before), rate_books(now), flatten({}, _NONE)
    books = {
        p: combine(old.get(p, nothing), new.get(p, nothing), lambda a, b: a != b) for p in {**old, **new}
    }
    return {p: b for p, b in books.items() if b.default or any(value for _, value in b.marks)}


def _keyed(events: DataFrame) -> DataFrame:
    return events.withColumns({_KEY: pricing_key(), _MODEL: F.nullif(F.col("model"), F.lit(""))})


def at_changed_rates(events: DataFrame, changed: dict[str, Book]) -> DataFrame:
    """Those events whose rate differs, see :func:`changed_rates`; the facts are not shuffled."""
    found = find(_keyed(events), changed, _KEY, _MODEL, BooleanType(), False, "_changed")
    return found.filter("_changed").select(*events.columns)


def _match_with_joins(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Longest prefix by equi-joins only, for rate tables of any size.

    Every distinct model is exploded into its own prefixes, which meet the rate table in a
    hash join. The result is keyed by (provider, model); the skew of the final join on the
    facts is left to adaptive execution.
    """
    named = rates.filter(F.col("model_prefix").isNotNull())
    defaults = rates.filter(F.col("model_prefix").isNull())
    pairs = events.select(_KEY, _MODEL).distinct()
    prefixes = pairs.filter(F.length(_MODEL) > 0).withColumn(
        "_prefix",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.length(_MODEL)), lambda n: F.left(F.col(_MODEL), n)
            )
        ),
    )
    hit = prefixes.join(
        named.select(
            F.col("provider").alias(_KEY),
            F.col("model_prefix").alias("_prefix"),
            _rate_struct().alias("_hit"),
        ),
        [_KEY, "_prefix"],
    )
    longest = hit.groupBy(_KEY, _MODEL).agg(
        F.max(F.struct(F.length("_prefix").alias("len"), F.col("_hit"))).getField("_hit").alias("hit")
    )
    default = defaults.groupBy(F.col("provider").alias(_KEY)).agg(
        F.max(_rate_struct()).alias("default_rate")
    )
    resolved = (
        pairs.join(longest, [_KEY, _MODEL], "left")
        .join(default, _KEY, "left")
        .select(
            _KEY,
            F.col(_MODEL).alias("_pair_model"),
            F.coalesce("hit", "default_rate", _no_rate()).alias("rate"),
        )
        .withColumnRenamed(_KEY, "_pair_key")
    )
    on = events[_KEY].eqNullSafe(resolved["_pair_key"]) & events[_MODEL].eqNullSafe(
        resolved["_pair_model"]
    )
    return events.join(resolved, on, "left").drop("_pair_key", "_pair_model")


def rate_lookup(
    events: DataFrame, rates: DataFrame, max_broadcast: int = MAX_BROADCAST_RATES
) -> DataFrame:
    """Add ``rate``, a struct of the five rates that apply to each event.

    The longest matching model prefix wins (an exact name is the longest possible), else
    the provider's default, else zeros. The rate table is configuration and read here; the facts
    are read once and not shuffled. A table of more than ``max_broadcast`` rows is not read here
    but joined, with the same result.
    """
    keyed = _keyed(events)
    # A rate table made on the driver is listed without a job.
    listed = rates.limit(max_broadcast + 1).collect()
    if len(listed) <= max_broadcast:
        found = find(keyed, rate_books(listed), _KEY, _MODEL, _RATE, _NONE, "rate")
    else:
        found = _match_with_joins(keyed, _one_each(rates))
    return found.drop(_KEY, _MODEL)


def event_cost() -> Column:
    """USD of an event whose ``rate`` is known; each token class at its own rate."""

    def billed(tokens: str, rate: str) -> Column:
        return F.coalesce(F.col(tokens), F.lit(0)) * F.col("rate")[rate]

    return (
        billed("input_tokens", "input")
        + billed("output_tokens", "output")
        + billed("cache_read_tokens", "cache_read")
        + billed("cache_create_5m", "cache_write_5m")
        + billed("cache_create_1h", "cache_write_1h")
    ) / F.lit(1e6)


def price(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Add (or replace) ``cost_usd``."""
    return (
        rate_lookup(events, rates).withColumn("cost_usd", event_cost()).drop("rate")
    )

