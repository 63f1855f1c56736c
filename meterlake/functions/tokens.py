"""Token arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes that make up total tokens. Reasoning is already inside output, and the
#: 5-minute / 1-hour columns only split cache creation for pricing.
BILLABLE = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


def total_tokens() -> Column:
    """Tokens of an event over every billable class."""
    total = F.col(BILLABLE[0])
    for name in BILLABLE[1:]:
        total = total + F.col(name)
    return total


def cache_hit_ratio(input_: Column, cache_read: Column, cache_creation: Column) -> Column:
    """Share of the prompt side that was served from cache; 0 without a prompt side."""
    side = input_ + cache_read + cache_creation
    return F.when(side > 0, cache_read / side).otherwise(F.lit(0.0))
