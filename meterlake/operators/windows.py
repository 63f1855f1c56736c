"""Totals over trailing windows and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import money
from meterlake.functions.clock import AsOf, before, instant, local_day, trailing
from meterlake.functions.tokens import total_tokens

#: Utilisation from which a limit counts as hot (fixed value).
HOT = 0.85


def _wide_totals(events: DataFrame, windows: dict[str, Column | None]) -> DataFrame:
    """One row with ``<window>_tokens``, ``_cost`` and ``_events``; one scan for all."""
    rows = events.select(
        total_tokens().alias("tokens"),
        money.micro_part(F.col("cost_usd")).alias("micro"),
        money.pico_part(F.col("cost_usd")).alias("pico"),
        *[(F.lit(True) if p is None else p).alias(f"in_{w}") for w, p in windows.items()],
    )

    def inside(window: str, name: str) -> Column:
        return F.when(F.col(f"in_{window}"), F.col(name))

    sums = []
    for w in windows:
        sums += [
            F.coalesce(F.sum(inside(w, "tokens")), F.lit(0)).alias(f"{w}_tokens"),
            money.total(F.sum(inside(w, "micro")), F.sum(inside(w, "pico"))).alias(f"{w}_cost"),
            F.count_if(F.col(f"in_{w}")).alias(f"{w}_events"),
        ]
    return rows.agg(*sums)


def _long(wide: DataFrame, windows: list[str]) -> DataFrame:
    measures = ("tokens", "cost", "events")
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(w).alias("window"), *[F.col(f"{w}_{m}").alias(m) for m in measures]
                    )
                    for w in windows
                ]
            )
        )
    )


def window_totals(events: DataFrame, windows: dict[str, Column | None]) -> DataFrame:
    """Tokens, cost and events of each window; ``None`` means all rows, none gives 0.

    ``windows`` maps a name to a row condition. All windows share one scan.
    """
    return _long(_wide_totals(events, windows), list(windows))


def summary_kpis(events: DataFrame, tz: str, as_of: AsOf = None) -> DataFrame:
    """Totals of the local day, the trailing 7 and 30 days, and all time."""
    now = instant(as_of)
    return window_totals(
        events,
        {
            "today": local_day(F.col("ts"), tz) == local_day(now, tz),
            "last_7d": F.col("ts") >= before(now, days=7),
            "last_30d": F.col("ts") >= before(now, days=30),
            "all_time": None,
        },
    )


def summary_meta(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of events and sessions, first and last instant.

    ``approximate`` counts sessions with a sketch instead of a shuffle on ``session_id``.
    """
    sessions = F.approx_count_distinct if approximate else F.count_distinct
    return events.agg(
        F.count("*").alias("events"),
        sessions("session_id").alias("sessions"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def _burn_totals(events: DataFrame, as_of: AsOf) -> DataFrame:
    now = instant(as_of)
    week = before(now, days=7)
    return _wide_totals(
        trailing(events, week),
        {
            "block_5h": F.col("ts") >= before(now, hours=5),
            "week": F.col("ts") >= week,
            "day": F.col("ts") >= before(now, days=1),
        },
    )


def burn_windows(events: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Totals of the trailing 5 hours, 7 days and 24 hours; reads seven days only."""
    return _long(_burn_totals(events, as_of), ["block_5h", "week", "day"])


def _limit(limit: int | None) -> Column:
    return F.lit(limit or None).cast("bigint")


def limit_utilisation(limit_5h: int | None, limit_week: int | None) -> dict[str, Column]:
    """Share of each limit that is used; NULL without a limit (0 is none)."""
    return {
        "block_5h_utilization": F.col("block_5h_tokens") / _limit(limit_5h),
        "week_utilization": F.col("week_tokens") / _limit(limit_week),
    }


def burn_rate() -> dict[str, Column]:
    """Hourly average of the last 24 hours."""
    return {
        "tokens_per_hour_24h": F.col("day_tokens") / F.lit(24.0),
        "cost_per_hour_24h": F.col("day_cost") / F.lit(24.0),
    }


def forecast_30d() -> dict[str, Column]:
    """Thirty days at the daily average of the last seven."""
    daily_tokens = F.col("week_tokens") / F.lit(7.0)
    daily_cost = F.col("week_cost") / F.lit(7.0)
    return {
        "forecast_tokens": daily_tokens * 30,
        "forecast_cost": daily_cost * 30,
        "daily_avg_tokens": daily_tokens,
        "daily_avg_cost": daily_cost,
    }


def hours_to_limit(limit_5h: int | None) -> dict[str, Column]:
    """Hours until the 5-hour limit at the current rate; NULL without limit or rate."""
    rate = F.col("day_tokens") / F.lit(24.0)
    left = F.greatest(_limit(limit_5h) - F.col("block_5h_tokens"), F.lit(0).cast("bigint"))
    usable = _limit(limit_5h).isNotNull() & (rate != 0)
    return {"hours_to_limit": F.when(usable, left / rate)}


def gauge(utilisation: Column) -> tuple[Column, Column]:
    """Fill of a limit gauge in percent (at most 100) and whether it is hot."""
    fill = F.when(utilisation.isNotNull(), F.least(F.lit(100.0), utilisation * 100))
    return fill, utilisation >= HOT


def burn(
    events: DataFrame,
    as_of: AsOf = None,
    limit_5h: int | None = None,
    limit_week: int | None = None,
) -> DataFrame:
    """The whole burn report in one row and one scan."""
    report = _burn_totals(events, as_of).withColumns(
        {
            "block_5h_limit": _limit(limit_5h),
            "week_limit": _limit(limit_week),
            **limit_utilisation(limit_5h, limit_week),
            **burn_rate(),
            **forecast_30d(),
            **hours_to_limit(limit_5h),
        }
    )
    gauges = {}
    for window in ("block_5h", "week"):
        fill, hot = gauge(F.col(f"{window}_utilization"))
        gauges |= {f"{window}_fill": fill, f"{window}_hot": hot}
    return report.withColumns(gauges)
