"""Plain SQL for every registered query, over the same tables.

The SQL recomputes each result from the ``events`` table by other means than the engine:
no JSON, no block-wise carry, DECIMAL money sums, ordinary joins for rates.
"""

from __future__ import annotations

from meterlake.checks.logs import ODD_FOLDERS
from meterlake.checks.usage_view import (
    AS_OF,
    CLAUDE_MODELS,
    LIMIT_5H,
    LIMIT_WEEK,
    OPENAI_MODELS,
    TZ,
)
from meterlake.sources.rates import DEFAULT_RATES

CUT = "2024-01-16 00:00:00"
#: Factor of the second rate table in the repricing check.
RATE_FACTOR = 1.5


def _text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _models(values: tuple) -> str:
    whens = " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(values))
    return f"CASE id % {len(values)} {whens} END"


def _rates(factor: float) -> str:
    rows = ", ".join(
        f"({_text(p)}, {_text(m)}, {', '.join(f'CAST({r * factor!r} AS DOUBLE)' for r in rates)})"
        for p, m, *rates in DEFAULT_RATES
    )
    return (
        "rates(provider, prefix, r_input, r_output, r_write_5m, r_write_1h, r_read) AS "
        f"(VALUES {rows})"
    )


BASE = f"""
raw AS (SELECT event_id AS id, ts, user_id, event_type, event_id % 3 < 2 AS is_claude FROM events),
base AS (
  SELECT id, user_id, event_type,
    'ev:' || id AS event_id,
    CASE WHEN is_claude THEN 'claude' ELSE 'openai' END AS provider,
    CASE WHEN is_claude THEN 'claude-code' ELSE 'codex-cli' END AS tool,
    'req' || id AS request_id,
    CASE WHEN id % 50 <> 0 THEN 's' || user_id || '-' || event_type END AS session_id,
    CASE WHEN is_claude THEN {_models(CLAUDE_MODELS)} ELSE {_models(OPENAI_MODELS)} END AS model,
    ts,
    (id * 37) % 2000 AS input_tokens,
    (id * 53) % 1500 AS output_tokens,
    CASE WHEN is_claude THEN (id * 71) % 3000 ELSE 0 END AS cache_creation_tokens,
    (id * 97) % 20000 AS cache_read_tokens,
    CASE WHEN is_claude AND id % 4 <> 0 THEN (id * 71) % 3000 ELSE 0 END AS cache_create_5m,
    CASE WHEN is_claude AND id % 4 = 0 THEN (id * 71) % 3000 ELSE 0 END AS cache_create_1h,
    CASE WHEN is_claude THEN 0 ELSE (id * 13) % 400 END AS reasoning_tokens,
    id % 5 AS web_search_requests,
    id % 3 AS web_fetch_requests,
    CASE WHEN is_claude THEN 'standard' END AS service_tier,
    CASE WHEN user_id % 12 <> 0 THEN '/home/u/p' || (user_id % 12) END AS project,
    'main' AS git_branch,
    '/logs/u' || user_id || '.jsonl' AS source_file
  FROM raw)"""


def _priced(source: str, name: str = "usage", factor: float = 1.0) -> str:
    """CTEs that price the rows of ``source``."""
    return f"""
{_rates(factor)},
keyed AS (
  SELECT *, CASE WHEN provider <> 'claude' THEN provider
                 WHEN coalesce(model, '') LIKE 'claude%' THEN 'anthropic'
                 ELSE 'local' END AS rate_key
  FROM {source}),
candidates AS (
  SELECT p.rate_key, p.model, r.*, row_number() OVER (
    PARTITION BY p.rate_key, p.model
    ORDER BY CASE WHEN r.prefix IS NULL THEN 0 ELSE length(r.prefix) END DESC) AS rank
  FROM (SELECT DISTINCT rate_key, model FROM keyed) p
  JOIN rates r ON r.provider = p.rate_key
   AND (r.prefix IS NULL OR starts_with(coalesce(p.model, ''), r.prefix))),
{name} AS (
  SELECT k.*, c.r_input, c.r_output, c.r_write_5m, c.r_write_1h, c.r_read,
    (k.input_tokens * c.r_input + k.output_tokens * c.r_output + k.cache_read_tokens * c.r_read
     + k.cache_create_5m * c.r_write_5m + k.cache_create_1h * c.r_write_1h) / 1e6 AS cost_usd,
    k.input_tokens + k.output_tokens + k.cache_creation_tokens + k.cache_read_tokens AS total
  FROM keyed k JOIN candidates c
    ON c.rate_key = k.rate_key AND c.model IS NOT DISTINCT FROM k.model AND c.rank = 1)"""


USAGE = f"WITH {BASE}, {_priced('base')}"

TRANSCRIPT = f"""{BASE},
copies AS (
  SELECT b.*, c.copy,
    id % 23 <> 0 AS is_assistant, id % 17 = 0 AS idle,
    id % 19 = 0 AND copy = 1 AS torn, id % 31 = 0 AND copy = 2 AS is_array
  FROM base b CROSS JOIN (VALUES (1), (2), (3)) c(copy)
  WHERE provider = 'claude' AND copy <= 1 + id % 3),
counted AS (
  SELECT *,
    CASE WHEN id % 11 <> 0 THEN 'req' || id WHEN id % 13 <> 0 THEN 'msg' || id END AS rid,
    CASE WHEN id % 8 = 3 THEN date_trunc('second', ts) ELSE ts END AS stamp,
    CASE WHEN idle THEN 0 ELSE input_tokens END AS inp,
    CASE WHEN idle THEN 0 ELSE output_tokens END AS outp,
    CASE WHEN idle OR id % 10 = 2 THEN 0 ELSE cache_creation_tokens END AS made,
    CASE WHEN idle THEN 0 ELSE cache_read_tokens END AS readt,
    CASE WHEN id % 6 = 1 THEN 0 ELSE cache_create_5m END AS split5,
    CASE WHEN id % 6 = 1 THEN 0 ELSE cache_create_1h END AS split1
  FROM copies),
split AS (
  SELECT *, CASE WHEN split5 + split1 = 0 AND made > 0 THEN made ELSE split5 END AS five
  FROM counted
  WHERE is_assistant AND NOT torn AND NOT is_array AND id % 29 <> 0 AND rid IS NOT NULL
    AND inp + outp + made + readt <> 0),
assistant_rows AS (
  SELECT 'claude:' || rid AS event_id, 'claude' AS provider, 'claude-code' AS tool,
    rid AS request_id, session_id, model, stamp AS ts, inp AS input_tokens,
    outp AS output_tokens,
    CASE WHEN made = 0 THEN five + split1 ELSE made END AS cache_creation_tokens,
    readt AS cache_read_tokens, five AS cache_create_5m, split1 AS cache_create_1h,
    0 AS reasoning_tokens, web_search_requests, web_fetch_requests, service_tier, project,
    git_branch, source_file, copy
  FROM split),
assistant_first AS (
  SELECT * EXCLUDE (copy, nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY copy) AS nth FROM assistant_rows)
  WHERE nth = 1)"""

ROLLOUT = f"""
rollout_base AS (
  SELECT *, CASE WHEN user_id % 3 = 0 THEN '/logs/rollout-u' || user_id || '.jsonl'
    ELSE '/logs/rollout-2024-01-01T00-00-00-00000000-0000-4000-8000-'
         || lpad(CAST(user_id AS VARCHAR), 12, '0') || '.jsonl' END AS file,
    CASE WHEN user_id % 3 = 0 THEN 'rollout-u' || user_id
    ELSE '00000000-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') END AS named
  FROM base WHERE provider = 'openai'),
rollout_lines AS (
  SELECT *, 0 AS k, CASE WHEN id % 20 <> 0 THEN 'm' || id END AS session_set,
    NULL AS model_set FROM rollout_base WHERE id % 10 = 0
  UNION ALL SELECT *, 1, NULL, model FROM rollout_base WHERE id % 4 = 0
  UNION ALL SELECT *, 2, NULL, NULL FROM rollout_base),
carried AS (
  SELECT *,
    last_value(model_set IGNORE NULLS) OVER before AS seen_model,
    coalesce(last_value(session_set IGNORE NULLS) OVER before, named) AS seen_session,
    count(*) FILTER (WHERE k = 2) OVER before AS ordinal,
    CASE WHEN id % 17 = 0 THEN 0 ELSE input_tokens END AS inp,
    CASE WHEN id % 17 = 0 THEN 0 ELSE output_tokens END AS outp
  FROM rollout_lines
  WINDOW before AS (PARTITION BY file ORDER BY id, k
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rollout_rows AS (
  SELECT 'codex:' || seen_session || ':' || ordinal AS event_id, 'openai' AS provider,
    'codex-cli' AS tool, CAST(NULL AS VARCHAR) AS request_id, seen_session AS session_id,
    seen_model AS model, ts, greatest(inp - cache_read_tokens, 0) AS input_tokens,
    outp AS output_tokens, 0 AS cache_creation_tokens, cache_read_tokens,
    0 AS cache_create_5m, 0 AS cache_create_1h, reasoning_tokens, 0 AS web_search_requests,
    0 AS web_fetch_requests, CAST(NULL AS VARCHAR) AS service_tier,
    CAST(NULL AS VARCHAR) AS project, CAST(NULL AS VARCHAR) AS git_branch,
    file AS source_file
  FROM carried WHERE k = 2 AND (inp <> 0 OR outp <> 0))"""

#: Events of both sources, with the id of the event they come from.
BOTH = """merged AS (
  SELECT *, CAST(regexp_extract(request_id, '([0-9]+)', 1) AS BIGINT) AS of_id FROM assistant_first
  UNION ALL BY NAME
  SELECT r.*, c.id AS of_id FROM rollout_rows r JOIN carried c
    ON c.k = 2 AND r.event_id = 'codex:' || c.seen_session || ':' || c.ordinal)"""

#: Ids at which the second and third third of the events begin.
CUTS = """cuts AS (SELECT max(event_id) // 3 AS first_cut, 2 * max(event_id) // 3 AS second_cut FROM events)"""

#: Which of them an ``id`` belongs to, from 0.
STAGE = "CAST(id >= first_cut AS INTEGER) + CAST(id >= second_cut AS INTEGER)"

FOLDER = f"list_extract([{', '.join(_text(f) for f in ODD_FOLDERS)}], user_id % {len(ODD_FOLDERS)} + 1)"

PLAIN = f"""plain AS (
  SELECT id, user_id, {FOLDER} AS folder,
    CASE WHEN id % 9 = 0 THEN '' ELSE id || ' ' || event_type || ' ' || repeat('x', CAST(id % 40 AS INTEGER))
    END AS line
  FROM base)"""

_BIGINTS = (
    "input_tokens output_tokens cache_creation_tokens cache_read_tokens cache_create_5m "
    "cache_create_1h reasoning_tokens web_search_requests web_fetch_requests"
).split()
_TEXTS = (
    "event_id provider tool request_id session_id model service_tier project git_branch "
    "source_file"
).split()
EVENT_COLUMNS = ", ".join(
    [*_TEXTS, "ts", *[f"CAST({c} AS BIGINT) AS {c}" for c in _BIGINTS]]
)

NOW = f"TIMESTAMP '{AS_OF}'"
DAY = f"CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}' AS DATE)"
TODAY = f"CAST({NOW} AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}' AS DATE)"


def _cost(condition: str = "true", column: str = "cost_usd") -> str:
    return (
        f"CAST(coalesce(sum(CAST({column} AS DECIMAL(38,12))) FILTER (WHERE {condition}), 0) "
        "AS DOUBLE)"
    )


def _sum(column: str, condition: str = "true") -> str:
    return f"CAST(coalesce(sum({column}) FILTER (WHERE {condition}), 0) AS BIGINT)"


def _windows(windows: dict[str, str]) -> str:
    rows = [
        f"SELECT '{name}' AS \"window\", {_sum('total', cond)} AS tokens, {_cost(cond)} AS cost, "
        f"count(*) FILTER (WHERE {cond}) AS events FROM usage"
        for name, cond in windows.items()
    ]
    return USAGE + " " + " UNION ALL ".join(rows)


_CLASSES = ", ".join(
    f"{_sum(column)} AS {name}"
    for name, column in (
        ("input", "input_tokens"),
        ("output", "output_tokens"),
        ("cache_read", "cache_read_tokens"),
        ("cache_creation", "cache_creation_tokens"),
    )
)
_MEASURES = f"{_cost()} AS cost, {_sum('total')} AS tokens, {_CLASSES}"
_RECENT = f"ts >= {NOW} - INTERVAL 30 DAY"

#: Daily series in long form, as CTE ``daily``.
DAILY = f"""{USAGE},
daily AS (
  SELECT provider AS series, {DAY} AS day, {_MEASURES} FROM usage WHERE {_RECENT}
  GROUP BY provider, {DAY}
  UNION ALL
  SELECT 'combined', {DAY}, {_MEASURES} FROM usage WHERE {_RECENT} GROUP BY {DAY})"""

BURN = f"""{USAGE},
b AS (
  SELECT {_sum('total', f"ts >= {NOW} - INTERVAL 5 HOUR")} AS block_tokens,
         {_sum('total', f"ts >= {NOW} - INTERVAL 7 DAY")} AS week_tokens,
         {_sum('total', f"ts >= {NOW} - INTERVAL 1 DAY")} AS day_tokens,
         {_cost(f"ts >= {NOW} - INTERVAL 7 DAY")} AS week_cost,
         {_cost(f"ts >= {NOW} - INTERVAL 1 DAY")} AS day_cost
  FROM usage)"""

_FIRST = "arg_min({c}, (ts, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}"

_THRESHOLDS = ["mx"]
for _ in range(5):
    _THRESHOLDS.append(f"({_THRESHOLDS[-1]} / 3.0::DOUBLE)")
_BUCKET = " + ".join(f"CAST(value >= {t} AS INTEGER)" for t in _THRESHOLDS)

_GRID = f"""{DAILY},
edge AS (SELECT max(day) AS last_day, max(day) - 29 AS first_day FROM daily),
cells AS (
  SELECT s.series, CAST(d.day AS DATE) AS day, e.first_day
  FROM (SELECT DISTINCT series FROM daily) s, edge e,
       LATERAL (SELECT unnest(generate_series(e.first_day, e.last_day, INTERVAL 1 DAY)) AS day) d)"""


def oracle_sql() -> dict[str, str]:
    assistants = f"WITH {TRANSCRIPT} SELECT {EVENT_COLUMNS}"
    rollouts = f"WITH {BASE}, {ROLLOUT} SELECT {EVENT_COLUMNS} FROM rollout_rows"
    hours = f"""SELECT week_tokens / 7.0::DOUBLE * 30 AS forecast_tokens,
      week_cost / 7.0::DOUBLE * 30 AS forecast_cost,
      week_tokens / 7.0::DOUBLE AS daily_avg_tokens, week_cost / 7.0::DOUBLE AS daily_avg_cost FROM b"""
    utilisation = f"""SELECT CAST(block_tokens AS DOUBLE) / {LIMIT_5H} AS block_5h_utilization,
      CAST(week_tokens AS DOUBLE) / {LIMIT_WEEK} AS week_utilization FROM b"""
    looked_up = f"""{USAGE} SELECT event_id, r_input AS input, r_output AS output,
      r_write_5m AS cache_write_5m, r_write_1h AS cache_write_1h, r_read AS cache_read FROM usage"""
    ingested = f"""WITH {TRANSCRIPT}, {ROLLOUT}, {BOTH}, {_priced('merged')}
      SELECT event_id, cost_usd, CAST(total AS BIGINT) AS tokens FROM usage"""
    by_project = f"""{USAGE} SELECT coalesce(usage.project, '(none)') AS project, provider,
            count(*) AS events, count(DISTINCT session_id) AS sessions, {_sum('total')} AS tokens,
            {_cost()} AS cost, max(ts) AS last_ts FROM usage GROUP BY usage.project, provider
            ORDER BY cost DESC, 1, provider LIMIT 30"""
    dearer = f"WITH {BASE}, {_priced('base', factor=RATE_FACTOR)}"
    return {
        # pricing
        "pricing_key": f"{USAGE} SELECT event_id, rate_key FROM usage",
        **{name: looked_up for name in ("rate_lookup", "rate_lookup_book", "rate_lookup_joined")},
        **{name: f"{USAGE} SELECT event_id, cost_usd FROM usage" for name in ("event_cost", "load_rates")},
        "reprice": f"""WITH {BASE}, {_priced('base', factor=RATE_FACTOR)}
            SELECT event_id, cost_usd FROM usage""",
        # parsing
        "parse_assistant": f"{assistants} FROM assistant_rows",
        "parse_rollout": rollouts,
        "rollout_carry": f"""WITH {BASE}, {ROLLOUT}
            SELECT file AS source_file, id * 10 + k AS line_id, seen_model AS model,
              seen_session AS session_id, CAST(ordinal AS BIGINT) AS ordinal
            FROM carried WHERE k = 2""",
        "dedup_first": f"{assistants} FROM assistant_first",
        "canonical_union": f"""WITH {TRANSCRIPT}, {ROLLOUT}
            SELECT event_id, provider, tool, CAST(input_tokens + output_tokens
              + cache_creation_tokens + cache_read_tokens AS BIGINT) AS tokens
            FROM (SELECT * FROM assistant_first UNION ALL BY NAME SELECT * FROM rollout_rows)""",
        "total_tokens": f"{USAGE} SELECT event_id, CAST(total AS BIGINT) AS tokens FROM usage",
        # tables
        "append_new_events": f"""WITH {BASE} SELECT event_id, CAST(ts AS DATE) AS event_date
            FROM base WHERE ts >= TIMESTAMP '{CUT}'""",
        "changed_files": f"""WITH {BASE},
            now_ AS (SELECT source_file, CAST(sum(id) AS BIGINT) AS size, max(ts) AS mtime
                     FROM base GROUP BY source_file),
            then_ AS (SELECT source_file, CAST(sum(id) AS BIGINT) AS size, max(ts) AS mtime
                      FROM base WHERE ts < TIMESTAMP '{CUT}' GROUP BY source_file)
            SELECT n.* FROM now_ n LEFT JOIN then_ t USING (source_file)
            WHERE t.source_file IS NULL OR t.size <> n.size OR t.mtime <> n.mtime""",
        "upsert_ingest_state": f"""WITH {BASE}
            SELECT source_file, max(id) AS last_offset, max(ts) AS last_mtime,
              CASE WHEN count(*) FILTER (WHERE ts >= TIMESTAMP '{CUT}') > 0
                THEN count(*) FILTER (WHERE ts >= TIMESTAMP '{CUT}') ELSE count(*) END AS last_size,
              count(*) AS rows, max(ts) AS updated_at
            FROM base GROUP BY source_file""",
        "ingest_summary": f"""WITH {BASE},
            files AS (SELECT CASE tool WHEN 'claude-code' THEN 'claude' ELSE 'codex' END AS source,
              source_file, count(*) FILTER (WHERE ts >= TIMESTAMP '{CUT}') AS fresh
              FROM base GROUP BY ALL)
            SELECT source, count(*) AS files_scanned,
              count(*) FILTER (WHERE fresh > 0) AS files_with_new_rows,
              CAST(sum(fresh) AS BIGINT) AS events_inserted
            FROM files GROUP BY source""",
        "metadata_upsert": f"""WITH {BASE}
            SELECT 'user:' || user_id AS key,
              arg_max(event_type || '-' || id, (ts, event_type || '-' || id)) AS value,
              max(ts) AS updated_at
            FROM base GROUP BY user_id""",
        "quarantine": f"""WITH {TRANSCRIPT}
            SELECT source_file, id * 10 + copy AS line_id,
              CASE WHEN torn THEN 'not_json' ELSE 'not_an_object' END AS reason
            FROM copies WHERE torn OR is_array""",
        "discover_files": f"""WITH {BASE}, {PLAIN}
            SELECT folder, user_id, CAST(sum(length(line) + 1) AS BIGINT) AS size
            FROM plain GROUP BY folder, user_id""",
        "read_log_lines": f"""WITH {BASE}, {PLAIN}
            SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY id) AS INTEGER)
              AS position, line AS value FROM plain WHERE line <> ''""",
        "ingest": ingested,
        "ingest_append": f"""WITH {TRANSCRIPT}, {ROLLOUT}, {BOTH}, {_priced('merged')}, {CUTS}
            SELECT event_id, cost_usd, CAST(total AS BIGINT) AS tokens,
              1 + {STAGE} AS pass
            FROM (SELECT *, of_id AS id FROM usage), cuts""",
        "ingest_odd_paths": f"""WITH {TRANSCRIPT}
            SELECT way, {FOLDER} AS folder, count(DISTINCT user_id) AS files, count(*) AS events,
              CAST(sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) AS BIGINT)
                AS tokens
            FROM (SELECT *, CAST(regexp_extract(source_file, '([0-9]+)', 1) AS BIGINT) AS user_id
                  FROM assistant_first), (VALUES ('batch'), ('stream')) w(way)
            GROUP BY way, folder""",
        # totals
        "window_totals": _windows(
            {
                "last_12h": f"ts >= {NOW} - INTERVAL 12 HOUR",
                "last_3d": f"ts >= {NOW} - INTERVAL 3 DAY",
                "never": "ts < TIMESTAMP '1990-01-01'",
            }
        ),
        "summary_kpis": _windows(
            {
                "today": f"{DAY} = {TODAY}",
                "last_7d": f"ts >= {NOW} - INTERVAL 7 DAY",
                "last_30d": f"ts >= {NOW} - INTERVAL 30 DAY",
                "all_time": "true",
            }
        ),
        "summary_meta": f"""WITH {BASE} SELECT count(*) AS events,
            count(DISTINCT session_id) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts
            FROM base""",
        "burn_windows": _windows(
            {
                "block_5h": f"ts >= {NOW} - INTERVAL 5 HOUR",
                "week": f"ts >= {NOW} - INTERVAL 7 DAY",
                "day": f"ts >= {NOW} - INTERVAL 1 DAY",
            }
        ),
        "limit_utilisation": f"{BURN} {utilisation}",
        "burn_rate": f"""{BURN} SELECT day_tokens / 24.0::DOUBLE AS tokens_per_hour_24h,
            day_cost / 24.0::DOUBLE AS cost_per_hour_24h FROM b""",
        "forecast_30d": f"{BURN} {hours}",
        "hours_to_limit": f"""{BURN} SELECT CASE WHEN day_tokens <> 0 THEN
            greatest({LIMIT_5H} - block_tokens, 0) / (day_tokens / 24.0::DOUBLE) END
            AS hours_to_limit FROM b""",
        "gauge": f"""{BURN}, u AS ({utilisation})
            SELECT least(100.0::DOUBLE, block_5h_utilization * 100) AS block_5h_fill,
              block_5h_utilization >= 0.85::DOUBLE AS block_5h_hot,
              least(100.0::DOUBLE, week_utilization * 100) AS week_fill,
              week_utilization >= 0.85::DOUBLE AS week_hot FROM u""",
        # breakdowns
        "by_provider": f"""{USAGE} SELECT provider, {_sum('total')} AS tokens, {_cost()} AS cost,
            max(ts) AS last_ts FROM usage GROUP BY provider""",
        "by_model": f"""{USAGE} SELECT provider, coalesce(usage.model, '(unknown)') AS model,
            count(*) AS events, {_sum('total')} AS tokens, {_cost()} AS cost, {_CLASSES}
            FROM usage GROUP BY provider, usage.model""",
        "cache_hit_ratio": f"""{USAGE}, m AS (SELECT provider, usage.model AS model, {_CLASSES}
            FROM usage GROUP BY provider, usage.model)
            SELECT provider, coalesce(model, '(unknown)') AS model,
              CASE WHEN input + cache_read + cache_creation > 0
                THEN CAST(cache_read AS DOUBLE) / (input + cache_read + cache_creation)
                ELSE 0.0::DOUBLE END AS cache_hit_ratio FROM m""",
        "by_project": by_project,
        "by_project_sketch": f"SELECT *, true AS within_bound FROM ({by_project})",
        "project_label": f"""WITH {BASE} SELECT DISTINCT project, CASE
            WHEN project IS NULL THEN '(none)'
            ELSE '.../u/p' || (user_id % 12) END AS label FROM base""",
        "top_sessions": f"""{USAGE} SELECT session_id,
            {_FIRST.format(c='provider')}, {_FIRST.format(c='model')}, {_FIRST.format(c='project')},
            count(*) AS turns, {_sum('total')} AS tokens, {_cost()} AS cost,
            min(ts) AS first_ts, max(ts) AS last_ts
            FROM usage WHERE session_id IS NOT NULL GROUP BY session_id
            ORDER BY cost DESC, session_id LIMIT 25""",
        "top_turns": f"""{USAGE} SELECT provider, model, project, session_id, ts,
            input_tokens AS input, output_tokens AS output, cache_read_tokens AS cache_read,
            CAST(cache_creation_tokens AS BIGINT) AS cache_creation,
            CAST(total AS BIGINT) AS tokens, cost_usd AS cost
            FROM usage ORDER BY cost_usd DESC, event_id LIMIT 25""",
        # daily series
        "daily_by_provider": f"""{DAILY} SELECT day, series AS provider, * EXCLUDE (day, series)
            FROM daily WHERE series <> 'combined'""",
        "daily_combined": f"{DAILY} SELECT * EXCLUDE (series) FROM daily WHERE series = 'combined'",
        "daily_burn": f"{DAILY} SELECT * FROM daily",
        "select_metric": f"{DAILY} SELECT series, day, CAST(tokens AS DOUBLE) AS value FROM daily",
        "moving_avg_7": f"""{DAILY} SELECT series, day, cost AS value,
            CAST(sum(CAST(cost AS DECIMAL(38,12))) OVER w AS DOUBLE) / count(*) OVER w AS moving_avg
            FROM daily WINDOW w AS (PARTITION BY series ORDER BY day
              ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
        "moving_avg_7_tokens": f"""{DAILY} SELECT series, day, CAST(tokens AS DOUBLE) AS value,
            CAST(sum(tokens) OVER w AS DOUBLE) / count(*) OVER w AS moving_avg
            FROM daily WINDOW w AS (PARTITION BY series ORDER BY day
              ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
        "daily_burn_kept": f"{DAILY.replace(USAGE, dearer, 1)} SELECT * FROM daily",
        "color_bucket": f"""{DAILY}, v AS (SELECT series, day, cost AS value,
              max(cost) OVER (PARTITION BY series) AS mx FROM daily)
            SELECT series, day, value, CASE WHEN mx > 0 THEN {_BUCKET} ELSE 0 END AS bucket FROM v""",
        "panel_totals": f"""{DAILY} SELECT series, {_cost(column='cost')} AS cost,
            CAST(sum(tokens) AS BIGINT) AS tokens FROM daily GROUP BY series""",
        "calendar_grid": f"""{_GRID} SELECT c.series, c.day,
            CAST(date_diff('day', c.first_day - CAST(dayofweek(c.first_day) AS INTEGER), c.day) // 7
              AS BIGINT) AS week,
            CAST(dayofweek(c.day) + 1 AS INTEGER) AS weekday,
            coalesce(d.cost, 0.0::DOUBLE) AS cost, coalesce(d.tokens, 0) AS tokens
            FROM cells c LEFT JOIN daily d ON d.series = c.series AND d.day = c.day""",
        # streams
        "tail_source": f"""WITH {TRANSCRIPT}, {ROLLOUT} SELECT event_id, CAST(input_tokens
              + output_tokens + cache_creation_tokens + cache_read_tokens AS BIGINT) AS tokens
            FROM (SELECT * FROM assistant_first UNION ALL BY NAME SELECT * FROM rollout_rows)""",
        "stream_summary": f"""WITH {TRANSCRIPT}, {ROLLOUT}, {BOTH}, {CUTS},
            lines AS (
              SELECT 'claude' AS source, id, source_file, torn OR is_array AS bad FROM copies
              UNION ALL SELECT 'codex', id, file, false FROM rollout_lines),
            added AS (
              SELECT CASE provider WHEN 'claude' THEN 'claude' ELSE 'codex' END AS source,
                of_id AS id, source_file FROM merged),
            read AS (
              SELECT source, {STAGE} AS batch, count(DISTINCT source_file) AS files_scanned,
                count(*) FILTER (WHERE bad) AS lines_rejected FROM lines, cuts GROUP BY ALL),
            gave AS (
              SELECT source, {STAGE} AS batch, count(DISTINCT source_file) AS files_with_new_rows,
                count(*) AS events_inserted FROM added, cuts GROUP BY ALL)
            SELECT *, CAST(0 AS BIGINT) AS files_unread FROM read JOIN gave USING (source, batch)""",
        "stream_rejects": f"""WITH {TRANSCRIPT}, {ROLLOUT},
            bad AS (
              SELECT 'u' || user_id || '.jsonl' AS file,
                CASE WHEN torn THEN 'not_json' ELSE 'not_an_object' END AS reason
              FROM copies WHERE torn OR is_array
              UNION ALL SELECT DISTINCT replace(file, '/logs/', ''), 'not_json'
              FROM rollout_base WHERE user_id % 5 = 0)
            SELECT file, reason, count(*) AS lines FROM bad GROUP BY ALL""",
        "stream_ingest": ingested,
        "stream_rollout_carry": rollouts,
        "stream_dedup": f"WITH {BASE} SELECT event_id, ts FROM base",
        "stream_daily": f"""{USAGE},
            local AS (SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}' AS local_ts FROM usage)
            SELECT CAST(local_ts AS DATE) AS day, provider, {_MEASURES} FROM local
            WHERE date_trunc('day', local_ts) + INTERVAL 1 DAY
                  <= (SELECT max(local_ts) FROM local) - INTERVAL 1 DAY
            GROUP BY CAST(local_ts AS DATE), provider""",
        "stream_burn": f"""{USAGE},
            steps AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS step, {_sum('total')} AS tokens,
              sum(CAST(cost_usd AS DECIMAL(38,12))) AS cost FROM usage GROUP BY ALL),
            spans AS (SELECT step - INTERVAL 15 MINUTE * k AS start, tokens, cost
              FROM steps, range(20) r(k)),
            t AS (SELECT start, start + INTERVAL 5 HOUR AS "end",
              CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost
              FROM spans GROUP BY start)
            SELECT *, CAST(tokens AS DOUBLE) / {LIMIT_5H} AS utilization,
              least(100.0::DOUBLE, CAST(tokens AS DOUBLE) / {LIMIT_5H} * 100) AS fill,
              CAST(tokens AS DOUBLE) / {LIMIT_5H} >= 0.85::DOUBLE AS hot
            FROM t WHERE "end" <= (SELECT max(ts) FROM usage) - INTERVAL 1 HOUR""",
    }
