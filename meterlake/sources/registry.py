"""Log sources: how each tool's files are found and turned into usage events.

A new tool is one more :class:`Source`. ``records`` maps lines to narrow parsed records
(the expensive step, done once), ``events`` maps those to events in the canonical schema.
Both are DataFrame to DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from meterlake.operators import assistant, rollout


@dataclass(frozen=True)
class Source:
    name: str
    provider: str
    tool: str
    glob: str
    records: Callable[[DataFrame], DataFrame]
    events: Callable[..., DataFrame]
    #: Whether an event depends on earlier lines of its file.
    contextual: bool = False

    def parse(self, lines: DataFrame) -> DataFrame:
        return self.events(self.records(lines))


# Source names, providers, tools and file patterns.
ASSISTANT_LOGS = Source(
    name="claude",
    provider="claude",
    tool="claude-code",
    glob="*.jsonl",
    records=assistant.assistant_records,
    events=assistant.assistant_events,
)
ROLLOUT_LOGS = Source(
    name="codex",
    provider="openai",
    tool="codex-cli",
    glob="rollout-*.jsonl",
    records=rollout.rollout_records,
    events=rollout.rollout_events,
    contextual=True,
)

SOURCES = {source.name: source for source in (ASSISTANT_LOGS, ROLLOUT_LOGS)}
