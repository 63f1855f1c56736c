import json
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from meterlake.plans.session import BUILD_SETTINGS, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
    settings = {
        **BUILD_SETTINGS,
        "spark.sql.shuffle.partitions": "3",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g",
        # Short jobs gain more from quick compilation than from optimised code.
        "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def write_lines(path: Path, records: list, mode: str = "w", end: str = "\n") -> Path:
    """One JSON document per line; strings are written as they are."""
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    with path.open(mode, newline="") as file:
        file.write("\n".join(lines) + end)
    return path


USAGE = {
    "input_tokens": 1200,
    "output_tokens": 640,
    "cache_creation_input_tokens": 3000,
    "cache_read_input_tokens": 7000,
    "cache_creation": {"ephemeral_5m_input_tokens": 3000, "ephemeral_1h_input_tokens": 0},
    "service_tier": "standard",
}


def turn(request="r1", message="m1", usage=USAGE, **changes) -> dict:
    """A transcript record; ``None`` leaves a field out."""
    record = {
        "type": "assistant",
        "uuid": "u",
        "requestId": request,
        "sessionId": "talk-1",
        "timestamp": "2026-03-05T08:30:15.250Z",
        "cwd": "/work/atlas",
        "gitBranch": "trunk",
        "message": {"id": message, "model": "claude-opus-4-8", "usage": usage},
        **changes,
    }
    record["message"] = {k: v for k, v in (record["message"] or {}).items() if v is not None}
    return {k: v for k, v in record.items() if v is not None}


def session(id_="night-run", cwd="/work/atlas") -> dict:
    return {
        "type": "session_meta",
        "timestamp": "2026-03-05T07:10:00Z",
        "payload": {"id": id_, "cwd": cwd},
    }


def model(name="gpt-5.3-codex") -> dict:
    return {
        "type": "turn_context",
        "timestamp": "2026-03-05T07:10:01Z",
        "payload": {"model": name, "cwd": "/work/atlas"},
    }


def tokens(input_=1000, cached=200, output=300, reasoning=100, **changes) -> dict:
    """A usage record of a rollout, with a running total that must be ignored."""
    return {
        "type": "event_msg",
        "timestamp": "2026-03-05T07:10:05Z",
        "payload": {
            "type": "token_count",
            "info": {
                "last_token_usage": {
                    "input_tokens": input_,
                    "cached_input_tokens": cached,
                    "output_tokens": output,
                    "reasoning_output_tokens": reasoning,
                },
                "total_token_usage": {"input_tokens": 10**6, "output_tokens": 10**6},
            },
        },
        **changes,
    }


def rollout_name(n: int = 1) -> str:
    return f"rollout-2026-03-05T07-10-00-{n:08d}-aaaa-bbbb-cccc-0123456789ab.jsonl"


def by_key(rows, key: str) -> dict:
    return {row[key]: row for row in rows}
