"""Cases measured by a command of their own, each in a task."""

from __future__ import annotations

import json
import subprocess
import uuid
from collections.abc import Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The names a command may hold in braces besides those of the tools.
PLACES = ("source", "case_id", "case_dir", "result_path")


def measurement(case: str, command: list[str], source: str, folder: str, tools: Mapping[str, str], seconds: float | None) -> tuple[str | None, str | None]:
    """(JSON text, reason) of one case's command, run without a shell in a new folder."""
    if not command:
        return None, "no command"
    path = source.removeprefix("file://").removeprefix("file:") if source else ""
    if not Path(path).is_file():
        return None, "source is not a file"
    own = Path(folder) / "cases" / case / uuid.uuid4().hex
    result = own / "measurement.json"
    values = {**tools, **dict(zip(PLACES, (path, case, str(own), str(result)), strict=True))}
    try:
        asked = [part.format_map(values) for part in command]
    except KeyError as e:
        return None, f"unknown placeholder {e.args[0]}"
    except (ValueError, IndexError, AttributeError):
        return None, "malformed command"
    own.mkdir(parents=True)
    try:
        ended = subprocess.run(asked, check=False, cwd=own, timeout=seconds, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL)
    except subprocess.TimeoutExpired:
        return None, "out of time"
    except OSError as e:
        return None, f"cannot run: {e.strerror}"
    if ended.returncode:
        return None, f"exit code {ended.returncode}"
    try:
        held = json.loads(result.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None, "no valid JSON"
    return (json.dumps(held), None) if isinstance(held, dict) else (None, "result is not an object")


def measured(cases: DataFrame, folder: str, tools: Mapping[str, str], tasks: int, seconds: float | None = None) -> DataFrame:
    """``cases`` (id, source, command, measurement, reason; as ``manifest_cases`` gives them)
    with ``measurement`` from the command where the manifest holds none, and the ``reason``
    where there is none: cases that are unfit already, or whose command failed, took longer
    than ``seconds`` or left no JSON object.  A failed case fails no other.

    Commands are dealt over ``tasks`` by their case.  ``folder`` is one that all executors
    mount; each attempt works in a folder of its own there, so what a lost one left is never
    read.  ``tools`` are the programs' paths by name."""
    kept = [f for f in cases.schema.fields if f.name not in ("measurement", "reason")]
    schema = StructType([*kept, StructField("measurement", StringType()), StructField("reason", StringType())])
    asked = cases.select(*(f"`{f.name}`" for f in kept), "measurement", "reason", F.col("id").alias("__id"), F.col("command").alias("__command"), F.col("source").alias("__source"))
    place, named = folder.removeprefix("file://").removeprefix("file:"), dict(tools)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = len(kept)
        for batch in batches:
            out = []
            for held, why, case, command, source in zip(*(batch.column(n + k).to_pylist() for k in range(5)), strict=True):
                if why is None and held is None:
                    held, why = measurement(case, command or [], source, place, named, seconds)
                out.append((held, why))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *(pa.array([r[k] for r in out], pa.string()) for k in range(2))], names=schema.names)

    return asked.repartition(tasks, "__id").mapInArrow(run, schema)
