"""Transcript files as a data source, and which units of them need reading."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "unit string, session string, seq int, role string, ts long, text string"


class Unit(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TranscriptReader(DataSourceReader):
    """One partition per file; a line that is no JSON object is skipped and counted on."""

    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")

    def partitions(self) -> list[Unit]:
        return [Unit(str(p)) for p in sorted(Path(self.root).rglob("*.jsonl"))]

    def read(self, partition: Unit):
        seq = 0
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            for line in f:
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(row, dict):
                    continue
                text = row.get("text") if isinstance(row.get("text"), str) else None
                ts = row.get("ts") if isinstance(row.get("ts"), int) else None
                yield partition.path, str(row.get("session", Path(partition.path).stem)), seq, row.get("role"), ts, text
                seq += 1


class TranscriptSource(DataSource):
    """``spark.read.format("transcripts").load(folder)`` once registered."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TranscriptReader:
        return TranscriptReader(dict(self.options))


def classify_units(now: DataFrame, state: DataFrame) -> DataFrame:
    """``unit, change, from_byte`` by size, time and cursor against the last ingest.

    ``now``: unit, size, mtime, prefix (hash of the first ``bytes`` the state read);
    ``state``: unit, size, mtime, bytes, prefix.  A grown file whose read prefix is the
    same was appended to; any other difference is a rewrite.
    """
    s = state.select("unit", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("bytes").alias("_b"), F.col("prefix").alias("_p"))
    j = now.join(s, "unit", "left")
    change = (
        F.when(F.col("_s").isNull(), "new")
        .when((F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m")), "unchanged")
        .when((F.col("size") > F.col("_s")) & F.col("prefix").eqNullSafe(F.col("_p")), "appended")
        .otherwise("rewritten")
    )
    return j.select("unit", change.alias("change"), F.when(change == "appended", F.col("_b")).otherwise(F.lit(0).cast("long")).alias("from_byte"))


def recent(units: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    """Units changed within the window, its edge included."""
    return units.where(F.col("mtime") >= now_ms - window_ms)
