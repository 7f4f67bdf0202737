"""Streaming twins of the event operators: the batch function over micro-batches, or a
stateful operator where state must outlive one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "10 minutes"


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, or one such file, as a stream; ``files_per_trigger``
    bounds a tick."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def run_available(df: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what has arrived, in ticks, and stop; the checkpoint resumes after a failure."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest_per_path(changes: DataFrame, path: str, at: str, cap: int = 4096) -> tuple[DataFrame, bool]:
    """Debounce of one micro-batch: the last change per path, and whether there were so
    many that a full rescan is due instead."""
    rest = [c for c in changes.columns if c not in (path, at)]
    last = changes.groupBy(path).agg(F.max(F.struct(at, *rest)).alias("_r")).select(path, *[F.col("_r")[c].alias(c) for c in [at, *rest]])
    overflow = last.limit(cap + 1).count() > cap
    return last, overflow


def reconciled(changes: DataFrame, path: str, at: str, rescan: Callable[[], DataFrame], cap: int = 4096) -> tuple[DataFrame, bool]:
    """A tick's changes, or, where they overflow ``cap``, a full rescan in their place: what
    was pending is dropped, as the rescan covers it."""
    last, overflow = latest_per_path(changes, path, at, cap)
    return (latest_per_path(rescan(), path, at, cap)[0], True) if overflow else (last, False)


class Cursor:
    """A growing long id up to which a reader has read, kept on the shared file system.

    ``page`` takes the rows beyond it and ``advance`` moves it after they are written, so a
    tick that dies in between is read again and one that is replayed adds nothing."""

    def __init__(self, spark: SparkSession, path: str, start: int = 0):
        from tracewell.streaming.feed import Store

        self.store, self.start = Store(spark, path), start

    def value(self) -> int:
        return (self.store.read("cursor") or {"at": self.start})["at"]

    def page(self, rows: DataFrame, ident: str, limit: int | None = None) -> DataFrame:
        after = rows.where(F.col(ident) > self.value())
        return after.orderBy(ident).limit(limit) if limit else after

    def advance(self, to: int | None) -> None:
        if to is not None and to > self.value():
            self.store.write("cursor", {"at": to})


def first_seen(events: DataFrame, key: list[str], at: str) -> DataFrame:
    """Each key once within the watermark: stateful deduplication with bounded state."""
    return events.withWatermark(at, LATE).dropDuplicatesWithinWatermark(key)


def windowed_activity(events: DataFrame, at: str, key: str, length: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Counts per sliding window and key; late rows within the watermark are counted."""
    return events.withWatermark(at, LATE).groupBy(F.window(at, length, slide), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per key, closed by a gap."""
    return events.withWatermark(at, LATE).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def correlated(errors: DataFrame, events: DataFrame, error_at: str, event_at: str, seconds: int = 30) -> DataFrame:
    """Stream-stream join of errors and events within ``seconds`` of each other; both
    watermarks bound the state.  The bucket is an equality, as such a join needs one."""
    b = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    e = errors.withWatermark(error_at, LATE).withColumn("_b", b(error_at))
    v = events.withWatermark(event_at, LATE).withColumn("_b", F.explode(F.array(b(event_at) - 1, b(event_at), b(event_at) + 1)))
    near = F.expr(f"{event_at} BETWEEN {error_at} - INTERVAL {seconds} SECONDS AND {error_at} + INTERVAL {seconds} SECONDS")
    return e.join(v, (e["_b"] == v["_b"]) & near).drop("_b")


def dedup_state(errors: DataFrame, identity: str, ts_ms: str) -> DataFrame:
    """``identity, count, first_ts, last_ts`` updated per micro-batch and error, in
    keyed state of three numbers."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, lo, hi = state.get if state.exists else (0, None, None)
        for p in batches:
            n += len(p)
            a, b = int(p[ts_ms].min()), int(p[ts_ms].max())
            lo, hi = (a if lo is None else min(lo, a)), (b if hi is None else max(hi, b))
        state.update((n, lo, hi))
        yield pd.DataFrame({identity: [key[0]], "count": [n], "first_ts": [lo], "last_ts": [hi]})

    return errors.select(identity, ts_ms).groupBy(identity).applyInPandasWithState(fold, f"{identity} string, count long, first_ts long, last_ts long", "n long, lo long, hi long", "update", "NoTimeout")


class Published:
    """Readers see the last published version; each micro-batch publishes a new one."""

    def __init__(self, spark: SparkSession, path: str):
        from tracewell.streaming.feed import Store

        self.spark, self.path, self.store = spark, path, Store(spark, path)

    def publish(self, df: DataFrame, generation: int, at_ms: int) -> None:
        data = f"{self.path}/generation-{generation:012d}"
        df.write.mode("overwrite").parquet(data)
        self.store.write("current", {"generation": generation, "at_ms": at_ms, "data": data})

    def read(self, now_ms: int) -> tuple[DataFrame, int, int]:
        """The last generation with its number and staleness in ms."""
        c = self.store.read("current")
        if c is None:
            raise FileNotFoundError(f"{self.path}: nothing published yet")
        return self.spark.read.parquet(c["data"]), c["generation"], now_ms - c["at_ms"]


def resume_point(ingested: DataFrame, by: str, at: str) -> DataFrame:
    """The last ingest per source; a source never ingested has no row."""
    return ingested.groupBy(by).agg(F.max(at).alias("last_ingest_at"))
