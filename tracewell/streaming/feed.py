"""A durable change feed over an append log, and the sink that takes its batches.

Each run first writes its plan - the offset range of every log partition - then reads
exactly that range, hands it to the sink, and commits.  A run that dies after its
plan leaves it open; the next run replays it, range for range, before it plans anew.
Nothing is ever deleted or moved away before its successor stands, so a crash at any
step leaves a state the next run can go on from.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Small files on any Hadoop file system, written whole and replaced in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.gateway, self.jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.fs.mkdirs(self.path(self.root))

    def write(self, name: str, value: dict) -> None:
        """Write beside, then rename over: a reader sees the old file or the new one,
        never none."""
        tmp = self.path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.context.rename(tmp, self.path(f"{self.root}/{name}"), how)

    def read(self, name: str) -> dict | None:
        p = self.path(f"{self.root}/{name}")
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self, kind: str) -> list[str]:
        every = (s.getPath().getName() for s in self.fs.listStatus(self.path(self.root)) if s.isFile())
        return sorted(n for n in every if n.startswith(f"{kind}-"))


class ChangeFeed:
    """``part`` names the log's partition column, ``offset`` the columns of its offset.

    An offset grows with the log and is unique within a partition.  Plans hold
    offsets as text and compare them in the columns' own types, so times and numbers
    serve alike; a filter on the first offset column reaches the scan.
    """

    def __init__(self, spark: SparkSession, state: str, part: str = "part", offset: tuple[str, ...] = ("offset",)):
        self.store, self.part, self.offset = Store(spark, state), part, tuple(offset)

    def commits(self) -> list[dict]:
        """The committed batches, oldest first."""
        return [self.store.read(n) for n in self.store.names("commit")]

    def _last(self, kind: str) -> dict | None:
        names = self.store.names(kind)
        return self.store.read(names[-1]) if names else None

    def open_plan(self) -> dict | None:
        """The plan of a run that died before its commit."""
        done, planned = self._last("commit"), self._last("plan")
        return planned if planned and (not done or planned["batch"] > done["batch"]) else None

    def ends(self, log: DataFrame) -> dict[str, list[str]]:
        """The greatest offset of each partition: one small row each."""
        top = log.groupBy(self.part).agg(F.max(F.struct(*self.offset)).alias("o"))
        return {str(r[0]): [str(v) for v in r["o"]] for r in top.collect()}

    def plan(self, log: DataFrame, ends: dict[str, list[str]] | None = None) -> dict | None:
        """A new plan, written, from the last commit to ``ends`` (of the log where not
        given); None if there is nothing new."""
        done = self._last("commit")
        start = done["to"] if done else {}
        to = start | (self.ends(self.after(log, start)) if ends is None else ends)
        if to == start:
            return None
        new = {"batch": (done["batch"] if done else 0) + 1, "from": start, "to": to}
        self.store.write(f"plan-{new['batch']:012d}", new)
        return new

    def _text(self, log: DataFrame, values: list[str]) -> str:
        types = {f.name: f.dataType.simpleString() for f in log.schema.fields}
        quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
        return "named_struct(" + ", ".join(f"'{c}', CAST({v} AS {types[c]})" for c, v in zip(self.offset, quoted)) + ")"

    def _compare(self, log: DataFrame, bounds: dict[str, list[str]]) -> tuple[Column, Column]:
        """The record's offset and its partition's bound (null without one)."""
        at = "map(" + ", ".join(f"'{k}', {self._text(log, v)}" for k, v in sorted(bounds.items())) + ")"
        return F.struct(*self.offset), F.try_element_at(F.expr(at), F.col(self.part).cast("string"))

    def _edge(self, log: DataFrame, bounds: dict[str, list[str]], pick: str) -> Column:
        """Least or greatest first offset column of the bounds, folded to one literal."""
        first = ", ".join(f"{self._text(log, v)}.{self.offset[0]}" for v in bounds.values())
        return F.expr(f"array_{pick}(array({first}))")

    def after(self, log: DataFrame, bounds: dict[str, list[str]]) -> DataFrame:
        if not bounds:
            return log
        own, bound = self._compare(log, bounds)
        return log.where(bound.isNull() | (own > bound))

    def batch(self, log: DataFrame, plan: dict) -> DataFrame:
        """Exactly the records of a plan, at most once each as the log holds them."""
        if not plan["to"]:
            return log.limit(0)
        own, bound = self._compare(log, plan["to"])
        some = log.where((F.col(self.offset[0]) <= self._edge(log, plan["to"], "max")) & (own <= bound))
        if plan["from"].keys() >= plan["to"].keys():  # no new partition: nothing older than the least start
            some = some.where(F.col(self.offset[0]) >= self._edge(log, plan["from"], "min"))
        return self.after(some, plan["from"])

    def run(self, log: DataFrame, apply: Callable[[DataFrame, int], None], label: str = "", ends: dict[str, list[str]] | None = None) -> int:
        """Replay what is open, then plan, read, apply and commit what is new; returns
        the number of batches committed, which carry ``label``."""
        done = 0
        while plan := self.open_plan() or (self.plan(log, ends) if done < 2 else None):
            apply(self.batch(log, plan), plan["batch"])
            self.store.write(f"commit-{plan['batch']:012d}", plan | {"label": label})
            done += 1
        return done


class DeltaSink:
    """A keyed table at ``path``: one folded delta per batch over bucketed base files.

    ``append`` writes a batch's delta once - a replay finds it whole and leaves it - so
    applying a batch twice leaves what applying it once does, and no batch rewrites
    what older ones wrote.  Reads fold by key: the greatest ``order`` stands, so a
    record seen under two batches counts once.  ``compact`` merges deltas into the
    base and rewrites only the buckets they touch.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.store = Store(spark, f"{self.path}/manifest")

    def _folded(self, rows: DataFrame, *also: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, *self.order, *also)]
        top = rows.groupBy(self.key, *also).agg(F.max(F.struct(*self.order, *rest)).alias("_r"))
        return top.select(self.key, *also, *[F.col("_r")[c].alias(c) for c in (*self.order, *rest)])

    def append(self, rows: DataFrame, batch: int) -> None:
        name = f"delta-{batch:012d}"
        if self.store.read(name):
            return
        data = f"{self.path}/deltas/batch={batch}/attempt={uuid.uuid4().hex}"
        self._folded(rows).write.parquet(data)
        self.store.write(name, {"batch": batch, "data": data})

    def deltas(self, batches: list[int]) -> DataFrame | None:
        """The deltas of the given batches with their ``batch`` number."""
        data = [m["data"] for b in batches if (m := self.store.read(f"delta-{b:012d}"))]
        return self.spark.read.option("basePath", f"{self.path}/deltas").parquet(*data).drop("attempt") if data else None

    def _base(self) -> dict:
        names = self.store.names("base")
        return self.store.read(names[-1]) if names else {"upto": 0, "buckets": {}}

    def table(self, batches: list[int]) -> DataFrame | None:
        """One row per key over the base and the given (committed) batches."""
        base = self._base()
        parts = [self.spark.read.parquet(*sorted(set(base["buckets"].values())))] if base["buckets"] else []
        later = self.deltas([b for b in batches if b > base["upto"]])
        parts += [later.drop("batch")] if later is not None else []
        return self._folded(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])) if parts else None

    def compact(self, batches: list[int]) -> None:
        """Merge the given (committed) batches into the base."""
        base = self._base()
        due = [b for b in batches if b > base["upto"]]
        later = self.deltas(due)
        if later is None:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
        new = later.drop("batch").withColumn("_b", bucket)
        touched = sorted(r[0] for r in new.select("_b").distinct().collect())  # at most ``buckets`` rows
        old = [base["buckets"][str(b)] for b in touched if str(b) in base["buckets"]]
        every = new.unionByName(self.spark.read.parquet(*old).withColumn("_b", bucket)) if old else new
        data = f"{self.path}/base/{uuid.uuid4().hex}"
        self._folded(every, "_b").repartition(len(touched), "_b").write.partitionBy("_b").parquet(data)
        now = base["buckets"] | {str(b): f"{data}/_b={b}" for b in touched}
        self.store.write(f"base-{max(due):012d}", {"upto": max(due), "buckets": now})
