"""Files as rows: walking a tree under ignore rules, bounded reads, fixed-format logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import paths as P

MAX_BYTES = 4 * 1024 * 1024
#: Directories never walked.
FIXED_IGNORES = [".git/", ".hg/", ".svn/", "node_modules/", "target/", "dist/", "build/", ".venv/", "__pycache__/"]


def walk(spark: SparkSession, root: str, ignore: list[str] = [], max_bytes: int = MAX_BYTES) -> DataFrame:  # noqa: B006
    """``path, size, modified, content`` of the files under ``root``.

    Files above ``max_bytes`` are left out by metadata, before their content is read;
    ignored directories and files whose name looks like a credential's are dropped after,
    as the reader takes no rules on paths.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^file:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{re.escape(base)}/", "")
    rules = [*FIXED_IGNORES, *ignore]
    dropped = F.lit(False)
    for g in rules:
        dropped = dropped | F.col("path").rlike(P.glob_regex(g.rstrip("/")))
    return (
        raw.withColumn("path", rel)
        .where((F.col("length") <= max_bytes) & ~dropped & ~P.credential_path(F.col("path")))
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    )


def texts(files: DataFrame) -> DataFrame:
    """Files that are text (no NUL byte), decoded."""
    # latin-1 keeps every byte one character, so a NUL byte is a NUL character
    return files.where(~F.decode("content", "ISO-8859-1").contains("\0")).select("path", "size", "modified", F.decode("content", "UTF-8").alias("text"))


ACTION = T.StructType(
    [
        T.StructField("ts", T.LongType()), T.StructField("invocation", T.StringType()), T.StructField("op", T.StringType()),
        T.StructField("duration_ms", T.LongType()), T.StructField("version", T.StringType()), T.StructField("coverage", T.StringType()),
        T.StructField("saved", T.StructType([T.StructField("bytes", T.LongType()), T.StructField("ms", T.LongType())])),
    ]
)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """The JSON-lines action log under its fixed schema; unreadable lines come out null."""
    return spark.read.schema(ACTION).option("mode", "PERMISSIVE").json(path)


def append_actions(df: DataFrame, path: str, rows_per_file: int = 5_000) -> None:
    """Append actions as JSON lines, files rotated by row count."""
    df.select(*[f.name for f in ACTION.fields]).write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def export_sessions(turns: DataFrame, path: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Write the turns of sessions that overlap the window as JSON, one folder per agent;
    return the sessions left out because no turn has a time."""
    s = turns.groupBy("session_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    unknown = s.where("first IS NULL").select("session_id")
    window = since_ms is not None or until_ms is not None
    keep = s.where("first IS NOT NULL") if window else s
    if since_ms is not None:
        keep = keep.where(F.col("last") >= since_ms)
    if until_ms is not None:
        keep = keep.where(F.col("first") <= until_ms)
    turns.join(keep.select("session_id"), "session_id", "left_semi").write.mode("overwrite").partitionBy("agent").json(path)
    return unknown if window else unknown.limit(0)


def pack(df: DataFrame, path: str) -> DataFrame:
    """Write an index as Parquet with a manifest: file and sha-256 of its bytes."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    m = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data").select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    m.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("file string, sha256 string").json(f"{path}/manifest")


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """The packed index, refused if any file differs from its manifest."""
    m = spark.read.schema("file string, sha256 string").json(f"{path}/manifest")
    now = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data").select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("now"))
    if not m.join(now, "file", "full").where(~F.col("sha256").eqNullSafe(F.col("now"))).isEmpty():
        raise ValueError(f"{path}: a file does not match the manifest")
    return spark.read.parquet(f"{path}/data")


def git_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``oid, parents, author, committed_at, message, files`` from a dump of
    ``git log -z --name-status --format='%x01%H%x02%P%x02%an%x02%cI%x02%B%x02'``.

    Records start at \\x01 and their fields end at \\x02; what follows the last is the
    NUL-separated list of status and path.
    """
    rows = spark.read.option("lineSep", "\x01").text(path).where(F.length("value") > 0)
    p = F.split("value", "\x02")
    pairs = F.filter(F.split(F.regexp_replace(F.get(p, F.lit(5)), r"^[\n\x00]+", ""), "\x00"), lambda s: F.trim(s) != "")
    idx = F.when(F.size(pairs) >= 2, F.sequence(F.lit(0), F.size(pairs) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    files = F.transform(idx, lambda i: F.struct(F.trim(F.get(pairs, i)).alias("status"), F.get(pairs, i + 1).alias("path")))
    return rows.select(
        F.get(p, F.lit(0)).alias("oid"), F.filter(F.split(F.get(p, F.lit(1)), " "), lambda s: s != "").alias("parents"), F.get(p, F.lit(2)).alias("author"),
        F.try_to_timestamp(F.get(p, F.lit(3))).alias("committed_at"), F.trim(F.get(p, F.lit(4))).alias("message"), files.alias("files"),
    )


def blob_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``oid, size`` from a dump of ``git cat-file --batch-check``; missing objects and other kinds are left out."""
    p = F.split("value", " ")
    rows = spark.read.text(path).where((F.size(p) == 3) & (F.get(p, F.lit(1)) == "blob"))
    return rows.select(F.get(p, F.lit(0)).alias("oid"), F.get(p, F.lit(2)).try_cast("long").alias("size")).where("size IS NOT NULL")


def diff_hunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``oid, path, n, old_start, old_lines, new_start, new_lines`` from a dump of
    ``git log -p --format='%x01%H%x02'``; a deleted file keeps its old path."""
    rows = spark.read.option("lineSep", "\x01").text(path).where(F.length("value") > 0)
    oid, patch = F.substring_index("value", "\x02", 1), F.regexp_replace("value", r"(?s)^.*?\x02", "")
    parts = rows.select(oid.alias("oid"), F.explode(F.filter(F.split(patch, r"(?m)^diff --git "), lambda s: s.contains("@@ -"))).alias("_d"))
    new, old = F.regexp_extract("_d", r"(?m)^\+\+\+ b/(.*)$", 1), F.regexp_extract("_d", r"(?m)^--- a/(.*)$", 1)
    head = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    group = lambda k: F.regexp_extract_all("_d", F.lit(head), k)
    hunks = parts.select("oid", F.when(new != "", new).otherwise(old).alias("path"), F.posexplode(F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"), group(4).alias("d"))).alias("n", "h"))
    count = lambda c: F.when(c == "", 1).otherwise(c.try_cast("int"))
    return hunks.select("oid", "path", "n", F.col("h.a").cast("int").alias("old_start"), count(F.col("h.b")).alias("old_lines"), F.col("h.c").cast("int").alias("new_start"), count(F.col("h.d")).alias("new_lines"))


def ingest_history(spark: SparkSession, dump: str, patches: str, sizes: str, state: str, sink: str) -> int:
    """Commits, then blob sizes and hunks of a growing dump folder into tables at ``sink``.

    The dump's files are the log's partitions: each tick plans the files that are new,
    appends their commits and changes (phase A) and hunks (phase C) and commits the plan;
    sizes (phase B) are a snapshot, replaced by every tick that brings commits.  Returns
    the number of commits taken in; a tick that died is replayed and overwrites its own rows.
    """
    from tracewell.streaming.feed import ChangeFeed

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(dump).select(F.col("path").alias("part"), F.col("length").alias("offset"))
    feed, taken = ChangeFeed(spark, state), 0

    def apply(batch: DataFrame, number: int) -> None:
        nonlocal taken
        names = sorted(r["part"] for r in batch.collect())  # the files of one tick
        log = git_log(spark, names).dropDuplicates(["oid"])
        log.write.mode("overwrite").parquet(f"{sink}/commits/batch={number}")
        hunks = [p for p in (n.replace(dump.removeprefix("file://"), patches.removeprefix("file://")) for n in names)]
        diff_hunks(spark, hunks).write.mode("overwrite").parquet(f"{sink}/hunks/batch={number}")
        blob_sizes(spark, sizes).write.mode("overwrite").parquet(f"{sink}/sizes")
        taken += spark.read.parquet(f"{sink}/commits/batch={number}").count()

    feed.run(listed, apply)
    return taken
