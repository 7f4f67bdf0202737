"""Session access, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, set[str]] = {}


def local_session(cores: int = 8, name: str = "tracewell") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Only a local master may go without: there a temporary folder is shared by all.
    On a cluster a machine-local folder would lose tables, so none is made up.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor shares")
        root = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    for path in _MADE.pop("paths", set()):
        if spark is not None:
            _remove(spark, path)


atexit.register(_sweep)


def scratch_folder(spark: SparkSession) -> str:
    """A folder of its own under the shared scratch folder; it goes when the process ends."""
    path = f"{scratch_dir(spark)}/tracewell-{uuid.uuid4().hex}"
    _MADE.setdefault("paths", set()).add(path)
    return path


def cut(df: DataFrame, partitioned: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage without relying on executor-local blocks, so a lost executor
    costs a re-read and nothing else.  The files go when the process ends, or
    earlier through :func:`drop`.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    writer = df.write.mode("overwrite")
    if partitioned:
        writer = writer.partitionBy(*partitioned)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tracewell_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``df``."""
    path = getattr(df, "_tracewell_path", None)
    if path:
        _MADE.get("paths", set()).discard(path)
        _remove(df.sparkSession, path)


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(F.length(t) > 0, t)


def standing(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` columns.

    Map-side combined (``max_by``), so a hot key never gathers its rows in a task.
    Rows whose key is null are dropped; ties beyond ``order`` go to the greatest
    remaining columns, which makes repeated rows collapse into one.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    cols = [*order, *rest]
    packed = df.where(F.col(key).isNotNull()).select(key, F.struct(*cols).alias("_row"))
    best = packed.groupBy(key).agg(F.max("_row").alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in cols])
