"""Items of varying size into containers of fixed capacity, by best fit decreasing."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut

SHARD_ITEMS = 50_000  # items packed together in one task
LOOSE = 0.02  # containers with more room than this share are packed once more


class Bins:
    """Open bins by remaining capacity, in a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, bin_no: int) -> None:
        self.open[left].append(bin_no)
        i = left + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """The open bin with the least room of at least ``need``, taken out."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        left = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return left, self.open[left].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; ``sizes`` come in decreasing order, none above ``capacity``."""
    bins, out, used = Bins(capacity), [], 0
    for need in sizes:
        found = bins.tightest(need)
        if found is None:
            found, used = (capacity, used), used + 1
        out.append(found[1])
        bins.put(found[0] - need, found[1])
    return out


_PIECES = "spec_id int, capacity int, doc_id long, piece_no int, from_token long, tokens long, shard int"


def _round(pieces: DataFrame, shards: int, label: int) -> DataFrame:
    """One packing of ``pieces``, ``shards`` tasks per capacity; adds container and room."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity = int(p["capacity"].iloc[0])
        p["container"] = best_fit_decreasing(p["tokens"].tolist(), capacity)
        p["room"] = capacity - p.groupby("container")["tokens"].transform("sum")
        p["container"] = f"{label}." + p["shard"].astype(str) + "." + p["container"].astype(str)
        return p

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(label)), F.lit(shards)).cast("int"))
    return sharded.groupBy("spec_id", "shard").applyInPandas(run, _PIECES + ", container string, room long")


def pack(items: DataFrame, specs: DataFrame, rounds: int = 3) -> DataFrame:
    """``spec_id, container, doc_id, piece_no, from_token, tokens`` for every item.

    ``items``: ``doc_id, tokens`` (one row per document; null counts as 0), ``specs``:
    ``spec_id, capacity``.  Only an item above the capacity is divided: into full
    pieces, each a container of its own, and a rest that is packed like any item.
    Items are hashed into shards of about ``SHARD_ITEMS``; what lies in containers
    that stay loose is hashed anew and packed again, in ever fewer shards, up to
    ``rounds`` times.  Items of size 0 lie where they fit, which is anywhere.  Specs
    without a positive capacity hold nothing and are left out.  A container's name is
    unique within its spec: ``d.document.piece`` for a full piece, else
    ``round.shard.number``.
    """
    specs = specs.where("capacity > 0").select("spec_id", "capacity").dropDuplicates(["spec_id"])
    each = F.collect_set(F.struct("spec_id", "capacity"))
    # one array of the few capacities rides along with every item: no join
    listed = [(r["spec_id"], r["capacity"]) for r in specs.agg(each.alias("s")).first()["s"]]
    if not listed:
        return items.limit(0).selectExpr("cast(0 as int) spec_id", "'' container", "doc_id", "0 piece_no", "0L from_token", "0L tokens")
    kinds = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity")) for s, c in sorted(listed)])
    sized = cut(items.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
    n = sized.count()
    per = sized.select("doc_id", F.col("tokens").alias("_n"), F.explode(kinds).alias("k")).select("doc_id", "_n", "k.*")
    full = F.floor(F.col("_n") / F.col("capacity")).cast("int")
    parts = F.when(F.col("_n") > F.col("capacity"), full + (F.col("_n") % F.col("capacity") > 0).cast("int")).otherwise(1)
    pieces = per.withColumn("piece_no", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "spec_id",
        "capacity",
        "doc_id",
        "piece_no",
        (F.col("piece_no").cast("long") * F.col("capacity")).alias("from_token"),
        F.least(F.col("_n") - F.col("piece_no").cast("long") * F.col("capacity"), F.col("capacity").cast("long")).alias("tokens"),
    )
    whole = pieces.where("tokens = capacity").withColumn("container", F.concat_ws(".", F.lit("d"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")))
    rest = pieces.where("tokens < capacity")
    names = ["spec_id", "container", "doc_id", "piece_no", "from_token", "tokens"]
    done = [whole.select(*names)]
    shards = max(1, -(-n // SHARD_ITEMS))
    for label in range(1, rounds + 1):
        packed = _round(rest, shards, label)
        last = label == rounds or shards == 1
        if last:
            done.append(packed.select(*names))
            break
        packed = cut(packed)
        loose = F.col("room") > F.col("capacity") * LOOSE
        done.append(packed.where(~loose).select(*names))
        rest = cut(packed.where(loose).drop("shard", "container", "room"))
        shards = max(1, min(shards - 1, -(-rest.count() // SHARD_ITEMS)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers used, tokens, the least number possible, share filled."""
    bins = packed.groupBy("spec_id").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    capacity = specs.select("spec_id", "capacity").dropDuplicates(["spec_id"])
    return bins.join(capacity, "spec_id").select(
        "spec_id", "capacity", "containers", "tokens",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"),
    )
