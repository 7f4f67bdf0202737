"""Exact vector search: columns of floats, a query or a few at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordering import numbered
from tracewell.session import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, one is empty or has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, allowed: Column | None = None) -> DataFrame:
    """The ``k`` nearest by cosine to one query, the lower key of equals first; the allow
    condition is applied before any arithmetic."""
    v = vectors if allowed is None else vectors.where(allowed)
    q = F.array(*[F.lit(float(x)) for x in query])
    return v.select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest_codes(codes: DataFrame, key: str, scale: str, code: str, query: list[float], k: int) -> DataFrame:
    """The same over quantised vectors: dot(query, codes) x scale."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return codes.select(key, F.round(dot(F.col(code), q) * F.col(scale), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


PASS_BYTES = 16 << 20  # query vectors held by a task at a time


def neighbours(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """``query, key, score``: the ``k`` nearest rows of every query, all rows searched.

    Queries are numbered once and go to the tasks ``PASS_BYTES`` at a time, so a scan of
    the vectors serves some tens of thousands of them; within it each task multiplies
    its vectors with blocks of ``block`` queries as matrices and hands on its own best
    ``k`` per query.  What is shuffled is k rows per query and batch, and no pair of
    rows is ever written out.  Null vectors, and those of another length than the
    queries', are nobody's neighbours.
    """
    spark = vectors.sparkSession
    keyed = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v"))
    placed = cut(numbered(keyed, [], ["q"], "_n"))
    stat = placed.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    total, dim = stat["n"], stat["d"] or 0
    step = max(block, PASS_BYTES // (8 * max(1, dim)))
    parts = []
    for start in range(0, total, step):
        rows = placed.where((F.col("_n") > start) & (F.col("_n") <= start + step) & (F.size("v") == dim)).select("q", "v").toPandas()  # PASS_BYTES at most
        ids, m = rows["q"].to_numpy(), np.array(rows["v"].tolist(), dtype=np.float64).reshape(len(rows), dim)
        held = spark.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            all_ids, all_m = held.value
            for p in batches:
                x = np.array(p[vector].tolist(), dtype=np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                keys = p[key].to_numpy()
                for at in range(0, len(all_ids), block):
                    ids, m = all_ids[at : at + block], all_m[at : at + block]
                    sims = np.round(m @ x.T, 6)
                    sims[ids[:, None] == keys[None, :]] = -np.inf
                    n = min(k, sims.shape[1])
                    first = np.lexsort((np.broadcast_to(keys, sims.shape), -sims), axis=1)[:, :n]
                    out = pd.DataFrame({"query": np.repeat(ids, n), key: keys[first].ravel(), "score": np.take_along_axis(sims, first, 1).ravel()})
                    yield out[np.isfinite(out["score"])]

        parts.append(vectors.where(F.size(vector) == dim).select(key, vector).mapInPandas(run, f"query long, {key} long, score double"))
    if not parts:
        return vectors.limit(0).selectExpr("0L query", key, "0D score")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)  # over k rows per batch of vectors
    return every.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


class Embedder:
    """A model behind an interface: ``embed`` maps texts to equal-length vectors."""

    dim = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError


class HashingEmbedder(Embedder):
    """Signed hashing of character trigrams: a stand-in that needs no model file."""

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            t = (t or "").lower()
            for j in range(len(t) - 2):
                h = zlib.crc32(t[j : j + 3].encode())
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-9)


def embed(text: Column, model: Embedder) -> Column:
    """Vectors of a text column by any :class:`Embedder`, in Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(model.embed(s.tolist())))

    return run(text)
