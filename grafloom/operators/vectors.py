"""Vectors: cosine distance, exact top-k, K-Means grouping, batched embedding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import held

Embedder = Callable[[list[str]], list[Sequence[float]]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the similarity; 1 if either vector is zero."""
    return 1.0 - cosine(a, b)


def top_by_cosine(rows: DataFrame, vector: Sequence[float], limit: int = 10, column: str = "embedding") -> DataFrame:
    """The ``limit`` rows nearest to one vector, with score; ties by id.  Rows without a vector take no part."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return rows.where(F.col(column).isNotNull()).withColumn("score", cosine(F.col(column), query)).orderBy(F.desc("score"), "id").limit(limit)


def group_count(n: int) -> int:
    """How many groups n members are put into: a fifth, at least two, at most half; one up to three members."""
    if n <= 3:
        return min(n, 1)
    return min(max(n // 5, 2), n // 2)


def assign(rows: DataFrame, centroids: DataFrame, column: str = "embedding", block: int = 4096) -> DataFrame:
    """rows (id, vector) with ``cluster``, the index of the nearest centroid (cluster, centroid); ties go to the lowest index.

    Centroids are sent around ``block`` at a time and met by a matrix product; rows are not
    shuffled unless there are several blocks, and then only with the best of each.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType
    low, n = centroids.agg(F.min("cluster"), F.count("*")).first()
    bounds = [r[0] for r in centroids.select(F.col("cluster").cast("long")).orderBy("cluster").toLocalIterator()][::block] if n > block else [low]

    def nearest(part: list[Row]) -> DataFrame:
        names = np.array([r["cluster"] for r in part], np.int64)
        sent = spark.sparkContext.broadcast((names, unit_rows([r["centroid"] for r in part])))

        def run(batches):
            names, unit = sent.value
            for batch in batches:
                vectors = batch.column(1).to_pylist()
                sound = [i for i, v in enumerate(vectors) if v is not None]
                far = 1.0 - unit_rows([vectors[i] for i in sound], unit.shape[1]) @ unit.T
                best = far.argmin(axis=1) if len(sound) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sound, pa.int64())), pa.array(far[np.arange(len(sound)), best]), pa.array(names[best])], names=["id", "distance", "cluster"])

        schema = T.StructType([T.StructField("id", kind), T.StructField("distance", T.DoubleType()), T.StructField("cluster", T.LongType())])
        return rows.select("id", column).mapInArrow(run, schema)

    parts = []
    for k, a in enumerate(bounds):
        own = centroids.where(F.col("cluster") >= a) if n else centroids
        own = own.where(F.col("cluster") < bounds[k + 1]) if k + 1 < len(bounds) else own
        parts.append(nearest(own.select("cluster", "centroid").orderBy("cluster").collect()))  # a block of rows at most
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        found = found.groupBy("id").agg(F.min(F.struct("distance", "cluster"))["cluster"].alias("cluster"))
    return found.select("id", F.col("cluster").cast(centroids.schema["cluster"].dataType).alias("cluster"))


def unit_rows(vectors: list, wide: int | None = None) -> np.ndarray:
    """Vectors as rows of length one; zero vectors stay zero."""
    out = np.array([[float(x) for x in v] for v in vectors], np.float64).reshape(len(vectors), -1 if vectors else wide or 0)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def move_centroids(rows: DataFrame, assigned: DataFrame, centroids: DataFrame, column: str = "embedding") -> DataFrame:
    """(cluster, centroid): the mean of a cluster's rows; a cluster without rows keeps its centroid."""
    parts = rows.join(assigned, "id").select("cluster", F.posexplode(column).alias("dim", "x"))
    means = parts.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    new = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("moved"))
    return centroids.join(new, "cluster", "left").select("cluster", F.coalesce("moved", F.col("centroid").cast("array<double>")).alias("centroid"))


def seed_centroids(rows: DataFrame, k: int, seed: int = 1, column: str = "embedding") -> DataFrame:
    """(cluster, centroid): k rows drawn one after another, each with odds by its squared distance to the nearest drawn so far.

    The draw is the least -ln(u) / weight with u from a hash of seed, round and id, so reruns
    agree; a round is one pass and one aggregate.  Fewer are drawn if no row is left apart.
    """
    spark = rows.sparkSession
    left = rows.select("id", F.col(column).cast("array<double>").alias("v")).where("v is not null")
    drawn: list = []
    for turn in range(k):
        weight = F.lit(1.0 if not drawn else 4.0)  # no squared distance is above 4
        for c in drawn:
            d = cosine_distance(F.col("v"), F.array(*map(F.lit, c)))
            weight = F.least(weight, d * d)
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        best = left.select("id", "v", weight.alias("w")).where("w > 1e-12").select("v", (-F.ln(u) / F.col("w")).alias("t"), "id").orderBy("t", "id").first()
        if best is None:
            break
        drawn.append(list(best["v"]))
    return spark.createDataFrame(list(enumerate(drawn)), "cluster int, centroid array<double>")


def lloyd(rows: DataFrame, centroids: DataFrame, max_iter: int = 50, column: str = "embedding") -> DataFrame:
    """(id, cluster) after assigning and moving in turn, until no row changes its cluster or ``max_iter`` assignments.

    Rows start in cluster 0.  A cluster without rows keeps its centroid.
    """
    assigned = None
    for turn in range(max_iter):
        new = held(assign(rows, centroids, column))
        if assigned is None:
            changed = not new.where("cluster <> 0").isEmpty()
        else:
            changed = not new.join(assigned.withColumnRenamed("cluster", "was"), "id").where("cluster <> was").isEmpty()
        assigned = new
        if not changed or turn == max_iter - 1:
            break
        centroids = held(move_centroids(rows, assigned, centroids, column))
    return assigned


def kmeans(rows: DataFrame, k: int, seed: int = 1, max_iter: int = 50, column: str = "embedding") -> DataFrame:
    """(id, cluster) of K-Means under cosine distance; zero vectors, at distance 1 from all, go to cluster 0."""
    sound = rows.select("id", column).where(F.col(column).isNotNull())
    centroids = seed_centroids(sound.where(norm(F.col(column)) > 0), k, seed, column) if k > 1 else None
    if centroids is None or centroids.count() < 2:
        return sound.select("id", F.lit(0).alias("cluster"))
    return lloyd(sound, centroids, max_iter, column)


def hash_embedder(width: int = 64) -> Embedder:
    """A deterministic embedder that needs no model: signed word hashes, normalised."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(width)
            for word in text.lower().split() or [" "]:
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                v[h % width] += 1 if h >> 63 else -1
            n = math.sqrt(float(v @ v))
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embed_column(rows: DataFrame, text: str, embedder: Embedder, into: str = "embedding", batch: int = 100) -> DataFrame:
    """rows with the vectors of a text column, asked for in batches; an empty text is asked for as one space, a null one gets none."""
    names = [c for c in rows.columns if c != into]
    schema = rows.select(*names).schema.add(into, T.ArrayType(T.FloatType()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors: list = [None] * len(part)
            asked = [i for i, t in enumerate(part[text]) if t is not None]
            for k in range(0, len(asked), batch):
                chunk = asked[k : k + batch]
                found = embedder([part[text].iloc[i] or " " for i in chunk])
                if len(found) != len(chunk):
                    raise ValueError(f"embedder returned {len(found)} vectors for {len(chunk)} texts")
                for i, v in zip(chunk, found, strict=True):
                    vectors[i] = [float(x) for x in v]
            part = part[names].copy()
            part[into] = pd.Series(vectors, index=part.index, dtype=object)
            yield part

    return rows.select(*names).mapInPandas(run, schema)
