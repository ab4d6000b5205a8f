"""Intent layer: domains, feature hierarchies over functions, descriptors and enrichment."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cut_bytes, path_stem
from ..storage import held
from .vectors import Embedder, embed_column, group_count, kmeans

BASES = ("internal", "pkg", "cmd", "src")
FEATURE_SAMPLE = 11
SNIPPET_BYTES = 3000
CODE_BYTES = 4000


def discover_domains(root: str, bases: Iterable[str] = BASES) -> dict[str, str]:
    """Folder name -> base/name of the folders under the bases; a later base wins; {'root': ''} if there are none."""
    found = {}
    for base in bases:
        top = os.path.join(root, base)
        if os.path.isdir(top):
            found |= {e.name: f"{base}/{e.name}" for e in sorted(os.scandir(top), key=lambda e: e.name) if e.is_dir()}
    return found or {"root": ""}


def domains_of(nodes: DataFrame, bases: Iterable[str] = BASES) -> DataFrame:
    """(domain, prefix) from the files of nodes themselves: the folder after a base."""
    pattern = rf"(?:^|/)({'|'.join(map(re.escape, bases))})/([^/]+)/"
    hit = nodes.where(F.rlike("file", F.lit(pattern)))
    base, name = F.regexp_extract("file", pattern, 1), F.regexp_extract("file", pattern, 2)
    return hit.select(name.alias("domain"), F.concat_ws("/", base, name).alias("prefix")).groupBy("domain").agg(F.max("prefix").alias("prefix"))


def domain_frame(spark: SparkSession, domains: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(domains.items()), "domain string, prefix string")


def members(functions: DataFrame, domains: DataFrame) -> DataFrame:
    """functions with their domain and prefix: those whose file contains the prefix.  Domains are few; a function can be in several."""
    return functions.where("file is not null").join(domains, F.contains(functions["file"], domains["prefix"]))


def file_cluster(file: Column | str) -> Column:
    """Group key of a function: its file's stem; ``misc`` without a file."""
    c = F.col(file) if isinstance(file, str) else file
    return F.when(c.isNull() | (c == ""), F.lit("misc")).otherwise(path_stem(c))


def cluster_text(features: str = "atomic_features") -> Column:
    """What a function is embedded by: its atomic features, else its name, else its id."""
    return F.coalesce(F.nullif(F.array_join(features, ", "), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.col("id"))


def semantic_clusters(rows: DataFrame, embedder: Embedder, seed: int = 1, k_of: Callable[[int], int] = group_count) -> DataFrame:
    """rows (domain, id, name, atomic_features) with ``cluster``, K-Means by domain.

    Up to three members make one ``<domain>-core``.  Domains are taken one at a time, each
    as a distributed K-Means; their number is the number of folders.
    """
    asked = rows.select("domain", "id", "name", "atomic_features").withColumn("__text", cluster_text())
    embedded = held(embed_column(asked, "__text", embedder, "__vector").select("domain", "id", "__vector"))  # every row is asked for once
    out = None
    for domain, n in [(r[0], r[1]) for r in rows.groupBy("domain").count().orderBy("domain").toLocalIterator()]:
        own = embedded.where(F.col("domain").eqNullSafe(domain))
        if n <= 3:
            part = own.select("domain", "id", F.lit(f"{domain}-core").alias("cluster"))
        else:
            groups = kmeans(own.select("id", "__vector"), k_of(n), seed, column="__vector")
            part = own.select("domain", "id").join(groups, "id").select("domain", "id", F.concat(F.lit(f"{domain}-cluster-"), F.col("cluster").cast("string")).alias("cluster"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select("domain", "id", F.lit(None).cast("string").alias("cluster"))


def hierarchy(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature nodes and edges of placed functions (domain, prefix, [category,] cluster, id).

    Domain -> feature, or domain -> category -> feature if there is a category column;
    functions IMPLEMENT the leaf only.  Equal cluster names of several domains share an id.
    """
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c))
    levels = [("domain", "domain")] + [("cat", "category")] * ("category" in placed.columns) + [("feat", "cluster")]
    nodes = edges = None
    for k, (kind, c) in enumerate(levels):
        part = placed.select(name(kind, c).alias("id"), F.lit("Feature").alias("label"), F.col(c).alias("name"), F.col("prefix").alias("scope_path"))
        nodes = part if nodes is None else nodes.unionByName(part)
        if k:
            up = placed.select(name(*levels[k - 1]).alias("src"), name(kind, c).alias("dst"), F.lit("PARENT_OF").alias("type"))
            edges = up if edges is None else edges.unionByName(up)
    leaf = placed.select(F.col("id").alias("src"), name(*levels[-1]).alias("dst"), F.lit("IMPLEMENTS").alias("type"))
    nodes = nodes.groupBy("id", "label", "name").agg(F.min("scope_path").alias("scope_path"))
    return nodes, edges.unionByName(leaf).distinct()


def feature_samples(implementers: DataFrame, most: int = FEATURE_SAMPLE) -> DataFrame:
    """(feature, id, content, atomic_features) of the first functions of every feature, by id.

    Ranks are taken in two steps, within a hashed part of a feature and then among the
    parts' firsts, so that a feature with very many functions is not one task's.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    first = implementers.withColumn("__part", part).withColumn("__r", F.row_number().over(Window.partitionBy("feature", "__part").orderBy("id"))).where(F.col("__r") <= most)
    return first.withColumn("__r", F.row_number().over(Window.partitionBy("feature").orderBy("id"))).where(F.col("__r") <= most).drop("__r", "__part")


def snippet(content: str = "content", features: str = "atomic_features") -> Column:
    """A function as shown to a summariser: its atomic features as a comment, then its cut content."""
    listed = F.when(F.size(F.coalesce(features, F.array().cast("array<string>"))) > 0, F.concat(F.lit("// Atomic features: "), F.array_join(features, ", "), F.lit("\n"))).otherwise("")
    return F.concat(listed, cut_bytes(F.coalesce(content, F.lit("")), SNIPPET_BYTES, "..."))


def parse_reply(reply: Column, schema: str) -> Column:
    """The JSON in a model's reply, its code fence taken off; null if it is not JSON."""
    body = F.regexp_replace(F.trim(reply), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```\s*$", "$1")
    return F.from_json(body, schema, {"mode": "PERMISSIVE"})


def offline_summary(feature: str, snippets: list[str]) -> dict[str, str]:
    """A deterministic name and description: the most frequent words of the snippets."""
    count: dict[str, int] = {}
    for text in snippets:
        for word in re.findall(r"[A-Za-z]{3,}", text):
            count[word.lower()] = count.get(word.lower(), 0) + 1
    words = sorted(count, key=lambda w: (-count[w], w))[:5]
    return {"name": " ".join(words[:2]) or feature, "description": f"{feature}: {', '.join(words)}" if words else ""}


def offline_descriptors(name: str, code: str) -> list[str]:
    """A deterministic stand-in for a model's descriptors: the words of a function's name."""
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name or "")][:5]


def describe(functions: DataFrame, descriptor=offline_descriptors) -> DataFrame:
    """functions with atomic_features from their code (cut to CODE_BYTES); none where there is no code."""
    names = [c for c in functions.columns if c != "atomic_features"]

    def run(parts):
        for part in parts:
            found = [list(descriptor(n, c)) if isinstance(c, str) and c else [] for n, c in zip(part["name"], part["__code"], strict=True)]
            part = part[names].copy()
            part["atomic_features"] = pd.Series(found, index=part.index, dtype=object)
            yield part

    return functions.select(*names, cut_bytes("content", CODE_BYTES).alias("__code")).mapInPandas(run, functions.select(*names).schema.add("atomic_features", T.ArrayType(T.StringType())))


def enrich(features: DataFrame, samples: DataFrame, summarizer=offline_summary, embedder: Embedder | None = None) -> DataFrame:
    """features (id, name, ...) with a summarised name and description, and the description's vector.

    samples: (feature, id, content, atomic_features), at most FEATURE_SAMPLE a feature.  A
    feature without samples, or whose summary fails, keeps its name.
    """
    shown = samples.withColumn("__s", snippet()).groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "__s"))), lambda x: x["__s"]).alias("__snippets"))
    names = [c for c in features.columns if c not in ("description", "embedding")]
    joined = features.select(*names).join(shown, features["id"] == shown["feature"], "left").drop("feature")

    def run(parts):
        for part in parts:
            named, described = [], []
            for old, snippets in zip(part["name"], part["__snippets"], strict=True):
                found = {}
                if snippets is not None and len(snippets):
                    try:
                        found = summarizer(old, list(snippets))
                    except (ValueError, OSError):  # a summary that fails leaves the feature as it is
                        found = {}
                named.append(found.get("name") or old)
                described.append(found.get("description") or None)
            part = part[names].copy()
            part["name"], part["description"] = named, pd.Series(described, index=part.index, dtype=object)
            yield part

    out = joined.mapInPandas(run, features.select(*names).schema.add("description", "string"))
    return embed_column(out, "description", embedder) if embedder else out.withColumn("embedding", F.lit(None).cast("array<float>"))
