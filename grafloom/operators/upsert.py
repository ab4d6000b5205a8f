"""Idempotent upserts of nodes and edges, defaults, uniqueness checks and the graph state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEFAULT_LABEL, DEFAULT_TYPE, STATE


def clean_label(label: Column, default: str = DEFAULT_LABEL) -> Column:
    """Label without backticks; the default where it is null or empty."""
    return F.coalesce(F.nullif(F.translate(label, "`", ""), F.lit("")), F.lit(default))


def clean_type(kind: Column) -> Column:
    return clean_label(kind, DEFAULT_TYPE)


def merge_nodes(rows: DataFrame, null_removes: bool = True) -> DataFrame:
    """(label, id, props) of rows (seq, label, id, props): key by key, the last writer wins.

    A key that is present with null removes the key (or, without ``null_removes``, leaves
    what there was).  Rows with a null or empty id go.  The existing table takes part as
    rows with a lower seq.  Values meet by (label, id, key), combined before the exchange.
    """
    rows = rows.where("id <> ''").select("seq", clean_label(F.col("label")).alias("label"), "id", "props")
    # a node without properties still is a node: its row has a null key
    entries = rows.select("seq", "label", "id", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))), F.coalesce(F.map_entries("props"), F.array().cast("array<struct<key:string,value:string>>")))).alias("e"))
    entries = entries.select("seq", "label", "id", "e.key", "e.value")
    if not null_removes:
        entries = entries.where("key is null or value is not null")
    last = entries.groupBy("label", "id", "key").agg(F.max_by(F.struct("value"), "seq")["value"].alias("value"))
    kept = F.collect_list(F.when(F.col("key").isNotNull() & F.col("value").isNotNull(), F.struct("key", "value")))
    return last.groupBy("label", "id").agg(F.map_from_entries(F.array_sort(kept)).alias("props"))


def merge_edges(edges: DataFrame, nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst, type) whose both ends are nodes; the existing edges stay."""
    new = edges.select("src", "dst", clean_type(F.col("type")).alias("type")).where("src <> '' and dst <> ''").distinct()
    ids = nodes.select("id").distinct()
    found = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")
    return found if existing is None else existing.select("src", "dst", "type").unionByName(found).distinct()


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """(label, id, n) of node keys that occur more than once: empty for a sound table."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")


def graph_state(spark: SparkSession, commit: str | None) -> DataFrame:
    """The one-row graph state, as of now."""
    return spark.createDataFrame([(commit,)], "commit string").select("commit", F.current_timestamp().alias("updated_at")).to(STATE)
