"""The stored graph: nodes partitioned by label, edges by type, a one-row state, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.upsert import graph_state
from ..schema import EDGE, NODE, STATE, conform

SOURCE = "path string, text string"


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, commit: str | None = None, sources: DataFrame | None = None) -> None:
    """Write the tables under path, in place of what is there.

    Rows are rebalanced by label and type: few files for small ones, and a label that most
    rows have is split over many tasks.
    """
    spark = nodes.sparkSession
    conform(nodes, NODE).hint("rebalance", "label").write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    conform(edges, EDGE).hint("rebalance", "type").write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    graph_state(spark, commit).write.mode("overwrite").parquet(f"{path}/state")
    if sources is not None:
        sources.select("path", "text").write.mode("overwrite").parquet(f"{path}/sources")


def load_graph(spark: SparkSession, path: str, with_sources: bool = False) -> Graph:
    """The stored graph; label and type filters become partition filters of the scans."""
    nodes = spark.read.schema(NODE).parquet(f"{path}/nodes")
    edges = spark.read.schema(EDGE).parquet(f"{path}/edges")
    state = spark.read.schema(STATE).parquet(f"{path}/state")
    return Graph(nodes, edges, state, spark.read.schema(SOURCE).parquet(f"{path}/sources") if with_sources else None)


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every file under a folder, for snippet queries."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))
