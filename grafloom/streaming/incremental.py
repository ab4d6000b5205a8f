"""Incremental ingest: a file stream of JSON lines, upserted into a stored graph batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import merge_edges, merge_nodes
from ..sources.jsonl import edges_of, nodes_of

NODE_ROWS = "label string, id string, props map<string,string>"
EDGE_ROWS = "src string, dst string, type string"


class Upserter:
    """Versions of the tables under a folder: every batch writes a new version and names it.

    A batch that runs again writes the same version anew, so an upsert counts once.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _version(self, spark: SparkSession) -> str | None:
        try:
            rows = spark.read.schema("batch long, path string").json(f"{self.folder}/versions").orderBy(F.desc("batch")).limit(1).collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return rows[0]["path"] if rows else None

    def nodes(self, spark: SparkSession) -> DataFrame:
        path = self._version(spark)
        return spark.read.schema(NODE_ROWS).parquet(f"{path}/nodes") if path else spark.createDataFrame([], NODE_ROWS)

    def edges(self, spark: SparkSession) -> DataFrame:
        path = self._version(spark)
        return spark.read.schema(EDGE_ROWS).parquet(f"{path}/edges") if path else spark.createDataFrame([], EDGE_ROWS)

    def __call__(self, lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        old = self.nodes(spark).select(F.lit(-1).cast("long").alias("seq"), "label", "id", "props")
        new = nodes_of(lines).select(F.monotonically_increasing_id().alias("seq"), "label", "id", "props")
        path = f"{self.folder}/v{batch}"
        merge_nodes(old.unionByName(new)).write.mode("overwrite").parquet(f"{path}/nodes")
        merge_edges(edges_of(lines), spark.read.schema(NODE_ROWS).parquet(f"{path}/nodes"), self.edges(spark)).write.mode("overwrite").parquet(f"{path}/edges")
        spark.createDataFrame([(batch, path)], "batch long, path string").coalesce(1).write.mode("append").json(f"{self.folder}/versions")


def follow(spark: SparkSession, source: str, folder: str, available_now: bool = True) -> StreamingQuery:
    """Upsert every JSON lines file that arrives under source into the tables under folder."""
    lines = spark.readStream.format("text").load(source)
    writer = lines.writeStream.foreachBatch(Upserter(folder)).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
