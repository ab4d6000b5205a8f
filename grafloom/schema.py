"""Schemas of the property graph: nodes, edges and the one-row graph state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [T.StructField("id", T.StringType(), False), T.StructField("label", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("name", "file")]
    + [T.StructField(c, T.LongType()) for c in ("line", "start_line", "end_line")]
    + [T.StructField(c, T.StringType()) for c in ("namespace", "signature", "lang", "content")]
    + [T.StructField("ui_contaminated", T.BooleanType()), T.StructField("risk_score", T.DoubleType())]
    + [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("atomic_features", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("description", "scope_path")]
    + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
)
EDGE = T.StructType([T.StructField(c, T.StringType(), False) for c in ("src", "dst", "type")])
STATE = T.StructType([T.StructField("commit", T.StringType()), T.StructField("updated_at", T.TimestampType())])

DEFAULT_LABEL = "Generic"
DEFAULT_TYPE = "RELATED_TO"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns only, cast; those that df lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Adds eid, a hash of what identifies an edge."""
    return edges.select("src", "dst", "type", F.xxhash64("src", "dst", "type").alias("eid"))
