"""Nodes and edges as JSON lines: reading with a discriminator, writing with flattened properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PROPS = "map<string,string>"


def discriminate(lines: DataFrame) -> DataFrame:
    """lines (value) with ``kind``: node, edge, dropped_node, dropped_edge or malformed.

    A line is an edge if it has the key ``source``, even with null; edges without both
    ends and nodes without an id are dropped; what is no JSON object is malformed.
    """
    keys = F.json_object_keys("value")
    sound = F.try_parse_json("value").isNotNull() & keys.isNotNull()
    filled = lambda k: F.coalesce(F.get_json_object("value", f"$.{k}"), F.lit("")) != ""
    edge = F.array_contains(keys, "source")
    kind = F.when(~sound, "malformed").when(edge, F.when(filled("source") & filled("target"), "edge").otherwise("dropped_edge")).otherwise(F.when(filled("id"), "node").otherwise("dropped_node"))
    return lines.withColumn("kind", F.coalesce(kind, F.lit("malformed")))


def nodes_of(lines: DataFrame) -> DataFrame:
    """(label, id, props) of the node lines; id and type are no properties; nested values stay JSON."""
    props = F.from_json("value", _PROPS)
    rows = discriminate(lines).where("kind = 'node'").select(F.get_json_object("value", "$.id").alias("id"), F.coalesce(F.get_json_object("value", "$.type"), F.lit("")).alias("label"), props.alias("all"))
    return rows.select("label", "id", F.map_filter("all", lambda k, _: ~k.isin("id", "type")).alias("props"))


def edges_of(lines: DataFrame) -> DataFrame:
    """(src, dst, type) of the edge lines; other keys are ignored."""
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return discriminate(lines).where("kind = 'edge'").select(get("source").alias("src"), get("target").alias("dst"), F.coalesce(get("type"), F.lit("")).alias("type"))


def functions_of(lines: DataFrame) -> DataFrame:
    """(id, props) of the Function lines; every key stays among the properties."""
    return lines.where(F.try_parse_json("value").isNotNull() & (F.get_json_object("value", "$.type") == "Function")).select(F.get_json_object("value", "$.id").alias("id"), F.from_json("value", _PROPS).alias("props"))


def _name(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node_lines(node_id: Column | str, label: Column | str, props: Column | str) -> Column:
    """A node as one JSON object: its properties, with id and type (its label) put over them; keys in order."""
    own = F.map_filter(_name(props), lambda k, v: ~k.isin("id", "type") & v.isNotNull())
    entries = F.concat(F.map_entries(F.coalesce(own, F.create_map().cast(_PROPS))), F.array(F.struct(F.lit("id").alias("key"), _name(node_id).alias("value")), F.struct(F.lit("type").alias("key"), _name(label).alias("value"))))
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type")).alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, split: bool = False) -> None:
    """Nodes (id, label, props) and edges as JSON lines: one folder, or path/nodes and path/edges."""
    lines = nodes.select(node_lines("id", "label", "props").alias("value"))
    if split:
        lines.write.mode("overwrite").text(f"{path}/nodes")
        edge_lines(edges).write.mode("overwrite").text(f"{path}/edges")
    else:
        lines.unionByName(edge_lines(edges)).write.mode("overwrite").text(path)
