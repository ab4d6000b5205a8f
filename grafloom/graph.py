"""Graph: the named queries over a nodes and an edges table, each a DataFrame."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .functions.text import find_pattern, regex_full, slice_lines
from .operators.vectors import Embedder, top_by_cosine
from .plans.traversal import reachable, trails
from .schema import EDGE, NODE, conform, with_edge_ids


class Graph:
    """nodes (key label, id) and edges (src, dst, type); optional state and sources (path, text).

    Missing node columns are null.  A start is named by id or by name and may be several
    nodes.  Unknown starts give empty results; ``require`` raises for them.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, state: DataFrame | None = None, sources: DataFrame | None = None):
        self.nodes, self.edges = conform(nodes, NODE), with_edge_ids(conform(edges, EDGE))
        self.state, self.sources = state, sources

    def match(self, start: str) -> DataFrame:
        """Nodes whose id or name is start."""
        return self.nodes.where((F.col("id") == start) | (F.col("name") == start))

    def first(self, start: str) -> DataFrame:
        """The first of them, by label and id."""
        return self.match(start).orderBy("label", "id").limit(1)

    def require(self, start: str) -> None:
        if self.match(start).isEmpty():
            raise LookupError(f"no node has id or name {start!r}")

    def _of(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def find_node(self, label: str, prop: str, value) -> DataFrame:
        """The first node of a label with a property value; properties outside the schema are looked up in extra."""
        column = F.col(prop) if prop in self.nodes.columns else F.col("extra")[prop]
        return self.nodes.where((F.col("label") == label) & (column == F.lit(value))).orderBy("id").limit(1)

    def traverse(self, start: str, types=None, direction: str = "outgoing", depth: int = 1, most_depth: int = 6) -> DataFrame:
        """Paths: start, end, depth, node_ids and edges (as stored)."""
        return trails(self.edges, self.match(start).select("id"), types, direction, depth, most_depth=most_depth)

    def callers(self, start: str) -> DataFrame:
        """Distinct names of the nodes that call any match."""
        called = self._of("CALLS").join(self.match(start).select(F.col("id").alias("dst")), "dst", "left_semi")
        return self.nodes.join(called.select(F.col("src").alias("id")), "id", "left_semi").where("name is not null").select("name").distinct()

    def impact(self, start: str, depth: int = 1) -> DataFrame:
        """name and ui_contaminated of all that call any match within depth.

        Distinct before null flags are shown as false, so two rows may look alike.
        """
        ids = reachable(self.edges, self.match(start).select("id"), ["CALLS"], "incoming", depth)
        return self.nodes.join(ids, "id", "left_semi").select("name", "ui_contaminated").distinct().select("name", F.coalesce("ui_contaminated", F.lit(False)).alias("ui_contaminated"))

    def globals_used(self, start: str) -> DataFrame:
        """name and file of the globals that matches use directly, one row a use."""
        used = self._of("USES_GLOBAL").join(self.match(start).select(F.col("id").alias("src")).distinct(), "src").select(F.col("dst").alias("id"))
        return self.nodes.where("label = 'Global'").join(used, "id").select("name", "file")

    def seams(self, pattern: str = ".*", limit: int = 20) -> DataFrame:
        """Clean functions that contaminated ones call, in files that match the whole pattern, riskiest first (nulls lead)."""
        functions = self.nodes.where("label = 'Function'")
        files = self.nodes.where("label = 'File'").where(regex_full("file", pattern)).select(F.col("id").alias("fid"), "file")
        callers = functions.where("ui_contaminated = true").select(F.col("id").alias("src"))
        clean = functions.where("ui_contaminated = false").select(F.col("id").alias("dst"), F.col("name").alias("seam"), "risk_score")
        called = self._of("CALLS").join(callers, "src", "left_semi").select("dst").distinct()
        placed = self._of("DEFINED_IN").select(F.col("src").alias("dst"), F.col("dst").alias("fid")).join(files, "fid").select("dst", "file")
        rows = clean.join(called, "dst", "left_semi").join(placed, "dst").select("seam", "file", "risk_score").distinct()
        top = rows.orderBy(F.desc_nulls_first("risk_score"), "seam", "file").limit(limit)
        return top.select("seam", "file", F.coalesce("risk_score", F.lit(0.0)).alias("risk"))

    def _scope(self, start: str) -> DataFrame:
        """Ids a query on a node stands for: itself and its methods."""
        one = self.first(start).select("id")
        return one.unionByName(self._of("HAS_METHOD").join(one.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))).distinct()

    def neighbors(self, start: str, depth: int = 1) -> DataFrame:
        """What the first match (and its methods) depends on: name, type, via.

        Globals come with the names on every trail of 0 to ``depth`` calls and the use that
        ends it, the scope's own node left out; direct calls and uses have a null via.
        """
        scope = self._scope(start)
        paths = trails(self.edges, scope, ["CALLS"], "outgoing", depth, least=0)
        uses = self._of("USES_GLOBAL").select(F.col("src").alias("end"), F.col("dst").alias("gid")).join(self.nodes.where("label = 'Global'").select(F.col("id").alias("gid"), F.col("name").alias("gname")), "gid")
        used = paths.join(uses, "end").select("start", "node_ids", "edges", "gid", "gname")
        steps = used.select("*", F.posexplode("node_ids").alias("pos", "id"))
        way = ["start", "node_ids", "edges", "gid", "gname"]
        # an id may stand for nodes of several labels: the least name counts
        named = steps.join(self.nodes.select("id", "name"), "id").groupBy(*way, "pos", "id").agg(F.min("name").alias("name"))
        on_way = named.groupBy(*way)
        names = F.transform(F.array_sort(F.collect_list(F.when(F.col("id") != F.col("start"), F.struct("pos", "name")))), lambda x: x["name"])
        via = on_way.agg(names.alias("way")).select(F.col("gname").alias("name"), F.lit("Global").alias("type"), F.array_append("way", F.col("gname")).alias("via")).distinct()
        direct = self._of("CALLS", "USES").join(scope.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        calls = self.nodes.join(direct, "id", "left_semi").select("name", F.col("label").alias("type"), F.lit(None).cast("array<string>").alias("via")).distinct()
        return via.unionByName(calls)

    def explore_domain(self, feature: str) -> DataFrame:
        """role (feature, parent, child, sibling, function), id and name around one feature id.

        Of several parents the one with the smallest id counts.
        """
        features = self.nodes.where("label = 'Feature'").select("id", "name")
        parent_of, me = self._of("PARENT_OF"), features.where(F.col("id") == feature)
        up = parent_of.where(F.col("dst") == feature).join(me.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("dst").agg(F.min("src").alias("src"))
        parent = features.join(up.select(F.col("src").alias("id")), "id", "left_semi")
        child = features.join(parent_of.join(me.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")), "id", "left_semi")
        sibling = features.where(F.col("id") != feature).join(parent_of.join(up.select("src"), "src", "left_semi").select(F.col("dst").alias("id")), "id", "left_semi")
        implementers = self._of("IMPLEMENTS").where(F.col("dst") == feature).join(me.select(F.col("id").alias("dst")), "dst", "left_semi")
        function = self.nodes.where("label = 'Function'").select("id", "name").join(implementers.select(F.col("src").alias("id")), "id", "left_semi")
        out = me.select(F.lit("feature").alias("role"), "id", "name")
        for role, part in (("parent", parent), ("child", child), ("sibling", sibling), ("function", function)):
            out = out.unionByName(part.distinct().select(F.lit(role).alias("role"), "id", "name"))
        return out

    def search_similar(self, vector: Sequence[float], limit: int = 10) -> DataFrame:
        """Functions nearest to a vector: all their properties, and score (cosine)."""
        return self._nearest("Function", vector, limit)

    def search_features(self, vector: Sequence[float], limit: int = 10) -> DataFrame:
        """Features nearest to a vector: all their properties, and score (cosine)."""
        return self._nearest("Feature", vector, limit)

    def _nearest(self, label: str, vector: Sequence[float], limit: int) -> DataFrame:
        """The few nearest are found over ids and vectors alone; then their properties are joined."""
        own = self.nodes.where(F.col("label") == label)
        best = top_by_cosine(own.select("id", "embedding"), vector, limit).select("id", "score")
        return own.join(best, "id").orderBy(F.desc("score"), "id")

    def hybrid_context(self, start: str, embedder: Embedder | Sequence[float], depth: int = 1, limit: int = 10) -> DataFrame:
        """Neighbors and functions similar to the start's own text, in one table: kind, name, type, via, score.

        If the embedder fails, that is logged and there are no similar functions.
        """
        try:
            vector = embedder([start])[0] if callable(embedder) else embedder
        except Exception:
            logging.getLogger(__name__).exception("no vector for %r", start)
            vector = None
        near = self.neighbors(start, depth).select(F.lit("neighbor").alias("kind"), "name", "type", "via", F.lit(None).cast("double").alias("score"))
        if vector is None:
            return near
        like = self.search_similar(vector, limit).select(F.lit("similar").alias("kind"), "name", F.lit("Function").alias("type"), F.lit(None).cast("array<string>").alias("via"), "score")
        return near.unionByName(like)

    def _located(self, start: str) -> tuple[Row, DataFrame]:
        """The first match, and its source's row (file, text); LookupError without a match, ValueError without a file."""
        if self.sources is None:
            raise ValueError("the graph has no sources (path, text)")
        one = self.first(start).select("id", "file", F.coalesce("start_line", F.lit(0)).alias("first"), F.coalesce("end_line", F.lit(0)).alias("last")).first()
        if one is None:
            raise LookupError(f"no node has id or name {start!r}")
        if not one["file"]:
            raise ValueError(f"node {start!r} has no file")
        return one, self.sources.where(F.col("path") == one["file"]).select(F.col("path").alias("file"), "text")

    def fetch_source(self, start: str) -> DataFrame:
        """id, file and source: the lines of the first match, 1 to 50 where it has none."""
        one, source = self._located(start)
        first, last = (one["first"], one["last"]) if one["first"] or one["last"] else (1, 50)
        return source.select(F.lit(one["id"]).alias("id"), "file", slice_lines("text", first, last).alias("source"))

    def locate_usage(self, source: str, target: str, context: int = 0) -> DataFrame:
        """match_no, number and content of the source's lines that hold the target's name.

        The source must have lines and the target a name: ValueError else.
        """
        one, text = self._located(source)
        if not one["first"] or not one["last"]:
            raise ValueError(f"node {source!r} has no lines")
        other = self.first(target).select("name").first()
        if other is None:
            raise LookupError(f"no node has id or name {target!r}")
        if not other["name"]:
            raise ValueError(f"node {target!r} has no name")
        scope = text.select(slice_lines("text", one["first"], one["last"]).alias("scope"))
        return find_pattern(scope, "scope", other["name"], context, first_line=max(one["first"], 1))

    def status(self) -> DataFrame:
        """commit: that of the graph state, or empty."""
        if self.state is None:
            return self.nodes.sparkSession.createDataFrame([("",)], "commit string")
        return self.state.agg(F.coalesce(F.max("commit"), F.lit("")).alias("commit"))
