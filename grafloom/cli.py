"""Command line: ingest, enrich-features, import and query.  Results are indented JSON."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings
from .operators import intent
from .operators.upsert import merge_edges, merge_nodes
from .operators.vectors import hash_embedder
from .schema import NODE
from .sources import extract, jsonl, tables


def _props(nodes: DataFrame) -> DataFrame:
    """(id, label, props): the filled columns as strings, lists as JSON."""
    names = [f for f in NODE if f.name not in ("id", "label", "extra")]
    value = lambda f: F.to_json(f.name) if f.dataType.typeName() == "array" else F.col(f.name).cast("string")
    filled = F.map_filter(F.create_map(*[x for f in names for x in (F.lit(f.name), value(f))]), lambda _, v: v.isNotNull())
    return nodes.select("id", "label", F.map_concat(filled, F.coalesce("extra", F.create_map().cast("map<string,string>"))).alias("props"))


def _columns(rows: DataFrame) -> DataFrame:
    """The typed columns of (label, id, props); what the schema lacks goes to extra."""
    known = [f for f in NODE if f.name not in ("id", "label", "extra")]

    def typed(f):
        raw = F.try_element_at("props", F.lit(f.name))
        kind = f.dataType.simpleString()
        return (F.from_json(raw, kind) if f.dataType.typeName() == "array" else raw.try_cast(kind)).alias(f.name)

    return rows.select("id", "label", *[typed(f) for f in known], F.map_filter("props", lambda k, _: ~k.isin([f.name for f in known])).alias("extra"))


def _ingest(spark: SparkSession, a) -> None:
    files = extract.read_listed(spark, a.file_list, a.dir) if a.file_list else extract.read_files(spark, a.dir)
    nodes, edges = extract.nodes_and_edges(extract.extract(files), hash_embedder() if a.embed else None)
    jsonl.write_graph(_props(nodes), edges, a.out, split=a.split)


def _import(spark: SparkSession, a) -> None:
    lines = spark.read.option("recursiveFileLookup", "true").text(a.input)
    new = jsonl.nodes_of(lines).select(F.monotonically_increasing_id().alias("seq"), "label", "id", "props")
    edges, old_edges = jsonl.edges_of(lines), None
    if not a.clean:
        try:
            old = tables.load_graph(spark, a.graph)
            new = _props(old.nodes).select(F.lit(-1).cast("long").alias("seq"), "label", "id", "props").unionByName(new)
            old_edges = old.edges
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    from .storage import held

    merged = held(_columns(merge_nodes(new)))  # the tables that are read are replaced
    linked = held(merge_edges(edges, merged, old_edges))
    head = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False).stdout.strip()
    tables.save_graph(merged, linked, a.graph, head)


def _enrich(spark: SparkSession, a) -> None:
    functions = intent.describe(_columns(jsonl.nodes_of(spark.read.option("recursiveFileLookup", "true").text(a.input)).where("label = 'Function'")))
    domains = intent.domain_frame(spark, intent.discover_domains(a.dir))
    placed = intent.members(functions, domains)
    if a.cluster == "semantic":
        placed = placed.drop("cluster").join(intent.semantic_clusters(placed, hash_embedder()), ["domain", "id"])
    else:
        placed = placed.withColumn("cluster", intent.file_cluster("file"))
    features, edges = intent.hierarchy(placed)
    implementers = placed.select(F.concat(F.lit("feat-"), "cluster").alias("feature"), "id", "content", "atomic_features").dropDuplicates(["feature", "id"])
    rich = intent.enrich(features, intent.feature_samples(implementers), embedder=hash_embedder())
    from .schema import conform

    jsonl.write_graph(_props(conform(rich.unionByName(functions.select("id", "label", "name", "atomic_features"), allowMissingColumns=True), NODE)), edges, a.out)


def _query(spark: SparkSession, a) -> DataFrame:
    g = tables.load_graph(spark, a.graph)
    if a.sources:
        g.sources = tables.read_sources(spark, a.sources)
    vector = lambda: hash_embedder()([a.target])[0]
    if a.type in ("neighbors", "test-context", "hybrid-context"):
        g.require(a.target)
    found = {
        "neighbors": lambda: g.neighbors(a.target, a.depth), "test-context": lambda: g.neighbors(a.target, a.depth), "impact": lambda: g.impact(a.target, a.depth),
        "callers": lambda: g.callers(a.target), "globals": lambda: g.globals_used(a.target), "seams": lambda: g.seams(a.module), "status": g.status,
        "traverse": lambda: g.traverse(a.target, a.edge_types, a.direction, a.depth), "explore-domain": lambda: g.explore_domain(a.target),
        "fetch-source": lambda: g.fetch_source(a.target), "locate-usage": lambda: g.locate_usage(a.target, a.target2),
        "search-similar": lambda: g.search_similar(vector(), a.limit), "search-features": lambda: g.search_features(vector(), a.limit), "features": lambda: g.search_features(vector(), a.limit),
        "hybrid-context": lambda: g.hybrid_context(a.target, hash_embedder(), a.depth, a.limit),
    }
    if a.type not in found:
        raise SystemExit(f"unknown query type {a.type}: one of {', '.join(sorted(found))}")
    return found[a.type]()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="grafloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--dir", default=".")
    p.add_argument("--file-list")
    p.add_argument("--out", required=True)
    p.add_argument("--split", action="store_true")
    p.add_argument("--embed", action="store_true")
    p = sub.add_parser("enrich-features")
    p.add_argument("--dir", default=".")
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--cluster", choices=("file", "semantic"), default="file")
    p = sub.add_parser("import")
    p.add_argument("--input", required=True)
    p.add_argument("--graph", required=True)
    p.add_argument("--clean", action="store_true")
    own = settings.load()
    p = sub.add_parser("query")
    p.add_argument("--graph", required=not own["graph"], default=own["graph"])
    p.add_argument("--type", required=True)
    for name, kind, default in (("target", str, ""), ("target2", str, ""), ("edge-types", str, ""), ("direction", str, "outgoing"), ("module", str, ".*"), ("sources", str, own["sources"]), ("depth", int, 1), ("limit", int, int(own["limit"] or 10))):
        p.add_argument(f"--{name}", type=kind, default=default)
    a = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("grafloom").getOrCreate()
    if a.command == "query":
        if a.direction not in ("outgoing", "incoming", "both"):
            a.direction = "outgoing"
        df = _query(spark, a)
        if a.type == "fetch-source":
            print("\n".join(r["source"] for r in df.collect()))
        else:
            print(json.dumps([json.loads(r) for r in df.toJSON().collect()], indent=2, ensure_ascii=False))
    else:
        {"ingest": _ingest, "enrich-features": _enrich, "import": _import}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
