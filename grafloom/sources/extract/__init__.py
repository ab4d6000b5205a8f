"""Extractors: source files to nodes and edges, one task a file, nothing shared."""

from __future__ import annotations

import logging
import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators.vectors import Embedder, embed_column
from ...schema import EDGE, NODE, conform
from .facts import Facts
from .languages import REGISTRY

_ROW = "kind string, id string, label string, name string, file string, line long, start_line long, end_line long, namespace string, signature string, lang string, content string, extra map<string,string>, dst string"
_ARROW = {"string": pa.string(), "long": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_KINDS = {x.split()[0]: _ARROW[x.split()[1]] for x in _ROW.split(", ")}


def extract_file(path: str, text: str) -> Facts | None:
    """Facts of one file with its File node and DEFINED_IN edges; None for an extension without extractor."""
    extractor = REGISTRY.get(posixpath.splitext(path)[1])
    if extractor is None:
        return None
    facts = extractor(path, text)
    own = facts.nodes.get(("File", path), {})
    facts.node("File", path, path, 0, **{k: own[k] for k in ("content", "lang") if k in own})
    for label, id in list(facts.nodes):
        if label in ("Function", "Method", "Class"):
            facts.edge(id, path, "DEFINED_IN")
    return facts


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every file under a folder; paths are below it."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", f"^.*?{_quoted(root)}/", "").alias("path"), "content")


def read_listed(spark: SparkSession, listing: str, base: str = "") -> DataFrame:
    """(path, content) of the files named in a listing, one path a line; blank lines are skipped.  The list is read on the driver."""
    paths = [r[0].strip() for r in spark.read.text(listing).collect() if r[0].strip()]
    files = spark.read.format("binaryFile").load([posixpath.join(base, p) for p in paths])
    return files.select(F.regexp_replace("path", "^[a-z]+:/*(?=/)", "").alias("path"), "content")


def _quoted(text: str) -> str:
    return "\\Q" + text.split("://")[-1] + "\\E"


#: Fixed value: files of one output batch, so that a worker's memory does not grow with Spark's batches.
_FILES_AT_ONCE = 200


def extract(files: DataFrame, columns: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """Tagged rows (kind node or edge) of files (path, content), or these columns of them; a file that fails is logged and left out."""

    kept = [c for c in _KINDS if c in columns]

    def batch(count: int, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values[c](), _KINDS[c]) if c in values else pa.nulls(count, _KINDS[c]) for c in kept], names=kept)

    def run(parts):
        for part in parts:
            for start in range(0, part.num_rows, _FILES_AT_ONCE):
                nodes, edges = [], []
                for path, content in zip(*(part.column(k).slice(start, _FILES_AT_ONCE).to_pylist() for k in (0, 1)), strict=True):
                    try:
                        facts = extract_file(path, content.decode("utf-8", "replace"))
                    except (ValueError, IndexError, KeyError, RecursionError):
                        logging.getLogger(__name__).exception("skipped %s", path)
                        continue
                    if facts is not None:
                        nodes += facts.nodes.values()
                        edges += facts.edges
                of = {c: lambda c=c: [n.get(c) for n in nodes] for c in _KINDS if c not in ("kind", "dst", "extra")}
                yield batch(len(nodes), **of, kind=lambda: ["node"] * len(nodes), extra=lambda: [v and list(v.items()) for v in (n.get("extra") for n in nodes)])
                yield batch(len(edges), kind=lambda: ["edge"] * len(edges), id=lambda: [e[0] for e in edges], dst=lambda: [e[1] for e in edges], label=lambda: [e[2] for e in edges])

    schema = ", ".join(x for x in _ROW.split(", ") if x.split()[0] in kept)
    wanted = files.where(F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(sorted(REGISTRY))).where("content is not null")
    return wanted.select("path", "content").mapInArrow(run, schema).select(*columns)


def nodes_and_edges(rows: DataFrame, embedder: Embedder | None = None, text: str = "name") -> tuple[DataFrame, DataFrame]:
    """The node and the edge table of extract()'s rows; functions get vectors of a text column if there is an embedder."""
    nodes = conform(rows.where("kind = 'node'").drop("kind", "dst"), NODE)
    if embedder is not None:
        asked = F.when(F.col("label").isin("Function", "Method"), F.col(text))
        nodes = conform(embed_column(nodes.withColumn("__asked", asked), "__asked", embedder), NODE)
    return nodes, conform(rows.where("kind = 'edge'").select(F.col("id").alias("src"), "dst", F.col("label").alias("type")), EDGE)
