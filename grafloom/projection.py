"""The relational test tables seen as a property graph.

Each view is one SELECT that any ANSI engine runs; table names are put in by the caller.
Parts are functions that call each other in cycles, files are made of brand and type,
suppliers are classes, nations are globals and features, regions are domains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .graph import Graph
from .sources.tables import load_graph, save_graph
from .storage import shared_folder

TABLES = ("region", "nation", "supplier", "part", "embeddings")
_FILE = "'src/' || p_brand || '/' || p_type || '.x'"

FUNCTIONS = f"""SELECT 'part:' || p_partkey AS id, 'Function' AS label, p_name AS name, {_FILE} AS file,
  CAST(1 + p_size % 5 AS BIGINT) AS start_line, CAST(3 + p_size % 5 AS BIGINT) AS end_line,
  CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size % 3 = 0 END AS ui_contaminated,
  CASE WHEN p_partkey % 50 = 1 THEN NULL ELSE p_retailprice END AS risk_score FROM {{part}}"""
_BLANK = "CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BIGINT) AS end_line, CAST(NULL AS BOOLEAN) AS ui_contaminated, CAST(NULL AS DOUBLE) AS risk_score"
NODES = f"""{FUNCTIONS}
UNION ALL SELECT DISTINCT {_FILE}, 'File', {_FILE}, {_FILE}, {_BLANK} FROM {{part}}
UNION ALL SELECT 'supp:' || s_suppkey, 'Class', s_name, CAST(NULL AS VARCHAR(99)), {_BLANK} FROM {{supplier}}
UNION ALL SELECT 'glob:' || n_nationkey, 'Global', n_name, 'globals.x', {_BLANK} FROM {{nation}}
UNION ALL SELECT 'domain-' || r_name, 'Feature', r_name, CAST(NULL AS VARCHAR(99)), {_BLANK} FROM {{region}}
UNION ALL SELECT 'feat-' || n_name, 'Feature', n_name, CAST(NULL AS VARCHAR(99)), {_BLANK} FROM {{nation}}"""

_PARTS = "(SELECT p_partkey AS k, p.* FROM {part} p) p, (SELECT count(*) AS n FROM {part}) c, (SELECT count(*) AS m FROM {supplier}) s"
EDGES = f"""SELECT DISTINCT src, dst, type FROM (
SELECT 'part:' || k AS src, 'part:' || ((7 * k + 1) % n) AS dst, 'CALLS' AS type FROM {_PARTS}
UNION ALL SELECT 'part:' || k, 'part:' || ((3 * k + 2) % n), 'CALLS' FROM {_PARTS}
UNION ALL SELECT 'supp:' || (k % m), 'part:' || k, 'HAS_METHOD' FROM {_PARTS}
UNION ALL SELECT 'part:' || k, 'supp:' || (k % m), 'USES' FROM {_PARTS} WHERE k % 3 = 0
UNION ALL SELECT 'part:' || k, 'glob:' || (k % 25), 'USES_GLOBAL' FROM {_PARTS} WHERE k % 4 = 0
UNION ALL SELECT 'part:' || k, {_FILE}, 'DEFINED_IN' FROM {_PARTS}
UNION ALL SELECT 'domain-' || r_name, 'feat-' || n_name, 'PARENT_OF' FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT 'part:' || k, 'feat-' || n_name, 'IMPLEMENTS' FROM {_PARTS} JOIN {{nation}} ON k % 25 = n_nationkey
) e"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt over four tasks a core, by columns or evenly: a table in one row group is otherwise read, and worked on, by one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a file's lines are the names of its parts, by key."""
    from pyspark.sql import functions as F

    named = project(spark, sf_dir, f"SELECT {_FILE} AS path, p_partkey, p_name FROM {{part}}")
    return named.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "\n").alias("text"))


_stored: dict[tuple[str, str], str] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The projected graph: stored once an application, then read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = shared_folder(spark)
        save_graph(project(spark, sf_dir, NODES), project(spark, sf_dir, EDGES), path, "c0ffee", sources(spark, sf_dir))
        _stored[key] = path
    return load_graph(spark, _stored[key], with_sources=True)


def vector_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Embeddings as functions (even labels) and features (odd labels)."""
    nodes = table(spark, sf_dir, "embeddings").selectExpr("concat('vec:', vec_id) as id", "if(label % 2 = 0, 'Function', 'Feature') as label", "concat('v', vec_id % 7) as name", "embedding")
    return Graph(nodes, nodes.selectExpr("id as src", "id as dst", "'NONE' as type").limit(0))


def oracle(sql: str) -> str:
    """A view's text with the tables' own names."""
    return sql.format(**{t: t for t in TABLES})
