"""The registered queries over the projected tables, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projection as P
from .functions.text import cut_bytes, find_pattern, path_ext, path_join, path_stem, slice_lines
from .operators import intent, trace, upsert, vectors
from .plans.traversal import trails_recursive
from .samples import SAMPLES, Sample, expected
from .sources.extract import extract
from .sources.jsonl import discriminate, edges_of, functions_of, node_lines, nodes_of, write_graph
from .sources.markup import language, script_bodies, server_code
from .storage import shared_folder

START, NAME, FEATURE = "part:7", "blue anvil", "feat-NATION_3"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _ORACLES[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


_G = f"nodes AS ({P.oracle(P.NODES)}), edges AS ({P.oracle(P.EDGES)})"
_MATCH = f"hit AS (SELECT * FROM nodes WHERE id = '{START}' OR name = '{NAME}')"


def _both(f):
    """Queries that start from an id and from a name take in both."""
    return lambda spark, sf_dir: f(P.graph(spark, sf_dir), START).unionByName(f(P.graph(spark, sf_dir), NAME))


def _two(body: str) -> str:
    """The SQL of such a query: body with HIT for the matched nodes, once for each start."""
    return f"WITH RECURSIVE {_G} " + " UNION ALL ".join(f"SELECT * FROM ({body.replace('HIT', f"(SELECT * FROM nodes WHERE id = '{x}' OR name = '{x}')")})" for x in (START, NAME))


@query(f"WITH {_G} SELECT id, name FROM nodes WHERE label = 'Function' AND file = 'src/Brand#17/ECONOMY.x' ORDER BY id LIMIT 1")
def find_node(spark, sf_dir):
    return P.graph(spark, sf_dir).find_node("Function", "file", "src/Brand#17/ECONOMY.x").select("id", "name")


query(_two("SELECT DISTINCT c.name FROM edges e JOIN HIT h ON e.dst = h.id JOIN nodes c ON c.id = e.src WHERE e.type = 'CALLS' AND c.name IS NOT NULL"), "callers")(_both(lambda g, s: g.callers(s)))


def _impact_sql(depth: int) -> str:
    walk = "SELECT id, 0 AS d FROM HIT UNION SELECT e.src, d + 1 FROM w{n} JOIN edges e ON e.dst = w{n}.id WHERE e.type = 'CALLS' AND d < {depth}"
    ctes, parts = [], []
    for n, x in enumerate((START, NAME)):
        hit = f"(SELECT * FROM nodes WHERE id = '{x}' OR name = '{x}')"
        ctes.append(f"w{n} AS ({walk.format(n=n, depth=depth).replace('HIT', hit)})")
        parts.append(f"SELECT name, coalesce(ui_contaminated, false) AS ui_contaminated FROM (SELECT DISTINCT name, ui_contaminated FROM nodes WHERE id IN (SELECT id FROM w{n} WHERE d > 0))")
    return f"WITH RECURSIVE {_G}, {', '.join(ctes)} {' UNION ALL '.join(parts)}"


for _d in (1, 3, 5):
    query(_impact_sql(_d), f"impact_d{_d}")(_both(lambda g, s, d=_d: g.impact(s, d)))

query(_two("SELECT g.name, g.file FROM edges e JOIN HIT h ON e.src = h.id JOIN nodes g ON g.id = e.dst WHERE e.type = 'USES_GLOBAL' AND g.label = 'Global'"), "globals")(_both(lambda g, s: g.globals_used(s)))


@query(f"""WITH {_G} SELECT seam, file, coalesce(risk_score, 0) AS risk FROM (
  SELECT DISTINCT f.name AS seam, d.file, f.risk_score FROM edges c JOIN nodes a ON a.id = c.src JOIN nodes f ON f.id = c.dst JOIN edges i ON i.src = f.id JOIN nodes d ON d.id = i.dst
  WHERE c.type = 'CALLS' AND i.type = 'DEFINED_IN' AND a.label = 'Function' AND f.label = 'Function' AND d.label = 'File' AND a.ui_contaminated AND NOT f.ui_contaminated AND regexp_full_match(d.file, '.*Brand#1.*')
  ORDER BY risk_score DESC NULLS FIRST, seam, file LIMIT 20)""")
def seams(spark, sf_dir):
    return P.graph(spark, sf_dir).seams(".*Brand#1.*")


def _trail_sql(types: str, direction: str, depth: int) -> str:
    where = f"type IN ({', '.join(repr(t) for t in types.split(','))})" if types else "true"
    ahead, back = f"SELECT src AS a, dst AS b, src, dst, type FROM edges WHERE {where}", f"SELECT dst AS a, src AS b, src, dst, type FROM edges WHERE {where}"
    step = {"outgoing": ahead, "incoming": back, "both": f"{ahead} UNION ALL {back} AND src <> dst"}[direction]
    return f"""WITH RECURSIVE {_G}, {_MATCH}, step AS ({step}), walk AS (
      SELECT id AS spot, 0 AS depth, [id] AS way, []::VARCHAR[] AS used FROM hit
      UNION ALL SELECT b, depth + 1, list_append(way, b), list_append(used, src || type || dst) FROM walk JOIN step ON a = spot WHERE depth < {depth} AND NOT list_contains(used, src || type || dst)
    ) SELECT depth, array_to_string(way, '>') AS path, array_to_string(used, '>') AS edges FROM walk WHERE depth > 0"""


def _paths(found: DataFrame) -> DataFrame:
    return found.select("depth", F.array_join("node_ids", ">").alias("path"), F.array_join(F.transform("edges", lambda e: F.concat(e["src"], e["type"], e["dst"])), ">").alias("edges"))


def _traverse(types, direction, depth):
    def run(spark, sf_dir):
        g = P.graph(spark, sf_dir)
        named, one = g.traverse(NAME, types, direction, depth), g.traverse(START, types, direction, depth)
        return _paths(named.unionByName(one))

    return run


for _n, _t, _dir, _d in (("traverse_out_d3", "CALLS", "outgoing", 3), ("traverse_in_d2", "CALLS", "incoming", 2), ("traverse_both_d2", "CALLS", "both", 2), ("traverse_multi_type_d2", "CALLS,USES,USES_GLOBAL", "outgoing", 2), ("traverse_any_type_d1", "", "outgoing", 1), ("traverse_in_d4", "CALLS", "incoming", 4)):
    query(_trail_sql(_t, _dir, _d), _n)(_traverse(_t, _dir, _d))


@query(_trail_sql("CALLS", "outgoing", 3).replace(", array_to_string(used, '>') AS edges", ""))
def traverse_recursive_d3(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    starts = g.match(NAME).select("id").unionByName(g.match(START).select("id"))
    return trails_recursive(spark, g.edges, starts, ["CALLS"], "outgoing", 3).select("depth", F.array_join("node_ids", ">").alias("path"))


def _neighbors_sql(start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_G}, one AS (SELECT id FROM nodes WHERE id = '{start}' OR name = '{start}' ORDER BY label, id LIMIT 1),
    scope AS (SELECT id FROM one UNION SELECT dst FROM edges JOIN one ON src = id WHERE type = 'HAS_METHOD'),
    walk AS (
      SELECT id AS s, id AS spot, 0 AS depth, []::VARCHAR[] AS way, []::VARCHAR[] AS used FROM scope
      UNION ALL SELECT s, dst, depth + 1, CASE WHEN dst = s THEN way ELSE list_append(way, n.name) END, list_append(used, src || dst)
      FROM walk JOIN edges e ON e.src = spot AND e.type = 'CALLS' JOIN nodes n ON n.id = e.dst WHERE depth < {depth} AND NOT list_contains(used, src || dst)
    )
    SELECT DISTINCT n.name, 'Global' AS type, array_to_string(list_append(way, n.name), '>') AS via FROM walk JOIN edges e ON e.src = spot AND e.type = 'USES_GLOBAL' JOIN nodes n ON n.id = e.dst WHERE n.label = 'Global'
    UNION ALL SELECT DISTINCT n.name, n.label, NULL FROM scope JOIN edges e ON e.src = scope.id AND e.type IN ('CALLS', 'USES') JOIN nodes n ON n.id = e.dst"""


def _neighbors(start: str, depth: int) -> Query:
    return lambda spark, sf_dir: P.graph(spark, sf_dir).neighbors(start, depth).withColumn("via", F.array_join("via", ">"))


for _n, _s, _d in (("neighbors_globals_via", NAME, 3), ("neighbors_direct", START, 0), ("neighbors_class_scope", "supp:3", 2)):
    query(_neighbors_sql(_s, _d), _n)(_neighbors(_s, _d))

_DOMAIN = f"""WITH {_G}, f AS (SELECT id, name FROM nodes WHERE label = 'Feature'), me AS (SELECT * FROM f WHERE id = 'ID'),
up AS (SELECT min(src) AS id FROM edges WHERE type = 'PARENT_OF' AND dst IN (SELECT id FROM me))
SELECT 'feature' AS role, id, name FROM me
UNION ALL SELECT 'parent', id, name FROM f WHERE id IN (SELECT id FROM up)
UNION ALL SELECT 'child', id, name FROM f WHERE id IN (SELECT dst FROM edges WHERE type = 'PARENT_OF' AND src IN (SELECT id FROM me))
UNION ALL SELECT 'sibling', id, name FROM f WHERE id <> 'ID' AND id IN (SELECT dst FROM edges WHERE type = 'PARENT_OF' AND src IN (SELECT id FROM up))
UNION ALL SELECT 'function', id, name FROM nodes WHERE label = 'Function' AND id IN (SELECT src FROM edges WHERE type = 'IMPLEMENTS' AND dst IN (SELECT id FROM me))"""
for _n, _f in (("explore_domain_feature", FEATURE), ("explore_domain_root", "domain-ASIA")):
    query(_DOMAIN.replace("ID", _f), _n)(lambda spark, sf_dir, f=_f: P.graph(spark, sf_dir).explore_domain(f))

_COSINE = "list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])))"


def _nearest_sql(odd: int) -> str:
    return f"""SELECT id, name, label, round(score, 6) AS score FROM (SELECT 'vec:' || vec_id AS id, 'v' || (vec_id % 7) AS name, '{('Function', 'Feature')[odd]}' AS label, {_COSINE.replace('a::', 'embedding::').replace('b::', 'q::')} AS score
    FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) WHERE label % 2 = {odd} ORDER BY score DESC, id LIMIT 10)"""


def _third(spark, sf_dir):
    return P.table(spark, sf_dir, "embeddings").where("vec_id = 3").select("embedding").first()[0]


@query(_nearest_sql(0))
def search_similar_topk(spark, sf_dir):
    return P.vector_graph(spark, sf_dir).search_similar(_third(spark, sf_dir)).select("id", "name", "label", F.round("score", 6).alias("score"))


@query(_nearest_sql(1))
def search_features_topk(spark, sf_dir):
    return P.vector_graph(spark, sf_dir).search_features(_third(spark, sf_dir)).select("id", "name", "label", F.round("score", 6).alias("score"))


@query(f"""WITH near AS ({_neighbors_sql(START, 1)}) SELECT 'neighbor' AS kind, name, type, via, NULL::DOUBLE AS score FROM near
UNION ALL SELECT 'similar', name, 'Function', NULL, score FROM ({_nearest_sql(0)})""")
def hybrid_context(spark, sf_dir):
    g, v = P.graph(spark, sf_dir), P.vector_graph(spark, sf_dir)
    g.nodes = g.nodes.unionByName(v.nodes)
    return g.hybrid_context(START, _third(spark, sf_dir), 1).withColumns({"via": F.array_join("via", ">"), "score": F.round("score", 6)})


_KM = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS b FROM embeddings), c AS (SELECT id::INTEGER AS cluster, b AS a FROM v WHERE id < 10),
assigned AS (SELECT id, cluster FROM (SELECT v.id, cluster, row_number() OVER (PARTITION BY v.id ORDER BY 1 - COS, cluster) AS r FROM v, c) WHERE r = 1)""".replace("COS", _COSINE)


def _lloyd(spark, sf_dir):
    rows = P.table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding")
    return rows, rows.where("id < 10").selectExpr("cast(id as int) as cluster", "cast(embedding as array<double>) as centroid")


@query(f"WITH {_KM} SELECT * FROM assigned")
def kmeans_assign_step(spark, sf_dir):
    return vectors.assign(*_lloyd(spark, sf_dir))


@query(f"""WITH {_KM}, p AS (SELECT cluster, unnest(b) AS x, generate_subscripts(b, 1) - 1 AS dim FROM assigned JOIN v USING (id)),
m AS (SELECT cluster, dim, avg(x) AS x FROM p GROUP BY ALL) SELECT c.cluster, k.dim::INTEGER AS dim, round(coalesce(m.x, a[k.dim + 1]), 6) AS x FROM c, range(64) k(dim) LEFT JOIN m ON m.cluster = c.cluster AND m.dim = k.dim""")
def kmeans_update_step(spark, sf_dir):
    rows, centroids = _lloyd(spark, sf_dir)
    moved = vectors.move_centroids(rows, vectors.assign(rows, centroids), centroids)
    return moved.select("cluster", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_G} SELECT regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '') AS cluster, count(*) AS n FROM nodes WHERE label = 'Function' GROUP BY 1")
def file_cluster(spark, sf_dir):
    return P.graph(spark, sf_dir).nodes.where("label = 'Function'").groupBy(intent.file_cluster("file").alias("cluster")).agg(F.count("*").alias("n"))


def _placed(spark, sf_dir):
    functions = P.graph(spark, sf_dir).nodes.where("label = 'Function'").select("id", "name", "file")
    return intent.members(functions, intent.domains_of(functions)).withColumn("cluster", intent.file_cluster("file"))


_PLACED = """f AS (SELECT id, file, regexp_extract(file, '([^/]*)\\.x$', 1) AS cluster FROM nodes WHERE label = 'Function'),
d AS (SELECT DISTINCT regexp_extract(file, '^src/([^/]*)/', 1) AS domain FROM f), placed AS (SELECT f.*, domain FROM f JOIN d ON contains(file, 'src/' || domain))"""


@query(f"""WITH {_G}, {_PLACED} SELECT DISTINCT 'domain-' || domain AS src, 'feat-' || cluster AS dst, 'PARENT_OF' AS type FROM placed
UNION ALL SELECT DISTINCT id, 'feat-' || cluster, 'IMPLEMENTS' FROM placed""")
def domain_build_edges(spark, sf_dir):
    return intent.hierarchy(_placed(spark, sf_dir))[1]


@query(f"""WITH {_G}, {_PLACED} SELECT DISTINCT 'domain-' || domain AS id, domain AS name FROM placed UNION ALL SELECT DISTINCT 'feat-' || cluster, cluster FROM placed""")
def domain_build_nodes(spark, sf_dir):
    return intent.hierarchy(_placed(spark, sf_dir))[0].select("id", "name")


@query(f"WITH {_G} SELECT feature, id FROM (SELECT dst AS feature, src AS id, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM edges WHERE type = 'IMPLEMENTS') WHERE r <= 11")
def feature_sample_11(spark, sf_dir):
    return intent.feature_samples(P.graph(spark, sf_dir).edges.where("type = 'IMPLEMENTS'").select(F.col("dst").alias("feature"), F.col("src").alias("id"))).select("feature", "id")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey AS id, l_returnflag, l_linestatus, l_shipdate, l_quantity FROM lineitem),
e AS (SELECT seq, id, 'flag' AS key, l_returnflag AS value FROM r UNION ALL SELECT seq, id, 'status', CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END FROM r),
l AS (SELECT id, key, value, row_number() OVER (PARTITION BY id, key ORDER BY seq DESC, value DESC NULLS LAST) AS n FROM e)
SELECT 'Generic' AS label, 'p' || id AS id, max(CASE WHEN key = 'flag' AND n = 1 THEN value END) AS flag, max(CASE WHEN key = 'status' AND n = 1 THEN value END) AS status FROM l GROUP BY l.id""")
def node_upsert(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").selectExpr("named_struct('a', l_orderkey * 10 + l_linenumber, 'b', l_returnflag, 'c', l_linestatus) as seq", "'' as label", "concat('p', l_partkey) as id", "map('flag', l_returnflag, 'status', if(l_linestatus = 'O', null, l_linestatus)) as props")
    rows = rows.withColumn("seq", F.col("seq.a"))
    return upsert.merge_nodes(rows).select("label", "id", F.try_element_at("props", F.lit("flag")).alias("flag"), F.try_element_at("props", F.lit("status")).alias("status"))


@query("""SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'RELATED_TO' AS type FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)""")
def edge_upsert_dangling(spark, sf_dir):
    nodes = P.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("concat('o', o_orderkey) as id").unionByName(P.table(spark, sf_dir, "part").where("p_size < 25").selectExpr("concat('p', p_partkey) as id"))
    edges = P.table(spark, sf_dir, "lineitem").selectExpr("concat('o', l_orderkey) as src", "concat('p', l_partkey) as dst", "'' as type")
    return upsert.merge_edges(edges, nodes)


@query("SELECT event_type AS raw, CASE WHEN event_type IS NULL OR event_type = 'error' THEN 'Generic' ELSE event_type END AS label, CASE WHEN event_type IS NULL OR event_type = 'error' THEN 'RELATED_TO' ELSE event_type END AS type, count(*) AS n FROM events GROUP BY ALL")
def default_labels(spark, sf_dir):
    raw = F.when(F.col("event_type") == "error", F.lit("``")).otherwise(F.concat(F.lit("`"), F.col("event_type"), F.lit("`")))
    return P.table(spark, sf_dir, "events").select(F.col("event_type").alias("raw"), upsert.clean_label(raw).alias("label"), upsert.clean_type(raw).alias("type")).groupBy("raw", "label", "type").agg(F.count("*").alias("n"))


_LINES = "CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) END"


@query(f"SELECT doc_id, array_to_string(({_LINES})[2:4], chr(10)) AS part FROM documents")
def slice_lines_2_4(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", slice_lines("text", 2, 4).alias("part"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS match_no FROM n WHERE contains(ls[i + 1], 'the'))
SELECT doc_id, match_no::INTEGER AS match_no, j + 10 AS number, ls[j + 1] AS content FROM (SELECT *, unnest(range(greatest(i - 1, 0), least(i + 1, len(ls) - 1) + 1)) AS j FROM h)""")
def find_pattern_context(spark, sf_dir):
    return find_pattern(P.table(spark, sf_dir, "documents"), "text", "the", 1, "doc_id", first_line=10)


_SOURCE = f"src AS (SELECT {P._FILE} AS path, string_agg(p_name, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1)"


@query(f"WITH {_G}, {_SOURCE}, one AS (SELECT * FROM nodes WHERE id = '{START}'), SELECT id, file, array_to_string(string_split(text, chr(10))[start_line:end_line], chr(10)) AS source FROM one JOIN src ON path = file".replace("), SELECT", ") SELECT"))
def fetch_source_window(spark, sf_dir):
    return P.graph(spark, sf_dir).fetch_source(START)


@query(f"""WITH {_G}, {_SOURCE}, one AS (SELECT * FROM nodes WHERE id = '{START}'),
l AS (SELECT content, unnest(range(len(content))) AS i, start_line FROM (SELECT start_line, string_split(text, chr(10))[start_line:end_line] AS content FROM one JOIN src ON path = file)),
h AS (SELECT *, row_number() OVER (ORDER BY i) AS match_no FROM l WHERE contains(content[i + 1], '{NAME}'))
SELECT match_no::INTEGER AS match_no, start_line + j AS number, content[j + 1] AS content FROM (SELECT *, unnest(range(greatest(i - 1, 0), least(i + 1, len(content) - 1) + 1)) AS j FROM h)""")
def locate_usage(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    return g.locate_usage(START, g.match(NAME).orderBy("id").first()["id"], 1)


_JSON_CASES = """CASE p_partkey % 5 WHEN 0 THEN '{"id":"p' || p_partkey || '","type":"Function","name":"' || p_name || '"}'
 WHEN 1 THEN '{"source":"p' || p_partkey || '","target":"p0","type":"CALLS"}' WHEN 2 THEN '{"source":null,"target":"p1","id":"x"}' WHEN 3 THEN '{"id":"","type":"File"}' ELSE '{broken ' || p_partkey END"""


@query("""SELECT CASE p_partkey % 5 WHEN 0 THEN 'node' WHEN 1 THEN 'edge' WHEN 2 THEN 'dropped_edge' WHEN 3 THEN 'dropped_node' ELSE 'malformed' END AS kind, count(*) AS n FROM part GROUP BY 1""")
def jsonl_discriminate(spark, sf_dir):
    lines = P.table(spark, sf_dir, "part").selectExpr(f"{_JSON_CASES} as value")
    return discriminate(lines).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'part:' || p_partkey AS id, '{\"id\":\"part:' || p_partkey || '\",\"name\":\"' || p_name || '\",\"type\":\"Function\"}' AS line FROM part")
def json_flatten(spark, sf_dir):
    nodes = P.table(spark, sf_dir, "part").selectExpr("concat('part:', p_partkey) as id", "'Function' as label", "map('name', p_name, 'type', p_type) as props")
    return nodes.select("id", node_lines("id", "label", "props").alias("line"))


@query("SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '(?s)<script[^>]*>(.*?)</script>', 1))::INTEGER AS bodies, array_to_string(regexp_extract_all(coalesce(html, ''), '(?s)<script[^>]*>(.*?)</script>', 1), chr(10)) AS code FROM pages")
def script_block_mask(spark, sf_dir):
    return P.table(spark, sf_dir, "pages").select("page_id", F.size(script_bodies("html")).alias("bodies"), F.array_join(script_bodies("html"), "\n").alias("code"))


_PAGE = "'<p>' || p_name || '</p>' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '<%@ Page Language=\"VB\" %>' WHEN 1 THEN '<%@ language=''C#''%>' ELSE '' END || '<%= Run(' || p_partkey || ') %><script runat=\"server\">x()</script><script>y()</script>'"
_HIDDEN = "CASE p_partkey % 3 WHEN 0 THEN 25 WHEN 1 THEN 19 ELSE 0 END"


@query(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 3 = 2 AND p_partkey % 2 = 0 THEN 'vb' ELSE 'cs' END AS lang, repeat(' ', 7 + length(p_name)) || chr(10) || repeat(' ', 3 + {_HIDDEN}) || ' Run(' || p_partkey || ') ' || repeat(' ', 2 + 23) || 'x()' || repeat(' ', 9 + 20) AS code FROM part")
def server_code_mask(spark, sf_dir):
    @F.pandas_udf("code string, lang string")
    def read(path: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"code": text.map(server_code), "lang": [language(p, t) for p, t in zip(path, text, strict=True)]})

    path = F.when(F.col("p_partkey") % 2 == 0, "a.ASP").otherwise("a.aspx")
    return P.dealt(P.table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("id"), read(path, F.expr(_PAGE)).alias("r")).select("id", "r.lang", "r.code")


_TOOL = "CASE WHEN event_type IN ('signup', 'purchase') AND event_id % 4 < 3 THEN CASE event_id % 3 WHEN 0 THEN 'scout' WHEN 1 THEN 'auditor' ELSE 'engineer' END WHEN event_id % 5 = 0 THEN NULL ELSE 'shell' END"
_HOOK = "CASE event_type WHEN 'signup' THEN 'BeforeTool' WHEN 'purchase' THEN 'AfterTool' WHEN 'error' THEN NULL ELSE 'Notice' END"
_INPUT = """CASE event_id % 4 WHEN 0 THEN '{"command":"run ' || event_id || '"}' WHEN 1 THEN '{"instruction":"fix ' || event_id || '"}' WHEN 2 THEN '{"k":' || event_id || '}' END"""


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {_TOOL} AS tool, {_HOOK} AS hook, {_INPUT} AS input FROM events),
m AS (SELECT *, coalesce(tool, '') IN ('scout', 'auditor', 'engineer') AS own FROM e),
b AS (SELECT *, own AND coalesce(hook, '') = 'BeforeTool' AS push, own AND coalesce(hook, '') = 'AfterTool' AS pop FROM m),
s AS (SELECT *, sum(CASE WHEN push THEN 1 WHEN pop THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM b),
a AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) AS upto FROM s),
h AS (SELECT *, CASE WHEN pop THEN coalesce(lag(upto) OVER (PARTITION BY user_id ORDER BY event_id), 0) ELSE upto END AS high FROM a)
SELECT event_id AS seq, coalesce(tool, hook, 'unknown') AS category,
  CASE WHEN high = 0 THEN 'CLI' ELSE last_value(CASE WHEN push THEN tool END IGNORE NULLS) OVER (PARTITION BY user_id, high ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS agent,
  greatest(high - CASE WHEN own AND hook IS NOT NULL THEN 1 ELSE 0 END, 0)::BIGINT AS depth,
  CASE event_id % 4 WHEN 0 THEN '$ run ' || event_id WHEN 1 THEN 'Replace: fix ' || event_id WHEN 2 THEN input ELSE CASE WHEN event_type = 'error' THEN '{{"event":"ERROR"}}' ELSE '' END END AS summary,
  event_type = 'error' AS is_error FROM h""")
def trace_events(spark, sf_dir):
    given = lambda k, x, q: f"""coalesce(concat(',"{k}":{q}', {x}, '{q}'), '')"""
    line = f"""concat('{{"at":0', {given("hook_event_name", _HOOK, '"')}, {given("tool_name", _TOOL, '"')}, {given("tool_input", _INPUT, "")}, if(event_type = 'error', ',"data":{{"event":"ERROR"}}', ''), '}}')"""
    broken = "'{\"hook_event_name\": \"BeforeTool\", '"
    events = P.dealt(P.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id")
    lines = events.selectExpr("user_id as session", "event_id as seq", f"explode(if(event_id % 7 = 0, array({line}, {broken}), array({line}))) as value")
    return trace.read_trace(lines).select("seq", "category", "agent", "depth", "summary", "is_error")


@query("""WITH m AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS msg, turn, role, text FROM conversations),
a AS (SELECT * FROM m WHERE role <> 'user'), t AS (SELECT * FROM a WHERE turn % 3 = 1), c AS (SELECT * FROM a WHERE turn % 4 = 1)
SELECT session, msg, type, category, summary, agent, depth::BIGINT AS depth, is_error FROM (
SELECT session, msg, 'user' AS type, 'USER' AS category, text AS summary, 'User' AS agent, 0 AS depth, false AS is_error FROM m WHERE role = 'user'
UNION ALL SELECT session, msg, 'thought', 'THOUGHT', 'think ' || turn, 'model', 1, false FROM t
UNION ALL SELECT session, msg, 'thought', 'THOUGHT', 'Reasoning', 'model', 1, false FROM t
UNION ALL SELECT session, msg, 'tool', 'read_file', 'Read: f' || turn, 'model', 1, false FROM c
UNION ALL SELECT session, msg, 'tool', 'list', '{"depth":"' || turn || '"}', 'model', 1, false FROM c
UNION ALL SELECT session, msg, 'tool_result', 'RESULT', 'Tool Finished', 'System', 2, false FROM c
UNION ALL SELECT session, msg, 'tool_result', 'ERROR', 'Tool Failed', 'System', 2, true FROM c
UNION ALL SELECT session, msg, 'assistant', 'RESPONSE', text, 'model', 0, false FROM a WHERE text <> '')""")
def session_events(spark, sf_dir):
    thoughts = "if(x.turn % 3 = 1, array(named_struct('subject', concat('think ', x.turn), 'description', 'd'), named_struct('subject', '', 'description', 'e')), null)"
    calls = """if(x.turn % 4 = 1, array(named_struct('name', 'read_file', 'args', map('file_path', concat('f', x.turn)), 'result', array(named_struct('status', 'ok'), named_struct('status', 'error'))),
        named_struct('name', 'list', 'args', map('depth', cast(x.turn as string)), 'result', cast(array() as array<struct<status:string>>))), null)"""
    message = f"named_struct('type', if(x.role = 'user', 'user', 'model'), 'content', x.text, 'thoughts', {thoughts}, 'toolCalls', {calls})"
    rows = P.table(spark, sf_dir, "conversations").selectExpr("conv_id as session", "struct(turn, role, text) as x")
    messages = rows.groupBy("session").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    docs = messages.selectExpr("session", f"to_json(struct(transform(xs, x -> {message}) as messages)) as value")
    return trace.read_session(docs).select("session", F.col("msg").cast("long").alias("msg"), "type", "category", "summary", "agent", "depth", "is_error")


@query("SELECT count(*) FILTER (WHERE contains(lower(concat_ws(' ', role, text)), 'assistant the')) AS shown, count(*) AS total FROM conversations")
def trace_found(spark, sf_dir):
    return trace.found(P.table(spark, sf_dir, "conversations"), "Assistant THE", "role", "text")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'trace' WHEN event_id % 3 = 1 THEN 'session' END AS kind, count(*) AS n FROM events GROUP BY 1")
def trace_kind(spark, sf_dir):
    content = """CASE event_id % 3 WHEN 0 THEN concat('\n{"tool_name":"x","n":', event_id, '}\n{broken') WHEN 1 THEN concat('{\n"messages": [', event_id, ']}') ELSE concat('{"n":', event_id, '}') END"""
    return P.table(spark, sf_dir, "events").select(trace.kind_of(F.expr(content)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(concat_ws(' ', role, text)), 'assistant the')")
def trace_search(spark, sf_dir):
    return trace.search(P.table(spark, sf_dir, "conversations"), "Assistant the", "role", "text").select("conv_id", "turn")


@query("SELECT 'c0ffee' AS commit")
def graph_state(spark, sf_dir):
    return P.graph(spark, sf_dir).status()


@query(f"WITH {_G} SELECT label, id, count(*) AS n FROM (SELECT label, name AS id FROM nodes WHERE name IS NOT NULL) GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return upsert.duplicate_ids(P.graph(spark, sf_dir).nodes.where("name is not null").selectExpr("label", "name as id"))


def _found_sql(sample: Sample) -> str:
    """What a reader of the language expects in the sample's files, one for each part."""
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(map(quoted, x))})" for x in expected(sample))
    return f"SELECT kind, label, replace(id, '{{k}}', p_partkey::VARCHAR) AS id, replace(target, '{{k}}', p_partkey::VARCHAR) AS target FROM part, (VALUES {rows}) v(kind, label, id, target)"


def _files(spark: SparkSession, sf_dir: str, sample: Sample) -> DataFrame:
    """The sample's file for every part: path and content."""
    k = F.col("p_partkey").cast("string")
    return P.dealt(P.table(spark, sf_dir, "part").select("p_partkey")).select(F.replace(F.lit(sample.path), F.lit("{k}"), k).alias("path"), F.replace(F.lit(sample.text), F.lit("{k}"), k).cast("binary").alias("content"))


for _n, _sample in SAMPLES.items():
    query(_found_sql(_sample), f"extract_{_n}")(lambda spark, sf_dir, x=_sample: extract(_files(spark, sf_dir, x), ("kind", "label", "id", "dst")).withColumnRenamed("dst", "target"))


@query("""SELECT suffix, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.vb' WHEN 2 THEN '.JAVA' ELSE '.txt' END AS suffix, p_partkey % 3 AS bad FROM part) WHERE suffix IN ('.java', '.vb') AND bad > 0 GROUP BY 1""")
def extract_file(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, (".java", ".vb", ".JAVA", ".txt"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = P.dealt(P.table(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.lit("f/x"), "p_partkey", suffix).alias("path"), F.when(F.col("p_partkey") % 3 > 0, F.lit("class A")).cast("binary").alias("content"))
    return extract(files, ("label", "id")).where("label = 'File'").groupBy(F.regexp_extract("id", r"(\.[^.]*)$", 1).alias("suffix")).agg(F.count("*").alias("n"))


_KM_STEP = """a{n} AS (SELECT id, cluster FROM (SELECT v.id, c{n}.cluster, row_number() OVER (PARTITION BY v.id ORDER BY 1 - COS, c{n}.cluster) AS r FROM v, c{n}) WHERE r = 1),
p{n} AS (SELECT cluster, unnest(b) AS x, generate_subscripts(b, 1) AS dim FROM a{n} JOIN v USING (id)),
m{n} AS (SELECT cluster, list(x ORDER BY dim) AS moved FROM (SELECT cluster, dim, avg(x) AS x FROM p{n} GROUP BY ALL) GROUP BY cluster),
c{m} AS (SELECT c{n}.cluster, coalesce(moved, a) AS a FROM c{n} LEFT JOIN m{n} USING (cluster))""".replace("COS", _COSINE)


@query("WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS b FROM embeddings), c0 AS (SELECT id::INTEGER AS cluster, b AS a FROM v WHERE id < 10), " + ", ".join(_KM_STEP.format(n=n, m=n + 1) for n in range(4)) + " SELECT * FROM a3")
def kmeans_lloyd_4(spark, sf_dir):
    return vectors.lloyd(*_lloyd(spark, sf_dir), max_iter=4)


@query(f"SELECT p_partkey, regexp_replace(regexp_extract({P._FILE}, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, '.x' AS ext, 'lib/' || p_type AS joined, CASE WHEN length(p_name) > 10 THEN p_name[1:10] || '..' ELSE p_name END AS cut FROM part")
def path_parts(spark, sf_dir):
    rows = P.table(spark, sf_dir, "part").selectExpr("p_partkey", "p_type", "p_name", f"{P._FILE} as f")
    return rows.select("p_partkey", path_stem("f").alias("stem"), path_ext("f").alias("ext"), path_join(F.lit("lib/core"), F.concat(F.lit("./../"), "p_type")).alias("joined"), cut_bytes("p_name", 10, "..").alias("cut"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN 1.0 ELSE length(p_name)::DOUBLE END AS size, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 100.0 END AS most FROM part")
def embed_batches(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 7 == 1, "").otherwise(F.col("p_name"))
    rows = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    sized = vectors.embed_column(rows, "text", lambda texts: [[float(len(t)), 100.0 if len(texts) <= 100 else 0.0] for t in texts])
    return sized.select("id", F.get("embedding", F.lit(0)).cast("double").alias("size"), F.get("embedding", F.lit(1)).cast("double").alias("most"))


_DESCRIBED = "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'code of ' || p_name END"


@query(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE replace(p_name, ' ', ',') END AS features, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '// Atomic features: ' || replace(p_name, ' ', ', ') || chr(10) || {_DESCRIBED} END AS shown FROM part")
def describe_functions(spark, sf_dir):
    rows = P.table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_name as name", f"{_DESCRIBED} as content")
    return intent.describe(rows).select("id", F.array_join("atomic_features", ",").alias("features"), intent.snippet().alias("shown"))


@query("""WITH s AS (SELECT 'feat-' || n_name AS feature, 'part:' || p_partkey AS id, p_name, row_number() OVER (PARTITION BY n_name ORDER BY 'part:' || p_partkey) AS r FROM part JOIN nation ON p_partkey % 20 = n_nationkey)
SELECT 'feat-' || n_name AS id, CASE WHEN n_nationkey < 10 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey < 10 THEN (SELECT string_agg(p_name, '; ' ORDER BY id) FROM s WHERE r <= 11 AND feature = 'feat-' || n_name) END AS description FROM nation""")
def enrich_features(spark, sf_dir):
    nation, part = P.table(spark, sf_dir, "nation"), P.table(spark, sf_dir, "part")
    features = nation.selectExpr("concat('feat-', n_name) as id", "n_name as name")
    pairs = part.join(nation, F.col("p_partkey") % 20 == F.col("n_nationkey")).selectExpr("concat('feat-', n_name) as feature", "concat('part:', p_partkey) as id", "p_name as content", "cast(null as array<string>) as atomic_features")
    low = [r[0] for r in nation.where("n_nationkey < 10").select("n_name").collect()]

    def summarise(name, snippets):
        if name not in low:
            raise ValueError("no answer")
        return {"name": name.lower(), "description": "; ".join(snippets)}

    return intent.enrich(features, intent.feature_samples(pairs), summarise).drop("embedding")


@query(f"""WITH {_G}, {_PLACED}, c AS (SELECT *, CASE WHEN id LIKE '%1' THEN 'one' ELSE 'rest' END AS category FROM placed)
SELECT DISTINCT 'domain-' || domain AS src, 'cat-' || category AS dst, 'PARENT_OF' AS type FROM c
UNION ALL SELECT DISTINCT 'cat-' || category, 'feat-' || cluster, 'PARENT_OF' FROM c UNION ALL SELECT DISTINCT id, 'feat-' || cluster, 'IMPLEMENTS' FROM c""")
def category_build_edges(spark, sf_dir):
    placed = _placed(spark, sf_dir).withColumn("category", F.when(F.endswith("id", F.lit("1")), "one").otherwise("rest"))
    return intent.hierarchy(placed)[1]


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type END AS name FROM part")
def parse_replies(spark, sf_dir):
    reply = """CASE p_partkey % 3 WHEN 0 THEN concat('```json\n', to_json(named_struct('name', p_name)), '\n```') WHEN 1 THEN to_json(named_struct('name', p_type)) ELSE p_name END"""
    return P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), intent.parse_reply(F.expr(reply), "name string")["name"].alias("name"))


@query("""SELECT 'node' AS kind, 'part:' || p_partkey AS id, p_name AS value FROM part UNION ALL SELECT 'edge', 'part:' || p_partkey, 'supp:' || (p_partkey % 10) FROM part""")
def graph_lines_round_trip(spark, sf_dir):
    part = P.table(spark, sf_dir, "part")
    path = shared_folder(spark)
    write_graph(part.selectExpr("concat('part:', p_partkey) as id", "'Function' as label", "map('name', p_name, 'id', 'own') as props"), part.selectExpr("concat('part:', p_partkey) as src", "concat('supp:', p_partkey % 10) as dst", "'CALLS' as type"), path)
    lines = spark.read.text(path)
    nodes = nodes_of(lines).select(F.lit("node").alias("kind"), "id", F.try_element_at("props", F.lit("name")).alias("value"))
    return nodes.unionByName(edges_of(lines).select(F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("value")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS props_name FROM part WHERE p_partkey % 5 <> 0")
def function_lines(spark, sf_dir):
    line = """if(p_partkey % 5 = 0, '{"type":"File","id":0}', to_json(named_struct('id', p_partkey, 'type', 'Function', 'name', if(p_partkey % 2 = 0, p_name, null))))"""
    return functions_of(P.table(spark, sf_dir, "part").selectExpr(f"{line} as value")).select(F.col("id").cast("long").alias("id"), F.try_element_at("props", F.lit("name")).alias("props_name"))
