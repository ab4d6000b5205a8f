import random
from itertools import product

import pytest

from grafloom.functions.text import cut_bytes, find_pattern, path_ext, path_join, path_stem, slice_lines
from grafloom.graph import Graph
from grafloom.operators import intent, trace, upsert, vectors
from grafloom.plans.traversal import reachable, trails, trails_recursive
from grafloom.sources import jsonl
from grafloom.sources.tables import load_graph, save_graph

N = "id string, label string, name string, file string, ui_contaminated boolean, risk_score double"
E = "src string, dst string, type string"


def fn(id, name=None, flag=None, risk=None, label="Function", file=None):
    return (id, label, name or id.upper(), file, flag, risk)


def make(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def walk(edges, start, depth, direction):
    """Every trail from start, by depth-first search."""
    out, steps = [], []
    for k, (s, d, _) in enumerate(edges):
        if direction in ("outgoing", "both"):
            steps.append((s, d, k))
        if direction == "incoming" or direction == "both" and s != d:
            steps.append((d, s, k))

    def go(at, used, way):
        if used:
            out.append(tuple(way))
        if len(used) < depth:
            for s, d, k in steps:
                if s == at and k not in used:
                    go(d, [*used, k], [*way, d])

    go(start, [], [start])
    return sorted(out)


def test_trails_and_reachability_match_search(spark):
    r = random.Random(5)
    for seed, (direction, depth) in enumerate(product(("outgoing", "incoming", "both"), (1, 3, 4))):
        names = "abcdef"
        edges = sorted({(r.choice(names), r.choice(names), r.choice(("X", "Y"))) for _ in range(9)})
        df = spark.createDataFrame(edges, E)
        start = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
        want = walk(edges, "a", depth, direction)
        got = sorted(tuple(x["node_ids"]) for x in trails(df, start, None, direction, depth).collect())
        assert got == want, (seed, direction, depth)
        if direction != "both":
            assert {x["id"] for x in reachable(df, start, None, direction, depth).collect()} == {w[-1] for w in want}
        if depth == 3:
            assert sorted(tuple(x["node_ids"]) for x in trails_recursive(spark, df, start, None, direction, depth).collect()) == want


def test_depth_limits(spark):
    edges, start = spark.createDataFrame([("a", "b", "X")], E), spark.createDataFrame([("a",)], "id string")
    assert trails(edges, start, depth=0).count() == 0 and reachable(edges, start, depth=0).count() == 0
    assert trails(edges, start, depth=0, least=0).count() == 1
    for bad in (lambda: trails(edges, start, depth=7), lambda: reachable(edges, start, depth=-1), lambda: reachable(edges, start, direction="both")):
        with pytest.raises(ValueError):
            bad()


def test_callers_impact_and_names(spark):
    nodes = [fn("a", "A", True), fn("b", "SAME", None), fn("c", "SAME", False), fn("SAME", "D"), fn("e", "SAME", False)]
    g = make(spark, nodes, [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("e", "c", "CALLS"), ("c", "SAME", "CALLS"), ("a", "c", "USES"), ("SAME", "SAME", "CALLS")])
    assert rows(g.callers("SAME")) == [("A",), ("D",), ("SAME",)]
    assert rows(g.impact("c", 1)) == [("SAME", False), ("SAME", False)]  # distinct before nulls are filled
    assert rows(g.impact("c", 2)) == [("A", True), ("SAME", False), ("SAME", False)]
    assert rows(g.impact("nobody", 3)) == []
    with pytest.raises(LookupError):
        g.require("nobody")


def test_neighbors_keep_every_way(spark):
    nodes = [fn("s", "S"), fn("m", "M1"), fn("n", "M2"), fn("g", "G", label="Global", file="g.c"), fn("k", "K", label="Class")]
    edges = [("s", "m", "CALLS"), ("s", "n", "CALLS"), ("m", "g", "USES_GLOBAL"), ("n", "g", "USES_GLOBAL"), ("s", "g", "USES_GLOBAL"), ("k", "s", "HAS_METHOD"), ("s", "k", "USES")]
    g = make(spark, nodes, edges)
    got = rows(g.neighbors("S", 2))
    assert [r for r in got if r[1] == "Global"] == [("G", "Global", ["G"]), ("G", "Global", ["M1", "G"]), ("G", "Global", ["M2", "G"])]
    assert [r for r in got if r[1] != "Global"] == [("K", "Class", None), ("M1", "Function", None), ("M2", "Function", None)]
    assert ("G", "Global", ["G"]) in rows(g.neighbors("k", 0))
    assert rows(g.globals_used("s")) == [("G", "g.c")]


def test_seams_order_nulls_first_and_match_whole(spark):
    nodes = [fn("bad", flag=True), fn("f", label="File", file="src/a.x"), *(fn(f"c{i}", flag=False, risk=None if i == 3 else float(i)) for i in range(22)), fn("u", flag=None, risk=99.0)]
    edges = [("bad", n[0], "CALLS") for n in nodes if n[0][0] in "cu"] + [(n[0], "f", "DEFINED_IN") for n in nodes if n[0][0] in "cu"]
    g = make(spark, nodes, edges)
    found = [tuple(r) for r in g.seams("src/.*").collect()]
    assert len(found) == 20 and found[0] == ("C3", "src/a.x", 0.0) and found[1][2] == 21.0
    assert g.seams("a").count() == 0


def test_domain_roles(spark):
    nodes = [fn(x, label="Feature") for x in ("d1", "d2", "f1", "f2", "f3")] + [fn("p"), fn("q", label="Class")]
    edges = [("d1", "f1", "PARENT_OF"), ("d1", "f2", "PARENT_OF"), ("d2", "f1", "PARENT_OF"), ("f1", "f3", "PARENT_OF"), ("p", "f1", "IMPLEMENTS"), ("q", "f1", "IMPLEMENTS")]
    got = {(r["role"], r["id"]) for r in make(spark, nodes, edges).explore_domain("f1").collect()}
    assert got == {("feature", "f1"), ("parent", "d1"), ("child", "f3"), ("sibling", "f2"), ("function", "p")}


def test_stored_graph_and_sources(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Function", "A", "x.c", 2, 3), ("b", "Function", "B", "x.c", None, None), ("c", "Function", "two", None, 1, 0)], "id string, label string, name string, file string, start_line long, end_line long")
    edges, sources = spark.createDataFrame([("a", "b", "CALLS")], E), spark.createDataFrame([("x.c", "one\ntwo\nthree two\nfour")], "path string, text string")
    save_graph(nodes, edges, f"file://{tmp_path}/g", "abc", sources)
    g = load_graph(spark, f"file://{tmp_path}/g", with_sources=True)
    assert rows(g.status()) == [("abc",)] and rows(g.callers("B")) == [("A",)]
    assert rows(g.fetch_source("A")) == [("a", "x.c", "two\nthree two")]
    assert rows(g.fetch_source("b")) == [("b", "x.c", "one\ntwo\nthree two\nfour")]
    for error, bad in ((LookupError, lambda: g.fetch_source("x")), (ValueError, lambda: g.fetch_source("c")), (ValueError, lambda: g.locate_usage("b", "a")), (LookupError, lambda: g.locate_usage("a", "x")), (ValueError, lambda: Graph(nodes, edges).fetch_source("a"))):
        with pytest.raises(error):
            bad()
    assert rows(g.locate_usage("a", "c")) == [(1, 2, "two"), (2, 3, "three two")]
    assert rows(Graph(nodes, edges).status()) == [("",)]
    assert g.find_node("Function", "name", "two").first()["id"] == "c"


def test_upserts(spark):
    p = "seq long, label string, id string, props map<string,string>"
    df = spark.createDataFrame([(1, "L", "x", {"a": "1", "b": "1"}), (2, "L", "x", {"b": "2", "c": "3"}), (3, "L", "x", {"a": None}), (1, "M", "x", {}), (1, "", "y", None), (1, "`Z`", "z", {"k": "v"}), (1, "L", "", {"k": "v"})], p)
    got = {(r["label"], r["id"]): dict(r["props"]) for r in upsert.merge_nodes(df).collect()}
    assert got == {("L", "x"): {"b": "2", "c": "3"}, ("M", "x"): {}, ("Generic", "y"): {}, ("Z", "z"): {"k": "v"}}
    kept = {(r["label"], r["id"]): dict(r["props"]) for r in upsert.merge_nodes(df, null_removes=False).collect()}
    assert kept["L", "x"] == {"a": "1", "b": "2", "c": "3"}
    edges = spark.createDataFrame([("x", "y", ""), ("x", "y", None), ("x", "gone", "T"), ("", "y", "T"), ("z", "x", "T")], E)
    assert rows(upsert.merge_edges(edges, upsert.merge_nodes(df))) == [("x", "y", "RELATED_TO"), ("z", "x", "T")]


def test_json_lines(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in ('{"id":"a","type":"Function","name":"A","n":3,"nested":{"k":1}}', '{"source":"a","target":"b","type":"CALLS","w":1}', "{bad", '{"source":null,"target":"b","id":"q"}', '{"id":"","type":"F"}', "[1]", "")], "value string")
    assert sorted(r["kind"] for r in jsonl.discriminate(lines).collect()) == ["dropped_edge", "dropped_node", "edge", "malformed", "malformed", "malformed", "node"]
    assert rows(jsonl.edges_of(lines)) == [("a", "b", "CALLS")]
    node = jsonl.nodes_of(lines).first()
    assert (node["label"], node["id"], dict(node["props"])) == ("Function", "a", {"name": "A", "n": "3", "nested": '{"k":1}'})
    nodes = spark.createDataFrame([("a", "Field", {"type": "int", "name": "A"})], "id string, label string, props map<string,string>")
    jsonl.write_graph(nodes, jsonl.edges_of(lines), f"file://{tmp_path}/out")
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect()) == ['{"id":"a","name":"A","type":"Field"}', '{"source":"a","target":"b","type":"CALLS"}']


def test_text_functions(spark):
    df = spark.createDataFrame([("1\n2\n3\n4\n5",)], "t string")
    cases = {(1, 5): "1\n2\n3\n4\n5", (2, 4): "2\n3\n4", (3, 3): "3", (4, 10): "4\n5", (10, 15): "", (5, 2): ""}
    for (a, b), want in cases.items():
        assert df.select(slice_lines("t", a, b)).first()[0] == want
    hits = spark.createDataFrame([("x\nfoo\ny\nfoo\nz",)], "t string")
    assert rows(find_pattern(hits, "t", "foo", 0)) == [(1, 2, "foo"), (2, 4, "foo")]
    assert [r[1] for r in rows(find_pattern(hits, "t", "foo", 2, first_line=10))] == [10, 11, 12, 13, 11, 12, 13, 14]
    assert find_pattern(hits, "t", "nope", 1).count() == 0
    paths = spark.createDataFrame([("a/b.test.ts", "../c.h"), (".env", "d"), ("x/y", ".")], "p string, q string")
    assert [tuple(r) for r in paths.select(path_stem("p"), path_ext("p"), path_join("p", "q")).collect()] == [("b.test", ".ts", "a/c.h"), ("", ".env", ".env/d"), ("y", "", "x/y")]
    cut = spark.createDataFrame([("abc",), ("ééé",), (None,)], "t string").select(cut_bytes("t", 3, "...")).collect()
    assert [r[0] for r in cut] == ["abc", "é...", None]


def test_vectors_and_groups(spark):
    v = spark.createDataFrame([(i, [1.0, 0.1 * (i % 2)] if i < 4 else [0.1 * (i % 2), 1.0]) for i in range(8)] + [(8, [0.0, 0.0])], "id long, embedding array<float>")
    groups = {r["id"]: r["cluster"] for r in vectors.kmeans(v, 2, seed=3).collect()}
    assert len({groups[i] for i in range(4)}) == 1 and len({groups[i] for i in range(4, 8)}) == 1 and groups[0] != groups[4] and groups[8] == 0
    assert [vectors.group_count(n) for n in (0, 1, 3, 4, 9, 10, 15, 100)] == [0, 1, 1, 2, 2, 2, 3, 20]
    assert [r["id"] for r in vectors.top_by_cosine(v, [0.9, 0.0], 2).collect()] == [0, 2]
    sound = v.where("id < 8")
    centroids = vectors.seed_centroids(sound, 5, seed=2)
    assert centroids.collect() == vectors.seed_centroids(sound.repartition(3), 5, seed=2).collect() and centroids.count() == 4  # no two alike
    near = rows(vectors.assign(v, centroids))
    assert near == rows(vectors.assign(v, centroids, block=2)) == rows(vectors.assign(v, centroids, block=1)) and (8, 0) in near
    g = Graph(v.selectExpr("cast(id as string) as id", "'Function' as label", "'n' as name", "embedding"), spark.createDataFrame([], E))

    def broken(texts):
        raise OSError("no service")

    assert g.search_similar([1.0, 0.0], 3).columns[-1] == "score" and [r["id"] for r in g.search_similar([1.0, 0.0], 3).collect()] == ["0", "2", "1"]
    assert g.hybrid_context("0", broken).count() == 0 and g.hybrid_context("0", [1.0, 0.0], limit=2).count() == 2
    calls = []

    def embedder(texts):
        calls.append(len(texts))
        return [[float(len(t))] for t in texts]

    texts = spark.createDataFrame([(i, None if i == 3 else "x" * (i % 5)) for i in range(250)], "id long, t string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in vectors.embed_column(texts, "t", embedder).collect()}
    assert got[0] == [1.0] and got[2] == [2.0] and got[3] is None and len(got) == 250


def test_intent_layer(spark, tmp_path):
    functions = spark.createDataFrame([("1", "parseInput", "internal/auth/login.go", "code a", []), ("2", "B", "internal/pay/bill.go", None, ["pays"])], "id string, name string, file string, content string, atomic_features array<string>")
    for d in ("internal/auth", "internal/pay", "pkg/util"):
        (tmp_path / d).mkdir(parents=True)
    assert intent.discover_domains(str(tmp_path)) == {"auth": "internal/auth", "pay": "internal/pay", "util": "pkg/util"}
    assert intent.discover_domains(str(tmp_path / "none")) == {"root": ""}
    from pyspark.sql import functions as F

    placed = intent.members(functions, intent.domains_of(functions)).withColumn("cluster", intent.file_cluster("file"))
    nodes, edges = intent.hierarchy(placed)
    assert nodes.count() == 4 and sorted(r["type"] for r in edges.collect()) == ["IMPLEMENTS", "IMPLEMENTS", "PARENT_OF", "PARENT_OF"]
    nodes3, edges3 = intent.hierarchy(placed.withColumn("category", F.col("domain")))
    assert nodes3.count() == 6 and edges3.where("type = 'PARENT_OF'").count() == 4
    samples = intent.feature_samples(placed.select(F.concat(F.lit("feat-"), "cluster").alias("feature"), "id", "content", "atomic_features"))
    rich = {r["id"]: r for r in intent.enrich(nodes, samples, embedder=vectors.hash_embedder(8)).collect()}
    assert rich["feat-bill"]["name"] == "atomic features" and len(rich["feat-bill"]["embedding"]) == 8 and rich["domain-auth"]["description"] is None
    assert [r["atomic_features"] for r in intent.describe(functions).orderBy("id").collect()] == [["parse", "input"], []]
    assert intent.semantic_clusters(placed, vectors.hash_embedder(8)).select("cluster").distinct().count() == 2
    reply = spark.createDataFrame([('```json\n{"name":"N"}\n```',), ('{"name":"M"}',), ("no",)], "r string").select(intent.parse_reply(F.col("r"), "name string")["name"]).collect()
    assert [r[0] for r in reply] == ["N", "M", None]


def test_traces(spark):
    steps = [(1, "AfterTool", "scout"), (2, "BeforeTool", "scout"), (3, "BeforeTool", "auditor"), (4, "Notice", "ls"), (5, "AfterTool", "auditor"), (6, None, "scout"), (7, "AfterTool", "scout"), (8, "AfterTool", "scout"), (9, "BeforeTool", "engineer")]
    df = spark.createDataFrame([("s", *e) for e in steps], "session string, seq long, hook string, tool string")
    got = trace.agent_at(df, "session", ["seq"], "hook", "tool").orderBy("seq").collect()
    assert [r["depth"] for r in got] == [0, 0, 1, 2, 1, 1, 0, 0, 0]
    assert [r["agent"] for r in got] == ["CLI", "scout", "auditor", "auditor", "auditor", "scout", "scout", "CLI", "engineer"]
    lines = [
        '{"hook_event_name":"BeforeTool","tool_name":"scout","tool_input":{"command":"ls","x":"1"},"timestamp":"2024-01-01T00:00:00Z"}', "{x", "", "[1]",
        '{"tool_name":"replace","tool_input":{"instruction":"swap","x":"1"},"data":{"x":"2","error":"e"},"tool_response":"done"}',
        '{"hook_event_name":"Stop","data":{"hook_event_name":"AfterTool","tool_name":"scout"},"event":"ERROR"}', '{"other":1}',
    ]
    rows_ = trace.read_trace(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, seq long, value string")).orderBy("seq").collect()
    assert [(r["seq"], r["category"], r["agent"], r["depth"], r["summary"], r["is_error"]) for r in rows_] == [
        (0, "scout", "scout", 0, "$ ls", False), (4, "replace", "scout", 1, "Replace: swap", True),
        (5, "scout", "scout", 0, '{"hook_event_name":"AfterTool","tool_name":"scout"}', True), (6, "unknown", "CLI", 0, "", False),
    ]
    import json

    assert json.loads(rows_[1]["details"]) == {"instruction": "swap", "x": "2", "error": "e", "response": "done"} and rows_[0]["ts"] is not None
    doc = '{"messages":[{"type":"user","content":"hi"},{"type":"model","content":"done","thoughts":[{"subject":"s","description":"d"},{}],"toolCalls":[{"name":"run_shell_command","args":{"command":"ls"},"result":[{"functionResponse":{"response":{"error":"no"}}},{"ok":1}]}]},{"type":"info","content":"x"}]}'
    chat = trace.read_session(spark.createDataFrame([("c", doc)], "session string, value string")).orderBy("msg", "part", "pos").collect()
    assert [(r["type"], r["summary"], r["depth"]) for r in chat] == [("user", "hi", 0), ("thought", "s", 1), ("thought", "Reasoning", 1), ("tool", "$ ls", 1), ("tool_result", "Tool Failed", 2), ("tool_result", "Tool Finished", 2), ("assistant", "done", 0)]
    kinds = spark.createDataFrame([(x,) for x in (lines[0] + "\n{x", " \n" + lines[0], doc, '{"a":1}', "", None)], "c string").select(trace.kind_of("c")).collect()
    assert [r[0] for r in kinds] == ["trace", "trace", "session", None, None, None]


def test_settings(tmp_path, monkeypatch):
    from grafloom.settings import load

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".env").write_text("# c\nGRAFLOOM_GRAPH='file:///g'\nexport GRAFLOOM_SOURCES=/s\nbroken\n")
    monkeypatch.delenv("GRAFLOOM_GRAPH", raising=False)
    monkeypatch.setenv("GRAFLOOM_SOURCES", "/mine")
    assert load(str(tmp_path / "a" / "b")) == {"graph": "file:///g", "sources": "/mine", "limit": ""}


def test_incremental_upserts(spark, tmp_path):
    from grafloom.streaming.incremental import Upserter, follow

    source = tmp_path / "in"
    source.mkdir()
    folder = f"file://{tmp_path}/graph"
    (source / "1.jsonl").write_text('{"id":"a","type":"F","k":"1"}\n{"id":"b","type":"F"}\n{"source":"a","target":"b","type":"CALLS"}\n{"source":"a","target":"c","type":"CALLS"}\n')
    follow(spark, str(source), folder).awaitTermination(120)
    (source / "2.jsonl").write_text('{"id":"a","type":"F","k":"2"}\n{"id":"c","type":"F"}\n{"source":"c","target":"a","type":"CALLS"}\n')
    follow(spark, str(source), folder).awaitTermination(120)
    tables = Upserter(folder)
    assert rows(tables.edges(spark)) == [("a", "b", "CALLS"), ("c", "a", "CALLS")]
    assert {r["id"]: dict(r["props"]) for r in tables.nodes(spark).collect()} == {"a": {"k": "2"}, "b": {}, "c": {}}


def test_sessions_are_read_once(spark, sf_dir):
    from grafloom.queries import queries

    plan = queries()["session_events"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_traces_are_read_once(spark, sf_dir):
    from grafloom.queries import queries

    plan = queries()["trace_events"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(user_id") == 1 and plan.count("Exchange") == 1
