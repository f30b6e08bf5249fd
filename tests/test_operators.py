"""Operators on literal rows and against plain Python."""

import hashlib
import random
from collections import OrderedDict

import pytest
from lodestrata.functions import paths, scoring, text
from lodestrata.functions.embedding import embed, vector
from lodestrata.operators import graph, integrity, navigation, search, sequential
from lodestrata.sources import audit, ingest, parsers, repository, store
from lodestrata.streaming import rolling
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scores(spark):
    assert one(spark, scoring.recency(F.lit(30.0), 30.0)) == pytest.approx(0.5)
    assert one(spark, scoring.recency(F.lit(-1.0), 30.0)) == 1 and one(spark, scoring.recency(F.lit(1.0), 0)) == 0
    assert one(spark, scoring.saturating(F.lit(4), 16)) == 0.5 and one(spark, scoring.saturating(F.lit(99), 16)) == 1
    for name, weight in scoring.RELEVANCE.items():
        values = {k: F.lit(1.0 if k == name else 0.0) for k in scoring.RELEVANCE}
        assert one(spark, scoring.weighted(values, scoring.RELEVANCE)) == pytest.approx(weight)
    with pytest.raises(ValueError, match="sum"):
        scoring.weighted({"a": F.lit(1.0)}, {"a": 0.5})
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, scoring.cosine(vec(1, 0), vec(0, 0))) == 0 and one(spark, scoring.cosine(vec(1, 1), vec(2, 2))) == pytest.approx(1)
    assert one(spark, scoring.cosine(vec(1), vec(1, 2))) is None
    for items in ([], ["graph"], ["graph", "vector"]):
        column = F.array(*map(F.lit, items)).cast("array<string>")
        assert one(spark, scoring.list_repr_length(column)) == len(str(items))
    assert [one(spark, scoring.pressure(F.lit(q), F.lit(0.0))) for q in (0.5, 0.8, 1.3, 1.6)] == [0, 1, 2, 3]
    assert [one(spark, scoring.backoff_ms(F.lit(k))) for k in range(3)] == [50, 100, 200]
    assert [one(spark, scoring.severity(F.lit(x))) for x in (0.01, 0.05, 0.2, 0.5)] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_paths(spark):
    name = lambda p: one(spark, paths.module_name(F.lit(p)))
    for p in ("a/b.py", "a/__init__.py", "__init__.py", "src/index.ts", "x/mod.rs", "docs/guide.md"):
        assert name(p) == parsers.module_name(p)
    assert one(spark, paths.normal_url(F.lit("git@host.org:team/Repo.git"))) == one(spark, paths.normal_url(F.lit("https://host.org/team/repo/"))) == "host.org/team/repo"
    assert one(spark, paths.slug(F.lit(" Hello, World! "))) == "hello-world"
    assert one(spark, paths.one_line(F.lit("\n  \n first \nnext"))) == "first"
    assert not one(spark, paths.is_relevant(F.lit("a/node_modules/b.js"))) and one(spark, paths.is_doc(F.lit("A.MD")))


def test_text(spark):
    assert one(spark, text.canonical_json(F.lit('{"b": 1, "a": "é"}'))) == '{"a":"é","b":1}'
    assert one(spark, text.canonical_json(F.lit("nope"))) is None
    assert one(spark, text.cut_at_line(F.lit("ab\ncdefgh"), 1)) == "ab" and one(spark, text.cut_at_line(F.lit("abcdefgh"), 1)) == "abcd"
    got = one(spark, text.compact(F.create_map(*map(F.lit, ["a", "", "b", "0", "c", "x"])), drop_zero=True))
    assert got == {"c": "x"}


def test_pack_greedy_passes_over_what_does_not_fit(spark):
    rnd = random.Random(1)
    entries = [(r, i, rnd.randint(1, 40)) for r in range(5) for i in range(30)]
    frame = spark.createDataFrame(entries, "request int, i int, cost long")
    got = {}
    for row in search.pack_greedy(frame, "request", [F.col("i")], "cost", 100).collect():
        got.setdefault(row.request, []).append((row.place, row.i))
    for r in range(5):
        used, want = 0, []
        for q, i, c in entries:
            if q == r and used + c <= 100:
                used += c
                want.append((len(want) + 1, i))
        assert sorted(got[r]) == want


def test_wildcards(spark):
    names = spark.createDataFrame([("a_b",), ("axb",), ("A%B",)], "qualified_name string")
    assert names.filter(search.keyword_match("a_b", "qualified_name")).count() == 3
    assert [r[0] for r in names.filter(search.plain_match("a_b", "qualified_name")).collect()] == ["a_b"]


def test_vector_kinds_filter_after_the_cut(spark):
    rows = [(i, "x" if i % 2 else "y", [1.0, i / 10]) for i in range(10)] + [(99, "x", [0.0, 0.0]), (98, "x", None)]
    frame = spark.createDataFrame(rows, "unit_id int, kind string, vector array<float>")
    assert [r.unit_id for r in search.cosine_top_k(frame, [1.0, 0.0], 4, ["x"]).collect()] == [1, 3]
    assert search.cosine_top_k(frame, [0.0, 0.0], 4).count() == 0


@pytest.fixture(scope="module")
def small_graph(spark):
    edges = spark.createDataFrame([("f1", "CALLS", "f2"), ("f2", "CALLS", "f3"), ("f3", "CALLS", "x"), ("x", "CALLS", "f4"), ("f1", "IMPORTS", "m")], "src_id string, kind string, dst_id string")
    nodes = spark.createDataFrame([(n, "External" if n == "x" else "Function") for n in ("f1", "f2", "f3", "f4", "x", "m")], "node_id string, kind string")
    return nodes, edges


def test_searches(spark, small_graph):
    nodes, edges = small_graph
    start = lambda *n: spark.createDataFrame([(x,) for x in n], "node_id string")
    ids = lambda df: {(r.node_id, r.depth) for r in df.collect()}
    assert ids(graph.neighbours(edges, start("f1"), 1, ["CALLS"])) == {("f2", 1)}
    assert ids(graph.neighbours(edges, start("f3"), 3)) == {("f2", 1), ("x", 1), ("f1", 2), ("f4", 2), ("m", 3)}
    assert ids(graph.graph_candidates(edges, nodes, start("f2", "x"), 3)) == {("f2", 0), ("x", 0), ("f1", 1), ("f3", 1), ("f4", 1), ("m", 2)}
    assert ids(graph.directed(edges, start("f3"), "CALLS", "in", 5)) == {("f2", 1), ("f1", 2)}


def test_edge_checks(spark, small_graph):
    nodes, edges = small_graph
    more = edges.union(spark.createDataFrame([("f1", "CALLS", "gone"), ("f1", "CALLS", "f1"), ("f1", "CONTAINS", "f2")], edges.schema))
    got = {(r.kind, r.dst_id): r.issue for r in graph.validate(more, nodes).collect()}
    assert got[("CALLS", "gone")] == "orphan" and got[("CALLS", "f1")] == "self_edge" and got[("CONTAINS", "f2")] == "edge_rule"
    assert ("CALLS", "f2") not in got


def requests(spark, seed=2):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(4), rnd.randrange(10**8), i) for i in range(400)]
    return rows, spark.createDataFrame([(u, u % 2, at, i, f"t{i}") for u, at, i in rows], "user_id long, shard long, at_us long, event_id long, event_type string")


def test_token_bucket(spark):
    rows, frame = requests(spark)
    got = {r.event_id: r.ok for r in sequential.token_bucket(frame, "user_id", 0.5, 3.0).collect()}
    state, want = {}, {}
    for u, at, i in sorted(rows):
        tokens, last = state.get(u, (3.0, at))
        tokens = min(3.0, tokens + (at - last) / 1e6 * 0.5)
        want[i] = tokens >= 1
        state[u] = (tokens - want[i], at)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_cache_trace(spark):
    rows, frame = requests(spark)
    got = {r.shard: (r.hits, r.misses) for r in sequential.cache_trace(frame, "shard", F.col("event_id") % 7, 3, 5.0).collect()}
    caches, want = {}, {}
    for u, at, i in sorted(rows, key=lambda r: (r[0] % 2, r[1], r[2])):
        cache, (h, m) = caches.setdefault(u % 2, OrderedDict()), want.get(u % 2, (0, 0))
        k = i % 7
        if k in cache and at - cache[k] <= 5e6:
            cache.move_to_end(k)
            want[u % 2] = (h + 1, m)
            continue
        cache.pop(k, None)
        cache[k] = at
        if len(cache) > 3:
            cache.popitem(last=False)
        want[u % 2] = (h, m + 1)
    assert got == want


def test_audit_chain_shows_tampering(spark, tmp_path):
    _, frame = requests(spark)
    chain = sequential.audit_chain(frame)
    assert sequential.verify_chain(chain).filter("n_broken > 0").count() == 0
    bad = chain.withColumn("payload", F.when((F.col("user_id") == 1) & (F.col("seq") == 3), "{}").otherwise(F.col("payload")))
    assert [(r.user_id, r.n_broken) for r in sequential.verify_chain(bad).filter("n_broken > 0").collect()] == [(1, 1)]
    audit.append(chain.select("user_id", "payload"), f"{tmp_path}/log")
    assert audit.replay(spark, f"{tmp_path}/log", "user_id long, payload string").count() == 400


def test_reconcile(spark):
    schema = "unit_id string, source_sha string, line int, repo_id string, file_path string"
    old = spark.createDataFrame([("a", "1", 1, "r", "p"), ("b", "1", 2, "r", "p"), ("c", "1", 3, "r", "q")], schema)
    new = spark.createDataFrame([("a", "1", 9, "r", "p"), ("b", "2", 8, "r", "p"), ("d", "1", 7, "r", "p")], schema)
    got = {r.unit_id: (r.state, r.line) for r in store.reconcile(old, new, "unit_id", "source_sha").collect()}
    # An equal digest keeps the old line numbers.
    assert got == {"a": ("unchanged", 1), "b": ("updated", 8), "c": ("obsolete", 3), "d": ("inserted", 7)}
    assert {r.unit_id for r in store.delete_files(old, spark.createDataFrame([("r", "p")], "repo_id string, file_path string")).collect()} == {"c"}
    with pytest.raises(ValueError, match="dimension"):
        store.with_placeholders(old, 0)


def test_parsers():
    units = parsers.parse_python("pkg/a.py", 'import os\nfrom .b import c\nLIMIT = 3\nclass A(Base):\n    """Doc."""\n    def f(self):\n        return os.path.join(g())\ndef g(): pass\n')
    assert [(u["kind"], u["qualified_name"]) for u in units] == [("module", "pkg.a"), ("constant", "pkg.a.LIMIT"), ("class", "pkg.a.A"), ("method", "pkg.a.A.f"), ("function", "pkg.a.g")]
    assert units[0]["imports"] == [".b", "os"] and units[2]["bases"] == ["Base"] and units[3]["calls"] == ["g", "os.path.join"]
    doc = parsers.parse_document("docs/x.md", "intro\n# One\nbody [l](../a.md#s) [w](http://x/y.md)\n```\n# no\n```\n## Two\n# One\n")
    assert [u["qualified_name"] for u in doc] == ["docs.x", "docs.x.one", "docs.x.one.two", "docs.x.one#2"]
    assert doc[1]["imports"] == ["a"] and doc[0]["docstring"] == "intro"
    go = parsers.parse("s/g.go", 'package s\ntype T struct {\n}\nfunc (t *T) M() {\n}\nfunc F() {}\nconst C = 1\n', "go")
    assert {(u["kind"], u["qualified_name"]) for u in go} == {("module", "s.g"), ("class", "s.g.T"), ("method", "s.g.T.M"), ("function", "s.g.F"), ("constant", "s.g.C")}
    java = parsers.parse("A.java", "import x.Y;\npublic class A extends B {\n  static final int MAX = 1;\n  public void run() {\n  }\n}\n", "java")
    assert {(u["kind"], u["qualified_name"]) for u in java} == {("module", "A"), ("class", "A.A"), ("constant", "A.A.MAX"), ("method", "A.A.run")} and java[0]["imports"] == ["x.Y"]
    rust = parsers.parse("g.rs", "use a::b;\nstruct P;\nimpl P {\n  pub fn new() -> P { P }\n}\nfn free() {}\n", "rust")
    assert {(u["kind"], u["qualified_name"]) for u in rust} >= {("class", "g.P"), ("method", "g.P.new"), ("function", "g.free")}


def test_walk_parse_and_resolve(spark, tmp_path):
    for name, content in {"pkg/__init__.py": b"# package\n", "pkg/empty.py": b"", "pkg/a.py": b"import pkg.b\ndef f():\n    g()\n    pkg.b.h()\n    print()\ndef g(): pass\n", "pkg/b.py": b"def h(): pass\n", "bad.py": b"def (\n", "raw.md": b"\xff\xfe", "node_modules/z.js": b"x", "skip/me.py": b"", "t.d.ts": b"", "README.md": b"# Hi\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    files = repository.walk(spark, f"file://{tmp_path}", "r", ["skip/", "# note", "!skip/keep.py"])
    assert {(r.path, r.valid) for r in files.collect()} == {("pkg/__init__.py", True), ("pkg/empty.py", True), ("pkg/a.py", True), ("pkg/b.py", True), ("bad.py", True), ("raw.md", False), ("README.md", True)}
    units, failed = parsers.units(files)
    assert {r.path for r in failed.collect()} == {"bad.py", "raw.md"}
    edges = {(r.src, r.kind, r.dst) for r in parsers.call_edges(units).collect()}
    assert edges == {("pkg.a", "IMPORTS", "pkg.b"), ("pkg.a.f", "CALLS", "pkg.a.g"), ("pkg.a.f", "CALLS", "pkg.b.h"), ("pkg.a.f", "CALLS", "external:print")}


def test_ingest_a_repository(spark, tmp_path):
    """Walk, parse, graph and vectors in one run, then a second run in which a file lost a unit and another changed."""
    (tmp_path / "pkg").mkdir()
    write = lambda name, content: (tmp_path / name).write_text(content)
    write("pkg/a.py", "import pkg.b\nimport os\nclass A(Base):\n    def f(self):\n        g()\n        pkg.b.h()\ndef g(): pass\nLIMIT = 3\n")
    write("pkg/b.py", "def h(): pass\ndef k(): pass\n")
    write("pkg/c.py", "def z(): pass\n")
    write("bad.py", "def (\n")
    run = lambda stored=None: ingest.ingest(repository.walk(spark, f"file://{tmp_path}", "r"), stored)
    first = run()
    names = {r.node_id: r.qualified_name for r in first.nodes.collect()}
    edges = {(names[r.src_id], r.kind, names[r.dst_id]) for r in first.edges.collect()}
    assert edges >= {("pkg.a", "IMPORTS", "pkg.b"), ("pkg.a", "IMPORTS", "os"), ("pkg.a", "DEFINES", "pkg.a.A"), ("pkg.a.A", "DEFINES", "pkg.a.A.f"), ("pkg.a.A.f", "CALLS", "pkg.a.g"), ("pkg.a.A.f", "CALLS", "pkg.b.h"), ("pkg.a.A", "INHERITS", "Base"), ("pkg/a.py", "CONTAINS", "pkg.a.g")}
    assert not graph.validate(first.edges, first.nodes).count()
    counted = first.counters()
    assert counted["files_walked"] == 4 and counted["files_failed"] == 1 and counted["units_emitted"] == counted["units_changed"] == counted["units_embedded"] == first.units.count() == 10
    assert counted["edges_written"] == len(edges) and counted["nodes_written"] == len(names)
    write("pkg/b.py", "def h(): pass\n")
    write("pkg/c.py", "def z(): return 1\n")
    second = run(first.units.select("unit_id", "repo_id", "file_path", "source_sha"))
    assert {r.qualified_name for r in second.units.filter("changed").collect()} == {"pkg.b", "pkg.b.h", "pkg.c", "pkg.c.z"}


def test_explore_takes_the_first_edge(spark):
    """Distances and relations against a plain queue, and the caps."""
    rnd = random.Random(4)
    rows = [(f"n{rnd.randrange(30):02d}", rnd.choice(["CALLS", "IMPORTS", "DEFINES"]), f"n{rnd.randrange(30):02d}") for _ in range(70)]
    frame = spark.createDataFrame([r for r in rows if r[0] != r[2]], "src_id string, kind string, dst_id string")
    for direction, rule in graph.DIRECTIONS.items():
        steps = {}
        for a, kind, b in rows:
            if a != b:
                for here, there, way in ((a, b, "out"), (b, a, "in")):
                    if rule is None or (kind, way) == rule:
                        steps.setdefault(here, []).append((there, kind, way))
        want, queue = {}, [("n01", 0)]
        for node, far in queue:
            for other, kind, way in sorted(steps.get(node, [])) if far < 3 else []:
                if other != "n01" and other not in want:
                    want[other] = (far + 1, f"{kind} {'->' if way == 'out' else '<-'}")
                    queue.append((other, far + 1))
        got = graph.explore(frame, spark.createDataFrame([("n01",)], "node_id string"), direction, 3)
        assert {r.node_id: (r.distance, r.relation) for r in got.collect()} == want
        kept = graph.nearest(got, 2).collect()
        assert {r.node_id for r in kept} == set(sorted(want, key=lambda n: (want[n][0], n))[:2]) and all(r.truncated == (len(want) > 2) for r in kept)


def test_policies_in_order(spark):
    rows = [("mcp_tool", "dev", "t1", 5), ("mcp_tool", "dev", "t9", 5), ("mcp_tool", None, "all", 5), ("read", "dev", "t1", 50), ("read", "dev", "t1", None)]
    frame = spark.createDataFrame(rows, "action string, role string, tool string, age int")
    policies = [(40, "age", integrity.enforce_retention(F.col("age"), 10)), (20, "role", integrity.restrict_tool_by_role(F.col("action"), F.col("role"), F.col("tool"), {"*": ["all"], "dev": ["t1"]}))]
    got = [(r.d.allowed, r.d.policy, r.d.trace) for r in frame.select(integrity.first_decision(policies).alias("d")).collect()]
    assert got == [(True, "role", "role=allow"), (False, "role", "role=deny"), (True, "role", "role=allow"), (False, "age", "role=neutral,age=deny"), (True, None, "role=neutral,age=neutral")]


def test_embedder_column_equals_the_plain_one(spark):
    texts = ["text", "", "é", None, "a" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(embed(F.col("t"), 20).alias("v")).collect()
    for t, r in zip(texts, got, strict=True):
        assert r.v is None if t is None else r.v == pytest.approx(vector(t, 20), abs=1e-6)


def test_embedder():
    v = vector("text", 20)
    first = int.from_bytes(hashlib.sha512(b"text:0").digest()[:4], "big", signed=True)
    assert len(v) == 20 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5) and (v[0] > 0) == (first > 0) and v == vector("text", 20)


def test_streams_drop_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for k, rows in enumerate([[(1, "2024-01-01 10:00:00"), (2, "2024-01-03 10:00:00")], [(3, "2024-01-01 11:00:00"), (2, "2024-01-03 10:00:00"), (4, "2024-01-05 00:00:00")]]):
        spark.createDataFrame([(i, t, 1, "a", 1.0) for i, t in rows], schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = []
        rolling.drain(rolling.once(rolling.events(spark, f"{tmp_path}/in", schema), "event_id", "1 hour"), lambda df, _, out=out: out.extend(df.collect()), f"{tmp_path}/state")
        assert sorted(r.event_id for r in out) == ([1, 2] if k == 0 else [4])


def test_snapshot_digests_hold_no_group(spark):
    """The digest of a key's sorted records, without an aggregate that collects them."""
    from lodestrata.plans import navigation as plans

    rows = [("a", "2"), ("a", "10"), (None, "x"), ("a", "é"), ("b", None), ("b", ""), ("b", "z"), (None, "X")]
    got = {r.k: (r.snapshot, r.n) for r in navigation.sorted_digests(spark.createDataFrame(rows * 50, "k string, r string"), "k", "r").collect()}
    for k in ("a", "b", None):
        own = sorted(r.encode() for i, r in rows * 50 if i == k and r is not None)
        assert got.pop(k) == (hashlib.sha256(b"\n".join(own)).hexdigest(), 50 * sum(i == k for i, _ in rows))
    assert not got
    found = plans.snapshot_hashes(spark, "/root/testdata/sf0.001")
    assert "collect_list" not in found._jdf.queryExecution().toString()
