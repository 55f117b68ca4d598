"""Graph operators on small literal graphs."""

import itertools

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import graph as G, reach as R
from tests.conftest import rows


@pytest.fixture
def edges(spark):
    def make(pairs, kind="imports"):
        return spark.createDataFrame([("r", a, b, kind) for a, b in pairs], "repo string, src string, dst string, type string")

    return make


@pytest.fixture
def nodes(spark):
    def make(*ids):
        data = [("r", i, "file", i.upper(), f"src/{i}.ts", "typescript", None) for i in ids]
        return spark.createDataFrame(
            data, "repo string, id string, type string, name string, file_path string, language string, framework string"
        )

    return make


def closure(pairs):
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    while True:
        grown = {a: bs | {c for b in bs for c in reach.get(b, set())} for a, bs in reach.items()}
        if grown == reach:
            return reach
        reach = grown


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([("a", "b"), ("b", "c")], set()),
        ([("a", "b"), ("b", "a")], {("a", "b", 2), ("b", "b", 2)}),
        ([("a", "a")], {("a", "a", 1)}),
        ([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c")], {("a", "b", 2), ("b", "b", 2), ("c", "d", 2), ("d", "d", 2)}),
        ([], set()),
    ],
)
def test_cycles_small(edges, pairs, expected):
    assert {tuple(r) for r in R.cycles(edges(pairs)).select("node", "component", "size").collect()} == expected


def test_cycles_are_mutual_reachability(edges):
    n = 23
    pairs = sorted({(f"n{i:02}", f"n{(i * i + 3) % n:02}") for i in range(n)} | {(f"n{(i * i + 3) % n:02}", f"n{i:02}") for i in range(0, n, 4)})
    reach = closure(pairs)
    expected = {}
    for a, b in itertools.product({x for p in pairs for x in p}, repeat=2):
        if a == b and (a, a) in pairs or a != b and b in reach.get(a, ()) and a in reach.get(b, ()):
            expected.setdefault(a, set()).update({a, b})
    got = {r["node"]: (r["component"], r["size"]) for r in R.cycles(edges(pairs)).collect()}
    assert got == {a: (max(group), len(group)) for a, group in expected.items()}


def test_impact_excludes_start_and_walks_through_dangling_ids(spark, edges, nodes):
    graph = edges([("a", "b"), ("b", "ghost"), ("ghost", "c"), ("d", "a"), ("c", "a")])
    start = spark.createDataFrame([("r", "c")], "repo string, id string")
    hits = R.impact_subgraph(nodes("a", "b", "c", "d"), graph, start)
    assert rows(hits, "id", "depth") == [("a", 3), ("b", 2), ("d", 4)]


def test_neighbors_both_merges_and_skips_missing_nodes(spark, edges, nodes):
    start = spark.createDataFrame([("r", "a")], "repo string, id string")
    near = G.neighbors(nodes("a", "b", "c"), edges([("a", "b"), ("b", "a"), ("c", "a"), ("a", "zz")]), start)
    assert rows(near, "id") == [("b",), ("c",)]


def test_shortest_path(edges, nodes):
    n, e = nodes("a", "b", "c", "d"), edges([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a")])
    assert rows(R.shortest_path(n, e, "a", "d"), "path", "length") == [(["a", "b", "d"], 2)]
    assert rows(R.shortest_path(n, e, "a", "a"), "path", "length") == [(["a"], 0)]
    assert rows(R.shortest_path(n, e, "a", "zz")) == []


def test_remove_nodes_drops_incident_edges(spark, edges, nodes):
    gone = spark.createDataFrame([("r", "b")], "repo string, id string")
    kept, left = G.remove_nodes(nodes("a", "b", "c"), edges([("a", "b"), ("b", "c"), ("a", "c")]), gone)
    assert rows(kept, "id") == [("a",), ("c",)] and rows(left, "src", "dst") == [("a", "c")]


def test_build_graph_last_write_wins(nodes, edges):
    first, second = nodes("a", "b"), nodes("a").withColumn("name", F.lit("new"))
    built, bag = G.build_graph([first, second], [edges([("a", "b")]), edges([("a", "b")])])
    assert rows(built, "id", "name") == [("a", "new"), ("b", "B")] and bag.count() == 2


def test_keyword_search_and_graph_query(nodes, edges):
    n = nodes("alpha", "beta", "alphabet")
    assert rows(G.keyword_search(n, "ALPHA"), "id") == [("alpha",), ("alphabet",)]
    hits, among = G.graph_query(n, edges([("alpha", "alphabet"), ("alpha", "beta")]), "alpha", "file")
    assert hits.count() == 2 and rows(among, "src", "dst") == [("alpha", "alphabet")]


def test_priority_rank_ties_share_a_rank(nodes, edges):
    ranked = G.priority_rank(nodes("hub", "leaf", "other", "alone"), edges([("leaf", "hub"), ("other", "hub")]))
    assert rows(ranked, "id", "score", "rank") == [("alone", 0, 4), ("hub", 2, 1), ("leaf", 1, 2), ("other", 1, 2)]


def test_budget_stops_at_first_overflow(spark):
    ranked = spark.createDataFrame(
        [("r", "a", 1, 40), ("r", "b", 2, 4000), ("r", "c", 3, 40)], "repo string, id string, rank int, length int"
    )
    assert rows(G.budget_select(ranked, 300), "id", "cost", "running") == [("a", 110, 110)]
    assert [r[0] for r in rows(G.budget_select(ranked, 5000), "id")] == ["a", "b", "c"]


def test_orphans_spare_entry_points(spark, edges):
    f = spark.createDataFrame([("r", p) for p in ("src/index.ts", "src/a.ts", "src/b.ts", "cli.js")], "repo string, path string")
    assert rows(G.orphans(f, edges([("src/a.ts", "src/b.ts")])), "file") == [("src/a.ts",)]


def test_topo_levels_and_cycle(spark):
    ids = spark.createDataFrame([("r", x) for x in "abcde"], "repo string, id string")
    deps = spark.createDataFrame([("r", "b", "a"), ("r", "c", "b"), ("r", "c", "a"), ("r", "d", "e"), ("r", "e", "d")], "repo string, id string, prereq string")
    got = {r["id"]: (r["level"], r["cyclic"]) for r in R.topo_levels(ids, deps).collect()}
    assert got == {"a": (0, False), "b": (1, False), "c": (2, False), "d": (None, True), "e": (None, True)}


def test_topo_levels_move_numbers_not_names(spark, monkeypatch):
    """Names are written twice, to number them; the rounds write numbers only.  Ids without a name wait for nothing."""
    written, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: written.append(dict(df.dtypes)) or cut(df))
    n = 11
    ids = spark.createDataFrame([("r", f"n{i}") for i in range(n)] * 2 + [("r", None)], "repo string, id string")
    deps = spark.createDataFrame([("r", f"n{i + 1}", f"n{i}") for i in range(n - 1)] + [("r", "n0", "unknown"), ("r", None, "n1")], "repo string, id string, prereq string")
    got = {r.id: (r.level, r.cyclic) for r in R.topo_levels(ids, deps, rounds=3).collect()}
    assert got == {f"n{i}": (i, False) for i in range(n)} | {None: (0, False)}
    assert sum("string" in kinds.values() for kinds in written) == 2


def test_slices(nodes, edges):
    n = nodes("a", "b", "c").withColumn("framework", F.when(F.col("id") != "c", "react"))
    e = edges([("a", "b"), ("a", "b"), ("b", "c")], "calls").unionByName(edges([("c", "a")], "reads"))
    assert rows(G.framework_slice(n, e, "react")[1]) == [("r", "a", "b")]
    assert rows(G.deps_slice(n, e, "a")) == [("r", "a", "b")]
    assert rows(G.deps_slice(n, e)) == [("r", "a", "b"), ("r", "b", "c")]
    assert rows(G.flow_slice(n, e)[0], "id") == [("a",), ("c",)]
    assert rows(G.architecture_slice(n, e)[0], "id", "group") == [("a", "src"), ("b", "src"), ("c", "src")]


def test_token_estimate_and_stats(nodes, edges):
    n = nodes("a", "b")
    assert rows(G.token_estimate(n, "shallow"), "tokens") == [(400,)]
    assert rows(G.graph_stats(n, edges([("a", "b")])), "nodes", "edges", "files", "languages") == [(2, 1, 2, "typescript")]


def test_module_edges_skip_same_module(spark, edges):
    m = spark.createDataFrame([("r", "a", "x"), ("r", "b", "x"), ("r", "c", "y")], "repo string, id string, module string")
    assert rows(G.module_edges(edges([("a", "b"), ("a", "c"), ("b", "c"), ("c", "q")]), m)) == [("r", "x", "y", 2), ("r", "y", "root", 1)]


def test_a_long_path_and_a_long_chain(spark):
    from codeatlas.operators import reach as R

    chain = spark.createDataFrame([("r", f"n{i:03d}", f"n{i + 1:03d}", "x") for i in range(50)], "repo string, src string, dst string, type string")
    nodes = spark.createDataFrame([("r", f"n{i:03d}") for i in range(51)], "repo string, id string")
    targets = spark.createDataFrame([("r", "n050"), ("r", "n017"), ("r", "none")], "repo string, id string")
    found = {r.dst: (r.path, r.length) for r in R.shortest_paths(nodes, chain, "n000", targets).collect()}
    assert found == {"n050": ([f"n{i:03d}" for i in range(51)], 50), "n017": ([f"n{i:03d}" for i in range(18)], 17)}
    deps = spark.createDataFrame([("r", f"m{i}", f"m{i - 1}") for i in range(1, 100)] + [("r", "c1", "c2"), ("r", "c2", "c1")], "repo string, id string, prereq string")
    ids = spark.createDataFrame([("r", f"m{i}") for i in range(100)] + [("r", "c1"), ("r", "c2")], "repo string, id string")
    levels = {r.id: (r.level, r.cyclic) for r in R.topo_levels(ids, deps, rounds=8).collect()}
    assert levels == {**{f"m{i}": (i, False) for i in range(100)}, "c1": (None, True), "c2": (None, True)}


def test_budget_of_a_repo_with_equal_ranks(spark):
    from codeatlas.operators import graph as G

    ranked = spark.createDataFrame([("r", f"i{n:04d}", 1, 40) for n in range(3000)] + [("s", "a", 1, 40)], "repo string, id string, rank int, length int")
    chosen = G.budget_select(ranked, 5000)
    cost = chosen.first()["cost"]
    assert [r.id for r in chosen.filter("repo = 'r'").orderBy("running").collect()] == [f"i{n:04d}" for n in range(5000 // cost)]


def test_joins_of_cycles_are_not_broadcast(edges):
    found = R.cycles(edges([("a", "b"), ("b", "a"), ("c", "c"), ("b", "d")]))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "node", "size") == [("a", 2), ("b", 2), ("c", 1)]


def test_distinct_edges_are_dealt_by_their_number(edges, nodes, monkeypatch):
    """A task meets a bounded number of edges, whatever the session's number of partitions is."""
    monkeypatch.setattr("codeatlas.session.ROWS_A_TASK", 10)
    some = edges([(f"n{i % 40}", f"n{i}") for i in range(400)])
    shown = G.architecture_slice(nodes("n1"), some.unionByName(some))[1]
    assert shown.count() == 400
    assert shown.select(F.spark_partition_id().alias("at")).distinct().count() > 40
    assert G.hotspots(some, 1).first()["importers"] == 1


def test_module_edges_count_each_import_once(spark, edges):
    some = edges([("a", "x"), ("a", "x"), ("b", "x"), ("c", "x"), ("c", "a"), ("a", "b"), ("q", "x")])
    modules = spark.createDataFrame([("r", "a", "m"), ("r", "b", "m"), ("r", "c", "n"), ("r", "x", "o")], "repo string, id string, module string")
    assert rows(G.module_edges(some, modules), "from", "to", "weight") == [("m", "o", 2), ("n", "m", 1), ("n", "o", 1), ("root", "o", 1)]


def test_numbers_of_names_differ(edges, spark, monkeypatch):
    """Names that share a hash are numbered anew."""
    hashes, tried = F.xxhash64, []

    def clash(seed, *cols):
        tried.append(seed)
        return F.lit(7).cast("long") + 0 * hashes(seed, *cols) if len(tried) == 1 else hashes(seed, *cols)

    monkeypatch.setattr(R.F, "xxhash64", clash)
    starts = spark.createDataFrame([("r", "c")], "repo string, id string")
    got = R.reach(edges([("a", "b"), ("b", "c"), ("c", "c")]), starts)
    assert rows(got, "origin", "id", "depth") == [("c", "a", 2), ("c", "b", 1)]
    assert len(tried) > 1
