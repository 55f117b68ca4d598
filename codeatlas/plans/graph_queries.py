"""Registered queries of the knowledge-graph and dependency-graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import graph as G, reach as R
from codeatlas.plans import adapters as A
from codeatlas.plans.registry import query, table

WITH_FK = "WITH RECURSIVE " + A.FK_SQL
WITH_MOD = "WITH RECURSIVE " + A.MOD_SQL
NODE_COLS = "repo, id, type, name, file_path, language, framework"
SLICE_NAMES = ["repo", "id", "type", "name", "file_path", "language", "framework"]

MOD_NODES = "mn AS (SELECT DISTINCT repo, id FROM (SELECT repo, src AS id FROM mg UNION ALL SELECT repo, dst FROM mg))"


def mod_nodes(spark, sf):
    edges = A.mod_edges(spark, sf)
    return edges.select("repo", F.col("src").alias("id")).unionByName(edges.select("repo", F.col("dst").alias("id"))).distinct()


def one(spark, repo, *ids):
    return spark.createDataFrame([(repo, i) for i in ids], "repo string, id string")


@query("e1_build_graph", WITH_FK + """,
both_parts AS (
  SELECT 0 AS p, repo, id, type, name, file_path FROM fkn
  UNION ALL SELECT 1, repo, id, type, upper(name), file_path FROM fkn WHERE type = 'table')
SELECT repo, id, last.type AS type, last.name AS name FROM (
  SELECT repo, id, max_by({'type': type, 'name': name}, p) AS last FROM both_parts GROUP BY repo, id)""")
def e1(spark, sf):
    nodes = A.fk_nodes(spark, sf)
    later = nodes.filter("type = 'table'").withColumn("name", F.upper("name"))
    built, _ = G.build_graph([nodes, later], [A.fk_edges(spark, sf)])
    return built.select("repo", "id", "type", "name")


@query("e2_remove_nodes", WITH_FK + """,
gone AS (SELECT id FROM fkn WHERE type = 'external'),
left_edges AS (SELECT * FROM fk WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone))
SELECT repo, type, count(*) AS edges, (SELECT count(*) FROM fkn WHERE id NOT IN (SELECT id FROM gone)) AS nodes
FROM left_edges GROUP BY repo, type""")
def e2(spark, sf):
    nodes = A.fk_nodes(spark, sf)
    kept, edges = G.remove_nodes(nodes, A.fk_edges(spark, sf), G.filter_by_type(nodes, "external"))
    return edges.groupBy("repo", "type").agg(F.count("*").alias("edges")).withColumn(
        "nodes", kept.agg(F.count("*")).scalar()
    )


@query("e3_incident_edges", WITH_FK + """
SELECT 'from' AS side, repo, src, dst, type FROM fk WHERE src IN (SELECT id FROM fkn WHERE framework = 'express')
UNION ALL
SELECT 'to', repo, src, dst, type FROM fk WHERE dst IN (SELECT id FROM fkn WHERE framework = 'react')""")
def e3(spark, sf):
    nodes, edges = A.fk_nodes(spark, sf), A.fk_edges(spark, sf)
    out = G.edges_from(edges, nodes.filter("framework = 'express'")).withColumn("side", F.lit("from"))
    into = G.edges_to(edges, nodes.filter("framework = 'react'")).withColumn("side", F.lit("to"))
    return out.unionByName(into).select("side", "repo", "src", "dst", "type")


@query("e4_neighbors", WITH_FK + """,
link AS (
  SELECT DISTINCT origin, id FROM (SELECT src AS origin, dst AS id FROM fk UNION ALL SELECT dst, src FROM fk)
  WHERE origin IN (SELECT id FROM fkn WHERE type IN ('service', 'external')))
SELECT repo, origin, id, type, name FROM link JOIN fkn USING (id)""")
def e4(spark, sf):
    nodes = A.fk_nodes(spark, sf)
    start = nodes.filter(F.col("type").isin("service", "external"))
    return G.neighbors(nodes, A.fk_edges(spark, sf), start, "both").select("repo", "origin", "id", "type", "name")


@query("e5_shortest_path", WITH_FK + """,
walk(spot, path) AS (
  SELECT 'order:7', ['order:7']
  UNION ALL SELECT dst, list_append(path, dst) FROM walk JOIN fk ON src = spot WHERE NOT list_contains(path, dst)),
best AS (
  SELECT spot, path, row_number() OVER (PARTITION BY spot ORDER BY len(path), array_to_string(list_reverse(path), '|')) AS r
  FROM walk WHERE spot LIKE 'region:%' OR spot LIKE 'nation:%')
SELECT 'shop' AS repo, 'order:7' AS src, spot AS dst, array_to_string(path, ' > ') AS path,
       CAST(len(path) - 1 AS INTEGER) AS length
FROM best WHERE r = 1""")
def e5(spark, sf):
    # targets are the fixed set of regions and nations
    targets = [f"region:{k}" for k in range(5)] + [f"nation:{k}" for k in range(25)]
    paths = R.shortest_paths(A.fk_nodes(spark, sf), A.fk_edges(spark, sf), "order:7", targets)
    return paths.withColumn("path", F.array_join("path", " > "))


IMPACT_SQL = WITH_FK + """,
r(n) AS (SELECT 'region:0' UNION SELECT fk.src FROM r JOIN fk ON fk.dst = r.n)
"""


def impact_by_type(spark, sf):
    """Flagship: everything that transitively depends on one region, counted by kind of node."""
    hits = R.impact_subgraph(A.fk_nodes(spark, sf), A.fk_edges(spark, sf), one(spark, "shop", "region:0"))
    return hits.groupBy("repo", F.split("id", ":")[0].alias("node_type")).agg(
        F.count("*").alias("n_nodes"), F.max("depth").cast("int").alias("max_depth")
    )


query("e6_impact_by_type", WITH_FK + """,
r(n, d) AS (SELECT 'region:0', 0 UNION SELECT fk.src, d + 1 FROM r JOIN fk ON fk.dst = r.n),
m AS (SELECT n, min(d) AS d FROM r GROUP BY n)
SELECT 'shop' AS repo, split_part(n, ':', 1) AS node_type, count(*) AS n_nodes, CAST(max(d) AS INTEGER) AS max_depth
FROM m WHERE n <> 'region:0' GROUP BY 2""")(impact_by_type)


@query("e6_impact_subgraph", IMPACT_SQL.replace("r(n) AS (SELECT 'region:0' UNION SELECT fk.src FROM r JOIN fk ON fk.dst = r.n)", """
r(o, n, d) AS (
  SELECT id, id, 0 FROM fkn WHERE type = 'schema' UNION SELECT o, fk.src, d + 1 FROM r JOIN fk ON fk.dst = r.n),
m AS (SELECT o, n, min(d) AS d FROM r GROUP BY o, n)""") + """
SELECT repo, o AS origin, id, type, name, CAST(d AS INTEGER) AS depth FROM m JOIN fkn ON id = n WHERE n <> o""")
def e6(spark, sf):
    nodes = A.fk_nodes(spark, sf)
    hits = R.impact_subgraph(nodes, A.fk_edges(spark, sf), G.filter_by_type(nodes, "schema"))
    return hits.select("repo", "origin", "id", "type", "name", "depth")


@query("e7_filter_by_type", WITH_FK + f" SELECT {NODE_COLS} FROM fkn WHERE type = 'file'")
def e7(spark, sf):
    return G.filter_by_type(A.fk_nodes(spark, sf), "file").select(*SLICE_NAMES)


@query("e8_keyword_search", WITH_FK + f"""
SELECT {NODE_COLS} FROM fkn
WHERE contains(lower(name), 'widget') OR contains(lower(coalesce(file_path, '')), 'widget')""")
def e8(spark, sf):
    return G.keyword_search(A.fk_nodes(spark, sf), "Widget").select(*SLICE_NAMES)


@query("e8_keyword_search_pages", """
SELECT 'web' AS repo, page_id, url FROM pages WHERE contains(lower(url), '.example.net/fr/')""")
def e8_pages(spark, sf):
    nodes = table(spark, sf, "pages").select(
        F.lit("web").alias("repo"), "page_id", "url", F.col("url").alias("name"), F.lit(None).cast("string").alias("file_path")
    )
    return G.keyword_search(nodes, ".example.NET/fr/").select("repo", "page_id", "url")


@query("e9_graph_stats", WITH_FK + """
SELECT 'shop' AS repo, (SELECT count(*) FROM fkn) AS nodes, (SELECT count(*) FROM fk) AS edges,
  (SELECT count(*) FROM fkn WHERE type = 'file') AS files,
  (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM fkn) AS languages,
  (SELECT string_agg(DISTINCT framework, ',' ORDER BY framework) FROM fkn) AS frameworks,
  CAST((SELECT floor(count(*) FILTER (WHERE framework IS NOT NULL) * 100.0 / count(*) + 0.5) FROM fkn) AS BIGINT) AS enriched_percent""")
def e9(spark, sf):
    nodes = A.fk_nodes(spark, sf)
    done = nodes.filter("framework is not null").select("repo", F.col("id").alias("node_id"))
    return G.graph_stats(nodes, A.fk_edges(spark, sf), done)


@query("e10_induced_subgraph", WITH_FK + """
SELECT repo, src, dst, type FROM fk
WHERE src IN (SELECT id FROM fkn WHERE type IN ('service', 'file', 'schema'))
  AND dst IN (SELECT id FROM fkn WHERE type IN ('service', 'file', 'schema'))""")
def e10(spark, sf):
    nodes = A.fk_nodes(spark, sf).filter(F.col("type").isin("service", "file", "schema"))
    return G.induced_edges(A.fk_edges(spark, sf), nodes).select("repo", "src", "dst", "type")


@query("e11_graph_query", WITH_FK + """,
hit AS (SELECT id FROM fkn WHERE (contains(lower(name), '9') OR contains(lower(coalesce(file_path, '')), '9')))
SELECT repo, src, dst, type FROM fk WHERE src IN (SELECT id FROM hit) AND dst IN (SELECT id FROM hit)""")
def e11(spark, sf):
    _, edges = G.graph_query(A.fk_nodes(spark, sf), A.fk_edges(spark, sf), "9")
    return edges.select("repo", "src", "dst", "type")


@query("e11_graph_query_typed", WITH_FK + f"""
SELECT {NODE_COLS} FROM fkn WHERE type = 'table'
  AND (contains(lower(name), 'ring') OR contains(lower(coalesce(file_path, '')), 'ring'))""")
def e11_typed(spark, sf):
    nodes, _ = G.graph_query(A.fk_nodes(spark, sf), A.fk_edges(spark, sf), "Ring", "table")
    return nodes.select(*SLICE_NAMES)


@query("e12_multi_query", WITH_FK + """,
ids AS (
  SELECT id FROM fkn WHERE type = 'service'
  UNION SELECT id FROM fkn WHERE contains(lower(name), 'supplier')
  UNION SELECT n.id FROM fk JOIN fkn n ON n.id = fk.dst WHERE fk.src IN (SELECT id FROM fkn WHERE type = 'service'))
SELECT repo, src, dst, type FROM fk WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)""")
def e12(spark, sf):
    nodes, edges = A.fk_nodes(spark, sf), A.fk_edges(spark, sf)
    services = G.filter_by_type(nodes, "service")
    _, found = G.multi_query(
        [services, G.keyword_search(nodes, "supplier"), G.neighbors(nodes, edges, services, "outgoing")], edges
    )
    return found.select("repo", "src", "dst", "type")


RANK_SQL = """,
ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM fk UNION ALL SELECT dst, 0, 1 FROM fk),
deg AS (SELECT id, sum(o) AS o, sum(i) AS i FROM ends GROUP BY id),
scored AS (
  SELECT fkn.*, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree,
         CAST(CASE WHEN type = 'file' THEN length(name) ELSE 0 END AS BIGINT) AS churn
  FROM fkn LEFT JOIN deg USING (id)),
ranked AS (SELECT *, in_degree + out_degree + churn AS score,
                  rank() OVER (ORDER BY in_degree + out_degree + churn DESC) AS rank FROM scored)
"""


def _ranked(spark, sf):
    nodes = A.fk_nodes(spark, sf)
    churn = nodes.filter("type = 'file'").select("repo", "id", F.length("name").cast("long").alias("churn"))
    return nodes, G.priority_rank(nodes, A.fk_edges(spark, sf), churn)


@query("e13_priority_rank", WITH_FK + RANK_SQL + "SELECT repo, id, in_degree, out_degree, churn, score, rank FROM ranked")
def e13(spark, sf):
    return _ranked(spark, sf)[1].select("repo", "id", "in_degree", "out_degree", "churn", "score", "rank")


@query("e14_budget_select", """
WITH c AS (
  SELECT source AS repo, doc_id, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS rank,
         CAST(ceil(length(text) / 4.0) AS BIGINT) + 100 AS cost FROM documents),
r AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY repo ORDER BY rank, CAST(doc_id AS VARCHAR)) AS BIGINT) AS running FROM c)
SELECT repo, CAST(doc_id AS VARCHAR) AS id, rank, cost, running FROM r WHERE running <= 20000""")
def e14(spark, sf):
    docs = A.files(spark, sf).select(
        "repo", F.col("doc_id").cast("string").alias("id"), F.col("size").alias("score"), F.length("content").alias("length")
    )
    chosen = G.budget_select(G.rank_by_histogram(docs, "score"), 20000)
    return chosen.select("repo", "id", "rank", "cost", "running")


@query("e15_token_estimate", WITH_FK + "SELECT repo, count(*) * 600 AS tokens FROM fkn GROUP BY repo")
def e15(spark, sf):
    return G.token_estimate(A.fk_nodes(spark, sf), "deep")


@query("e17_attach_enrichment", WITH_FK + """
SELECT repo, id, type, name, CASE WHEN framework IS NOT NULL THEN 'uses ' || framework END AS purpose FROM fkn""")
def e17(spark, sf):
    nodes = A.fk_nodes(spark, sf)
    extra = nodes.filter("framework is not null").select(
        "repo", F.col("id").alias("node_id"), F.concat_ws(" ", F.lit("uses"), "framework").alias("purpose")
    )
    return G.attach_enrichment(nodes, extra).select("repo", "id", "type", "name", "purpose")


@query("e18_architecture_slice", WITH_FK + """
SELECT repo, id, type,
  CASE WHEN type = 'file' THEN CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE 'root' END END AS "group"
FROM fkn WHERE type IN ('file', 'service', 'endpoint', 'table', 'external', 'schema', 'queue', 'event', 'config')""")
def e18(spark, sf):
    nodes, _ = G.architecture_slice(A.fk_nodes(spark, sf), A.fk_edges(spark, sf))
    return nodes.select("repo", "id", "type", "group")


@query("e18_architecture_edges", WITH_FK + "SELECT DISTINCT repo, src, dst, type FROM fk")
def e18_edges(spark, sf):
    edges = A.fk_edges(spark, sf)
    return G.architecture_slice(A.fk_nodes(spark, sf), edges.unionByName(edges))[1]


@query("e19_deps_slice", WITH_FK + """
SELECT DISTINCT repo, src, dst FROM fk WHERE type = 'depends-on'
  AND src IN (SELECT id FROM fkn) AND dst IN (SELECT id FROM fkn)""")
def e19(spark, sf):
    return G.deps_slice(A.fk_nodes(spark, sf), A.fk_edges(spark, sf))


@query("e19_deps_slice_focus", WITH_FK + """,
near AS (SELECT 'order:7' AS id UNION SELECT dst FROM fk WHERE src = 'order:7')
SELECT DISTINCT repo, src, dst FROM fk WHERE type = 'depends-on'
  AND src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""")
def e19_focus(spark, sf):
    return G.deps_slice(A.fk_nodes(spark, sf), A.fk_edges(spark, sf), "order:7")


@query("e20_flow_slice", WITH_FK + """
SELECT repo, id, type FROM fkn WHERE id IN (
  SELECT src FROM fk WHERE type IN ('reads', 'writes') UNION ALL SELECT dst FROM fk WHERE type IN ('reads', 'writes'))""")
def e20(spark, sf):
    return G.flow_slice(A.fk_nodes(spark, sf), A.fk_edges(spark, sf))[0].select("repo", "id", "type")


@query("e21_framework_slice", WITH_FK + """
SELECT DISTINCT repo, src, dst FROM fk WHERE src IN (SELECT id FROM fkn WHERE framework IS NOT NULL)
  AND dst IN (SELECT id FROM fkn WHERE framework IS NOT NULL)""")
def e21(spark, sf):
    return G.framework_slice(A.fk_nodes(spark, sf), A.fk_edges(spark, sf))[1]


HREF_SQL = """
hrefs AS (
  SELECT DISTINCT 'web' AS repo, url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)
"""


def page_links(spark, sf):
    """Distinct (page, target) links of the raw pages."""
    return table(spark, sf, "pages").select(
        F.lit("web").alias("repo"), F.col("url").alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"),
    ).distinct()


@query("e22_import_graph", WITH_MOD + "," + MOD_NODES + """
SELECT DISTINCT repo, src, dst FROM mg""")
def e22(spark, sf):
    files = mod_nodes(spark, sf).withColumnRenamed("id", "path")
    return G.import_graph(A.mod_edges(spark, sf), files)


@query("e22_page_links", "WITH " + HREF_SQL + "SELECT repo, src, dst FROM hrefs")
def e22_pages(spark, sf):
    return page_links(spark, sf)


CYCLE_SQL = WITH_MOD + """,
core AS (SELECT src, dst FROM mg WHERE src <> dst),
r(a, b) AS (SELECT src, dst FROM core UNION SELECT r.a, core.dst FROM r JOIN core ON core.src = r.b),
mutual AS (SELECT x.a AS node, max(x.b) AS top, count(*) AS n FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
comp AS (
  SELECT 'mod' AS repo, node, top AS component, n AS size FROM mutual WHERE n > 1
  UNION ALL
  SELECT 'mod', src, src, 1 FROM mg WHERE src = dst AND src NOT IN (SELECT node FROM mutual WHERE n > 1))
"""


@query("e23_cycles", CYCLE_SQL + "SELECT repo, node, component, CAST(size AS BIGINT) AS size FROM comp")
def e23(spark, sf):
    return R.cycles(A.mod_edges(spark, sf))


@query("e24_orphans", WITH_MOD + "," + MOD_NODES + """
SELECT repo, id AS file FROM mn WHERE id NOT IN (SELECT dst FROM mg)
  AND NOT regexp_matches(id, '(index\\.[jt]sx?$)|(main\\.[jt]sx?$)|(cli\\.[jt]sx?$)|(^src/index)')""")
def e24(spark, sf):
    return G.orphans(mod_nodes(spark, sf).withColumnRenamed("id", "path"), A.mod_edges(spark, sf))


@query("e25_hotspots", "WITH " + HREF_SQL + """
SELECT repo, dst AS file, count(DISTINCT src) AS importers FROM hrefs GROUP BY 1, 2
ORDER BY importers DESC, repo, file LIMIT 15""")
def e25(spark, sf):
    return G.hotspots(page_links(spark, sf))


@query("e25_hotspots_graph", WITH_FK + """
SELECT repo, dst AS file, count(DISTINCT src) AS importers FROM fk GROUP BY 1, 2
ORDER BY importers DESC, repo, file LIMIT 15""")
def e25_graph(spark, sf):
    return G.hotspots(A.fk_edges(spark, sf))


@query("e26_deps_summary", CYCLE_SQL.rstrip() + "," + MOD_NODES + """
SELECT 'mod' AS repo, (SELECT count(*) FROM mn) AS files, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM mg)) AS imports,
       (SELECT count(DISTINCT component) FROM comp) AS cycles""")
def e26(spark, sf):
    edges = A.mod_edges(spark, sf)
    return G.deps_summary(mod_nodes(spark, sf), edges, R.cycles(edges))


@query("e27_module_edges", WITH_FK + """
SELECT fk.repo, coalesce(a.type, 'root') AS "from", coalesce(b.type, 'root') AS "to", count(*) AS weight
FROM (SELECT DISTINCT repo, src, dst FROM fk) fk LEFT JOIN fkn a ON a.id = src LEFT JOIN fkn b ON b.id = dst
WHERE coalesce(a.type, 'root') <> coalesce(b.type, 'root') GROUP BY ALL
ORDER BY weight DESC, 1, 2, 3 LIMIT 20""")
def e27(spark, sf):
    modules = A.fk_nodes(spark, sf).select("repo", "id", F.col("type").alias("module"))
    return G.module_edges(A.fk_edges(spark, sf), modules)


@query("e29_topo_levels", WITH_FK + """,
lv(id, l) AS (
  SELECT id, 0 FROM fkn UNION SELECT fk.src, l + 1 FROM lv JOIN fk ON fk.dst = lv.id)
SELECT 'shop' AS repo, id, CAST(max(l) AS INTEGER) AS level, false AS cyclic FROM lv GROUP BY id""")
def e29(spark, sf):
    deps = A.fk_edges(spark, sf).select("repo", F.col("src").alias("id"), F.col("dst").alias("prereq"))
    return R.topo_levels(A.fk_nodes(spark, sf), deps)


@query("e29_dag_check", WITH_MOD + "," + MOD_NODES + """,
core AS (SELECT src, dst FROM mg),
r(a, b) AS (SELECT src, dst FROM core UNION SELECT r.a, core.dst FROM r JOIN core ON core.src = r.b),
bad AS (SELECT DISTINCT a AS id FROM r WHERE a = b),
held AS (SELECT id FROM bad UNION SELECT r.a FROM r WHERE r.b IN (SELECT id FROM bad))
SELECT repo, count(*) FILTER (WHERE id IN (SELECT id FROM held)) AS held_by_cycle, count(*) AS ids FROM mn GROUP BY repo""")
def e29_check(spark, sf):
    deps = A.mod_edges(spark, sf).select("repo", F.col("src").alias("id"), F.col("dst").alias("prereq"))
    levels = R.topo_levels(mod_nodes(spark, sf), deps)
    return levels.groupBy("repo").agg(F.count_if("cyclic").alias("held_by_cycle"), F.count("*").alias("ids"))
