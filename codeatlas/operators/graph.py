"""Knowledge-graph operators that need no iteration: joins, aggregates and slices over nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.session import dealt

# What counts as an entry file, as top-level in an overview, as a dependency and as data flow.
ENTRY_PATTERNS = [r"index\.[jt]sx?$", r"main\.[jt]sx?$", r"cli\.[jt]sx?$", r"^src/index"]
TOP_LEVEL_TYPES = ["service", "endpoint", "table", "external", "schema", "queue", "event", "config"]
DEPENDENCY_TYPES = ["imports", "calls", "depends-on", "consumes"]
FLOW_TYPES = ["reads", "writes", "publishes", "subscribes"]
SHALLOW_TOKENS, DEEP_TOKENS = 200, 600
SHALLOW_OUTPUT, DEEP_OUTPUT = 100, 300

SALTS = 64



def build_graph(node_parts: list[DataFrame], edge_parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union analyser outputs.  Of nodes with one id the last part wins (then the last path); edges stay a bag."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(node_parts)]
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    payload = [c for c in everything.columns if c not in ("repo", "id", "_part")]
    # max_by keeps one row per id on the map side, so a popular id never piles up in one task.
    nodes = (
        everything.groupBy("repo", "id")
        .agg(
            F.max_by(
                F.struct(*payload), F.struct("_part", F.coalesce("file_path", F.lit("")), F.coalesce("name", F.lit("")))
            ).alias("last")
        )
        .select("repo", "id", "last.*")
    )
    edges = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), edge_parts)
    return nodes, edges


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("repo", "id").distinct()
    return (
        nodes.join(gone, ["repo", "id"], "left_anti"),
        edges.join(gone.withColumnRenamed("id", "src"), ["repo", "src"], "left_anti")
        .join(gone.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_anti"),
    )


def edges_from(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("repo", F.col("id").alias("src")), ["repo", "src"], "left_semi")


def edges_to(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("repo", F.col("id").alias("dst")), ["repo", "dst"], "left_semi")


def neighbors(nodes: DataFrame, edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Distinct neighbours per origin that exist as nodes."""
    start = ids.select("repo", F.col("id").alias("origin")).distinct()
    parts = []
    if direction in ("outgoing", "both"):
        parts.append(edges.select("repo", F.col("src").alias("origin"), F.col("dst").alias("id")))
    if direction in ("incoming", "both"):
        parts.append(edges.select("repo", F.col("dst").alias("origin"), F.col("src").alias("id")))
    linked = reduce(DataFrame.unionByName, parts).join(start, ["repo", "origin"], "left_semi").distinct()
    return nodes.join(linked, ["repo", "id"])


def filter_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.filter(F.col("type") == node_type)


def keyword_search(nodes: DataFrame, keyword: str) -> DataFrame:
    """Case-insensitive substring of name or path."""
    needle = keyword.lower()
    return nodes.filter(
        F.lower("name").contains(needle) | F.coalesce(F.lower("file_path").contains(needle), F.lit(False))
    )


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in the set."""
    return edges_to(edges_from(edges, ids), ids)


def graph_query(nodes: DataFrame, edges: DataFrame, term: str, node_type: str | None = None):
    hits = keyword_search(nodes, term)
    if node_type is not None:
        hits = filter_by_type(hits, node_type)
    return hits, induced_edges(edges, hits)


def multi_query(results: list[DataFrame], edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of several node results, one row per id, and the edges among them."""
    shared = [c for c in results[0].columns if all(c in r.columns for r in results)]
    union = reduce(DataFrame.unionByName, [r.select(shared) for r in results])
    rest = [c for c in shared if c not in ("repo", "id")]
    merged = union.groupBy("repo", "id").agg(F.max(F.struct(*rest)).alias("_row")).select("repo", "id", "_row.*").select(shared) if rest else union.distinct()
    return merged, induced_edges(edges, merged)


def graph_stats(nodes: DataFrame, edges: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """One row per repo: node, edge and file counts, languages, frameworks, share of enriched nodes in percent."""
    per_node = nodes.groupBy("repo").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("type") == "file").alias("files"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
        F.array_join(F.array_sort(F.collect_set("framework")), ",").alias("frameworks"),
    )
    per_edge = edges.groupBy("repo").agg(F.count("*").alias("edges"))
    out = per_node.join(per_edge, "repo", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))
    if enrichment is None:
        return out.withColumn("enriched_percent", F.lit(0).cast("long"))
    rich = enrichment.groupBy("repo").agg(F.count("*").alias("_rich"))
    return (
        out.join(rich, "repo", "left")
        .withColumn(
            "enriched_percent",
            F.floor(F.coalesce("_rich", F.lit(0)) * 100 / F.col("nodes") + 0.5).cast("long"),
        )
        .drop("_rich")
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, id, in_degree, out_degree) with zeros; one aggregate pass over both ends."""
    ends = edges.select("repo", F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select("repo", F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    sums = ends.groupBy("repo", "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("repo", "id").join(sums, ["repo", "id"], "left").fillna(0, ["in_degree", "out_degree"])


def priority_rank(nodes: DataFrame, edges: DataFrame, churn: DataFrame | None = None) -> DataFrame:
    """(repo, id, in_degree, out_degree, churn, score, rank), rank 1 = highest score, ties share a rank.

    The rank comes from the histogram of scores, not from a window over all nodes: distinct scores are few, since
    n distinct degrees need about n*n/2 edges.
    """
    scored = degrees(nodes, edges)
    if churn is not None:
        scored = scored.join(churn.select("repo", "id", "churn"), ["repo", "id"], "left").fillna(0, ["churn"])
    else:
        scored = scored.withColumn("churn", F.lit(0).cast("long"))
    scored = scored.withColumn("score", F.col("in_degree") + F.col("out_degree") + F.col("churn"))
    return rank_by_histogram(scored, "score")


def rank_by_histogram(df: DataFrame, score: str, by: str = "repo") -> DataFrame:
    """`rank` of each row by `score` descending within `by`, from the counts per distinct score."""
    from pyspark.sql import Window

    counts = df.groupBy(by, score).agg(F.count("*").alias("_n"))
    above = Window.partitionBy(by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(by, score, (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("rank"))
    return df.join(ranks, [by, score])


def prompt_cost(text_length: Column, depth: str = "shallow") -> Column:
    """Tokens a prompt and its answer are taken to cost: a quarter of the characters, rounded up, plus output."""
    output = SHALLOW_OUTPUT if depth == "shallow" else DEEP_OUTPUT
    return F.ceil(text_length / 4) + F.lit(output)


def budget_select(ranked: DataFrame, budget: int, depth: str = "shallow", order: list[Column] | None = None) -> DataFrame:
    """Items in rank order until the first that would overflow the budget: input columns + (cost, running).

    `ranked` has (repo, id, rank, length).  Every item costs at least its output allowance, so no more than
    budget / allowance items per repo can be chosen.  That many are kept of each of `SALTS` parts of a repo, and only those meet in
    one task for the running sum.
    """
    from pyspark.sql import Window

    output = SHALLOW_OUTPUT if depth == "shallow" else DEEP_OUTPUT
    order = order or [F.col("rank"), F.col("id")]
    most = budget // output + 1
    part = Window.partitionBy("repo", "_part").orderBy(*order)
    w = Window.partitionBy("repo").orderBy(*order)
    some = ranked.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= most)
    return (
        some.withColumn("_place", F.row_number().over(w))
        .filter(F.col("_place") <= most)
        .withColumn("cost", prompt_cost(F.col("length"), depth))
        .withColumn("running", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("running") <= budget)
        .drop("_place", "_part")
    )


def token_estimate(nodes: DataFrame, depth: str = "shallow") -> DataFrame:
    per_node = {"none": 0, "shallow": SHALLOW_TOKENS, "deep": DEEP_TOKENS}[depth]
    return nodes.groupBy("repo").agg((F.count("*") * per_node).alias("tokens"))


def attach_enrichment(nodes: DataFrame, enrichment: DataFrame) -> DataFrame:
    return nodes.join(enrichment.withColumnRenamed("node_id", "id"), ["repo", "id"], "left")


# ---------------------------------------------------------------- diagram slices


def top_directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.split(path, "/")[0]).otherwise("root")


def architecture_slice(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with `group`, distinct edges): files under their top directory, other known types on top."""
    shown = nodes.filter(F.col("type").isin(["file", *TOP_LEVEL_TYPES])).withColumn(
        "group", F.when(F.col("type") == "file", top_directory(F.coalesce("file_path", "name")))
    )
    return shown, dealt(edges.select("repo", "src", "dst", "type"), "repo", "src", "dst", "type").distinct()


def deps_slice(nodes: DataFrame, edges: DataFrame, focus: str | None = None) -> DataFrame:
    """Distinct dependency edges (src, dst) among all nodes, or among a focus and what it points to (none if it is unknown)."""
    shown = nodes.select("repo", "id")
    if focus is not None:
        at = shown.filter(F.col("id") == focus)
        shown = neighbors(nodes, edges, at, "outgoing").select("repo", "id").unionByName(at)
    wanted = edges.filter(F.col("type").isin(DEPENDENCY_TYPES))
    return induced_edges(wanted, shown).select("repo", "src", "dst").distinct()


def flow_slice(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    flow = edges.filter(F.col("type").isin(FLOW_TYPES)).select("repo", "src", "dst", "type").distinct()
    ends = flow.select("repo", F.col("src").alias("id")).unionByName(flow.select("repo", F.col("dst").alias("id")))
    return nodes.join(ends.distinct(), ["repo", "id"], "left_semi"), flow


def framework_slice(nodes: DataFrame, edges: DataFrame, framework: str | None = None) -> tuple[DataFrame, DataFrame]:
    keep = F.col("framework") == framework if framework else F.col("framework").isNotNull()
    shown = nodes.filter(keep)
    return shown, induced_edges(edges, shown).select("repo", "src", "dst").distinct()


# ---------------------------------------------------------------- import graph


def import_graph(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct edges between known files."""
    known = files.select("repo", F.col("path").alias("id")).distinct()
    return induced_edges(edges.select("repo", "src", "dst").distinct(), known)


def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files nothing imports, entry points aside."""
    imported = edges.select("repo", F.col("dst").alias("file")).distinct()
    entry = F.col("file").rlike("|".join(f"(?:{p})" for p in ENTRY_PATTERNS))
    return files.select("repo", F.col("path").alias("file")).filter(~entry).join(imported, ["repo", "file"], "left_anti")


def hotspots(edges: DataFrame, k: int = 15) -> DataFrame:
    """Most imported files: distinct importers per target, top k over all repos."""
    counted = (
        dealt(edges.select("repo", "src", "dst"), "repo", "src", "dst").distinct().groupBy("repo", F.col("dst").alias("file"))
        .agg(F.count("*").alias("importers"))
    )
    return counted.orderBy(F.desc("importers"), "repo", "file").limit(k)


def module_of(path: Column) -> Column:
    """Second segment below src/, else the first; files at the top belong to `root`."""
    parts = F.split(path, "/")
    return (
        F.when(F.size(parts) <= 1, "root")
        .when((parts[0] == "src") & (F.size(parts) > 2), F.try_element_at(parts, F.lit(2)))
        .when(parts[0] == "src", "root")
        .otherwise(parts[0])
    )


def module_edges(edges: DataFrame, modules: DataFrame, k: int = 20) -> DataFrame:
    """(repo, from, to, weight): imports crossing modules; `modules` maps (repo, id) to module, unknown = root.

    Edges into a node are counted by the module they come from before they meet the node's module, so they are joined once.
    """
    pairs = dealt(edges.select("repo", "src", "dst"), "repo", "src", "dst").distinct()
    a = modules.select("repo", F.col("id").alias("src"), F.col("module").alias("_from"))
    b = modules.select("repo", F.col("id").alias("dst"), F.col("module").alias("_to"))
    into = pairs.join(a.hint("merge"), ["repo", "src"], "left").groupBy("repo", "dst", F.coalesce("_from", F.lit("root")).alias("from")).agg(F.count("*").alias("_n"))
    counted = (
        into.join(b.hint("merge"), ["repo", "dst"], "left")
        .select("repo", "from", F.coalesce("_to", F.lit("root")).alias("to"), "_n")
        .filter(F.col("from") != F.col("to"))
        .groupBy("repo", "from", "to").agg(F.sum("_n").alias("weight"))
    )
    return counted.orderBy(F.desc("weight"), "repo", "from", "to").limit(k)


def deps_summary(files: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row per repo: files, import edges and cycles (components that hold a cycle)."""
    f = files.groupBy("repo").agg(F.count("*").alias("files"))
    e = edges.select("repo", "src", "dst").distinct().groupBy("repo").agg(F.count("*").alias("imports"))
    c = components.groupBy("repo").agg(F.count_distinct("component").alias("cycles"))
    return f.join(e, "repo", "left").join(c, "repo", "left").fillna(0, ["imports", "cycles"])


def class_inventory(symbols: DataFrame, classes: int | None = None, interfaces: int | None = None, enums: int | None = None) -> DataFrame:
    """(repo, module, kind, name, place): the symbols of each kind per module, the first ones only of a kind given a size."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo", "module", "kind").orderBy("name", "file")
    sizes = {"class": classes, "interface": interfaces, "enum": enums}
    placed = symbols.filter(F.col("kind").isin(list(sizes))).withColumn("place", F.row_number().over(w))
    for kind, size in sizes.items():
        if size is not None:
            placed = placed.filter((F.col("kind") != kind) | (F.col("place") <= size))
    return placed.select("repo", "module", "kind", "name", "place")
