"""Iterative graph operators: reachability, upstream chains, shortest paths, cycles and topological levels.

Every loop works on whole frontiers.  A round is one equi-join of the frontier with the edge table followed by a
distinct (partial on the map side) and an anti-join against what was seen; its result is written to the shared
folder (`session.cut`), so lineage stays flat and a lost executor costs one round at most.  The edge
table is written once, in the partitioning it comes in, so a vertex holding a large share of all edges stays spread
over all partitions; small frontiers are broadcast by Catalyst because the written table carries its real size, and
then edges are never shuffled; large ones shuffle with AQE's skew splitting.  Only counts travel to the driver.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import accumulate, count

from pyspark.sql import DataFrame, functions as F

from codeatlas.operators import chains
from codeatlas.session import cut, drop_scratch

_FOLD_EVERY = 16  # rounds after which the pieces of the seen-set are written as one table
_ROOTS = 100_000  # names whose chains are walked together
_HELD = 24_000_000  # names and steps that a task can take into its memory


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _folded(parts: list[DataFrame]) -> list[DataFrame]:
    return [cut(_union(parts))] if len(parts) > _FOLD_EVERY else parts


def _numbers(names: DataFrame) -> DataFrame:
    """(repo, <name>, num): a number for each distinct row, in the order of the rows, written so that it is fixed.

    Loops then move eight bytes a node instead of its id, and the smallest number is the smallest name.
    """
    return cut(names.distinct().orderBy(*names.columns).withColumn("num", F.monotonically_increasing_id()))


def _dense(names: DataFrame) -> DataFrame:
    """`_numbers` from 0 on without gaps: each written part counts on from the part before."""
    nums = _numbers(names)
    sizes = {r.part: r.n for r in nums.groupBy(F.shiftright("num", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    starts = [0, *accumulate(sizes.get(part, 0) for part in range(max(sizes, default=0)))]
    start = F.array(*[F.lit(x).cast("long") for x in starts])[F.shiftright("num", 33).cast("int")]
    return nums.withColumn("num", start + F.col("num").bitwiseAND(F.lit((1 << 33) - 1)))


def _hashed(names: DataFrame):
    """(repo, id, num) for each distinct name without nulls, and the function that tells the number of a column of names.

    A number that follows from the name needs no join to take the name's place.  Should two names share one, all are numbered anew by
    another seed, so that different names always have different numbers.
    """
    names = names.dropna().distinct()
    for seed in count():
        number = lambda name, seed=seed: F.xxhash64(F.lit(seed), F.col("repo"), F.col(name) if isinstance(name, str) else name)
        nums = cut(names.withColumn("num", number("id")))
        if nums.groupBy("num").count().filter("count > 1").isEmpty():
            return nums, number


def reach(
    edges: DataFrame, starts: DataFrame, *, direction: str = "incoming", max_depth: int | None = None
) -> DataFrame:
    """(repo, origin, id, depth): every id reachable from each start, the start itself left out.

    `starts` has (repo, id).  `incoming` walks edges backwards (who depends on me), `outgoing` forwards.  The result is the
    closure, origins times what they reach: ask for a set of starts, not for all nodes of a large graph.
    """
    near, far = ("dst", "src") if direction == "incoming" else ("src", "dst")
    pairs = edges.select("repo", F.col(near).alias("id"), F.col(far).alias("next")).dropna()
    asked = starts.select("repo", "id").dropna().distinct()
    nums, number = _hashed(pairs.select("repo", "id").unionByName(pairs.select("repo", F.col("next").alias("id"))).unionByName(asked))
    steps = cut(pairs.select(number("id").alias("a"), number("next").alias("b")).distinct())
    frontier = cut(asked.select(number("id").alias("o"), number("id").alias("a"), F.lit(0).alias("depth")))
    seen, depth = [frontier], 0
    while (max_depth is None or depth < max_depth) and frontier.count():
        depth += 1
        found = steps.join(frontier.select("a", "o"), "a").select("o", F.col("b").alias("a")).distinct()
        seen = _folded(seen)
        known = _union(seen).select("o", "a")
        frontier = cut(found.join(known, ["o", "a"], "left_anti").withColumn("depth", F.lit(depth)))
        seen.append(frontier)
    hits = _union(seen).filter("depth > 0")
    to = nums.select(F.col("num").alias("a"), "repo", "id")
    return hits.join(to, "a").join(nums.select(F.col("num").alias("o"), F.col("id").alias("origin")), "o").select("repo", "origin", "id", "depth")


def impact_subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes that transitively depend on each id; dangling ids are walked through but not returned."""
    hits = reach(edges, ids, direction="incoming")
    return nodes.join(hits, ["repo", "id"])


def _chain_steps(symbols: DataFrame, calls: DataFrame, names: DataFrame):
    """Numbers of the names, steps (a, b, info) from callee to caller, and the numbers `o` of the asked names in slices of about `_ROOTS`."""
    who = symbols.select(
        "repo", F.col("id").alias("caller_id"), F.col("name").alias("caller"),
        F.struct("id", "file", "line", "language").alias("info"),
    )
    asked = names.select("repo", "name").distinct()
    sites = cut(
        calls.select("repo", "callee_name", "caller_id").distinct()
        .join(who, ["repo", "caller_id"])
        .groupBy("repo", F.col("callee_name").alias("name"), "caller")
        .agg(F.min("info").alias("info"))
    )
    nums = _dense(sites.select("repo", "name").unionByName(sites.select("repo", F.col("caller").alias("name"))).unionByName(asked))
    number = lambda df, name, out: df.join(nums.select("repo", F.col("name").alias(name), F.col("num").alias(out)), ["repo", name])
    steps = cut(number(number(sites, "name", "a"), "caller", "b").select("a", "b", "info"))
    roots = cut(number(asked, "name", "o").select("o"))
    return nums, steps, roots


def _slices(roots: DataFrame) -> list[DataFrame]:
    slices = max(1, -(-roots.count() // _ROOTS))
    return [roots.filter(F.pmod(F.xxhash64("o"), F.lit(slices)) == i) for i in range(slices)]


def _holds(nums: DataFrame, steps: DataFrame) -> bool:
    return nums.count() + steps.count() <= _HELD


def _held(nums: DataFrame, steps: DataFrame, roots: DataFrame, walk, schema: str, depth: int | None) -> DataFrame:
    """`walk` of `chains`, run by tasks that are each dealt all steps and a share of the roots.

    Walking in memory moves no rows between rounds, where joins shuffle the frontier and all that was seen in each; only the steps
    travel, once a task and many in a row.
    """
    n, cores = nums.count(), steps.sparkSession.sparkContext.defaultParallelism
    tasks = min(2 * cores, roots.count() // 256 + 1)
    infos = _dense(steps.select("info"))
    numbered = steps.join(infos.select(F.col("info").alias("told"), F.col("num").alias("i")), F.col("info").eqNullSafe(F.col("told"))).select("a", "b", "i")
    task = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    dealt_out = [
        numbered.mapInArrow(chains.packed, "steps binary, infos binary").select(task, "steps", "infos"),
        nums.select(task, F.col("num").cast("int").alias("num"), "repo", "name"),
        infos.select(task, F.col("num").cast("int").alias("info"), "info.file", F.col("info.line").cast("int").alias("line"), "info.language"),
        roots.select(F.pmod(F.xxhash64("o"), F.lit(tasks)).cast("int").alias("task"), F.col("o").cast("int").alias("root")),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dealt_out)
    return together.repartitionById(tasks, "task").mapInArrow(lambda batches: walk(batches, n, depth), schema)


def _walk(steps: DataFrame, roots: DataFrame, depth: int | None, folder: str = "") -> list[DataFrame]:
    """(o, a, parent, branch, depth) of the chains of `roots`, one table a level, written to `folder`."""
    frontier = cut(roots.select("o", F.col("o").alias("a"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("branch"), F.lit(0).alias("depth")), folder)
    seen, level = [frontier], 0
    while (depth is None or level < depth) and not frontier.isEmpty():
        level += 1
        found = (
            steps.select("a", "b").join(frontier.select("o", "a", "branch"), "a").groupBy("o", F.col("b").alias("a"))
            .agg(F.min(F.col("a")).alias("parent"), F.min_by("branch", "a").alias("branch"))
        )
        seen = [cut(_union(seen), folder)] if len(seen) > _FOLD_EVERY else seen
        fresh = found.join(_union(seen).select("o", "a"), ["o", "a"], "left_anti")
        frontier = cut(fresh.select("o", "a", "parent", F.coalesce("branch", "a").alias("branch"), F.lit(level).alias("depth")), folder)
        seen.append(frontier)
    return seen


def upstream_chain(symbols: DataFrame, calls: DataFrame, names: DataFrame, depth: int | None = None) -> DataFrame:
    """Transitive callers by name: (repo, root, name, parent, branch, depth, file, line, language).

    Breadth first, so `depth` is the least one; of several parents at that depth the smallest name is kept and
    `branch` is the first-level caller the row hangs under.  With a bound on the depth, `cut` tells the roots that have callers
    beyond it.  Steps that a task can hold are walked in memory; else, and with a bounded depth, names are walked slice by slice by joins, so
    what a round shuffles doesn't grow with the number of names asked.
    """
    nums, steps, asked = _chain_steps(symbols, calls, names)
    if depth is None and _holds(nums, steps):
        return _held(nums, steps, asked, chains.chain, chains.CHAIN, depth)
    walked = [_walk(steps, roots, depth) for roots in _slices(asked)]
    seen = _union([piece for pieces in walked for piece in pieces])
    named = lambda df, num, out: df.join(nums.select(F.col("num").alias(num), F.col("name").alias(out)), num)
    hits = seen.filter("depth > 0").join(steps.select(F.col("a").alias("parent"), F.col("b").alias("a"), "info"), ["parent", "a"])
    hits = hits.join(nums.select(F.col("num").alias("o"), "repo", F.col("name").alias("root")), "o")
    if depth is not None:
        last = _union([pieces[-1] for pieces in walked])
        beyond = steps.select("a", "b").join(last.select("o", "a"), "a").select("o", F.col("b").alias("a")).distinct()
        cut_roots = beyond.join(seen.select("o", "a"), ["o", "a"], "left_anti").select("o").distinct().withColumn("_cut", F.lit(True))
        hits = hits.join(cut_roots, "o", "left").withColumn("cut", F.coalesce("_cut", F.lit(False)))
    out = named(named(named(hits.withColumnsRenamed({"a": "n1", "parent": "n2", "branch": "n3"}), "n1", "name"), "n2", "parent"), "n3", "branch")
    more = [] if depth is None else ["cut"]
    return out.select("repo", "root", "name", "parent", "branch", "depth", "info.file", F.col("info.line").cast("int").alias("line"), "info.language", *more)


def chain_roots(symbols: DataFrame, calls: DataFrame, names: DataFrame, depth: int | None = None) -> DataFrame:
    """(repo, root, name, file, line, upstream): the first-level callers of `upstream_chain`, and how many rows hang under each.

    The whole chains are walked, but only their counts are kept.  Steps that a task can hold are walked in memory; by joins, a slice's
    levels are dropped once they are counted.
    """
    nums, steps, asked = _chain_steps(symbols, calls, names)
    if _holds(nums, steps):
        return cut(_held(nums, steps, asked, chains.roots_of, chains.ROOTS, depth))
    counts = []
    for roots in _slices(asked):
        folder = f"chain-{uuid.uuid4().hex}"
        hung = _union(_walk(steps, roots, depth, folder)).filter("depth > 0").groupBy("o", F.col("branch").alias("a"))
        counts.append(cut(hung.agg((F.count("*") - 1).alias("upstream"))))
        drop_scratch(steps.sparkSession, folder)
    first = _union(counts).join(steps.select(F.col("a").alias("o"), F.col("b").alias("a"), "info"), ["o", "a"])
    first = first.join(nums.select(F.col("num").alias("o"), "repo", F.col("name").alias("root")), "o").join(nums.select(F.col("num").alias("a"), "name"), "a")
    return first.select("repo", "root", "name", "info.file", F.col("info.line").cast("int").alias("line"), "upstream")


def shortest_paths(nodes: DataFrame, edges: DataFrame, src: str, targets: list[str] | DataFrame) -> DataFrame:
    """(repo, src, dst, path, length): one shortest outgoing path per reachable target; none gives no row.

    `targets` are ids, or a table (repo, id).  Each level keeps one parent per node (the smallest id).  Paths are only put
    together for the targets, in one walk from the last level to the first that takes up the targets of each level on its way.
    """
    steps = cut(edges.select("repo", F.col("src").alias("id"), F.col("dst").alias("next")))
    known_nodes = nodes.select("repo", "id")
    nothing = F.lit(None).cast("string")
    levels = [cut(known_nodes.filter(F.col("id") == src).select("repo", "id", nothing.alias("parent")))]
    wanted = known_nodes.filter(F.col("id").isin(targets)) if isinstance(targets, list) else known_nodes.join(targets.select("repo", "id").distinct(), ["repo", "id"], "left_semi")
    wanted = cut(wanted.join(levels[0].select("repo"), "repo", "left_semi"))
    reached = lambda level: level.join(wanted, ["repo", "id"], "left_semi")
    todo = wanted.count() - reached(levels[0]).count()
    seen = [levels[0].select("repo", "id")]
    while todo > 0 and levels[-1].count():
        found = (
            steps.join(levels[-1].select("repo", "id"), ["repo", "id"])
            .groupBy("repo", F.col("next").alias("id"))
            .agg(F.min("id").alias("parent"))
        )
        seen = _folded(seen)
        levels.append(cut(found.join(_union(seen), ["repo", "id"], "left_anti")))
        seen.append(levels[-1].select("repo", "id"))
        todo -= reached(levels[-1]).count()
    rows = None
    for length in range(len(levels) - 1, -1, -1):
        level = levels[length]
        if rows is not None:
            up = level.select("repo", F.col("id").alias("parent"), F.col("parent").alias("above"))
            rows = rows.join(up, ["repo", "parent"]).select("repo", "dst", F.col("above").alias("parent"), F.concat(F.array("parent"), "path").alias("path"), "length")
        here = reached(level).select("repo", F.col("id").alias("dst"), "parent", F.array("id").alias("path"), F.lit(length).alias("length"))
        rows = here if rows is None else rows.unionByName(here)
        if length % _FOLD_EVERY == 0 and length:
            rows = cut(rows)
    return rows.select("repo", F.lit(src).alias("src"), "dst", "path", "length")


def shortest_path(nodes: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    return shortest_paths(nodes, edges, src, [dst])


# ---------------------------------------------------------------- strongly connected components


def _trim(edges: DataFrame, scope: list[str], peels: int = 3, worth: float = 0.1) -> DataFrame:
    """Drop edges that cannot lie on a cycle: their source is never entered or their target never left.

    Peeling goes on while it pays; what is left of the acyclic part is sorted out by the colours.
    """
    size = edges.count()
    while True:
        kept = edges
        for _ in range(peels):  # several peels per written table keep the number of jobs low
            entered = kept.select(*scope, F.col("dst").alias("src")).distinct()
            left = kept.select(*scope, F.col("src").alias("dst")).distinct()
            kept = kept.join(entered.hint("merge"), [*scope, "src"], "left_semi").join(left.hint("merge"), [*scope, "dst"], "left_semi")
        kept = cut(kept)
        now = kept.count()
        if now >= size * (1 - worth) or now == 0:
            return kept
        edges, size = kept, now


def _colours(edges: DataFrame, hops: int = 8) -> DataFrame:
    """(id, ahead, behind): the largest number that reaches each node, and the largest number it reaches.

    Both directions run in one loop, told apart by `way`.  Between written tables every label goes several hops, and
    each node also takes over the label of its label (what reaches my label reaches me).
    """
    fwd = edges.select(F.lit(0).alias("way"), F.col("src").alias("id"), F.col("dst").alias("next"))
    bwd = edges.select(F.lit(1).alias("way"), F.col("dst").alias("id"), F.col("src").alias("next"))
    moves = fwd.unionByName(bwd)
    ids = moves.select("way", "id").unionByName(moves.select("way", F.col("next").alias("id"))).distinct()
    # A stay-put step per node lets one join carry both the pushed and the kept labels.
    steps = cut(
        moves.withColumn("stay", F.lit(False)).unionByName(ids.select("way", "id", F.col("id").alias("next"), F.lit(True).alias("stay")))
    )
    labels = steps.filter("stay").select("way", "id", F.col("id").alias("label"))
    while True:
        grown = labels.withColumn("old", F.col("label"))
        for _ in range(hops):
            grown = (
                steps.join(grown.hint("merge"), ["way", "id"]).groupBy("way", F.col("next").alias("id"))
                .agg(F.max("label").alias("label"), F.max(F.when(F.col("stay"), F.col("old"))).alias("old"))
            )
        grown = cut(grown)
        if grown.filter("label <> old").isEmpty():
            return grown.groupBy("id").agg(
                F.max(F.when(F.col("way") == 0, F.col("label"))).alias("ahead"),
                F.max(F.when(F.col("way") == 1, F.col("label"))).alias("behind"),
            )
        over = grown.select("way", F.col("id").alias("label"), F.col("label").alias("further"))
        labels = grown.drop("old").join(over.hint("merge"), ["way", "label"]).select("way", "id", F.greatest("label", "further").alias("label"))


def cycles(edges: DataFrame) -> DataFrame:
    """(repo, node, component, size) of components with more than one node, plus self-loops; named by their largest id.

    Two-way colouring: trim what lies on no cycle, then give every node the largest number reaching it and the largest
    it reaches.  Where both are the same, the node and the node of that number reach each other, so they form a
    component.  Edges between differently coloured nodes cannot lie inside a component and are dropped; the rest goes
    another round, each of which settles at least the component of the largest number left.

    Nodes are numbered once in a written table, so the numbers are fixed; the loop then moves eight bytes per node
    instead of ids and aggregates by hash.  Both sides of every join are as large as the graph, and there are many joins, so none
    is broadcast: the driver would hold each in turn, however small its file.
    """
    pairs = cut(edges.select("repo", "src", "dst").distinct())
    loops = pairs.filter("src = dst").select("repo", F.col("src").alias("node"), F.col("src").alias("component"))
    core = _trim(pairs.filter("src <> dst"), ["repo"])
    ends = core.select("repo", F.col("src").alias("node")).unionByName(core.select("repo", F.col("dst").alias("node")))
    names = cut(ends.distinct().withColumn("id", F.monotonically_increasing_id()))
    a = names.select("repo", F.col("node").alias("src"), F.col("id").alias("a"))
    b = names.select("repo", F.col("node").alias("dst"), F.col("id").alias("b"))
    rest = cut(core.join(a.hint("merge"), ["repo", "src"]).join(b.hint("merge"), ["repo", "dst"]).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    found = []
    while not rest.isEmpty():
        colour = cut(_colours(rest))
        found.append(colour.filter("ahead = behind").select("id", F.col("ahead").alias("group")))
        open_ids = colour.filter("ahead <> behind")
        a = open_ids.select(F.col("id").alias("src"), F.struct("ahead", "behind").alias("a"))
        b = open_ids.select(F.col("id").alias("dst"), F.struct("ahead", "behind").alias("b"))
        rest = _trim(rest.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").filter("a = b").select("src", "dst"), [])
    if not found:
        return loops.withColumn("size", F.lit(1).cast("long"))
    groups = _union(found).join(names.hint("merge"), "id")
    # A node settled alone lies on no cycle.
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"), F.max("node").alias("component")).filter("size > 1")
    members = groups.join(sizes.hint("merge"), "group").select("repo", "node", "component", "size")
    lone = loops.join(members.select("repo", "node").hint("merge"), ["repo", "node"], "left_anti")
    return members.unionByName(lone.withColumn("size", F.lit(1).cast("long")))


# ---------------------------------------------------------------- topological levels


def topo_levels(ids: DataFrame, deps: DataFrame, rounds: int = 4) -> DataFrame:
    """(repo, id, level, cyclic): prerequisites before dependents; level is null for ids held up by a cycle.

    `deps` has (repo, id, prereq).  Every id carries the number of its open prerequisites; a level is what has none left, and
    takes one off its dependents for each.  Ids are numbered by hash, and a level meets the edges once; the table of open ids is
    written anew every few `rounds`, and only what was taken off since is added up in between.
    """
    nameless = ids.select("repo", "id").filter("repo IS NULL OR id IS NULL").distinct()  # waits for nothing
    pairs = deps.select("repo", "id", "prereq").dropna()
    _, number = _hashed(ids.select("repo", "id").unionByName(pairs.select("repo", "id")).unionByName(pairs.select("repo", F.col("prereq").alias("id"))))
    known = cut(ids.select("repo", "id").dropna().distinct().withColumn("n", number("id")))
    needs = cut(
        pairs.select(number("id").alias("n"), number("prereq").alias("p")).distinct()
        .join(known.select("n"), "n", "left_semi").join(known.select(F.col("n").alias("p")), "p", "left_semi")
    )
    open_ = cut(needs.groupBy("n").agg(F.count("*").alias("missing")))
    now = cut(known.select("n").join(open_, "n", "left_anti"))
    done, offs, level = [], [], 0
    added = lambda parts: _union(parts).groupBy("n").agg(F.sum("off").alias("off"))
    while not now.isEmpty():
        done = _folded([*done, now.withColumn("level", F.lit(level))])
        level += 1
        off = cut(needs.join(now.withColumnRenamed("n", "p"), "p").groupBy("n").agg(F.count("*").alias("off")))
        offs.append(off)
        total = off if len(offs) == 1 else added([o.join(off.select("n"), "n", "left_semi") for o in offs])
        now = cut(open_.join(total, "n").filter("missing = off").select("n"))
        if len(offs) >= rounds:
            left = F.col("missing") - F.coalesce("off", F.lit(0))
            open_ = cut(open_.join(added(offs), "n", "left").select("n", left.alias("missing")).filter("missing > 0"))
            offs = []
    levels = _union(done) if done else now.withColumn("level", F.lit(0))
    named = known.join(levels, "n", "left").select("repo", "id", "level")
    return named.unionByName(nameless.withColumn("level", F.lit(0))).withColumn("cyclic", F.col("level").isNull())
