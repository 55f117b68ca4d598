"""Commit and activity logs: recent files, branches, conventions, contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeatlas.operators.graph import rank_by_histogram

# Branches that are never stale, ticket styles (label, pattern, how a ticket looks), commit types.
DEFAULT_BRANCHES = ["main", "master"]
TICKET_STYLES = [
    ("jira", r"^([A-Z]{2,10}-\d+)", r"[A-Z]{2,10}-\d+"),
    ("jira-colon", r"^([A-Z]{2,10}-\d+)\s*:", r"[A-Z]{2,10}-\d+"),
    ("bracket-ticket", r"^\[([A-Z]{2,10}-\d+)\]", r"[A-Z]{2,10}-\d+"),
    ("gh-issue", r"^#(\d+)", r"#\d+"),
]
CONVENTIONAL = r"^(feat|fix|docs|style|refactor|perf|test|chore|ci|build)(\([^)]+\))?[!]?:\s"
CONVENTIONAL_STYLE = r"^(feat|fix|chore|docs|style|refactor|test|perf|ci|build|revert)(\(.+?\))?:"
SAMPLE, SHARE, LEAST_MESSAGES = 20, 0.3, 3


def _since(as_of: Column, days: int) -> Column:
    return (F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= as_of)


def recent_files(commits: DataFrame, as_of: Column, days: int = 7, author: str | None = None, limit: int = 30) -> DataFrame:
    """(repo, file, commits, last_ts, authors): most committed files of the window, then the most recent.

    Authors are gathered for the reported files only.
    """
    window = commits.filter(_since(as_of, days))
    if author is not None:
        window = window.filter(F.col("author") == author)
    top = (
        window.groupBy("repo", "file").agg(F.count("*").alias("commits"), F.max("ts").alias("last_ts"))
        .orderBy(F.desc("commits"), F.desc("last_ts"), "repo", "file").limit(limit)
    )
    who = (
        window.select("repo", "file", "author").join(F.broadcast(top.select("repo", "file")), ["repo", "file"], "left_semi")
        .distinct().groupBy("repo", "file").agg(F.array_sort(F.collect_list("author")).alias("authors"))
    )
    return top.join(who, ["repo", "file"])


def recency_bucket(ts: Column, as_of: Column) -> Column:
    age = F.timestamp_diff("SECOND", ts, as_of)
    return F.when(age < 86400, "today").when(age < 7 * 86400, "week").otherwise("earlier")


def recency_buckets(recent: DataFrame, as_of: Column) -> DataFrame:
    return recent.withColumn("bucket", recency_bucket(F.col("last_ts"), as_of))


def standup(commits: DataFrame, author: str, as_of: Column, days: int = 1, merge: Column | None = None) -> DataFrame:
    """The author's own commits of the window, newest first; merges do not count."""
    is_merge = F.col("subject").startswith("Merge ") if merge is None else merge
    mine = commits.filter((F.col("author") == author) & _since(as_of, days) & ~F.coalesce(is_merge, F.lit(False)))
    return mine.select("repo", "hash", "author", "ts", "subject").distinct().orderBy(F.desc("ts"), "repo", "hash")


def stale_branches(
    branch_commits: DataFrame, merged: DataFrame, as_of: Column, days: int = 90, default: list[str] = DEFAULT_BRANCHES
) -> DataFrame:
    """(repo, branch, last_ts, old, merged) of branches that are old or merged, default branches aside."""
    last = branch_commits.filter(~F.col("branch").isin(default)).groupBy("repo", "branch").agg(F.max("ts").alias("last_ts"))
    flagged = last.join(merged.select("repo", "branch").distinct().withColumn("m", F.lit(True)), ["repo", "branch"], "left")
    old = F.col("last_ts") < as_of - F.expr(f"INTERVAL {days} DAYS")
    return flagged.select("repo", "branch", "last_ts", old.alias("old"), F.coalesce("m", F.lit(False)).alias("merged")).filter(
        "old or merged"
    )


def _sample(commits: DataFrame, newest_messages: int) -> DataFrame:
    newest = Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("hash"))
    one = commits.select("repo", "hash", "ts", "subject").distinct()
    return one.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= newest_messages)


def commit_convention(commits: DataFrame, newest_messages: int = SAMPLE) -> DataFrame:
    """(repo, format, ticket_pattern, types) of repos with a clear convention among their newest messages."""
    sample = _sample(commits, newest_messages)
    counts = sample.groupBy("repo").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("subject").rlike(CONVENTIONAL)).alias("typed"),
        F.array_sort(F.collect_set(F.when(F.col("subject").rlike(CONVENTIONAL), F.regexp_extract("subject", CONVENTIONAL, 1)))).alias("types"),
        *[F.count_if(F.col("subject").rlike(p)).alias(f"_{i}") for i, (_, p, _) in enumerate(TICKET_STYLES)],
    ).filter(F.col("n") >= LEAST_MESSAGES)
    # the most frequent style wins, the earlier listed one on a tie
    best = F.greatest(*[F.struct(F.col(f"_{i}").alias("n"), F.lit(-i).alias("i")) for i in range(len(TICKET_STYLES))])
    told = counts.withColumn("best", best)
    ticketed = (F.col("best.n") > 0) & (F.col("best.n") >= F.col("n") * SHARE)
    typed = F.col("typed") >= F.col("n") * SHARE
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), -F.col("best.i"))
    label = pick([s[0] for s in TICKET_STYLES])
    both = (
        F.when(label == "bracket-ticket", "[{ticket}] {type}({scope}): {description}")
        .when(label == "jira-colon", "{ticket}: {type}({scope}): {description}")
        .otherwise("{ticket} {type}({scope}): {description}")
    )
    alone = F.when(label == "bracket-ticket", "[{ticket}] {description}").otherwise("{ticket}: {description}")
    form = F.when(ticketed & typed, both).when(ticketed, alone).when(typed, "{type}({scope}): {description}")
    return told.select(
        "repo", form.alias("format"), F.when(ticketed, pick([s[2] for s in TICKET_STYLES])).alias("ticket_pattern"), "types"
    ).filter("format is not null")


def commit_style(commits: DataFrame, branches: DataFrame | None = None, newest_messages: int = SAMPLE) -> DataFrame:
    """(repo, commit_convention, branch_pattern): conventional when half of the newest messages are."""
    sample = _sample(commits, newest_messages).groupBy("repo").agg(
        F.count("*").alias("n"), F.count_if(F.col("subject").rlike(CONVENTIONAL_STYLE)).alias("typed")
    )
    style = F.when((F.col("typed") > 0) & (F.col("typed") >= F.col("n") * 0.5), "conventional").otherwise("freeform")
    out = sample.select("repo", style.alias("commit_convention"))
    if branches is None:
        return out.withColumn("branch_pattern", F.lit("unknown"))
    named = branches.groupBy("repo").agg(
        F.bool_or(F.col("branch").rlike(r"^(feat|feature)/")).alias("feature"),
        F.bool_or(F.col("branch").rlike(r"^(develop|release/|hotfix/)")).alias("flow"),
    )
    pattern = F.when(F.col("feature"), "feat/<name>").when(F.col("flow"), "gitflow").when(
        F.col("feature").isNotNull(), "<type>/<name>"
    ).otherwise("unknown")
    return out.join(named, "repo", "left").select("repo", "commit_convention", pattern.alias("branch_pattern"))


def contributors_pace(commits: DataFrame, as_of: Column) -> DataFrame:
    """(repo, author, commits, week, rank): commits per author, of the last 7 days, and the rank in the repo."""
    counted = commits.groupBy("repo", "author").agg(
        F.count_distinct("hash").alias("commits"), F.count_distinct(F.when(_since(as_of, 7), F.col("hash"))).alias("week")
    )
    return rank_by_histogram(counted, "commits")


def status_counts(status: DataFrame) -> DataFrame:
    """(repo, staged, modified, untracked, conflicts) from short status lines (repo, line)."""
    line = F.col("line")
    return status.groupBy("repo").agg(
        F.count_if(line.rlike(r"^[MADRC]")).alias("staged"), F.count_if(line.rlike(r"^.[MD]")).alias("modified"),
        F.count_if(line.startswith("??")).alias("untracked"), F.count_if(line.rlike(r"^(U.|.U|AA|DD)")).alias("conflicts"),
    )


def top_accessed(reads: DataFrame, k: int = 15) -> DataFrame:
    """(repo, file, reads): the most read files."""
    return reads.groupBy("repo", "file").agg(F.count("*").alias("reads")).orderBy(F.desc("reads"), "repo", "file").limit(k)


def first_queries(searches: DataFrame, k: int = 10) -> DataFrame:
    """(query, first_ts): the first k distinct search queries (ts, query)."""
    return searches.groupBy("query").agg(F.min("ts").alias("first_ts")).orderBy("first_ts", "query").limit(k)
