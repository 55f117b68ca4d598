"""Lines of code, size, complexity, churn, search, markers and debt over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.functions.scan import keep_where
from codeatlas.functions.text import EDGE, basename, split_lines, trim, words_pattern
from codeatlas.sources.corpus import glob_pattern

# Marker words, branch tokens, and the tiers of the mood.
MARKERS = "TODO|FIXME|HACK|XXX|NOTE|WARN|BUG|OPTIMIZE|REVIEW"
BRANCH_TOKENS = r"if|else|switch|case|for|while|catch|&&|\|\||\?"
COMMENT_PREFIXES = ["//", "#", "--"]


def classify_lines(files: DataFrame, text: str = "content", keep: list[str] = ("repo", "path")) -> DataFrame:
    """(keep..., lines, blank, comment, code) per file.

    The block-comment state runs through the lines of one file inside one expression, so nothing is shuffled.  Files
    without a block opener skip the state and count by prefix.
    """
    lines = F.transform(split_lines(text), lambda x: trim(x))
    prefixed = lambda x: F.lit(False) | x.startswith("//") | x.startswith("#") | x.startswith("--")
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("blank"), F.lit(0).alias("comment"))

    def step(acc, x):
        blank, opens, closes = x == "", x.startswith("/*"), x.contains("*/")
        inside = acc["open"] & ~blank
        comment = inside | opens | prefixed(x)
        still = F.when(blank, acc["open"]).when(acc["open"], ~closes).otherwise(opens & ~closes)
        return F.struct(
            still.alias("open"),
            (acc["blank"] + blank.cast("int")).alias("blank"),
            (acc["comment"] + (comment & ~blank).cast("int")).alias("comment"),
        )

    stateful = F.aggregate("lines_", start, step)
    simple = F.struct(
        F.lit(False).alias("open"),
        F.size(F.filter("lines_", lambda x: x == "")).alias("blank"),
        F.size(F.filter("lines_", prefixed)).alias("comment"),
    )
    counted = files.withColumn("lines_", lines).withColumn(
        "state", F.when(F.col(text).contains("/*"), stateful).otherwise(simple)
    )
    total = F.size("lines_")
    return counted.select(
        *keep, total.cast("long").alias("lines"), F.col("state.blank").cast("long").alias("blank"),
        F.col("state.comment").cast("long").alias("comment"),
        (total - F.col("state.blank") - F.col("state.comment")).cast("long").alias("code"),
    )


def loc_by_language(files: DataFrame, sort: str = "code", text: str = "content") -> DataFrame:
    """(repo, language, files, lines, blank, comment, code, share), a total per repo with language `total` included."""
    counted = classify_lines(files, text, ["repo", "language"])
    summed = counted.rollup("repo", "language").agg(
        F.grouping_id().alias("_level"), F.count("*").alias("files"),
        *[F.sum(c).alias(c) for c in ("lines", "blank", "comment", "code")],
    ).filter("_level < 2")
    total = summed.filter("_level = 1").select("repo", F.col(sort).alias("_all"))
    return (
        summed.join(total, "repo")
        .select(
            "repo", F.when(F.col("_level") == 1, "total").otherwise(F.col("language")).alias("language"),
            "files", "lines", "blank", "comment", "code",
            F.when(F.col("_all") > 0, F.round(F.col(sort) * 100.0 / F.col("_all"), 1)).otherwise(F.lit(0.0)).alias("share"),
        )
        .orderBy("repo", F.desc(sort), "language")
    )


def line_count(text: Column | str) -> Column:
    return F.size(split_lines(text)).cast("long")


def largest_files(files: DataFrame, k: int = 10) -> DataFrame:
    sized = files.select("repo", "path", line_count("content").alias("lines"), F.col("size").alias("bytes"))
    return sized.orderBy(F.desc("lines"), "repo", "path").limit(k)


def complexity_hotspots(files: DataFrame, k: int = 10, min_lines: int = 20, min_branches: int = 5) -> DataFrame:
    """(repo, path, branches, lines, density): most branch tokens per line among files worth looking at."""
    pattern = f"{EDGE}(?:{BRANCH_TOKENS}){EDGE}"
    counts = F.struct(
        line_count("content").alias("lines"), F.regexp_count("content", F.lit(pattern)).cast("long").alias("branches")
    )
    counted = keep_where(files, "n", counts, lambda n: (n["lines"] > min_lines) & (n["branches"] > min_branches))
    density = F.round(F.col("n.branches") / F.col("n.lines"), 6)
    return counted.select("repo", "path", "n.branches", "n.lines", density.alias("density")).orderBy(
        F.desc("density"), "repo", "path"
    ).limit(k)


def churn(commits: DataFrame, as_of: Column, days: int = 90, k: int = 10) -> DataFrame:
    """(repo, file, commits) of the most often changed files in the window."""
    recent = commits.filter((F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= as_of))
    return recent.groupBy("repo", "file").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "repo", "file").limit(k)


def search_text(
    files: DataFrame, query: str, *, regex: bool = False, glob: str | None = None, max_per_file: int | None = None,
    max_total: int | None = None,
) -> DataFrame:
    """(repo, path, line, text) of matching lines, in path order if `max_total` is given; plain search ignores case.

    `glob` picks files: `*` stays within a directory, `**` does not; without a slash it is tried on the file's name.

    Matches are taken inside the file's own line array, so only hits leave the scan and no window is needed for the
    limit per file.
    """
    if glob is not None:
        at = F.col("path") if "/" in glob else basename("path")
        files = files.filter(at.rlike(f"^{glob_pattern(glob)}$"))
    hit = (lambda x: x["text"].rlike(query)) if regex else (lambda x: F.lower(x["text"]).contains(query.lower()))
    numbered = F.transform(split_lines("content"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    found = F.filter(numbered, hit)
    if max_per_file is not None:
        found = F.slice(found, 1, max_per_file)
    rows = files.select("repo", "path", F.explode(found).alias("m")).select("repo", "path", "m.line", "m.text")
    if max_total is None:
        return rows
    return rows.orderBy("repo", "path", "line").limit(max_total)


def scan_markers(lines: DataFrame, types: list[str] | None = None, pattern: str = MARKERS) -> DataFrame:
    """(repo, path, line, type, text): the first marker of each line, upper-cased, with the rest of the line."""
    full = rf"(?i)(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])[:\s-]*([^\n]*)"
    found = lines.filter(F.col("text").rlike(full)).select(
        "repo", "path", "line",
        F.upper(F.regexp_extract("text", full, 1)).alias("type"), trim(F.regexp_extract("text", full, 2)).alias("text"),
    )
    return found if types is None else found.filter(F.col("type").isin([t.upper() for t in types]))


def group_markers(markers: DataFrame, by: str = "type") -> DataFrame:
    """Markers with the size of their group.  Items stay rows: one popular group never becomes one value."""
    who = F.coalesce(F.col(by), F.lit("unknown"))
    counts = markers.groupBy("repo", who.alias("group")).agg(F.count("*").alias("count"))
    return markers.withColumn("group", who).join(counts, ["repo", "group"])


def age_label(days: Column) -> Column:
    """today / 1 day ago / N days ago / Nmo ago / Ny ago."""
    months = F.floor(days / 30)
    return (
        F.when(days == 0, "today").when(days == 1, "1 day ago")
        .when(days < 30, F.concat_ws(" ", days.cast("string"), F.lit("days ago")))
        .when(months < 12, F.concat(months.cast("string"), F.lit("mo ago")))
        .otherwise(F.concat(F.floor(months / 12).cast("string"), F.lit("y ago")))
    )


def join_blame(markers: DataFrame, blame: DataFrame, as_of: Column) -> DataFrame:
    """Markers with author, time and age; lines nobody committed are `uncommitted` and `new`."""
    days = F.timestamp_diff("DAY", F.col("ts"), as_of)
    return markers.join(blame.select("repo", "path", "line", "author", "ts"), ["repo", "path", "line"], "left").select(
        "repo", "path", "line", "type", "text", F.coalesce("author", F.lit("uncommitted")).alias("author"), "ts",
        F.coalesce(age_label(days), F.lit("new")).alias("age"),
    )


def mood(debt: Column, tests: Column, commits_week: Column) -> Column:
    tested = tests > 0
    return (
        F.when((debt == 0) & tested, "Immaculate")
        .when((debt < 5) & tested & (commits_week > 5), "Cautiously Optimistic")
        .when((debt < 15) & tested, "Content")
        .when(debt < 30, "Pensive")
        .when(debt < 60, "Nervous Laughter")
        .when(~tested & (debt > 30), "This Is Fine")
        .otherwise("Send Help")
    )


def debt_score(
    files: DataFrame, activity: DataFrame, words: tuple[str, str, str] = ("TODO", "FIXME", "HACK"), tests: Column | None = None
) -> DataFrame:
    """(repo, todo, fixme, hack, debt, health, mood); `activity` has (repo, commits_week).

    `tests` flags a file as a test; by default test and spec files that call `it(`.
    """
    if tests is None:
        tests = F.col("path").rlike(r"\.(test\.ts|test\.js|spec\.ts)$") & F.col("content").contains("it(")
    count = lambda w: F.sum(F.regexp_count("content", F.lit("(?i)" + words_pattern(w))))
    sums = files.groupBy("repo").agg(
        count(words[0]).alias("todo"), count(words[1]).alias("fixme"), count(words[2]).alias("hack"),
        F.count_if(tests).alias("tests"),
    )
    debt = F.col("todo") + 2 * F.col("fixme") + 3 * F.col("hack")
    return (
        sums.join(activity.select("repo", "commits_week"), "repo", "left")
        .withColumn("debt", debt)
        .withColumn("health", F.greatest(F.lit(0), 100 - 2 * F.col("debt")))
        .withColumn("mood", mood(F.col("debt"), F.col("tests"), F.coalesce("commits_week", F.lit(0))))
        .select("repo", "todo", "fixme", "hack", "debt", "health", "mood")
    )


# Files that show continuous integration and pinned dependencies.
CI_PATHS = r"^(\.github/workflows/|\.gitlab-ci\.yml$|Jenkinsfile$)"
LOCK_FILES = r"^(package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$"


def repo_summary(files: DataFrame) -> DataFrame:
    """(repo, files, lines, avg_lines, largest, largest_lines, languages, has_ci, has_lockfile)."""
    sized = files.withColumn("n", line_count("content"))
    out = sized.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum("n").alias("lines"),
        # of equally long files the first path wins
        F.min(F.struct((-F.col("n")).alias("n"), F.col("path"))).alias("top"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
        F.bool_or(F.col("path").rlike(CI_PATHS)).alias("has_ci"),
        F.bool_or(F.col("path").rlike(LOCK_FILES)).alias("has_lockfile"),
    )
    return out.select(
        "repo", "files", "lines", F.floor(F.col("lines") / F.col("files") + 0.5).cast("long").alias("avg_lines"),
        basename("top.path").alias("largest"), (-F.col("top.n")).alias("largest_lines"), "languages", "has_ci", "has_lockfile",
    )
