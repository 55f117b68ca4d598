"""Environment files, dependency bookkeeping and command logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeatlas.functions.text import split_lines, trim

# What makes a key look secret, tools that are never imported, and the command rules.
SECRET_KEYS = (
    r"(?i)password|secret|token|key|api_key|private|credential|auth|jwt|bearer|connection_string|database_url|dsn"
)
TOOL_PREFIXES = [
    "typescript", "eslint", "prettier", "vitest", "jest", "mocha", "tsx", "ts-node", "nodemon", "@types/", "lint-staged",
    "husky", "turbo", "webpack", "vite", "rollup", "esbuild",
]
SAFE_COMMANDS = [
    "ls", "cat", "head", "tail", "wc", "echo", "pwd", "whoami", "date", "which", "env", "find", "grep", "rg", "fd",
    "git status", "git diff", "git log", "git show", "git branch", "git tag", "git remote", "git rev-parse", "npm test",
    "npx vitest", "npx jest", "npx tsc", "npx eslint", "npx prettier", "node", "deno", "bun test", "bun run", "cargo test",
    "go test", "python -m pytest",
]
DANGEROUS_COMMANDS = [
    r"\brm\b.*-[a-zA-Z]*[rf][a-zA-Z]*", r"\brm\b.*--recursive", r"\brm\b.*--force", r"^git\s+push(\s|$)",
    r"^git\s+reset(\s|$)", r"^git\s+rebase(\s|$)", r"^git\s+push\s+.*--force", r"^git\s+checkout\s+--(\s|$)",
    r"^git\s+branch\s+(-d|-D)(\s|$)", r"^chmod(\s|$)", r"^chown(\s|$)", r"^sudo(\s|$)", r"^su\s+-(\s|$)", r"^su\s*$", r"\|",
]
BLOCKED_COMMANDS = [
    r"\brm\b.*-[a-zA-Z]*r[a-zA-Z]*f[a-zA-Z]*\s*/", r"\brm\b.*-[a-zA-Z]*f[a-zA-Z]*r[a-zA-Z]*\s*/", r"^sudo(\s|$)",
    r"^su\s+-(\s|$)", r"^su\s*$", r"^mkfs(\s|$)", r"^dd(\s|$)", r"^chmod\s+777\s+/", r"^shutdown(\s|$)", r"^reboot(\s|$)",
]
SAFE_PATTERN = "^(?:" + "|".join(c.replace(" ", r"\s+") for c in SAFE_COMMANDS) + r")(\s|$)"


def parse_env(files: DataFrame) -> DataFrame:
    """(repo, file, line, key, value, comment, raw) of env files (repo, path, content).

    A comment belongs to the setting right after it, unless a blank line stands between.  The look back happens inside
    the file's own line array: no window, no shuffle.
    """
    told = F.transform(
        split_lines("content"),
        lambda x, i: F.struct((i + 1).alias("line"), trim(x).alias("t"), x.alias("raw")),
    )
    kind = lambda t: (
        F.when(t == "", "blank").when(t.startswith("#"), "comment").when(t.contains("="), "setting")
    )
    marked = files.withColumn("_e", F.filter(told, lambda x: kind(x["t"]).isNotNull()))
    linked = F.transform(
        "_e",
        lambda x, i: F.struct(
            x["line"].alias("line"), x["t"].alias("t"), x["raw"].alias("raw"), F.get(F.col("_e"), i - 1)["t"].alias("above")
        ),
    )
    settings = marked.select(
        "repo", F.col("path").alias("file"), F.explode(F.filter(linked, lambda x: kind(x["t"]) == "setting")).alias("s")
    )
    value = trim(F.regexp_extract("s.t", r"(?s)^[^=]*=(.*)$", 1))
    quoted = (value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'"))
    return settings.select(
        "repo", "file", "s.line", trim(F.substring_index("s.t", "=", 1)).alias("key"),
        F.when(quoted & (F.length(value) > 1), F.substr(value, F.lit(2), F.length(value) - 2))
        .when(quoted, F.lit("")).otherwise(value).alias("value"),
        F.when(F.col("s.above").startswith("#"), trim(F.substr("s.above", F.lit(2)))).alias("comment"), F.col("s.raw").alias("raw"),
    )


def likely_secret(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).rlike(SECRET_KEYS)


def env_inventory(settings: DataFrame) -> DataFrame:
    return settings.groupBy("repo", "file").agg(
        F.count("*").alias("vars"), F.count_if(likely_secret("key")).alias("secrets"), F.count_if(F.col("value") == "").alias("empty")
    )


def env_drift(actual: DataFrame, example: DataFrame) -> DataFrame:
    """(repo, key, side): `missing` only in the example, `extra` only in the actual file, `common` in both."""
    a = actual.select("repo", "key").distinct().withColumn("a", F.lit(True))
    b = example.select("repo", "key").distinct().withColumn("b", F.lit(True))
    side = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").otherwise("common")
    return a.join(b, ["repo", "key"], "full").select("repo", "key", side.alias("side"))


def env_empty(settings: DataFrame) -> DataFrame:
    return settings.filter(F.col("value") == "").select("repo", "file", "line", "key", "comment")


def env_validate(settings: DataFrame) -> DataFrame:
    """(repo, file, line, key, issue): repeated keys from the second on, odd keys, empty secrets, unquoted blanks."""
    seen = Window.partitionBy("repo", "file", "key").orderBy("line")
    issues = F.array_compact(
        F.array(
            F.when(F.col("_nth") > 1, "duplicate key"),
            F.when(
                ~F.col("key").rlike("^[A-Z][A-Z0-9_]*$") & ~F.col("key").rlike("^[a-z][a-z0-9_]*$"), "non-standard key format"
            ),
            F.when((F.col("value") == "") & likely_secret("key"), "empty secret"),
            F.when(F.col("value").contains(" ") & ~F.col("raw").contains('"'), "unquoted value with spaces"),
        )
    )
    return settings.withColumn("_nth", F.row_number().over(seen)).select(
        "repo", "file", "line", "key", F.explode(issues).alias("issue")
    )


def env_redact(settings: DataFrame) -> DataFrame:
    """Settings with `value` masked: flags stay, secrets keep two characters at each end, URL passwords go."""
    value = F.col("value")
    masked = F.when(
        F.length(value) > 4, F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), F.length(value) - 4), F.right(value, F.lit(2)))
    ).otherwise("****")
    url = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/@:\s]*:)[^@/\s]+@"
    out = (
        F.when(value.isin("", "true", "false", "0", "1"), value)
        .when(likely_secret("key"), masked)
        .otherwise(F.regexp_replace(value, url, "$1****@"))
    )
    return settings.withColumn("value", out)


# ---------------------------------------------------------------- dependencies


def unused_dependencies(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(repo, name, section) declared but never imported; development tools are expected not to be."""
    tool = reduce(lambda a, b: a | b, [F.col("name").startswith(p) for p in TOOL_PREFIXES])
    asked = declared.filter(
        (F.col("section") == "dependencies") | ((F.col("section") == "devDependencies") & ~tool)
    ).filter(F.col("name") != "typescript")
    return asked.select("repo", "name", "section").join(used.select("repo", "name").distinct(), ["repo", "name"], "left_anti")


def dependency_counts(declared: DataFrame) -> DataFrame:
    return declared.groupBy("repo", "section").agg(F.count("*").alias("dependencies"))


def installed_package(path: Column, root: str = "node_modules") -> Column:
    """Package a file below the module directory belongs to; scoped names keep two segments."""
    return F.regexp_extract(path, rf"(?:^|/){root}/(@[^/]+/[^/]+|[^/@][^/]*)/", 1)


def dependency_sizes(files: DataFrame, declared: DataFrame, k: int = 25, package: Column | None = None) -> DataFrame:
    """(repo, name, bytes, files) of the largest declared dependencies, by prefix of the installed files."""
    name = package if package is not None else installed_package(F.col("path"))
    sizes = files.select("repo", name.alias("name"), "size").groupBy("repo", "name").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("files")
    )
    wanted = declared.select("repo", "name").distinct()
    return sizes.join(wanted, ["repo", "name"], "left_semi").orderBy(F.desc("bytes"), "repo", "name").limit(k)


# ---------------------------------------------------------------- command logs


def classify_command(command: Column, safe: list[str] = (), dangerous: list[str] = ()) -> Column:
    """blocked > custom dangerous > custom safe > dangerous > safe > moderate."""
    text = trim(command)
    begins = lambda prefixes: reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes], F.lit(False))
    return (
        F.when(text.rlike("|".join(BLOCKED_COMMANDS)), "blocked").when(begins(dangerous), "dangerous").when(begins(safe), "safe")
        .when(text.rlike("|".join(DANGEROUS_COMMANDS)), "dangerous").when(text.rlike(SAFE_PATTERN), "safe").otherwise("moderate")
    )


def classify_commands(log: DataFrame, safe: list[str] = (), dangerous: list[str] = ()) -> DataFrame:
    """(repo, kind, tier, commands): commands counted by their first two words."""
    words = F.split(trim("command"), r"\s+")
    return (
        log.select("repo", F.array_join(F.slice(words, 1, 2), " ").alias("kind"), classify_command(F.col("command"), safe, dangerous).alias("tier"))
        .groupBy("repo", "kind", "tier").agg(F.count("*").alias("commands"))
    )
