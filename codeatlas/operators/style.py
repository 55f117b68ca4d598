"""Conventions of a repo: code style, naming, exports, tests, tooling, frameworks and layout.

Every detector is one pass of conditional aggregates over the files (or dependencies) of each repo.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.functions.text import split_lines, trim
from codeatlas.operators.extract_lines import exported_symbols
from codeatlas.operators.graph import module_of
from codeatlas.sources.manifests import read_manifests

# Indent bases in order of preference, and what names a declaration.
INDENT_BASES = [2, 4, 3, 8]
DECLARED = r"(?:const|let|var|function)\s+"
NAMING = {
    "camel": DECLARED + r"([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*)",
    "snake": DECLARED + r"([a-z][a-z0-9]*_[a-z][a-z0-9_]*)",
    "pascal": DECLARED + r"([A-Z][a-zA-Z0-9]+)",
}
OPEN_ENDINGS = ["{", "}", ",", "(", ":", "|", "&", "\\", ")"]
FILE_NAMES = {
    "kebab": r"^[a-z][a-z0-9]*(-[a-z0-9]+)+$", "camel": r"^[a-z][a-zA-Z0-9]+$", "pascal": r"^[A-Z][a-zA-Z0-9]+$",
    "snake": r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$",
}
TEST_DIRS = ["tests", "__tests__", "test", "spec"]
ENTRY_POINTS = ["src/index.ts", "src/main.ts", "src/app.ts", "main.py", "main.go", "src/main.rs"]
# Which dependency means which tool, first match wins.
TEST_RUNNERS = [("vitest", "vitest"), ("jest", "jest"), ("@jest/core", "jest"), ("mocha", "mocha")]
LINTERS = [("eslint", "eslint"), ("biome", "biome"), ("@biomejs/biome", "biome"), ("oxlint", "oxlint")]
FORMATTERS = [("prettier", "prettier"), ("biome", "biome"), ("@biomejs/biome", "biome")]
BUILD_TOOLS = [("tsup", "tsup"), ("vite", "vite"), ("esbuild", "esbuild"), ("webpack", "webpack"), ("rollup", "rollup")]
# Fixed values: (framework, how it shows, what shows it).
FRAMEWORK_MARKERS = [
    ("express", "package-dep", "express"), ("react", "package-dep", "react"), ("dbt", "file-exists", "dbt_project.yml"),
    ("django", "file-exists", "manage.py"), ("flask", "package-dep", "flask"), ("airflow", "dir-exists", "dags"),
    ("docker-compose", "file-exists", "docker-compose.yml"), ("prisma", "file-exists", "schema.prisma"),
    ("kafka", "package-dep", "kafkajs"), ("spark", "package-dep", "pyspark"), ("sqlalchemy", "package-dep", "sqlalchemy"),
]
PYTHON_FRAMEWORKS = [
    ("flask", "flask"), ("django", "django"), ("sqlalchemy", "sqlalchemy"), ("pyspark", "spark"),
    ("apache-airflow", "airflow"), ("kafka-python", "kafka"),
]
VOTES = ["tabs", "spaces", "single", "double", "semi", "no_semi", "trailing_comma", *NAMING, *[f"by{b}" for b in INDENT_BASES]]


def style_votes(files: DataFrame) -> DataFrame:
    """(repo, path, votes...) per file: how often its lines speak for each habit."""
    rows = (
        files.withColumn("_l", split_lines("content"))
        .select("repo", "path", F.explode(F.transform(
            "_l", lambda x, i: F.struct(x.alias("line"), F.get(F.col("_l"), i + 1).alias("next")))).alias("x"))
        .select("repo", "path", "x.line", "x.next")
    )
    line = F.col("line")
    bare = F.regexp_replace(line, r"^\s+", "")
    told = rows.withColumn("bare", bare).filter(
        (F.col("bare") != "") & ~F.col("bare").startswith("//") & ~F.col("bare").startswith("*") & ~F.col("bare").startswith("#")
    )
    bare = F.col("bare")
    lead = F.length(line) - F.length(bare)
    tabbed = F.left(line, lead).contains("\t")
    spaced = (lead > 0) & ~tabbed
    plain = F.regexp_replace(bare, r"`[^`]*`", "")
    end = F.regexp_replace(F.regexp_replace(bare, r"//.*$", ""), r"\s+$", "")
    unfinished = reduce(lambda a, b: a | b, [end.endswith(e) for e in OPEN_ENDINGS])
    closing = reduce(lambda a, b: a | b, [trim("next").startswith(c) for c in "}])"])
    sums = {
        "tabs": F.count_if((lead > 0) & tabbed), "spaces": F.count_if(spaced),
        "single": F.sum(F.regexp_count(plain, F.lit(r"'[^'\n]{1,80}'"))), "double": F.sum(F.regexp_count(plain, F.lit(r'"[^"\n]{1,80}"'))),
        "semi": F.count_if(end.endswith(";")),
        "no_semi": F.count_if(~end.endswith(";") & ~end.startswith(".") & (end != "") & ~unfinished),
        "trailing_comma": F.count_if(end.endswith(",") & F.coalesce(closing, F.lit(False))),
        **{name: F.count_if(bare.rlike(p)) for name, p in NAMING.items()},
        **{f"by{b}": F.count_if(spaced & (lead <= 8) & (lead % b == 0)) for b in INDENT_BASES},
    }
    return told.groupBy("repo", "path").agg(*[sums[v].alias(v) for v in VOTES])


def code_style(votes: DataFrame) -> DataFrame:
    """(repo, indent, indent_size, quotes, semicolons, trailing_commas, naming): what most lines of a repo do.

    On a naming tie snake_case wins, then PascalCase; on an indent tie the base listed first.
    """
    total = votes.groupBy("repo").agg(*[F.sum(v).alias(v) for v in VOTES])
    most = F.greatest(*[F.col(f"by{b}") for b in INDENT_BASES])
    size = F.lit(2)
    for b in reversed(INDENT_BASES):
        size = F.when((most > 0) & (F.col(f"by{b}") == most), b).otherwise(size)
    top = F.greatest("camel", "snake", "pascal")
    return total.select(
        "repo", F.when(F.col("tabs") > F.col("spaces"), "tabs").otherwise("spaces").alias("indent"), size.alias("indent_size"),
        F.when(F.col("single") >= F.col("double"), "single").otherwise("double").alias("quotes"),
        (F.col("semi") >= F.col("no_semi")).alias("semicolons"), (F.col("trailing_comma") > 0).alias("trailing_commas"),
        F.when(F.col("snake") == top, "snake_case").when(F.col("pascal") == top, "PascalCase").otherwise("camelCase").alias("naming"),
    )


def entries(files: DataFrame) -> DataFrame:
    """(repo, directory, entry): what lies directly in each repo's root (directory ''), and in its first-level directories."""
    parts = F.split("path", "/")
    return files.select("repo", F.lit("").alias("directory"), parts[0].alias("entry")).unionByName(
        files.filter(F.size(parts) > 1).select("repo", parts[0].alias("directory"), F.get(parts, 1).alias("entry"))
    ).distinct()


def file_naming(files: DataFrame) -> DataFrame:
    """(repo, file_naming) by the names in the root, src/ and lib/; a tie goes to Pascal, camel, snake, kebab in turn."""
    name = F.regexp_replace("entry", r"(?<=.)\.[^.]*$", "")
    taken = F.lit(False)
    counts = []
    for kind, pattern in FILE_NAMES.items():  # the first fitting pattern counts
        counts.append(F.count_if(name.rlike(pattern) & ~taken).alias(kind))
        taken = taken | name.rlike(pattern)
    told = entries(files).filter(F.col("directory").isin("", "src", "lib")).groupBy("repo").agg(*counts)
    top = F.greatest(*FILE_NAMES)
    pick = (
        F.when(F.col("pascal") == top, "PascalCase").when(F.col("camel") == top, "camelCase")
        .when(F.col("snake") == top, "snake_case").otherwise("kebab-case")
    )
    return told.select("repo", pick.alias("file_naming"))


def export_import_style(files: DataFrame) -> DataFrame:
    """(repo, export_style, import_style)."""
    content = F.col("content")
    lines = F.filter(split_lines("content"), lambda x: x.contains("import"))
    alias = F.size(F.filter(lines, lambda x: x.rlike(r"from ['\"](@/|~/|#)")))
    relative = F.size(F.filter(lines, lambda x: x.rlike(r"from ['\"](\.\.\.|\./|\.\./)") & ~x.rlike(r"from ['\"](@/|~/|#)")))
    told = files.groupBy("repo").agg(
        F.bool_or(F.col("path").rlike(r"^src/index\.(ts|js|tsx)$")).alias("barrel"),
        F.count_if(content.rlike(r"(?m)^export default ")).alias("default"),
        F.count_if(content.rlike(r"(?m)^export (?:const|function|class|interface|type|enum) ")).alias("named"),
        F.sum(alias).alias("alias"), F.sum(relative).alias("relative"),
    )
    export = F.when(F.col("barrel"), "barrel").when(F.col("default") > F.col("named"), "default").otherwise("named")
    return told.select("repo", export.alias("export_style"), F.when(F.col("alias") > F.col("relative"), "alias").otherwise("relative").alias("import_style"))


def test_layout(files: DataFrame) -> DataFrame:
    """(repo, test_location, test_naming, test_style): the first known test directory, else tests beside the code."""
    path = F.col("path")
    places = [place for d in TEST_DIRS for place in (d, f"src/{d}")]
    aggregates = []
    for i, place in enumerate(places):
        inside = path.startswith(place + "/")
        child = F.split(F.substr(path, F.lit(len(place) + 2)), "/")[0]
        aggregates += [F.bool_or(inside).alias(f"at{i}"), F.bool_or(inside & child.contains(".spec.")).alias(f"spec{i}")]
    child = F.regexp_extract(path, r"^src/([^/]+)", 1)
    told = files.groupBy("repo").agg(
        *aggregates, F.bool_or(child.rlike(r"\.test\.tsx?$")).alias("test"), F.bool_or(child.rlike(r"\.spec\.tsx?$")).alias("spec")
    )
    naming = lambda spec: F.when(spec, "*.spec.ts").otherwise("*.test.ts")
    beside = F.col("test") | F.col("spec")
    location, style = F.when(beside, "co-located").otherwise("unknown"), F.when(beside, "co-located").otherwise("unknown")
    name = naming(F.col("spec"))
    for i, place in reversed(list(enumerate(places))):
        here = F.col(f"at{i}")
        location, style = F.when(here, place).otherwise(location), F.when(here, "dedicated-directory").otherwise(style)
        name = F.when(here, naming(F.col(f"spec{i}"))).otherwise(name)
    return told.select("repo", location.alias("test_location"), name.alias("test_naming"), style.alias("test_style"))


def _first_rule(names: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(F.array_contains(names, dep), F.lit(value)) for dep, value in rules])


def tooling(files: DataFrame) -> DataFrame:
    """(repo, language, package_manager, test_framework, test_command, linter, formatter, build_tool).

    Only files in the root of a repo count.  package.json speaks first, then pyproject.toml, Cargo.toml and go.mod.
    """
    root = files.filter(~F.col("path").contains("/"))
    text = lambda name: F.max(F.when(F.col("path") == name, F.col("content")))
    has = lambda name: F.bool_or(F.col("path") == name)
    known = {d for rules in (TEST_RUNNERS, LINTERS, FORMATTERS, BUILD_TOOLS) for d, _ in rules} | {"typescript"}
    deps = (
        read_manifests(root).filter(F.col("section").isin("dependencies", "devDependencies") & F.col("name").isin(sorted(known)))
        .groupBy("repo").agg(F.collect_set("name").alias("deps"))
    )
    told = root.groupBy("repo").agg(
        text("package.json").alias("package"), text("pyproject.toml").alias("pyproject"), has("Cargo.toml").alias("cargo"),
        has("go.mod").alias("go"), has("yarn.lock").alias("yarn"), has("pnpm-lock.yaml").alias("pnpm"), has("bun.lockb").alias("bun"),
    ).join(deps, "repo", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    node, python = F.col("package").isNotNull(), F.col("package").isNull() & F.col("pyproject").isNotNull()
    neither = F.col("package").isNull() & F.col("pyproject").isNull()
    rust, go = neither & F.col("cargo"), neither & ~F.col("cargo") & F.col("go")
    field = F.coalesce(F.get_json_object("package", "$.packageManager"), F.lit(""))
    script = F.coalesce(F.get_json_object("package", "$.scripts.test"), F.lit(""))
    manager = F.lit("npm")
    for name in ("bun", "pnpm", "yarn"):
        manager = F.when(node & (field.startswith(name) | F.col(name)), name).otherwise(manager)
    typed = F.array_contains("deps", "typescript")
    return told.withColumn("manager", manager).select(
        "repo",
        F.when(node & typed, "typescript").when(python, "python").when(rust, "rust").when(go, "go").otherwise("javascript").alias("language"),
        F.col("manager").alias("package_manager"),
        F.when(node, F.coalesce(_first_rule(F.col("deps"), TEST_RUNNERS), F.lit("unknown")))
        .when(python & F.col("pyproject").contains("pytest"), "pytest").when(rust, "cargo-test").when(go, "go-test")
        .otherwise("unknown").alias("test_framework"),
        F.when(python, "pytest").when(rust, "cargo test").when(go, "go test ./...").when(script.contains("vitest"), "npx vitest run")
        .when(script.contains("jest"), "npx jest").when(script != "", F.concat(F.col("manager"), F.lit(" run test")))
        .otherwise("npm test").alias("test_command"),
        F.when(node, _first_rule(F.col("deps"), LINTERS)).alias("linter"), F.when(node, _first_rule(F.col("deps"), FORMATTERS)).alias("formatter"),
        F.when(node, _first_rule(F.col("deps"), BUILD_TOOLS)).alias("build_tool"),
    )


def detect_frameworks(files: DataFrame) -> DataFrame:
    """(repo, framework), distinct: by declared packages and by files and directories in the root of a repo."""
    spark = files.sparkSession
    rules = lambda rows, names: F.broadcast(spark.createDataFrame(rows, names))  # noqa: E731  (fixed tables of a dozen rows)
    root = files.filter(~F.col("path").contains("/"))
    deps = read_manifests(root).select("repo", F.lower("name").alias("pattern"), "section")
    npm = deps.filter(F.col("section").isin("dependencies", "devDependencies", "peerDependencies"))
    python = deps.filter("section = 'requirements'")
    by = {kind: [(f, p) for f, k, p in FRAMEWORK_MARKERS if k == kind] for kind in ("package-dep", "file-exists", "dir-exists")}
    top = F.when(F.col("path").contains("/"), F.split("path", "/")[0])
    parts = [
        python.join(rules([(f, p) for p, f in PYTHON_FRAMEWORKS], "framework string, pattern string"), "pattern"),
        npm.join(rules(by["package-dep"], "framework string, pattern string"), "pattern"),
        root.withColumn("pattern", F.col("path")).join(rules(by["file-exists"], "framework string, pattern string"), "pattern"),
        files.withColumn("pattern", top).join(rules(by["dir-exists"], "framework string, pattern string"), "pattern"),
    ]
    return reduce(DataFrame.union, [p.select("repo", "framework") for p in parts]).distinct()


def modules(files: DataFrame, symbols: int | None = None) -> DataFrame:
    """(repo, module, file_count, exported_symbols): modules by size with the names they export, the first ones if a size is given."""
    from pyspark.sql import Window

    sized = files.groupBy("repo", module_of(F.col("path")).alias("module")).agg(F.count("*").alias("file_count"))
    exported = exported_symbols(files).select("repo", module_of(F.col("file")).alias("module"), "name").distinct()
    w = Window.partitionBy("repo", "module").orderBy("name")
    first = exported if symbols is None else exported.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= symbols)
    names = first.groupBy("repo", "module").agg(F.array_sort(F.collect_list("name")).alias("exported_symbols"))
    return sized.join(names, ["repo", "module"], "left").select(
        "repo", "module", "file_count", F.coalesce("exported_symbols", F.array().cast("array<string>")).alias("exported_symbols")
    ).orderBy("repo", F.desc("file_count"), "module")


def project_layout(files: DataFrame) -> DataFrame:
    """(repo, src_layout, monorepo, entry_points)."""
    path = F.col("path")
    top = F.split(path, "/")[0]
    within = lambda d: F.bool_or(path.startswith(d + "/"))
    told = files.groupBy("repo").agg(
        F.bool_or(top == "src").alias("src"), F.bool_or(top == "lib").alias("lib"), F.bool_or(top == "app").alias("app"),
        (within("packages") | within("apps")
         | F.coalesce(F.bool_or((path == "package.json") & F.get_json_object("content", "$.workspaces").isNotNull()), F.lit(False))).alias("monorepo"),
        *[F.bool_or(path == e).alias(f"e{i}") for i, e in enumerate(ENTRY_POINTS)],
    )
    layout = F.when(F.col("src"), "src/").when(F.col("lib"), "lib/").when(F.col("app"), "app/").otherwise("flat")
    found = F.array_compact(F.array(*[F.when(F.col(f"e{i}"), F.lit(e)) for i, e in enumerate(ENTRY_POINTS)]))
    return told.select("repo", layout.alias("src_layout"), "monorepo", found.alias("entry_points"))


