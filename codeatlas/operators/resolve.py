"""Imports: which file a relative path means, and which packages a repo uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How a module is imported, which extensions and index files are tried, and in which order.
IMPORT_PATTERNS = [
    r"(?:import|export)\s+.*?from\s+['\"]([^'\"]+)['\"]",
    r"(?:import|export)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
]
MULTILINE_IMPORT = r"(?:import|export)\s+[^'\";]*?from\s+['\"]([^'\"]+)['\"]"
PACKAGE_PATTERNS = [r"(?:import|export)\s+.*?from\s+['\"]([^'\"./][^'\"]*)['\"]", r"require\s*\(\s*['\"]([^'\"./][^'\"]*)['\"]\s*\)"]
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs"]
INDEX_FILES = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def imported_paths(content: Column | str, multiline: bool = False) -> Column:
    """Relative paths a text imports, in the order of the patterns."""
    patterns = [MULTILINE_IMPORT, *IMPORT_PATTERNS[1:]] if multiline else IMPORT_PATTERNS
    col = F.col(content) if isinstance(content, str) else content
    return F.filter(F.concat(*[F.regexp_extract_all(col, F.lit(p), F.lit(1)) for p in patterns]), lambda x: x.startswith("."))


def extract_imports(files: DataFrame, multiline: bool = False) -> DataFrame:
    """(repo, file, raw) of relative imports."""
    return files.select("repo", F.col("path").alias("file"), F.explode(imported_paths("content", multiline)).alias("raw"))


def normalise(path: Column) -> Column:
    """A path without `.` and `..` steps."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(done, s):
        up = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def target(file: Column, raw: Column) -> Column:
    """The path an import points at, before extensions are tried."""
    return normalise(F.concat_ws("/", directory(file), raw))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file, raw, resolved): relative imports (repo, file, raw) that meet a file; the first candidate wins.

    Candidates are generated per import and matched with the paths by equality.
    """
    base, stem = F.col("base"), F.regexp_replace("base", r"\.js$", "")
    script = F.col("raw").endswith(".js")
    candidates = F.array(
        base, *[F.concat(base, F.lit(e)) for e in EXTENSIONS], *[F.when(script, F.concat(stem, F.lit(e))) for e in (".ts", ".tsx")],
        *[F.concat(base, F.lit(i)) for i in INDEX_FILES],
    )
    wanted = imports.select("repo", "file", "raw").distinct().withColumn("base", target(F.col("file"), F.col("raw")))
    tried = wanted.select("repo", "file", "raw", F.posexplode(candidates).alias("place", "path")).filter("path is not null")
    known = files.select("repo", "path").distinct()
    return (
        tried.join(known, ["repo", "path"])
        .groupBy("repo", "file", "raw").agg(F.min_by("path", "place").alias("resolved"))
    )


def package_usage(files: DataFrame) -> DataFrame:
    """(repo, name) of packages imported or required; scoped names keep two segments.  `typescript` counts as used."""
    raw = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in PACKAGE_PATTERNS])
    name = F.when(F.col("raw").startswith("@"), F.substring_index("raw", "/", 2)).otherwise(F.substring_index("raw", "/", 1))
    used = files.select("repo", F.explode(F.array_distinct(raw)).alias("raw")).select("repo", name.alias("name"))
    return used.unionByName(files.select("repo", F.lit("typescript").alias("name"))).distinct()
