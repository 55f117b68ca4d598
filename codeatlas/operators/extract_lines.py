"""Line-level symbol extraction: definitions, references, enclosing functions, outgoing calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.functions.scan import keep_where, numbered, sections
from codeatlas.functions.text import capture, split_lines, trim
from codeatlas.sources.corpus import explode_lines

# One pattern per kind of line, tried in this order, and names that are no calls of interest.
TS_KINDS = [
    ("function", r"export\s+(?:async\s+)?function\s+(\w+)"),
    ("class", r"export\s+(?:abstract\s+)?class\s+(\w+)"),
    ("interface", r"export\s+interface\s+(\w+)"),
    ("type", r"export\s+type\s+(\w+)"),
    ("enum", r"export\s+enum\s+(\w+)"),
    ("const", r"export\s+const\s+(\w+)"),
    ("class", r"^(?!.*export)(?:abstract\s+)?class\s+(\w+)"),
]
PY_KINDS = [("function", r"^(?:async\s+)?def\s+(\w+)"), ("class", r"^class\s+(\w+)")]
EXPORT_KINDS = [
    ("class", r"export\s+(?:default\s+)?class\s+(\w+)"),
    ("interface", r"export\s+(?:default\s+)?interface\s+(\w+)"),
    ("type", r"export\s+(?:default\s+)?type\s+(\w+)"),
    ("function", r"export\s+(?:default\s+)?(?:async\s+)?function\s+(\w+)"),
    ("enum", r"export\s+(?:default\s+)?enum\s+(\w+)"),
    ("function", r"export\s+const\s+(\w+)"),
]
NOT_CALLS = [
    "if", "for", "while", "switch", "catch", "return", "throw", "new", "typeof", "instanceof", "void", "delete",
    "import", "require", "console", "process", "Math", "JSON", "Object", "Array", "String", "Number", "Boolean",
    "Promise", "Date", "Map", "Set", "RegExp", "Error", "Buffer", "setTimeout", "setInterval", "clearTimeout",
    "clearInterval", "parseInt", "parseFloat", "encodeURIComponent", "decodeURIComponent",
]
IDENTIFIER = r"[A-Za-z_]\w*"


def _first_kind(line: Column, kinds: list[tuple[str, str]]) -> Column:
    """(kind, name) of the first pattern a line matches, null when none does."""
    out = F.lit(None)
    for kind, pattern in reversed(kinds):
        out = F.when(line.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("name"))).otherwise(out)
    return out


def _line_symbols(files: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    lines = explode_lines(files)
    return (
        keep_where(lines, "s", _first_kind(F.col("text"), kinds), lambda s: s.isNotNull())
        .select("repo", "s.name", "s.kind", F.col("path").alias("file"), "line")
    )


def extract_symbols_ts(files: DataFrame) -> DataFrame:
    """(repo, name, kind, file, line): exported declarations and plain classes, one per line."""
    return _line_symbols(files, TS_KINDS)


def extract_symbols_py(files: DataFrame) -> DataFrame:
    """(repo, name, kind, file, line): top-level functions and classes."""
    return _line_symbols(files, PY_KINDS)


def exported_symbols(files: DataFrame) -> DataFrame:
    """(repo, name, kind, file): every exported name, all kinds on a line included."""
    found = F.flatten(F.array(*[_named(kind, pattern) for kind, pattern in EXPORT_KINDS]))
    return files.select("repo", F.col("path").alias("file"), F.explode(found).alias("s")).select("repo", "s.name", "s.kind", "file")


def _named(kind: str, pattern: str) -> Column:
    names = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))


def find_definitions(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(repo, name, kind, file, line, priority): the best definition of each name.

    Every line is read once and yields the name it could define with its priority, so asking for many names is an
    equi-join on the name.  The highest priority wins, then the first path and line.
    """
    at = F.transform(split_lines("content"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    below = F.col("next")
    text = F.col("text")
    rows = (
        files.withColumn("_l", at)
        .select("repo", F.col("path").alias("file"), F.explode(F.transform(
            "_l", lambda x, i: F.struct(x["line"].alias("line"), x["text"].alias("text"),
                                        F.coalesce(F.get(F.col("_l"), i + 1)["text"], F.lit("")).alias("next"))
        )).alias("x"))
        .select("repo", "file", "x.line", "x.text", "x.next")
    )
    exported = text.contains("export")
    arrow = text.contains("=>") | below.contains("=>")
    bare = trim(text)

    def row(pattern, kind, priority):
        return F.when(text.rlike(pattern), F.struct(
            F.regexp_extract(text, pattern, 1).alias("name"), kind.alias("kind"), priority.alias("priority")
        ))

    method = rf"^\s+(?:async\s+)?({IDENTIFIER})\s*\("
    body = text.contains("{") | text.contains("):") | trim(below).startswith("{")
    found = F.coalesce(
        row(rf"export\s+(?:async\s+)?function\s+({IDENTIFIER})\s*\(", F.lit("function"), F.lit(10)),
        row(rf"^(?:async\s+)?function\s+({IDENTIFIER})\s*\(", F.lit("function"), F.lit(8)),
        row(rf"(?:export\s+)?(?:abstract\s+)?class\s+({IDENTIFIER})", F.lit("class"), F.when(exported, 10).otherwise(8)),
        row(
            rf"export\s+(?:interface|type)\s+({IDENTIFIER})",
            F.when(text.contains("interface"), "interface").otherwise("type"), F.lit(9),
        ),
        row(
            rf"(?:export\s+)?const\s+({IDENTIFIER})\s*[=:]", F.when(arrow, "function").otherwise("const"),
            F.when(exported, 7).otherwise(5),
        ),
        F.when(body & ~bare.startswith("//") & ~bare.startswith("*"), row(method, F.lit("method"), F.lit(6))),
    )
    candidates = keep_where(rows, "d", found, lambda d: d.isNotNull()).select(
        "repo", "d.name", "d.kind", "file", "line", "d.priority"
    )
    if names is not None:
        candidates = candidates.join(names.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    best = F.min_by(F.struct("kind", "file", "line", "priority"), F.struct((-F.col("priority")).alias("p"), "file", "line"))
    return candidates.groupBy("repo", "name").agg(best.alias("b")).select("repo", "name", "b.*")


def find_references(files: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, symbol, kind, file, line, code, args): imports and call sites of names (repo, name, def_file).

    Lines are cut into identifiers once and meet the names by equality; there is no pattern per name.
    """
    bare = trim("text")
    lines = explode_lines(files).filter(~bare.startswith("//") & ~bare.startswith("*") & ~bare.startswith("/*"))
    called = F.regexp_extract_all("text", F.lit(rf"(?<!\w)({IDENTIFIER})\s*(?=\()"), F.lit(1))
    mentioned = F.regexp_extract_all(F.regexp_extract("text", r"(?:import|from)(.*)", 1), F.lit(IDENTIFIER), F.lit(0))
    words = F.array_union(
        F.transform(F.array_distinct(called), lambda n: F.struct(n.alias("name"), F.lit("call").alias("kind"))),
        F.transform(F.array_distinct(mentioned), lambda n: F.struct(n.alias("name"), F.lit("import").alias("kind"))),
    )
    hits = lines.select("repo", F.col("path").alias("file"), "line", "text", F.explode(words).alias("w")).select(
        "repo", "file", "line", "text", "w.name", "w.kind"
    )
    asked = names.select("repo", "name", "def_file").distinct()
    joined = hits.join(asked, ["repo", "name"])
    home = F.coalesce(F.col("file") == F.col("def_file"), F.lit(False))
    definition = F.col("text").rlike(r"(?:function|const|class|interface|type)\s+\w") & F.expr(
        r"text rlike concat('(?:(?:export\\s+)?(?:async\\s+)?function|(?:export\\s+)?(?:const|class|interface|type))\\s+', name)"
    )
    kept = joined.filter(F.when(F.col("kind") == "import", ~home).otherwise(~(home & definition)))
    # a line that imports a name is not also a call of it
    one = kept.groupBy("repo", F.col("name").alias("symbol"), "file", "line").agg(
        F.max("kind").alias("kind"), F.any_value("text").alias("text")
    )
    args = F.expr(r"regexp_extract(text, concat('(?<![A-Za-z0-9_])', symbol, '\\s*\\(([^)]*)'), 1)")
    return one.select(
        "repo", "symbol", "kind", "file", "line", trim("text").alias("code"), F.when(F.col("kind") == "call", trim(args)).alias("args")
    )


FUNCTION = r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"
METHOD = r"^\s+(?:async\s+)?(\w+)\s*\("
ARROW = r"(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?\("


def enclosing_function(files: DataFrame) -> DataFrame:
    """(repo, path, line, text, enclosing): every line with the nearest function, method or arrow at or above it."""
    head = (
        r"(?:[^\n]*(?:export\s+)?(?:async\s+)?function\s+\w|[^\n]*(?:const|let)\s+\w+\s*=\s*(?:async\s+)?\("
        r"|\s+(?:async\s+)?\w+\s*\((?=[^\n]*(?:\{|=>)|[^\n]*\n[^\n]*\{))"
    )
    cut = sections(files, head, numbered("content"), ["repo", "path"])
    first = F.col("head")
    name = F.coalesce(capture(first, FUNCTION), capture(first, METHOD), capture(first, ARROW))
    return cut.select("repo", "path", name.alias("enclosing"), F.explode("lines").alias("l")).select(
        "repo", "path", "l.line", "l.text", "enclosing"
    )


def outgoing_calls(bodies: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, caller, name, line, args, known): what a body (repo, caller, body) calls, each name at its first place."""
    stop = F.array(*[F.lit(w) for w in NOT_CALLS])
    bare = trim("text")
    lines = explode_lines(bodies, "body", ["repo", "caller"]).filter(~bare.startswith("//") & ~bare.startswith("*"))
    pattern = rf"(?<!\w)({IDENTIFIER})\s*(?=\(([^)]*))"
    sites = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("name"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("args"),
    )
    rows = lines.select("repo", "caller", "line", F.posexplode(sites).alias("at", "s")).select(
        "repo", "caller", "line", "at", "s.name", trim("s.args").alias("args")
    ).filter((F.col("name") != F.col("caller")) & ~F.array_contains(stop, F.col("name")))
    first = rows.groupBy("repo", "caller", "name").agg(F.min(F.struct("line", "at", "args")).alias("f"))
    names = known.select("repo", "name").distinct().withColumn("known", F.lit(True))
    return first.join(names, ["repo", "name"], "left").select(
        "repo", "caller", "name", "f.line", "f.args", F.coalesce("known", F.lit(False)).alias("known")
    )
