"""Analysers: source files to graph nodes and edges.

Each analyser turns (repo, path, content) into one tagged table (`record_type` = node or edge) with JVM expressions over
one file at a time; `split_graph` gives the nodes and edges.  Classes and functions are named by file and name, so that
homonyms stay apart; `merged=True` names them by kind and name only.  Edges whose target is no node stay in the table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.functions.scan import blocks, first_seen, matches
from codeatlas.functions.text import basename, capture, extension, split_lines, trim
from codeatlas.operators.resolve import IMPORT_PATTERNS, normalise, directory

FIELDS = ["record_type", "id", "type", "name", "file_path", "line", "language", "framework", "metadata", "src", "dst"]
RECORD = (
    "struct<record_type:string,id:string,type:string,name:string,file_path:string,line:int,language:string,"
    "framework:string,metadata:map<string,string>,src:string,dst:string>"
)

# Patterns of the analysers and the names they leave out.
TS_SYMBOLS = [
    ("class", r"export\s+(?:default\s+)?class\s+(\w+)"),
    ("class", r"export\s+(?:default\s+)?interface\s+(\w+)"),
    ("class", r"export\s+(?:default\s+)?type\s+(\w+)\s*="),
    ("function", r"export\s+(?:default\s+)?(?:async\s+)?function\s+(\w+)"),
    ("function", r"export\s+(?:default\s+)?enum\s+(\w+)"),
    ("function", r"export\s+const\s+(\w+)"),
]
EXPRESS_ROUTE = r"(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)['\"]"
PROCESS_ENV = r"process\.env\.([A-Z_][A-Z0-9_]*)"
PY_IMPORT = r"(?m)^(?:from\s+(\.[\w.]*)\s+import|import\s+(\.[\w.]*))"
PY_CLASS = r"(?m)^class\s+(\w+)\s*(?:\(([^)]*)\))?:"
PY_MODEL = r"(?m)^class\s+(\w+)\s*\(\s*(?:Base|db\.Model)\s*\)"
PY_COLUMN = r"(\w+)\s*=\s*(?:db\.)?Column\s*\("
PY_FUNCTION = r"(?m)^(?: {4})?def\s+(\w+)\s*\("
FLASK_ROUTE = r"@(?:\w+)\.route\s*\(\s*['\"]([^'\"]+)['\"]\s*(?:,\s*methods\s*=\s*\[([^\]]*)\])?\s*\)"
DJANGO_PATH = r"(?:re_)?path\s*\(\s*['\"r]([^'\"]*)['\"]\s*,"
PY_ENV = r"os\.environ\s*\[\s*['\"]([^'\"]+)['\"]\s*\]|os\.getenv\s*\(\s*['\"]([^'\"]+)['\"]"
AIRFLOW, SPARK = r"@dag\b|DAG\s*\(", r"from\s+pyspark|import\s+pyspark|SparkSession"
_Q = "[`\"']?"
SQL_CREATE = rf"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_Q}(\w+){_Q}([^;]*)"
SQL_CONSTRAINT = r"(?i)^\s*(?:PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|CONSTRAINT|INDEX|KEY)\b"
SQL_NOT_TABLES = ["WHERE", "JOIN", "ON", "SELECT", "SET", "VALUES", "DUAL"]
COBOL_DIVISIONS = [
    "IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE", "FILE", "WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE",
]
COMPOSE_FILES = ["docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]
HTTP_METHODS = "get|post|put|patch|delete|head|options|trace"
SCHEMA_REF = r"\$ref\s*:\s*['\"]?#/(?:components/schemas|definitions)/(\w+)['\"]?"


def _record(**values: Column) -> Column:
    return F.struct(*[values.get(f, F.lit(None)).alias(f) for f in FIELDS]).cast(RECORD)


def node(kind: str, name: Column, *, id: Column | None = None, language: str | None = None, framework=None, metadata: Column | None = None) -> Column:
    framework = F.lit(framework) if framework is None or isinstance(framework, str) else framework
    return _record(
        record_type=F.lit("node"), id=F.concat(F.lit(kind + ":"), name) if id is None else id, type=F.lit(kind), name=name,
        file_path=F.col("path"), language=F.lit(language), framework=framework,
        metadata=F.create_map().cast("map<string,string>") if metadata is None else metadata,
    )


def edge(kind: str, src: Column, dst: Column) -> Column:
    return _record(record_type=F.lit("edge"), type=F.lit(kind), src=src, dst=dst)


def facts(**values: Column) -> Column:
    """Metadata map; entries without a value are left out."""
    pairs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in values.items()]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def file_id(path: Column | None = None) -> Column:
    return F.concat(F.lit("file:"), F.col("path") if path is None else path)


def member_id(kind: str, name: Column, merged: bool) -> Column:
    return F.concat(F.lit(kind + ":"), name) if merged else F.concat(F.lit(kind + ":"), F.col("path"), F.lit("#"), name)


def _all(pattern: str, group: int = 1, text: Column | str = "content") -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(group))


class Plan(NamedTuple):
    """What an analyser makes of a file: columns worked out once, then the records; `only` picks the files it is meant for."""

    records: list[Column]
    steps: list[tuple[str, Column]] = []
    only: Column | None = None


def _emit(files: DataFrame, plans: list[tuple[Column, Plan]]) -> DataFrame:
    """Records of all files in one pass; each file takes the plan whose condition it meets."""
    chosen = None
    for hit, plan in plans:
        for name, value in plan.steps:
            files = files.withColumn(name, F.when(hit, value))
        records = F.concat(*plan.records)
        records = records if plan.only is None else F.when(plan.only, records)
        chosen = F.when(hit, records) if chosen is None else chosen.when(hit, records)
    return files.select("repo", F.explode(chosen).alias("r")).select("repo", "r.*")


def _alone(files: DataFrame, plan: Plan) -> DataFrame:
    return _emit(files, [(F.lit(True), plan)])


def _one(*records: Column) -> Column:
    return F.array_compact(F.array(*records))


def split_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of tagged records."""
    nodes = records.filter("record_type = 'node'").select(
        "repo", "id", "type", "name", "file_path", "line", "language", "framework", "metadata"
    )
    return nodes, records.filter("record_type = 'edge'").select("repo", "src", "dst", "type")


# ---------------------------------------------------------------- TypeScript and JavaScript


def guessed_import(path: Column, raw: Column) -> Column:
    """The file an import most likely means, from the text alone: .js stands for .ts, no extension for .ts."""
    joined = normalise(F.concat_ws("/", directory(path), raw))
    return F.when(joined.endswith(".js"), F.regexp_replace(joined, r"\.js$", ".ts")).when(
        joined.rlike(r"\.(?:jsx|tsx|ts|mjs|cjs)$"), joined
    ).otherwise(F.concat(joined, F.lit(".ts")))


def analyze_ts(files: DataFrame, merged: bool = False) -> DataFrame:
    return _alone(files, ts_plan(merged))


def ts_plan(merged: bool) -> Plan:
    ext = extension("path")
    language = F.when(ext.isin(".ts", ".tsx"), "typescript").otherwise("javascript")
    with_lang = lambda r: r.withField("language", F.col("_lang"))
    symbols = []
    for kind, pattern in TS_SYMBOLS:
        framework = F.when(F.col("_tsx"), "react") if kind == "function" else None
        symbols.append(F.flatten(_members(kind, pattern, framework, merged, with_lang)))
    imports = F.filter(F.concat(*[_all(p) for p in IMPORT_PATTERNS]), lambda x: x.startswith(".") | x.startswith("/"))
    import_edges = F.transform(imports, lambda x: edge("imports", file_id(), file_id(guessed_import(F.col("path"), x))))
    routes = F.transform(
        matches("content", EXPRESS_ROUTE, "method", "route"),
        lambda m: node(
            "endpoint", F.concat_ws(" ", F.upper(m["method"]), m["route"]), framework="express",
            metadata=facts(method=F.upper(m["method"]), path=m["route"]),
        ),
    )
    config = F.transform(F.array_distinct(_all(PROCESS_ENV)), lambda n: node("config", n))
    return Plan([_one(with_lang(node("file", F.col("path")))), *symbols, import_edges, routes, config], [("_lang", language), ("_tsx", ext == ".tsx")])


def _members(kind: str, pattern: str, framework, merged: bool, finish) -> Column:
    """Node and containing edge for every name the pattern finds."""

    def both(name):
        at = member_id(kind, name, merged)
        return F.array(finish(node(kind, name, id=at, framework=framework)), edge("contains", file_id(), at))

    return F.transform(_all(pattern), both)


# ---------------------------------------------------------------- Python


def analyze_py(files: DataFrame, merged: bool = False) -> DataFrame:
    return _alone(files, py_plan(merged))


def py_plan(merged: bool) -> Plan:
    framework = F.when(F.col("content").rlike(AIRFLOW), "airflow").when(F.col("content").rlike(SPARK), "spark")
    imports = F.filter(F.concat(_all(PY_IMPORT, 1), _all(PY_IMPORT, 2)), lambda x: x != "")
    import_edges = F.transform(imports, lambda x: edge("imports", file_id(), F.concat(F.lit("file:"), x)))
    # a class with its indented lines: cut before every line that starts at the margin
    bodies = F.filter(F.split("content", r"(?md)^(?=[^\s#)])"), lambda b: b.rlike(PY_CLASS))

    def of_class(body):
        name = F.regexp_extract(body, PY_CLASS, 1)
        table = F.concat(F.lit("table:"), name)
        columns = F.to_json(_all(PY_COLUMN, 1, F.regexp_replace(body, r"^[^\n]*", "")))
        at = member_id("class", name, merged)
        return (
            F.when(body.rlike(PY_MODEL), F.array(
                node("table", name, framework="sqlalchemy", metadata=facts(columns=columns)), edge("contains", file_id(), table)))
            .when(~name.startswith("_"), F.array(node("class", name, id=at, language="python"), edge("contains", file_id(), at)))
            .otherwise(F.array().cast(f"array<{RECORD}>"))
        )

    names = F.filter(F.array_distinct(_all(PY_FUNCTION)), lambda n: ~n.startswith("_"))

    def of_function(n):
        at = member_id("function", n, merged)
        return F.array(node("function", n, id=at, language="python"), edge("contains", file_id(), at))

    def routes(m):
        told = F.filter(F.transform(F.split(m["methods"], ","), lambda x: F.upper(F.regexp_replace(trim(x), "['\"]", ""))), lambda x: x != "")
        methods = F.when(m["methods"] == "", F.array(F.lit("GET"))).otherwise(told)
        return F.transform(methods, lambda x: node(
            "endpoint", F.concat_ws(" ", x, m["route"]), framework="flask", metadata=facts(method=x, path=m["route"])))

    django = F.when(F.col("path").endswith("urls.py"), _all(DJANGO_PATH)).otherwise(F.array().cast("array<string>"))
    env = F.filter(F.array_distinct(F.transform(matches("content", PY_ENV, "a", "b"), lambda m: F.concat(m["a"], m["b"]))), lambda n: n != "")
    return Plan([
        _one(node("file", F.col("path"), language="python", framework=framework)), import_edges,
        F.flatten(F.transform(bodies, of_class)), F.flatten(F.transform(names, of_function)),
        F.flatten(F.transform(matches("content", FLASK_ROUTE, "route", "methods"), routes)),
        F.transform(django, lambda p: node("endpoint", F.concat(F.lit("GET "), p), framework="django", metadata=facts(path=p))),
        F.transform(env, lambda n: node("config", n)),
    ])


# ---------------------------------------------------------------- SQL


def analyze_sql(files: DataFrame, merged: bool = False) -> DataFrame:
    return _alone(files, sql_plan(merged))


def sql_plan(merged: bool) -> Plan:
    layer = F.when(F.col("path").contains("models/staging/"), "staging").when(F.col("path").contains("models/marts/"), "mart")
    table = lambda n: F.concat(F.lit("table:"), n)
    creates = matches("content", SQL_CREATE, "name", "rest")

    def columns(rest):
        lines = F.filter(
            F.transform(split_lines(F.regexp_extract(rest, r"(?s)\((.*)\)", 1)), trim), lambda x: (x != "") & ~x.rlike(SQL_CONSTRAINT)
        )
        return F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"^{_Q}(\w+)", 1)), lambda c: c != "")

    created = F.flatten(F.transform(creates, lambda m: F.array(
        node("table", m["name"], language="sql", metadata=facts(columns=F.to_json(columns(m["rest"])))),
        edge("contains", file_id(), table(m["name"])),
    )))
    alters = F.transform(_all(rf"(?i)ALTER\s+TABLE\s+{_Q}(\w+)"), lambda n: edge("depends-on", file_id(), table(n)))
    # a reference belongs to the latest CREATE TABLE before it: cut the text there
    parts = F.split("content", r"(?i)(?=CREATE\s+TABLE\s)")
    references = F.flatten(F.transform(parts, lambda p: F.when(
        p.rlike(r"(?i)^CREATE\s+TABLE\s"),
        F.transform(
            F.regexp_extract_all(p, F.lit(rf"(?i)REFERENCES\s+{_Q}(\w+)"), F.lit(1)),
            lambda r: edge("depends-on", table(F.regexp_extract(p, SQL_CREATE, 1)), table(r)),
        ),
    ).otherwise(F.array().cast(f"array<{RECORD}>"))))
    steps = [
        ("_made", F.transform(creates, lambda m: F.upper(m["name"]))),
        ("_in", _all(rf"(?i)INSERT\s+INTO\s+{_Q}(\w+)")),
        ("_from", F.transform(
            first_seen(F.transform(
                F.filter(_all(rf"(?i)\bFROM\s+{_Q}(\w+)"), lambda n: ~F.upper(n).isin(SQL_NOT_TABLES)),
                lambda n: F.struct(n.alias("n"), F.upper(n).alias("u"))), "u"),
            lambda s: s["n"])),
        ("_new", F.filter(
            first_seen(F.transform(F.concat("_in", "_from"), lambda n: F.struct(n.alias("n"), F.upper(n).alias("u"))), "u"),
            lambda s: ~F.array_contains(F.col("_made"), s["u"]))),
    ]
    refs = F.transform(_all(r"\{\{\s*ref\s*\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}"), lambda m: edge("depends-on", file_id(), F.concat(F.lit("file:"), m, F.lit(".sql"))))
    sources = F.transform(
        matches("content", r"\{\{\s*source\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}", "source", "table"),
        lambda m: edge("reads", file_id(), table(F.concat_ws(".", m["source"], m["table"]))),
    )
    return Plan([
        _one(node("file", F.col("path"), language="sql", metadata=facts(dbtLayer=layer))), created, alters, references,
        F.transform("_new", lambda s: node("table", s["n"], language="sql")),
        F.transform("_in", lambda n: edge("writes", file_id(), table(n))), F.transform("_from", lambda n: edge("reads", file_id(), table(n))),
        refs, sources,
    ], steps)


# ---------------------------------------------------------------- COBOL


def analyze_cobol(files: DataFrame, merged: bool = False) -> DataFrame:
    return _alone(files, cobol_plan(merged))


def cobol_plan(merged: bool) -> Plan:
    program = F.coalesce(capture("content", r"(?i)PROGRAM-ID\s*\.\s*(\S+?)\s*\."), F.col("path"))
    framework = F.when(F.col("content").rlike(r"(?i)EXEC\s+CICS"), "cics")
    target = lambda n: F.concat(F.lit("file:"), n)
    mention = lambda body, pattern, op: F.transform(
        F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.upper(n).alias("n"), F.lit(op).alias("op"))
    )
    steps = [("_sql", _all(r"(?i)EXEC\s+SQL([\s\S]*?)END-EXEC")), ("_tables", F.flatten(F.transform("_sql", lambda b: F.concat(
        mention(b, r"(?i)\bFROM\s+(\w+)", "reads"), mention(b, r"(?i)\bJOIN\s+(\w+)", "reads"),
        mention(b, r"(?i)\bINSERT\s+INTO\s+(\w+)", "writes"), mention(b, r"(?i)\bUPDATE\s+(\w+)", "writes"),
        mention(b, r"(?i)\bDELETE\s+FROM\s+(\w+)", "writes"),
    ))))]
    table = lambda n: F.concat(F.lit("table:"), n)
    touched = F.transform("_tables", lambda t: edge("reads", file_id(), table(t["n"])).withField("type", t["op"]))
    sections = F.filter(
        F.array_distinct(_all(r"(?im)^\s{0,8}(\S[\w-]+)\s+SECTION\s*\.")), lambda s: ~F.upper(s).isin(COBOL_DIVISIONS)
    )
    records = F.array_distinct(F.transform(_all(r"(?im)^\s*FD\s+(\S+)"), lambda n: F.regexp_replace(n, r"\.$", "")))

    def of_section(s):
        at = member_id("function", s, merged)
        return F.array(node("function", s, id=at, language="cobol", metadata=facts(sectionType=F.lit("SECTION"))), edge("contains", file_id(), at))

    return Plan([
        _one(node("file", program, id=file_id(), language="cobol", framework=framework, metadata=facts(programId=program))),
        F.transform(_all(r"(?im)^\s*COPY\s+(\S+)"), lambda n: edge("imports", file_id(), target(n))),
        F.transform(_all(r"(?i)\bCALL\s+['\"]([^'\"]+)['\"]"), lambda n: edge("calls", file_id(), target(n))),
        F.transform(F.array_distinct(F.transform("_tables", lambda t: t["n"])), lambda n: node("table", n)), touched,
        F.flatten(F.transform(sections, of_section)),
        F.flatten(F.transform(records, lambda n: F.array(
            node("external", n, language="cobol", metadata=facts(fdType=F.lit("file-descriptor"))),
            edge("contains", file_id(), F.concat(F.lit("external:"), n))))),
    ], steps)


# ---------------------------------------------------------------- Docker


def analyze_docker(files: DataFrame, merged: bool = False) -> DataFrame:
    return _alone(files, docker_plan(merged))


def docker_plan(merged: bool) -> Plan:
    name = basename("path")
    is_file = (name == "Dockerfile") | name.startswith("Dockerfile.")
    nothing = F.array().cast("array<string>")
    images = F.filter(
        F.array_distinct(_all(r"(?im)^FROM\s+(\S+?)(?:\s+AS\s+\S+)?\s*$")), lambda i: F.upper(i) != "SCRATCH"
    )
    ports = F.flatten(F.transform(_all(r"(?im)^EXPOSE\s+([\d\s/tcp/udp]+)"), lambda p: F.split(trim(p), r"\s+")))
    services = F.flatten(F.transform(
        F.filter(blocks(F.col("content"), 0), lambda b: b.rlike(r"^services\s*:")), lambda b: blocks(b, 2)
    ))
    steps = [
        ("_images", F.when(is_file, images).otherwise(nothing)), ("_ports", F.when(is_file, ports).otherwise(nothing)),
        ("_services", F.filter(F.when(name.isin(COMPOSE_FILES), services).otherwise(nothing), lambda b: b.rlike(r"^ {2}\w[\w-]*\s*:"))),
    ]
    key = lambda b: F.lower(F.regexp_extract(b, r"^ {4}(\w[\w_-]*)\s*:", 1))
    value = lambda b: trim(F.regexp_extract(b, r"^ {4}\w[\w_-]*\s*:([^\n]*)", 1))
    items = lambda b: F.transform(
        F.regexp_extract_all(b, F.lit(r"(?m)^ {6}-\s+(.+)$"), F.lit(1)), lambda i: F.regexp_replace(trim(i), r"^['\"]|['\"]$", "")
    )

    def listed(service, wanted):
        return F.flatten(F.transform(F.filter(blocks(service, 4), lambda b: key(b) == wanted), items))

    def inline(service):
        told = F.transform(F.filter(blocks(service, 4), lambda b: key(b) == "depends_on"), value)
        return F.filter(F.flatten(F.transform(told, lambda v: F.transform(F.split(F.regexp_replace(v, r"[\[\]]", ""), ","), trim))), lambda x: x != "")

    def of_service(service):
        n = F.regexp_extract(service, r"^ {2}(\w[\w-]*)", 1)
        at = F.concat(F.lit("service:"), n)
        image = F.nullif(F.get(F.transform(F.filter(blocks(service, 4), lambda b: key(b) == "image"), value), 0), F.lit(""))
        needs = F.concat(inline(service), listed(service, "depends_on"))
        return F.concat(
            F.array(
                node("service", n, framework="docker-compose", metadata=facts(
                    ports=F.to_json(listed(service, "ports")), volumes=F.to_json(listed(service, "volumes")), image=image)),
                edge("contains", file_id(), at),
            ),
            F.transform(needs, lambda d: edge("deploys-with", at, F.concat(F.lit("service:"), d))),
        )

    exposed = F.when(F.size("_ports") > 0, F.to_json("_ports"))
    return Plan([
        _one(node("file", F.col("path"), language="docker", metadata=facts(exposedPorts=exposed))),
        F.flatten(F.transform("_images", lambda i: F.array(
            node("external", i, metadata=facts(imageType=F.lit("base-image"))), edge("depends-on", file_id(), F.concat(F.lit("external:"), i))))),
        F.flatten(F.transform("_services", of_service)),
    ], steps)


# ---------------------------------------------------------------- OpenAPI


def analyze_openapi(files: DataFrame, merged: bool = False) -> DataFrame:
    return _alone(files, openapi_plan(merged))


def openapi_plan(merged: bool) -> Plan:
    told = F.col("content").rlike(r"(?m)^(?:openapi|swagger)\s*:")
    steps = [("_top", F.when(told, blocks(F.regexp_replace("content", r"(?m)^\s*#.*$", ""), 0)))]
    top = lambda word: F.filter("_top", lambda b: b.rlike(rf"^{word}\s*:"))

    def endpoints(path_block):
        route = trim(F.regexp_extract(path_block, r"^ {2}([^:\n]*):", 1))
        methods = F.regexp_extract_all(path_block, F.lit(rf"(?im)^ {{4}}({HTTP_METHODS})\s*:"), F.lit(1))

        def of_method(m):
            label = F.concat_ws(" ", F.upper(m), route)
            return F.array(
                node("endpoint", label, language="openapi", metadata=facts(method=F.upper(m), path=route)),
                edge("contains", file_id(), F.concat(F.lit("endpoint:"), label)),
            )

        return F.flatten(F.transform(methods, of_method))

    paths = F.filter(F.flatten(F.transform(top("paths"), lambda b: blocks(b, 2))), lambda b: b.startswith("  /"))
    below = lambda parts, indent: F.flatten(F.transform(parts, lambda b: F.filter(blocks(b, indent), lambda x: x.rlike(rf"^ {{{indent}}}\S"))))
    schemas = F.concat(
        below(F.filter(below(top("components"), 2), lambda b: b.rlike(r"^ {2}schemas\s*:")), 4), below(top("definitions"), 2)
    )

    def of_schema(block):
        name = trim(F.regexp_extract(block, r"^\s*([^:\n]*):", 1))
        at = F.concat(F.lit("schema:"), name)
        refs = F.filter(F.regexp_extract_all(block, F.lit(SCHEMA_REF), F.lit(1)), lambda r: r != name)
        return F.concat(
            F.array(node("schema", name, language="openapi"), edge("contains", file_id(), at)),
            F.transform(refs, lambda r: edge("depends-on", at, F.concat(F.lit("schema:"), r))),
        )

    return Plan(
        [_one(node("file", F.col("path"), language="openapi")), F.flatten(F.transform(paths, endpoints)), F.flatten(F.transform(schemas, of_schema))],
        steps, F.col("_top").isNotNull(),
    )


PLANS = {
    "typescript": ts_plan, "javascript": ts_plan, "python": py_plan, "cobol": cobol_plan, "sql": sql_plan, "docker": docker_plan, "openapi": openapi_plan,
}


def analyze(files: DataFrame, merged: bool = False, plans: dict = PLANS) -> DataFrame:
    """Tagged records of all files whose language has a plan, in one read of `files`; `plans` may hold further ones."""
    languages: dict = {}
    for language, plan in plans.items():
        languages.setdefault(plan, []).append(language)
    known = files.filter(F.col("language").isin(list(plans))).select("repo", "path", "content", "language")
    return _emit(known, [(F.col("language").isin(names), plan(merged)) for plan, names in languages.items()])
