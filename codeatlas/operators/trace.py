"""Symbol and impact queries over the trace index (symbols, calls, imports, columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeatlas.operators.reach import chain_roots

WRITES = ["UPDATE", "INSERT", "DELETE"]
READS = ["SELECT", "READ"]
# Thresholds of the risk ladder.
CRITICAL_TOTAL, HIGH_CALLERS, HIGH_COLUMNS, MEDIUM_CALLERS = 10, 4, 4, 2


def lookup(symbols: DataFrame, *, name: str | None = None, file: str | None = None, id: int | None = None) -> DataFrame:
    """Symbols matching every given property exactly."""
    for column, value in (("name", name), ("file", file), ("id", id)):
        if value is not None:
            symbols = symbols.filter(F.col(column) == value)
    return symbols


def candidates(symbols: DataFrame, term: str, k: int | None = None) -> DataFrame:
    """Symbols (the first k, if given) whose name holds the term in any case; nothing when the exact name exists."""
    hit = symbols.agg(F.coalesce(F.bool_or(F.col("name") == term), F.lit(False))).scalar()
    like = symbols.filter(F.lower("name").contains(term.lower())).filter(~hit)
    return like if k is None else like.orderBy("repo", "name", "id").limit(k)


def callers(symbols: DataFrame, calls: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per call site of each name; sites whose caller is unknown are dropped."""
    if names is not None:
        calls = calls.join(names.select("repo", F.col("name").alias("callee_name")).distinct(), ["repo", "callee_name"], "left_semi")
    who = symbols.select(
        "repo", F.col("id").alias("caller_id"), F.col("name").alias("caller"), F.col("kind").alias("caller_kind"), "language"
    )
    return calls.join(who, ["repo", "caller_id"]).select(
        "repo", F.col("callee_name").alias("callee"), "caller_id", "caller", F.col("caller_kind").alias("kind"), "file", "line",
        F.col("arguments").alias("args"), "language",
    )


def callees(calls: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    if ids is not None:
        calls = calls.join(ids.select("repo", F.col("id").alias("caller_id")).distinct(), ["repo", "caller_id"], "left_semi")
    return calls.select("repo", "caller_id", F.col("callee_name").alias("name"), "file", "line", F.col("arguments").alias("args"))


def importers(imports: DataFrame, names: DataFrame) -> DataFrame:
    return imports.join(names.select("repo", F.col("name").alias("symbol_name")).distinct(), ["repo", "symbol_name"], "left_semi")


def owners(symbols: DataFrame) -> DataFrame:
    """(repo, name, symbol_id, language): a name belongs to its lowest symbol id."""
    return symbols.groupBy("repo", "name").agg(F.min(F.struct("id", "language")).alias("s")).select(
        "repo", "name", F.col("s.id").alias("symbol_id"), F.col("s.language").alias("language")
    )


def direct_callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, callee, caller_id, caller, file, line, language): each calling symbol once, at its first line."""
    first = calls.groupBy("repo", F.col("callee_name").alias("callee"), "caller_id").agg(F.min("line").alias("line"))
    who = symbols.select("repo", F.col("id").alias("caller_id"), F.col("name").alias("caller"), "file", "language")
    return first.join(who, ["repo", "caller_id"])


def _touches(symbols: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per (symbol, table, column) with its least operation and whether it reads or writes."""
    known = symbols.select("repo", F.col("id").alias("symbol_id"))
    return (
        columns.groupBy("repo", "symbol_id", "table_name", "column_name")
        .agg(
            F.min("operation").alias("operation"),
            F.bool_or(F.col("operation").isin(WRITES)).alias("writes"),
            F.bool_or(F.col("operation").isin(READS)).alias("reads"),
        )
        .join(known, ["repo", "symbol_id"], "left_semi")
    )


def _pairs(symbols: DataFrame, columns: DataFrame, ids: DataFrame) -> DataFrame:
    touch = _touches(symbols, columns)
    mine = touch.join(ids.select("repo", F.col("id").alias("symbol_id")).distinct(), ["repo", "symbol_id"], "left_semi")
    other = touch.select(
        "repo", "table_name", "column_name", F.col("symbol_id").alias("other_id"), "operation", F.col("reads").alias("other_reads")
    )
    return mine.drop("operation", "reads").join(other, ["repo", "table_name", "column_name"]).filter("symbol_id <> other_id")


def column_dependents(symbols: DataFrame, columns: DataFrame, ids: DataFrame) -> DataFrame:
    """Other symbols on the same (table, column), for the symbols asked about.

    The result is one row per dependent, so it is meant for a set of changed symbols; counts over all symbols come
    from `impact_report`, which never forms pairs.
    """
    return _pairs(symbols, columns, ids).select("repo", "symbol_id", "other_id", "table_name", "column_name", "operation")


def downstream_effects(symbols: DataFrame, columns: DataFrame, ids: DataFrame) -> DataFrame:
    """Dependents that read a column the asked symbol writes."""
    return _pairs(symbols, columns, ids).filter("writes and other_reads").select(
        "repo", "symbol_id", "other_id", "table_name", "column_name"
    )


def _plural(n: Column, one: str, reason: Column) -> Column:
    return F.when(reason, F.concat_ws(" ", n.cast("string"), F.lit(one)))


def risk_level(counts: DataFrame) -> DataFrame:
    """Adds risk and reason to (callers, columns, dependents, foreign) counts."""
    callers_, columns_ = F.col("callers"), F.col("columns")
    total = callers_ + F.col("dependents")
    high = (callers_ >= HIGH_CALLERS) | (columns_ >= HIGH_COLUMNS) | F.col("foreign")
    medium = (callers_ >= MEDIUM_CALLERS) | (columns_ >= 1)
    risk = F.when(total >= CRITICAL_TOTAL, "CRITICAL").when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")
    reason = (
        F.when(
            total >= CRITICAL_TOTAL,
            F.format_string(
                "%d total dependents (%d callers, %d column dependents)", total, callers_, F.col("dependents")
            ),
        )
        .when(
            high,
            F.concat_ws(
                ", ",
                _plural(callers_, "direct callers", callers_ >= HIGH_CALLERS),
                _plural(columns_, "column references", columns_ >= HIGH_COLUMNS),
                F.when(F.col("foreign"), "cross-language callers"),
            ),
        )
        .when(
            medium,
            F.concat_ws(
                ", ",
                _plural(callers_, "direct callers", callers_ >= MEDIUM_CALLERS),
                _plural(columns_, "column references", columns_ >= 1),
            ),
        )
        .when(callers_ == 0, "No callers found")
        .otherwise(F.format_string("%d caller, no column references", callers_))
    )
    return counts.withColumn("risk", risk).withColumn("reason", reason)


def impact_counts(symbols: DataFrame, calls: DataFrame, columns: DataFrame) -> DataFrame:
    """(repo, symbol_id, callers, columns, dependents, downstream, foreign) for every symbol.

    Dependents are counted per (table, column) as the symbols there minus one, so a column touched by a third of all
    symbols costs one row per symbol and not one per pair.
    """
    lang = symbols.select("repo", F.col("name").alias("callee"), F.col("id").alias("symbol_id"), F.col("language").alias("own"))
    called = (
        direct_callers(symbols, calls).groupBy("repo", "callee")
        .agg(F.count("*").alias("callers"), F.collect_set("language").alias("languages"))
    )
    incoming = lang.join(called, ["repo", "callee"]).select(
        "repo", "symbol_id", "callers", F.exists("languages", lambda x: x != F.col("own")).alias("foreign")
    )
    touch = _touches(symbols, columns)
    per_column = touch.groupBy("repo", "table_name", "column_name").agg(
        F.count("*").alias("everyone"), F.count_if("reads").alias("readers")
    )
    shared = (
        touch.join(per_column, ["repo", "table_name", "column_name"])
        .groupBy("repo", "symbol_id")
        .agg(
            F.sum(F.col("everyone") - 1).alias("dependents"),
            F.sum(F.when(F.col("writes"), F.col("readers") - F.col("reads").cast("long")).otherwise(0)).alias("downstream"),
        )
    )
    refs = columns.groupBy("repo", "symbol_id").agg(F.count("*").alias("columns"))
    return (
        symbols.select("repo", F.col("id").alias("symbol_id"))
        .join(incoming, ["repo", "symbol_id"], "left")
        .join(refs, ["repo", "symbol_id"], "left")
        .join(shared, ["repo", "symbol_id"], "left")
        .select(
            "repo", "symbol_id",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("callers", "columns", "dependents", "downstream")],
            F.coalesce("foreign", F.lit(False)).alias("foreign"),
        )
    )


def impact_report(symbols: DataFrame, calls: DataFrame, columns: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Counts, risk and reason of changing each symbol, for all symbols at once.

    With the result of `triggers.trigger_chains`, `triggers` is how many triggers the symbol sets off, through others as well.
    """
    report = risk_level(impact_counts(symbols, calls, columns)).select(
        "repo", "symbol_id", "callers", "columns", "dependents", "downstream", "risk", "reason"
    )
    if chains is None:
        return report
    fired = chains.groupBy("repo", "name").agg(F.count("*").alias("fired"))
    named = symbols.select("repo", F.col("id").alias("symbol_id"), "name").join(fired.hint("merge"), ["repo", "name"]).drop("name")
    return report.join(named.hint("merge"), ["repo", "symbol_id"], "left").withColumn("triggers", F.coalesce("fired", F.lit(0))).drop("fired")


def caller_multiplicity(sites: DataFrame) -> DataFrame:
    """Call sites of `callers` grouped by callee and caller@file: how many, and the first line."""
    return sites.groupBy("repo", "callee", "caller", "file").agg(F.count("*").alias("sites"), F.min("line").alias("first_line"))


def _first_k(df: DataFrame, key: str, order: list[str], k: int | None, section: str, label: Column) -> DataFrame:
    w = Window.partitionBy("repo", key).orderBy(*order)
    sizes = df.groupBy("repo", key).agg(F.count("*").alias("total"))
    first = df.withColumn("place", F.row_number().over(w))
    if k is not None:
        first = first.filter(F.col("place") <= k)
    return first.join(sizes, ["repo", key]).select(
        "repo", F.col(key).alias("name"), F.lit(section).alias("section"), "place", label.alias("item"),
        (F.lit(0).cast("long") if k is None else F.greatest(F.col("total") - k, F.lit(0))).alias("more"),
    )


def trace_summary(
    symbols: DataFrame, calls: DataFrame, imports: DataFrame, names: DataFrame, k: int | None = None,
    roots: int | None = None, depth: int | None = None,
) -> DataFrame:
    """(repo, name, section, place, item, more): callers, callees, importers and chain roots, the first k (roots) if given.

    `more` is how many further rows the section has; a chain root also tells how many callers hang under it.
    """
    names = names.select("repo", "name").distinct()
    into = callers(symbols, calls, names)
    ids = symbols.join(names, ["repo", "name"], "left_semi").groupBy("repo", "name").agg(F.min("id").alias("id"))
    out = callees(calls, ids).join(ids.select("repo", F.col("id").alias("caller_id"), F.col("name").alias("root")), ["repo", "caller_id"])
    imp = importers(imports, names)
    first = chain_roots(symbols, calls, names, depth)
    at = lambda name, file, line: F.concat(name, F.lit(" at "), file, F.lit(":"), line.cast("string"))
    c = F.col
    return (
        _first_k(into, "callee", ["file", "line", "caller", "args"], k, "callers", at(c("caller"), c("file"), c("line")))
        .unionByName(_first_k(out, "root", ["file", "line", "name", "args"], k, "callees", c("name")))
        .unionByName(
            _first_k(imp, "symbol_name", ["file", "source_module"], k, "imports", F.concat_ws(" from ", "file", "source_module"))
        )
        .unionByName(
            _first_k(
                first, "root", ["name"], roots, "chain",
                F.concat(at(c("name"), c("file"), c("line")), F.format_string(" (%d upstream)", "upstream")),
            )
        )
    )


def bind_ids(records: DataFrame, symbols: DataFrame, name: str = "owner") -> DataFrame:
    """Replace an owner name by the symbol id inside the same file; the last duplicate wins, unknown owners go."""
    last = symbols.groupBy("repo", "file", "name").agg(F.max_by("id", F.struct("line", "id")).alias("symbol_id"))
    return records.join(last.withColumnRenamed("name", name), ["repo", "file", name]).drop(name)
