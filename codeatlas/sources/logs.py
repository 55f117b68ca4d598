"""Commit logs, unified diffs and session documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeatlas.functions.series import forward_fill
from codeatlas.functions.text import split_lines, trim

COMMIT_MARK = "__COMMIT__"


def read_commit_log(lines: DataFrame, chunk: int = 65536) -> DataFrame:
    """(repo, hash, author, ts, subject, file) from log lines (repo, pos, text).

    A line `__COMMIT__hash__date__author` applies to the file lines after it; blank lines are skipped.  One row per
    changed file.
    """
    head = F.when(F.col("text").startswith(COMMIT_MARK), F.col("text"))
    filled = forward_fill(lines.select("repo", "pos", "text"), ["repo"], "pos", head, "head", chunk)
    parts = F.split("head", "__")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    return filled.filter(~F.col("text").startswith(COMMIT_MARK) & (trim("text") != "")).select(
        "repo", part(3).alias("hash"), part(5).alias("author"), part(4).try_cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("string").alias("subject"), trim("text").alias("file"),
    )


def log_lines(logs: DataFrame, text: str = "text") -> DataFrame:
    """(repo, pos, text) of whole log texts."""
    return logs.select("repo", F.posexplode(split_lines(text)).alias("pos", "text"))


def read_unified_diff(changes: DataFrame, text: str = "text") -> DataFrame:
    """(repo, change_id, file, kind, text): added (`+`) and removed (`-`) lines, and one row per file header (kind null).

    A text is cut at its `diff --git` headers first, so every line knows its file without a window or a shuffle.
    """
    sections = changes.select("repo", "change_id", F.explode(F.split(text, r"(?md)^(?=diff --git)")).alias("section"))
    file = F.regexp_extract("section", r"^diff --git a/.+ b/([^\n]+)", 1)
    rows = sections.filter("section <> ''").select(
        "repo", "change_id", F.when(file != "", file).alias("file"), F.explode(split_lines("section")).alias("line")
    )
    line = F.col("line")
    kind = F.when(line.startswith("+") & ~line.startswith("+++"), "+").when(line.startswith("-") & ~line.startswith("---"), "-")
    return rows.withColumn("kind", kind).filter(F.col("kind").isNotNull() | line.startswith("diff --git")).select(
        "repo", "change_id", "file", "kind", F.when(F.col("kind").isNotNull(), F.substr(line, F.lit(2))).alias("text")
    )


SESSION = (
    "id string, name string, workspaceRoot string, createdAt string, updatedAt string, "
    "messages array<struct<role:string, content:string>>"
)


def read_sessions(documents: DataFrame, json: str = "json") -> DataFrame:
    """(session_id, name, turn, role, text, ts): one row per message of each session document."""
    doc = F.from_json(json, SESSION)
    opened = documents.select(doc.alias("s")).filter("s.id is not null")
    return opened.select(
        F.col("s.id").alias("session_id"), F.col("s.name").alias("name"),
        F.col("s.updatedAt").try_cast("timestamp_ntz").alias("ts"), F.posexplode("s.messages").alias("turn", "m"),
    ).select("session_id", "name", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"), "ts")
