"""Dependency manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeatlas.functions.text import basename, split_lines, trim

SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]


def read_manifests(files: DataFrame) -> DataFrame:
    """(repo, path, name, section, version) from package.json and requirements.txt files; broken files give no rows."""
    schema = ", ".join(f"{s} map<string,string>" for s in SECTIONS)
    package = files.filter(basename("path") == "package.json").select("repo", "path", F.from_json("content", schema).alias("p"))
    nothing = F.array().cast("array<struct<key:string,value:string>>")

    def entries(section):
        told = F.coalesce(F.map_entries(f"p.{section}"), nothing)
        return F.transform(
            told, lambda e: F.struct(e["key"].alias("name"), F.lit(section).alias("section"), e["value"].alias("version"))
        )

    pairs = F.flatten(F.array(*[entries(section) for section in SECTIONS]))
    npm = package.filter("p is not null").select("repo", "path", F.explode(pairs).alias("d")).select("repo", "path", "d.*")
    line = trim(F.substring_index("line", "#", 1))
    spec = r"^([A-Za-z0-9_.-]+)"
    pip = (
        files.filter(basename("path") == "requirements.txt")
        .select("repo", "path", F.explode(split_lines("content")).alias("line"))
        .withColumn("line", line)
        .withColumn("name", F.lower(F.regexp_extract("line", spec, 1)))
        .filter("name <> ''")
        .select(
            "repo", "path", "name", F.lit("requirements").alias("section"),
            trim(F.regexp_replace("line", spec, "")).alias("version"),
        )
    )
    return npm.unionByName(pip)
