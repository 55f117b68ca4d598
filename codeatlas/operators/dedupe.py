"""Near-duplicate blocks, content hashes, directory checksums and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.functions.text import split_lines, word_tokens
from codeatlas.session import cut

SALTS = 8


# Fixed value: a block comment, open to the end if nothing closes it, or a stretch without one.
BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"


def _no_blocks(text: Column) -> Column:
    """The text without its block comments; their line breaks stay, so lines keep their numbers."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?:{BLOCK_COMMENT}|[^/]++|/)"), F.lit(0))
    clean = F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("/*"), F.regexp_replace(x, r"[^\n]", "")).otherwise(x)), "")
    return F.when(text.contains("/*"), clean).otherwise(text)


def strip_comments(text: Column) -> Column:
    """Lines of a text without comments.  A `#` opens a comment unless a quote stands before it."""

    def strip(line):
        head = F.substring_index(line, "//", 1)
        before = F.substring_index(head, "#", 1)
        return F.when(before.contains('"') | before.contains("'"), head).otherwise(before)

    return F.transform(split_lines(_no_blocks(text)), strip)


def tokenize(files: DataFrame, keep: list[str] = ("repo", "path")) -> DataFrame:
    """(keep..., tokens): array of (token, line) per file, comments left out."""
    per_line = F.transform(
        strip_comments(F.col("content")),
        lambda line, i: F.transform(word_tokens(line), lambda t: F.struct(t.alias("token"), (i + 1).alias("line"))),
    )
    return files.select(*keep, F.flatten(per_line).alias("tokens"))


def _starts(tokens: str, width: int, step: int) -> Column:
    """Where windows begin in a token array; none in a text shorter than a window."""
    return F.expr(f"if(size({tokens}) >= {width}, sequence(1, size({tokens}) - {width} + 1, {step}), array())")


def token_windows(tokens: DataFrame, min_lines: int = 6, stride: int | None = None) -> DataFrame:
    """(repo, path, start_line, end_line, tokens): windows of 3 tokens per line, half overlapping, long enough in lines."""
    width = 3 * min_lines
    step = stride or max(1, width // 2)
    windows = tokens.select(
        "repo", "path", F.explode(F.transform(_starts("tokens", width, step), lambda i: F.slice(F.col("tokens"), i, width))).alias("w")
    )
    return windows.select(
        "repo", "path", F.col("w")[0]["line"].alias("start_line"), F.col("w")[width - 1]["line"].alias("end_line"),
        F.col("w.token").alias("tokens"),
    ).filter(F.col("end_line") - F.col("start_line") + 1 >= min_lines)


def window_hash(windows: DataFrame) -> DataFrame:
    """Adds `hash`, the bucket key over the joined characters, and `exact`, which tells the tokens apart."""
    return windows.withColumn("hash", F.md5(F.array_join("tokens", ""))).withColumn(
        "exact", F.md5(F.array_join("tokens", "\x01"))
    )


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(both / union)


def _blocks(files: DataFrame, min_lines: int, stride: int | None) -> DataFrame:
    """(repo, file, start, end, bucket, exact) of every window; the tokens themselves are not carried along."""
    width = 3 * min_lines
    step = stride or max(1, width // 2)
    told = tokenize(files).select(
        "repo", F.col("path").alias("file"), F.col("tokens.token").alias("t"), F.col("tokens.line").alias("l")
    )

    def window(i):
        tokens = F.slice(F.col("t"), i, width)
        return F.struct(
            F.get(F.col("l"), i - 1).alias("start"), F.get(F.col("l"), i + (width - 2)).alias("end"),
            F.xxhash64(F.array_join(tokens, "")).alias("bucket"), F.unhex(F.md5(F.array_join(tokens, "\x01"))).alias("exact"),
        )

    windows = F.filter(
        F.transform(_starts("t", width, step), window),
        lambda w: w["end"] - w["start"] + 1 >= min_lines,
    )
    return told.select("repo", "file", F.explode(windows).alias("w")).select("repo", "file", "w.*")


def duplicate_pairs(
    files: DataFrame, min_lines: int = 6, threshold: float = 0.8, across_repos: bool = False, stride: int | None = None
) -> DataFrame:
    """(repo_a, file_a, start_a, end_a, repo_b, file_b, start_b, end_b, lines, similarity), linear in the number of blocks.

    Blocks with the same tokens form a class.  Every block with a twin that does not overlap it is paired once: with
    the first block of its class or, where it overlaps that one, with the last (if it overlaps both, it overlaps the
    whole class and has no twin).  Classes of one bucket, which spell the same characters with other tokens, are all compared
    with each other, through blocks that don't overlap.  All further pairs follow from these, and a class of n copies costs n
    rows instead of n*n/2.  A class meets its blocks in `SALTS` parts, so that a block copied everywhere is no single join key.  Only hashes are shuffled; texts are read again for buckets with several spellings, if any.
    """
    scope = [] if across_repos else ["repo"]
    blocks = cut(_blocks(files, min_lines, stride))
    shared = blocks.groupBy(*scope, "bucket").agg(
        F.count("*").alias("n"), F.min(F.xxhash64("exact")).alias("lo"), F.max(F.xxhash64("exact")).alias("hi")
    ).filter("n > 1")
    at = F.struct("repo", "file", "start", "end")
    # most windows are unique: from here on only those in a shared bucket are left
    dense = cut(
        blocks.join(shared.select(*scope, "bucket", (F.col("lo") != F.col("hi")).alias("mixed")), [*scope, "bucket"])
        .select(*scope, "bucket", "exact", "mixed", at.alias("at"))
    )
    classes = dense.groupBy(*scope, "bucket", "exact", "mixed").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))

    def overlaps(a, b):
        return (a["repo"] == b["repo"]) & (a["file"] == b["file"]) & (F.abs(a["start"] - b["start"]) < min_lines)

    pairs = (
        dense.withColumn("_salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
        .join(
            classes.filter("n > 1").select(*scope, "exact", "first", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")),
            [*scope, "exact", "_salt"],
        )
        .select(
            F.when(~overlaps(F.col("at"), F.col("first")), F.col("first"))
            .when(~overlaps(F.col("at"), F.col("last")), F.col("last")).alias("a"),
            F.col("at").alias("b"), F.lit(1.0).alias("similarity"),
        )
        .filter("a is not null")
        # a pair met from both ends is told once
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()
    )
    mixed = cut(classes.filter("mixed"))
    if not mixed.isEmpty():
        one = mixed.select(*scope, "bucket", F.col("exact").alias("exact_a"), F.col("first").alias("fa"), F.col("last").alias("la"))
        two = mixed.select(*scope, "bucket", F.col("exact").alias("exact_b"), F.col("first").alias("fb"), F.col("last").alias("lb"))
        # A bucket holds as many classes as there are ways to cut the same characters, whatever the number of copies.
        spelled = one.join(two, [*scope, "bucket"]).filter("exact_a < exact_b").select("exact_a", "exact_b", "fa", "la", "fb", "lb")
        apart = F.coalesce(*[F.when(~overlaps(F.col(x), F.col(y)), F.struct(F.col(x).alias("a"), F.col(y).alias("b"))) for x, y in (("fa", "fb"), ("fa", "lb"), ("la", "fb"), ("la", "lb"))])
        spelled = cut(spelled.withColumn("pair", apart).filter("pair IS NOT NULL").select("exact_a", "exact_b", "fa", "fb", "pair"))
        ends = spelled.select(F.col("fa").alias("at")).unionByName(spelled.select(F.col("fb").alias("at"))).distinct()
        sources = files.join(ends.select("at.repo", F.col("at.file").alias("path")).distinct(), ["repo", "path"], "left_semi")
        windows = token_windows(tokenize(sources), min_lines, stride).select(
            F.struct("repo", F.col("path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end")).alias("at"),
            "tokens", F.unhex(F.md5(F.array_join("tokens", "\x01"))).alias("exact"),
        )
        texts = windows.join(mixed.select("exact").distinct(), "exact", "left_semi").groupBy("exact").agg(F.first("tokens").alias("tokens"))
        other = (
            spelled.join(texts.select(F.col("exact").alias("exact_a"), F.col("tokens").alias("tokens_a")), "exact_a")
            .join(texts.select(F.col("exact").alias("exact_b"), F.col("tokens").alias("tokens_b")), "exact_b")
            .withColumn("similarity", jaccard(F.col("tokens_a"), F.col("tokens_b")))
            .filter(F.col("similarity") >= threshold)
            .select(F.least("pair.a", "pair.b").alias("a"), F.greatest("pair.a", "pair.b").alias("b"), "similarity")
        )
        pairs = pairs.unionByName(other)
    return pairs.select(
        *[F.col(f"{s}.{f}").alias(f"{f}_{s}") for s in "ab" for f in ("repo", "file", "start", "end")],
        (F.greatest(F.col("a.end") - F.col("a.start"), F.col("b.end") - F.col("b.start")) + 1).alias("lines"), "similarity",
    )


def duplicate_report(pairs: DataFrame, limit: int = 20, min_lines: int = 6) -> DataFrame:
    """The most similar, longest pairs; of pairs between the same stretches of two files only the best is told."""
    spot = lambda s: F.concat_ws(":", f"repo_{s}", f"file_{s}", F.floor(F.col(f"start_{s}") / min_lines).cast("string"))
    key = F.array_join(F.array_sort(F.array(spot("a"), spot("b"))), "|")
    order = F.struct(
        (-F.col("similarity")).alias("s"), (-F.col("lines")).alias("l"), "repo_a", "file_a", "start_a", "repo_b", "file_b", "start_b"
    )
    row = F.struct(*pairs.columns)
    best = pairs.groupBy(key.alias("pair")).agg(F.min_by(row, order).alias("best"))
    return best.select("best.*").orderBy(
        F.desc("similarity"), F.desc("lines"), "repo_a", "file_a", "start_a", "repo_b", "file_b", "start_b"
    ).limit(limit)


# ---------------------------------------------------------------- hashes


def content_hash(content: Column, algo: str = "sha256", short: bool = False) -> Column:
    digest = {"sha256": lambda c: F.sha2(c, 256), "md5": F.md5, "sha1": F.sha1}[algo](content)
    return F.left(digest, F.lit(12)) if short else digest


def directory_checksum(files: DataFrame, directory: Column) -> DataFrame:
    """(repo, path, hash, files, bytes) per directory.

    A set hash: the digests of (path, content) are added up lane by lane, and the sums are hashed.  It does not depend
    on the order of the files, changes when one is renamed or edited, and is built by partial sums, so a directory
    with a third of all files is no hot spot.
    """
    one = F.sha2(F.concat_ws("\x00", F.col("path"), F.sha2("content", 256)), 256)
    lanes = [F.conv(F.substring(F.col("one"), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    sums = files.select("repo", directory.alias("dir"), "size", one.alias("one")).groupBy("repo", "dir").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), *[F.sum(lane).alias(f"s{i}") for i, lane in enumerate(lanes)]
    )
    return sums.select(
        "repo", F.col("dir").alias("path"), F.sha2(F.concat_ws(",", *[F.col(f"s{i}").cast("string") for i in range(8)]), 256).alias("hash"),
        "files", "bytes",
    )


def check_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(repo, path, expected, hash, status): OK when the hash begins with the expected one, FAIL, or MISS."""
    return manifest.join(actual.select("repo", "path", "hash"), ["repo", "path"], "left").withColumn(
        "status",
        F.when(F.col("hash").isNull(), "MISS").when(F.col("hash").startswith(F.col("expected")), "OK").otherwise("FAIL"),
    )


def dirty_set(modified: DataFrame, staged: DataFrame, actual: DataFrame, short: bool = False) -> DataFrame:
    """(repo, path, hash) of files modified or staged; `deleted` where the file is gone."""
    dirty = modified.select("repo", "path").unionByName(staged.select("repo", "path")).distinct()
    digest = F.left("hash", F.lit(12)) if short else F.col("hash")
    return dirty.join(actual.select("repo", "path", "hash"), ["repo", "path"], "left").select(
        "repo", "path", F.coalesce(digest, F.lit("deleted")).alias("hash")
    )


# Files whose contents decide whether a cached profile still holds.
MANIFESTS = ["package.json", "pyproject.toml", "Cargo.toml"]
CONFIG_FILES = [
    ".eslintrc", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml", ".prettierrc",
    ".prettierrc.js", ".prettierrc.cjs", ".prettierrc.json", ".prettierrc.yml", "tsconfig.json", "biome.json",
]


def profile_fingerprint(files: DataFrame, source_dir: str = "src", key_files: list[str] | None = None) -> DataFrame:
    """(repo, fingerprint): changes with a manifest, a config file, or the names right below the source directory.

    Names enter as a set hash (see `directory_checksum`), so a directory of any size is summed, not collected.
    """
    key_files = key_files or MANIFESTS + CONFIG_FILES
    below = F.regexp_extract("path", f"^{source_dir}/([^/]+)", 1)
    parts = files.filter(F.col("path").isin(key_files)).select(
        "repo", F.concat_ws(":", F.col("path"), F.sha2("content", 256)).alias("part")
    )
    names = files.select("repo", below.alias("name")).filter("name <> ''").select(
        "repo", F.concat_ws(":", F.lit("src-file"), "name").alias("part")
    ).distinct()
    lanes = [F.conv(F.substring(F.sha2("part", 256), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    sums = parts.unionByName(names).groupBy("repo").agg(*[F.sum(lane).alias(f"s{i}") for i, lane in enumerate(lanes)])
    return files.select("repo").distinct().join(sums, "repo", "left").select(
        "repo", F.sha2(F.concat_ws(",", *[F.coalesce(f"s{i}", F.lit(0)).cast("string") for i in range(8)]), 256).alias("fingerprint")
    )


def stale_profiles(fingerprints: DataFrame, cached: DataFrame) -> DataFrame:
    """Repos whose cached profile is missing or was built from another state."""
    return fingerprints.join(cached.select("repo", "fingerprint"), ["repo", "fingerprint"], "left_anti")


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(hash, copies, first_repo, first_path) of contents held more than once."""
    hashed = files.select(F.sha2("content", 256).alias("hash"), F.struct("repo", "path").alias("at"))
    groups = hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min("at").alias("first")).filter("copies > 1")
    return groups.select("hash", "copies", F.col("first.repo").alias("first_repo"), F.col("first.path").alias("first_path"))

