"""Substring dedup by super-k-mer partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from codeatlas.llm.base import text_batches
from codeatlas.llm.substring_kernels import cell_rows, digest_rows, kept_rows, packed_rows, repeated_runs

WINDOW = 20
MINIMISER = 3
BUCKET_BYTES = 4 << 20
"""Bytes of input text per bucket; a bucket's super-k-mers are about three times as long."""
CELLS = 8
"""Cells per bucket, for which windows are counted."""
SPLIT_WINDOWS = 1 << 19
"""Windows from which on the super-k-mers of a cell are taken apart; a bucket has about as many words on average."""


def drop_repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, digest: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept) of every document, `kept` being its words without the repeated ones, joined by one
    space (with `digest`: `kept_sha256` instead).

    Removed is each word covered by a run of `window` words that also starts earlier: in a document with a smaller key, or
    before in the same one.  Runs are judged on the input.

    Consecutive windows whose least hash of a `minimiser`-word run is the same travel as one string to the bucket of that
    hash, so equal windows meet.  Of equal strings in a chunk of a task only the earliest travels, the others are repeats
    as a whole: a passage in any share of the documents reaches its bucket once per chunk.  A short run of words that is frequent
    among varying neighbours would bring its bucket unequal strings without bound: windows are counted by cell of their minimisers
    first, and where a cell has more than `SPLIT_WINDOWS` its windows travel one by one to the bucket of the hash of all their
    words.  In a bucket, windows are sorted by hash, and those with equal hashes are compared word by word (by 64-bit hashes of
    words).  The number of buckets follows the bytes of text.

    Keys are whole numbers.  Null text has no words; rows with a null key keep all words and are compared with none;
    repeated rows of one key start at the same places and don't remove each other's words; an empty frame gives no rows;
    other columns are ignored.
    """
    named = text_batches(docs).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET_BYTES))
    given, cells = named.filter("id IS NOT NULL AND text IS NOT NULL"), CELLS * buckets
    counts = given.mapInArrow(cell_rows(window, minimiser, cells), "cell long, windows long").groupBy("cell").agg(F.sum("windows").alias("windows"))
    hot = np.array(sorted(r.cell for r in counts.filter(F.col("windows") > SPLIT_WINDOWS).collect()), np.int64)
    packed = given.mapInArrow(packed_rows(window, minimiser, buckets, cells, hot), "bucket long, payload binary")
    runs = packed.groupBy("bucket").applyInPandas(repeated_runs(window), "id long, start long, stop long")
    per = runs.groupBy("id").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("stop"))).alias("runs"))
    joined = named.join(per, "id", "left").select("id", "text", "runs")
    schema = "id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string")
    return joined.mapInArrow(digest_rows if digest else kept_rows, schema).withColumnRenamed("id", key)
