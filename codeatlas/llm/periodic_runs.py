"""Periodic run detection by internal pattern matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeatlas.llm.base import text_batches
from codeatlas.llm.run_kernels import collapsed_rows

LEAST_WORDS = 6
LEAST_PERIODS = 4


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(key, n_words, runs, collapsed) of every document.

    `runs`, an array of (start, length, period) by start and period, has every stretch of consecutive words with smallest period q that is
    as long as `least_words` and `least_periods` times q and that neither neighbouring word continues.  `collapsed` is the text's words, joined
    by one space, without those that a run contains after its first q words.  `least_words` is 6 or more, `least_periods` 4 or more:
    blocks are placed for that.

    Blocks of 2, 4, 8, ... words ask for their next and last occurrence, by a wavelet tree over the suffix array of the words; where these
    are near, the occurrences in the block's neighbourhood form a progression whose difference is the period (see `run_kernels.periodic_runs`).
    Words are told by 64-bit hashes.  Whole texts are read, 1 MB of short ones at a time or one long one; a task needs about 100 bytes a word
    and four more for each doubling of the longest repeat.  Nothing is shuffled.

    Null and blank texts have no words and no runs; rows with a null key or a repeated one are handled like others; an empty
    frame gives no rows; other columns are ignored.
    """
    if least_words < 6 or least_periods < 4:
        raise ValueError("runs have at least 6 words and 4 periods")
    kind = docs.schema[key].dataType.simpleString()
    named = text_batches(docs).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return named.mapInArrow(collapsed_rows(least_words, least_periods), schema).withColumnRenamed("key", key)
