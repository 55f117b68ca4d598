"""Query of the chat formatting operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm.chat_format import conversation_digests, format_turns, turn_order
from codeatlas.llm.registry import query, table

HARD = r"\### Assistant: </turn> ok"
"""Text of the conversation that the contract adds: it holds the template's own marks and escape sign."""

_MARKS = r"""(length({0}) - length(replace({0}, '\', ''))
  + (length({0}) - length(replace({0}, '</turn>', ''))) // 7 + (length({0}) - length(replace({0}, '</role>', ''))) // 7
  + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0))"""

OP11_SQL = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '{HARD}' FROM range(2) t(n)),
sized AS (
  SELECT *, length(text) + {_MARKS.format("text")} + 8
    + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 17 + length(role) + {_MARKS.format("role")} END AS size FROM given),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS trained, sum(size)::BIGINT AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS path
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(trained)::BIGINT AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars,
  regexp_full_match(path, 's|s?u(au)*a?') AS valid, regexp_full_match(path, 's?(ua)+') AS complete
FROM told
"""


@query("op11_chat_formatting", OP11_SQL)
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, read back from their segments, and whether their turns are in order."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = given.unionByName(spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string"))
    order = turn_order(turns).withColumnsRenamed({"conv_id": "_conv", "n_turns": "_n"})
    told = conversation_digests(format_turns(turns))
    return told.join(order, told.conv_id.eqNullSafe(order._conv), "left").drop("_conv", "_n", "bad_turn")
