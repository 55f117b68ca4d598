"""Registered queries of the commit, session, answer and cache log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import activity as H, sessions as L
from codeatlas.plans import adapters as A
from codeatlas.plans.registry import query, table
from codeatlas.sources import logs

COMMITS = "WITH " + A.COMMITS_SQL
MESSAGES = "WITH " + A.MESSAGES_SQL
REQUESTS = "WITH " + A.REQUESTS_SQL
NOW = f"TIMESTAMP '{A.AS_OF}'"


RECENT_SQL = COMMITS + f""",
win AS (SELECT * FROM commits WHERE ts > {NOW} - INTERVAL 7 DAYS AND ts <= {NOW}),
rec AS (
  SELECT repo, file, count(*) AS commits, max(ts) AS last_ts, string_agg(DISTINCT author, ',' ORDER BY author) AS authors
  FROM win GROUP BY 1, 2 ORDER BY commits DESC, last_ts DESC, repo, file LIMIT 30)
"""


@query("h1_recent_files", RECENT_SQL + "SELECT * FROM rec")
def h1(spark, sf):
    return H.recent_files(A.commits(spark, sf), A.as_of()).withColumn("authors", F.array_join("authors", ","))


@query("h2_recency_buckets", COMMITS + f""",
f AS (SELECT repo, file, max(ts) AS last_ts FROM commits GROUP BY 1, 2)
SELECT *, CASE WHEN epoch_us({NOW}) - epoch_us(last_ts) < 86400000000 THEN 'today'
  WHEN epoch_us({NOW}) - epoch_us(last_ts) < 7 * 86400000000 THEN 'week' ELSE 'earlier' END AS bucket FROM f""")
def h2(spark, sf):
    last = A.commits(spark, sf).groupBy("repo", "file").agg(F.max("ts").alias("last_ts"))
    return H.recency_buckets(last, A.as_of())


@query("h3_standup", COMMITS + f"""
SELECT DISTINCT repo, hash, author, ts, subject FROM commits
WHERE author = 'u7' AND subject <> 'error' AND ts > {NOW} - INTERVAL 10 DAYS AND ts <= {NOW}""")
def h3(spark, sf):
    return H.standup(A.commits(spark, sf), "u7", A.as_of(), 10, F.col("subject") == "error")


@query("h4_stale_branches", COMMITS + f""",
b AS (SELECT repo, author AS branch, max(ts) AS last_ts FROM commits WHERE subject = 'signup' AND author NOT IN ('u1', 'u2') GROUP BY 1, 2),
m AS (SELECT DISTINCT repo, author AS branch FROM commits WHERE subject = 'purchase' AND file LIKE '%/7')
SELECT b.repo, b.branch, last_ts, last_ts < {NOW} - INTERVAL 14 DAYS AS old, m.branch IS NOT NULL AS merged
FROM b LEFT JOIN m ON m.repo = b.repo AND m.branch = b.branch
WHERE last_ts < {NOW} - INTERVAL 14 DAYS OR m.branch IS NOT NULL""")
def h4(spark, sf):
    log = A.commits(spark, sf).withColumn("branch", F.col("author"))
    merged = log.filter("subject = 'purchase' and file like '%/7'")
    return H.stale_branches(log.filter("subject = 'signup'"), merged, A.as_of(), 14, ["u1", "u2"])


# Commit subjects told from events: the user decides the house style, the event fills it in.
SUBJECT_SQL = """
talk AS (
  SELECT 'p' || user_id AS repo, CAST(event_id AS VARCHAR) AS hash, ts,
    CASE WHEN k % 7 = 0 THEN 'update ' || event_type ELSE
    CASE user_id % 5 WHEN 0 THEN 'feat(' || event_type || '): add ' || k WHEN 1 THEN 'AB-' || k || ': ' || event_type
      WHEN 2 THEN '[XY-' || k || '] ' || event_type WHEN 3 THEN '#' || k || ' ' || event_type
      ELSE event_type || ' ' || k END END AS subject
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""


def talk(spark, sf):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    style = F.col("user_id") % 5
    text = F.concat
    subject = (
        F.when(k.cast("int") % 7 == 0, text(F.lit("update "), kind))
        .when(style == 0, text(F.lit("feat("), kind, F.lit("): add "), k)).when(style == 1, text(F.lit("AB-"), k, F.lit(": "), kind))
        .when(style == 2, text(F.lit("[XY-"), k, F.lit("] "), kind)).when(style == 3, text(F.lit("#"), k, F.lit(" "), kind))
        .otherwise(text(kind, F.lit(" "), k))
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("repo"), F.col("event_id").cast("string").alias("hash"), "ts",
        subject.alias("subject"), kind.alias("event_type"),
    )


@query("h5_commit_convention", "WITH " + SUBJECT_SQL + r""",
s AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash DESC) AS nth FROM talk),
c AS (
  SELECT repo, count(*) AS n,
    count(*) FILTER (WHERE regexp_matches(subject, '^(feat|fix|docs|style|refactor|perf|test|chore|ci|build)(\([^)]+\))?[!]?:\s')) AS typed,
    string_agg(DISTINCT CASE WHEN regexp_matches(subject, '^feat(\([^)]+\))?[!]?:\s') THEN 'feat' END, ',') AS types,
    count(*) FILTER (WHERE regexp_matches(subject, '^([A-Z]{2,10}-\d+)')) AS jira,
    count(*) FILTER (WHERE regexp_matches(subject, '^\[([A-Z]{2,10}-\d+)\]')) AS bracket,
    count(*) FILTER (WHERE regexp_matches(subject, '^#(\d+)')) AS gh
  FROM s WHERE nth <= 20 GROUP BY repo HAVING count(*) >= 3)
SELECT repo, CASE WHEN jira >= n * 0.3 THEN '{ticket}: {description}' WHEN bracket >= n * 0.3 THEN '[{ticket}] {description}'
    WHEN gh >= n * 0.3 THEN '{ticket}: {description}' WHEN typed >= n * 0.3 THEN '{type}({scope}): {description}' END AS format,
  CASE WHEN jira >= n * 0.3 THEN '[A-Z]{2,10}-\d+' WHEN bracket >= n * 0.3 THEN '[A-Z]{2,10}-\d+' WHEN gh >= n * 0.3 THEN '#\d+' END AS ticket_pattern,
  coalesce(types, '') AS types
FROM c WHERE greatest(jira, bracket, gh, typed) >= n * 0.3""")
def h5(spark, sf):
    return H.commit_convention(talk(spark, sf)).withColumn("types", F.array_join("types", ","))


@query("h6_commit_style", "WITH " + SUBJECT_SQL + r""",
s AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash DESC) AS nth FROM talk),
c AS (SELECT repo, count(*) AS n, count(*) FILTER (WHERE regexp_matches(subject, '^feat(\(.+?\))?:')) AS typed FROM s WHERE nth <= 20 GROUP BY repo),
b AS (SELECT 'p' || user_id AS repo, bool_or(event_type = 'purchase' AND k % 7 = 0) AS f, bool_or(event_type = 'signup' AND k % 5 = 0) AS g
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1)
SELECT c.repo, CASE WHEN typed > 0 AND typed >= n * 0.5 THEN 'conventional' ELSE 'freeform' END AS commit_convention,
  CASE WHEN f THEN 'feat/<name>' WHEN g THEN 'gitflow' WHEN f IS NOT NULL THEN '<type>/<name>' ELSE 'unknown' END AS branch_pattern
FROM c LEFT JOIN b USING (repo)""")
def h6(spark, sf):
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    branches = table(spark, sf, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("repo"),
        F.when((kind == "purchase") & (k % 7 == 0), "feature/x").when((kind == "signup") & (k % 5 == 0), "release/1").otherwise("wip").alias("branch"),
    )
    return H.commit_style(talk(spark, sf), branches)


@query("h7_contributors_pace", COMMITS + f""",
c AS (SELECT repo, author, count(DISTINCT hash) AS commits,
             count(DISTINCT hash) FILTER (WHERE ts > {NOW} - INTERVAL 7 DAYS AND ts <= {NOW}) AS week FROM commits GROUP BY 1, 2)
SELECT *, rank() OVER (PARTITION BY repo ORDER BY commits DESC) AS rank FROM c""")
def h7(spark, sf):
    return H.contributors_pace(A.commits(spark, sf), A.as_of()).select("repo", "author", "commits", "week", "rank")


STATUS = ["M  a", " M a", "MM a", "?? a", "UU a", "AA a", "A  a", " D a", "R  a", "DD a"]


@query("h8_status_counts", """
WITH s AS (
  SELECT 'p' || user_id AS repo, list_extract(['M  a', ' M a', 'MM a', '?? a', 'UU a', 'AA a', 'A  a', ' D a', 'R  a', 'DD a'],
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 + 1) AS line FROM events)
SELECT repo, count(*) FILTER (WHERE left(line, 1) IN ('M', 'A', 'D', 'R', 'C')) AS staged,
  count(*) FILTER (WHERE substr(line, 2, 1) IN ('M', 'D')) AS modified, count(*) FILTER (WHERE line LIKE '??%') AS untracked,
  count(*) FILTER (WHERE left(line, 1) = 'U' OR substr(line, 2, 1) = 'U' OR left(line, 2) IN ('AA', 'DD')) AS conflicts
FROM s GROUP BY repo""".replace("line LIKE '??%'", "left(line, 2) = '??'"))
def h8(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % len(STATUS)
    return H.status_counts(
        table(spark, sf, "events").select(
            F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("repo"), F.get(F.array(*[F.lit(s) for s in STATUS]), k).alias("line")
        )
    )


@query("h9_top_accessed", COMMITS + """
SELECT repo, file, count(*) AS reads FROM commits WHERE subject = 'view' GROUP BY 1, 2 ORDER BY reads DESC, repo, file LIMIT 15""")
def h9(spark, sf):
    return H.top_accessed(A.commits(spark, sf).filter("subject = 'view'"))


@query("h9_first_queries", COMMITS + """
SELECT file AS query, min(ts) AS first_ts FROM commits WHERE subject = 'click' GROUP BY 1 ORDER BY 2, 1 LIMIT 10""")
def h9_queries(spark, sf):
    return H.first_queries(A.commits(spark, sf).filter("subject = 'click'").select("ts", F.col("file").alias("query")))


@query("a10_read_commit_log", COMMITS + "SELECT repo, hash, author, ts, file FROM commits")
def a10(spark, sf):
    """Events written out as log text lines (header, file, blank) and read back."""
    c = A.commits(spark, sf).withColumn("n", F.col("hash").cast("long") * 3)
    head = F.concat_ws("__", F.lit(""), F.lit("COMMIT"), "hash", F.col("ts").cast("string"), "author")
    rows = c.select("repo", F.explode(F.array(
        F.struct(F.col("n").alias("pos"), head.alias("text")),
        F.struct((F.col("n") + 1).alias("pos"), F.lit("").alias("text")),
        F.struct((F.col("n") + 2).alias("pos"), F.concat(F.lit("  "), F.col("file")).alias("text")),
    )).alias("l")).select("repo", "l.pos", "l.text")
    return logs.read_commit_log(rows, chunk=1024).drop("subject")


# ---------------------------------------------------------------- sessions


@query("a12_read_sessions", MESSAGES + "SELECT session_id::VARCHAR || ':' || turn AS session_id, 's' || turn AS name, CAST(0 AS INTEGER) AS turn, role, text, ts FROM messages")
def a12(spark, sf):
    """Each message wrapped as a one-message session document and read back."""
    m = A.messages(spark, sf)
    doc = F.to_json(F.struct(
        F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("s"), F.col("turn").cast("string")).alias("name"), F.col("ts").cast("string").alias("updatedAt"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"),
    ))
    return logs.read_sessions(m.select(doc.alias("json")))


@query("a12_whole_sessions", MESSAGES + """
SELECT session_id::VARCHAR AS session_id, 'all' AS name, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, role, text) - 1 AS INTEGER) AS turn, role, text,
  max(ts) OVER (PARTITION BY session_id) AS ts FROM messages""")
def a12_whole(spark, sf):
    """Each conversation as one session document, read back message by message."""
    m = A.messages(spark, sf)
    per = m.groupBy("session_id").agg(F.max("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("said"))
    doc = F.to_json(F.struct(
        F.col("session_id").cast("string").alias("id"), F.lit("all").alias("name"), F.col("ts").cast("string").alias("updatedAt"),
        F.transform("said", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"),
    ))
    return logs.read_sessions(per.select(doc.alias("json")))


@query("l1_session_list", MESSAGES + """
SELECT repo, session_id, count(*) AS messages, min(ts) AS created, max(ts) AS updated FROM messages GROUP BY 1, 2""")
def l1(spark, sf):
    return L.session_list(A.messages(spark, sf))


@query("l2_resolve_prefix", MESSAGES + """
SELECT repo, min(session_id::VARCHAR) AS session_id FROM messages WHERE starts_with(session_id::VARCHAR, '7') GROUP BY 1""")
def l2(spark, sf):
    return L.resolve_prefix(A.messages(spark, sf), "7")


PAIRS_SQL = MESSAGES + """,
pairs AS (
  SELECT repo, session_id, turn, text AS question, ans AS answer FROM (
    SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS ans FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY turn))
  WHERE role = 'user' AND nr = 'assistant' AND NOT starts_with(text, '[Tool result:') AND NOT starts_with(text, '[SYSTEM')
    AND NOT starts_with(text, '[WORKING MEMORY') AND NOT starts_with(text, '[CONTEXT'))
"""


@query("l3_qa_pairs", PAIRS_SQL + "SELECT * FROM pairs")
def l3(spark, sf):
    return L.qa_pairs(A.messages(spark, sf))


def _words(col, stop, keep):
    words = ", ".join(f"'{w}'" for w in stop)
    return (
        f"list_filter(regexp_split_to_array(regexp_replace(lower({col}), '[^a-z0-9\\s{keep}]', ' ', 'g'), '\\s+'), "
        f"lambda w: length(w) > 2 AND w NOT IN ({words}))"
    )


def related_sql(recent: str, score: str) -> str:
    return PAIRS_SQL + f""",
newest AS (SELECT session_id FROM messages GROUP BY 1 ORDER BY max(ts) DESC, session_id {recent}),
t AS (SELECT *, {_words('question', L.SEARCH_STOP_WORDS, '_.-')} AS target FROM pairs WHERE session_id IN (SELECT session_id FROM newest)),
asked AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'),
q AS (SELECT id, {_words('text', L.SEARCH_STOP_WORDS, '_.-')} AS query FROM asked),
s AS (
  SELECT q.id, t.*, CASE WHEN len(query) = 0 OR len(target) = 0 THEN 0.0 ELSE
    round(len(list_filter(query, lambda w: list_contains(target, w))) / len(list_distinct(list_concat(query, target))), 6) END AS score
  FROM q, t),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, session_id, turn) AS nth FROM s WHERE score >= {score})
SELECT repo, id, session_id, turn, left(question, 500) AS question, left(answer, 1500) AS answer, CAST(score AS DOUBLE) AS score
FROM r WHERE nth <= 3"""


def questions(spark, sf):
    """Benchmark items and all that users said."""
    said = table(spark, sf, "conversations").filter("role = 'user'")
    return table(spark, sf, "benchmark").select(F.lit("chat").alias("repo"), F.col("item_id").alias("id"), "text").unionByName(
        said.select(F.lit("chat").alias("repo"), (1000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    )


@query("l4_related_exchanges", related_sql("LIMIT 20", "0.15"))
def l4(spark, sf):
    return L.related_exchanges(questions(spark, sf), A.messages(spark, sf), min_score=0.15, recent=20, shown=(500, 1500))


@query("l4_related_exchanges_all", related_sql("", "0.15"))
def l4_all(spark, sf):
    return L.related_exchanges(questions(spark, sf), A.messages(spark, sf), min_score=0.15, shown=(500, 1500))


@query("l5_rank_symbols", """
WITH s AS (
  SELECT 'shop' AS repo, p_partkey AS id, p_name AS name, p_brand AS file,
    CASE WHEN lower(p_name) = 'red' THEN 10 WHEN contains(lower(p_name), 'red') THEN 5 WHEN contains(lower(p_brand), 'red') THEN 2 ELSE 0 END
    + CASE WHEN lower(p_name) = 'ring' THEN 10 WHEN contains(lower(p_name), 'ring') THEN 5 WHEN contains(lower(p_brand), 'ring') THEN 2 ELSE 0 END
    + CASE WHEN lower(p_name) = 'brand#1' THEN 10 WHEN contains(lower(p_name), 'brand#1') THEN 5 WHEN contains(lower(p_brand), 'brand#1') THEN 2 ELSE 0 END AS score
  FROM part)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, repo, name, id LIMIT 20""")
def l5(spark, sf):
    symbols = table(spark, sf, "part").select(
        F.lit("shop").alias("repo"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file")
    )
    return L.rank_symbols(symbols, "Red ring a Brand#1")


USE_SQL = MESSAGES + """,
used AS (SELECT repo, session_id, CAST(sum(CAST(ceil(length(text) / 3.8) AS BIGINT) + 4) AS BIGINT) AS tokens, count(*) AS n FROM messages GROUP BY 1, 2),
modelled AS (
  SELECT *, list_extract(['llama3:70b', 'llama2', 'Mistral', 'codellama', 'unheard-of'], CAST(session_id % 5 AS INTEGER) + 1) AS model,
         list_extract([6144, 3072, 6144, 12288, 6144], CAST(session_id % 5 AS INTEGER) + 1)::BIGINT AS budget FROM used)
"""
MODELS = ["llama3:70b", "llama2", "Mistral", "codellama", "unheard-of"]


def models(spark, sf):
    pick = F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("session_id") % 5).cast("int"))
    return A.messages(spark, sf).select("repo", "session_id").distinct().withColumn("model", pick)


@query("l6_token_usage", USE_SQL + "SELECT repo, session_id, tokens FROM used")
def l6(spark, sf):
    return L.token_usage(A.messages(spark, sf))


@query("l7_over_budget", USE_SQL + """
SELECT repo, session_id, tokens, model, budget, greatest(0, tokens - budget) AS excess, tokens > budget AS over FROM modelled""")
def l7(spark, sf):
    return L.over_budget(L.token_usage(A.messages(spark, sf)).join(models(spark, sf), ["repo", "session_id"]))


LONG_SQL = """,
long_ AS (SELECT repo, session_id, turn * 8 + i AS turn, repeat(text, 4) AS text FROM messages, range(8) r(i)),
shape AS (
  SELECT repo, session_id, count(*) AS n, min(turn) AS lo, max(turn) AS hi, sum(CAST(ceil(length(text) / 3.8) AS BIGINT) + 4) AS tokens
  FROM long_ GROUP BY 1, 2)
"""


@query("l8_compaction_plan", USE_SQL + LONG_SQL + """
SELECT l.repo, l.session_id, CAST(l.turn AS INTEGER) AS turn, CASE WHEN l.turn = lo OR l.turn > hi - 6 THEN 'keep' ELSE 'summarise' END AS action
FROM long_ l JOIN shape s USING (repo, session_id) JOIN modelled m USING (repo, session_id)
WHERE s.tokens > m.budget * 0.7 AND s.n > 8""")
def l8(spark, sf):
    """Sessions stretched eightfold, so that some fill their context."""
    long = A.messages(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
        "repo", "session_id", (F.col("turn") * 8 + F.col("i")).alias("turn"), F.repeat("text", F.lit(4)).alias("text")
    )
    return L.compaction_plan(long, models(spark, sf))


@query("l9_truncate_middle", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, md5(CASE WHEN ceil(length(text) / 3.8) <= 200 THEN text ELSE
  left(text, 342) || chr(10) || chr(10) || '[… ~' || (CAST(ceil(length(text) / 3.8) AS BIGINT) - 200) || ' tokens omitted …]' || chr(10) || chr(10) || right(text, 342) END) AS digest
FROM documents""")
def l9(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.length("text").alias("chars"), F.md5(L.truncate_middle(F.col("text"), 200)).alias("digest")
    )


@query("l9_truncate_lines", """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, CAST(ceil(length(text) / 3.8) AS BIGINT) AS tk FROM documents)
SELECT doc_id,
  md5(CASE WHEN tk <= 100 OR len(ls) <= 10 THEN text ELSE array_to_string(ls[1:4], chr(10)) || chr(10) || chr(10) || '[… ' || (len(ls) - 8)
      || ' lines omitted …]' || chr(10) || chr(10) || array_to_string(ls[-4:], chr(10)) END) AS as_file,
  md5(CASE WHEN tk <= 100 OR len(ls) <= 12 THEN text ELSE array_to_string(ls[1:12], chr(10)) || chr(10) || chr(10) || '[… ' || (len(ls) - 12)
      || ' more results truncated]' END) AS as_results
FROM d""")
def l9_lines(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(L.truncate_lines(t, 100)).alias("as_file"), F.md5(L.truncate_results(t, 100)).alias("as_results")
    )


@query("l10_loop_detection", """
WITH c AS (SELECT 'app' AS repo, user_id AS session_id, event_id AS seq, event_type AS name, props AS args FROM events),
g AS (SELECT repo, session_id, count(*) AS calls, count(*) - count(DISTINCT name || args) AS repeats,
             count(*) FILTER (WHERE name = 'error') AS errors FROM c GROUP BY 1, 2),
l AS (SELECT session_id, count(*) FILTER (WHERE name = 'view') AS v FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM c) WHERE r <= 3 GROUP BY 1)
SELECT repo, session_id, calls, repeats, errors, CASE WHEN calls < 2 THEN NULL WHEN errors >= 2 THEN 'errors' WHEN repeats >= 2 THEN 'repeats'
  WHEN v = 3 THEN 'searching' END AS hint FROM g JOIN l USING (session_id)""")
def l10(spark, sf):
    calls = table(spark, sf, "events").select(
        F.lit("app").alias("repo"), F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("seq"),
        F.col("event_type").alias("name"), F.col("props").alias("args"), (F.col("event_type") == "error").alias("error"),
    )
    return L.loop_detection(calls, "view")


_TERMS = _words("question", L.ANSWER_STOP_WORDS, "")


@query("l11_validate_answers", PAIRS_SQL + f""",
w AS (SELECT *, trim(answer, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(160) || chr(65279)) AS a, {_TERMS} AS terms FROM pairs),
v AS (SELECT *, CASE WHEN length(a) = 0 THEN 'empty'
    WHEN (a LIKE '{{%' OR a LIKE '[%') AND NOT contains(a, '```') AND length(a) > 10 THEN 'raw json' WHEN length(a) < 20 THEN 'too short'
    WHEN length(a) > 50 AND len(terms) >= 2 AND len(list_filter(terms, lambda t: contains(lower(a), t))) / len(terms) < 0.15 THEN 'off topic' END AS reason FROM w)
SELECT repo, session_id, turn, reason, reason IS NULL AS valid FROM v""")
def l11(spark, sf):
    return L.validate_answers(L.qa_pairs(A.messages(spark, sf))).select("repo", "session_id", "turn", "reason", "valid")


@query("l12_recent_tool_results", MESSAGES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS nth FROM messages WHERE role = 'assistant')
SELECT repo, session_id, turn, CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS text FROM r WHERE nth <= 6""")
def l12(spark, sf):
    return L.recent_tool_results(A.messages(spark, sf), is_tool=F.col("role") == "assistant")


@query("l13_request_key", MESSAGES + """
SELECT repo, sha256(to_json({'provider': 'p' || (turn % 2), 'model': '', 'messages': [{'role': role, 'content': text}], 'temperature': 0.0::DOUBLE, 'systemPrompt': ''})::VARCHAR) AS key,
  count(*) AS requests FROM messages GROUP BY 1, 2""")
def l13(spark, sf):
    key = L.request_key(
        F.concat(F.lit("p"), (F.col("turn") % 2).cast("string")), F.lit(None).cast("string"),
        F.array(F.struct("role", F.col("text").alias("content"))), F.lit(None).cast("double"), F.lit(None).cast("string"),
    )
    return L.repeated_requests(A.messages(spark, sf).select("repo", key.alias("key")))


@query("l14_cache_lookup", REQUESTS + """,
e AS (SELECT * FROM requests WHERE id % 2 = 0), q AS (SELECT * FROM requests WHERE id % 2 = 1),
j AS (SELECT q.*, (SELECT max(e.created_at) FROM e WHERE e.key = q.key AND e.created_at <= q.created_at) AS prev FROM q)
SELECT repo, id, key, coalesce(epoch_us(created_at) - epoch_us(prev) <= 3600000000, false) AS hit,
  CASE WHEN epoch_us(created_at) - epoch_us(prev) <= 3600000000 THEN prev END AS hit_ts,
  CASE WHEN epoch_us(created_at) - epoch_us(prev) <= 3600000000 THEN (epoch_us(created_at) - epoch_us(prev)) / 1000000.0::DOUBLE END AS age FROM j""")
def l14(spark, sf):
    """Even events store an entry, odd ones ask for it."""
    r = A.requests(spark, sf)
    return L.cache_lookup(r.filter("id % 2 = 1"), r.filter("id % 2 = 0"))


@query("l15_cache_stats", REQUESTS + """,
s AS (SELECT repo, key, max(created_at) AS at_, max_by(strlen(text), id) AS size FROM requests GROUP BY 1, 2)
SELECT repo, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, min(at_) AS oldest, max(at_) AS newest FROM s GROUP BY 1""")
def l15(spark, sf):
    return L.cache_stats(A.requests(spark, sf))


@query("l15_cache_prune", REQUESTS + f"SELECT repo, id, key FROM requests WHERE created_at < {NOW} - INTERVAL 86400 SECONDS")
def l15_prune(spark, sf):
    return L.cache_prune(A.requests(spark, sf), A.as_of(), 86400).select("repo", "id", "key")


@query("l16_parse_verdicts", """
WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events)
SELECT event_id, k % 5 = 0 OR k % 5 IN (1, 3) AS pass,
  CASE WHEN k % 5 = 0 THEN 0.0 WHEN k % 5 IN (1, 2) THEN least(1.0, k / 40.0) ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN k % 5 = 0 THEN 'Empty critic response.' WHEN k % 5 = 4 THEN 'No reason provided.' ELSE 'about ' || event_type END AS reason
FROM k""")
def l16(spark, sf):
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    conf = F.concat(F.lit("\nConfidence: "), (k / 40.0).cast("string"))
    why = F.concat(F.lit("\n\n  reason: about "), kind)
    text = (
        F.when(k % 5 == 0, "  \n ").when(k % 5 == 1, F.concat(F.lit(" pass "), conf, why))
        .when(k % 5 == 2, F.concat(F.lit("FAIL"), conf, why)).when(k % 5 == 3, F.concat(F.lit("Verdict: PASS"), why)).otherwise("fail")
    )
    return L.parse_verdicts(table(spark, sf, "events").select("event_id", text.alias("text"))).drop("text")
