"""Session, answer and cache logs.

`turn` numbers the messages of a session without gaps, as `read_sessions` does.  Neighbouring messages are therefore
found by an equi-join on (session, turn), which spreads even a session holding a third of all messages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeatlas.functions.scan import keep_where
from codeatlas.functions.text import split_lines, trim
from codeatlas.operators import overlap
from codeatlas.operators.reach import _hashed
from codeatlas.session import cut, dealt

# Words that say nothing about a topic (search, then answer checks), model context sizes, ratios.
SEARCH_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at",
    "by", "from", "as", "into", "through", "about", "this", "that", "and", "or", "but", "not", "so", "if", "then",
    "than", "too", "very", "just", "how", "where", "what", "which", "who", "when", "why", "all", "each", "every",
    "some", "any", "its", "it", "you", "your", "we", "our", "they", "their", "i", "me", "my", "change", "adding",
    "using", "make", "use",
]
ANSWER_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at",
    "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "out", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "because", "but", "and", "or", "if", "while", "about", "this", "that", "these",
    "those", "what", "which", "who", "whom", "its", "it", "you", "your", "we", "our", "they", "their", "i", "me",
    "my", "change", "adding", "using", "make",
]
INJECTED = ["[Tool result:", "[SYSTEM", "[WORKING MEMORY", "[CONTEXT"]
CHARS_PER_TOKEN, MESSAGE_OVERHEAD = 3.8, 4
MODEL_LIMITS = {
    "llama3.2": 128_000, "llama3.2:1b": 8_192, "llama3.2:3b": 128_000, "llama3.1": 128_000, "llama3": 8_192,
    "llama2": 4_096, "mistral": 8_192, "mixtral": 32_768, "codellama": 16_384, "deepseek-coder": 16_384,
    "deepseek-coder-v2": 128_000, "qwen2.5-coder": 128_000, "phi3": 128_000, "gemma2": 8_192, "command-r": 128_000,
}
DEFAULT_LIMIT, USAGE_RATIO, COMPACTION_RATIO, KEEP_RECENT = 8_192, 0.75, 0.7, 6
_HELD = 24_000_000  # words of texts that a task can take into its memory


def session_list(messages: DataFrame) -> DataFrame:
    """(repo, session_id, messages, created, updated), newest first."""
    return messages.groupBy("repo", "session_id").agg(
        F.count("*").alias("messages"), F.min("ts").alias("created"), F.max("ts").alias("updated")
    ).orderBy(F.desc("updated"), "repo", "session_id")


def resolve_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The first session whose id begins with the prefix, per repo."""
    sid = F.col("session_id").cast("string")
    return sessions.filter(sid.startswith(prefix)).groupBy("repo").agg(F.min(sid).alias("session_id"))


def qa_pairs(messages: DataFrame) -> DataFrame:
    """(repo, session_id, turn, question, answer): a user turn and the assistant turn right after it.

    Turns put in by the tool loop are no questions.
    """
    injected = reduce(lambda a, b: a | b, [F.col("text").startswith(p) for p in INJECTED])
    asked = messages.filter((F.col("role") == "user") & ~injected).select(
        "repo", "session_id", "turn", F.col("text").alias("question")
    )
    said = messages.filter("role = 'assistant'").select(
        "repo", "session_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(said, ["repo", "session_id", "turn"])


def topic_tokens(text: Column) -> Column:
    """Lower-cased words of three letters and more, stop words left out, repeats kept."""
    clean = F.regexp_replace(F.lower(text), r"[^a-z0-9\s_.-]", " ")
    stop = F.array(*[F.lit(w) for w in SEARCH_STOP_WORDS])
    return F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def overlap_score(query: Column, target: Column) -> Column:
    """Query words found in the target, repeats counted, over the distinct words of both."""
    hits = F.size(F.filter(query, lambda t: F.array_contains(target, t)))
    union = F.size(F.array_union(query, target))
    return F.when((F.size(query) == 0) | (F.size(target) == 0), 0.0).otherwise(F.round(hits / union, 6))


def newest_sessions(messages: DataFrame, k: int = 20) -> DataFrame:
    w = Window.partitionBy("repo").orderBy(F.desc("updated"), "session_id")
    listed = messages.groupBy("repo", "session_id").agg(F.max("ts").alias("updated"))
    return listed.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).select("repo", "session_id")


def _scored_in_memory(queries: DataFrame, targets: DataFrame, n: int, min_score: float) -> DataFrame:
    """(q, t, score) of the pairs that can be among the best n of q.  Words travel as numbers: all of the targets to each task, and a share of the queries."""
    said = lambda df, words: df.select("repo", F.explode(words).alias("id"))
    _, number = _hashed(said(queries, "query").unionByName(said(targets, "target")))
    tasks = min(2 * queries.sparkSession.sparkContext.defaultParallelism, queries.count() // 256 + 1)
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    theirs = targets.select(F.transform("target", lambda w: number(w)).alias("words"), "t").select(every, "t", "words")
    own = queries.select(F.pmod(F.xxhash64("q"), F.lit(tasks)).cast("int").alias("task"), "q", F.transform("query", lambda w: number(w)).alias("words"))
    dealt_out = theirs.unionByName(own, allowMissingColumns=True).repartitionById(tasks, "task")
    pairs = cut(dealt_out.mapInArrow(lambda batches: overlap.best(batches, n, min_score), overlap.PAIRS))
    return pairs.select("q", "t", F.round(F.col("hits") / F.col("all"), 6).alias("score")).filter(F.col("score") >= min_score)


def _scored_by_joins(queries: DataFrame, targets: DataFrame, min_score: float) -> DataFrame:
    """(q, t, score) of all pairs that reach the score."""
    words = targets.select("repo", "t", "target", F.explode("target").alias("word"))
    frequency = words.groupBy("repo", "word").agg(F.count("*").alias("df"))
    weighed = queries.select("repo", "q", F.size(F.array_distinct("query")).alias("width"), F.explode("query").alias("word")).groupBy(
        "repo", "q", "width", "word"
    ).agg(F.count("*").alias("w"))
    by_common = Window.partitionBy("repo", "q").orderBy(F.desc("df"), "word").rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        weighed.join(frequency, ["repo", "word"])  # words no exchange holds cannot bring a candidate
        .withColumn("reach", F.sum("w").over(by_common))
        .filter(F.col("reach") >= F.col("width") * min_score - 1e-9)
        .select("repo", "q", "word")
    )
    # An exchange with more distinct words than the question's words could outweigh is no candidate either.
    most = F.size("query") / F.lit(max(min_score, 1e-9)) + 1e-9
    met = dealt(kept.join(queries, ["repo", "q"]), "repo", "word").join(dealt(words, "repo", "word"), ["repo", "word"]).filter(F.size("target") <= most)
    return keep_where(met, "score", overlap_score(F.col("query"), F.col("target")), lambda s: s >= min_score).select("q", "t", "score")


def related_exchanges(
    questions: DataFrame, messages: DataFrame, n: int = 3, min_score: float = 0.15, recent: int | None = None,
    shown: tuple[int, int] | None = None,
) -> DataFrame:
    """(repo, id, session_id, turn, question, answer, score): the best earlier exchanges for each question (repo, id, text).

    Texts are compared as classes of equal words, so what is said often is compared once; of the exchanges of a class only the first `n`
    can be among the best.  Where a task can hold the words of all exchanges, each compares a share of the questions with them in memory.

    Else classes meet in an equi-join on words and bring their word lists along: the score is told in the join, and only
    pairs that reach it are written, so what is shuffled grows with the texts and not with the pairs compared.  A question's
    commonest words are left out of that join as long as they could not reach the score by themselves: a pair sharing only those
    scores below `min_score`, so the result is the same and the words found everywhere never meet.
    """
    pairs = qa_pairs(messages)
    if recent is not None:
        pairs = pairs.join(newest_sessions(messages, recent), ["repo", "session_id"], "left_semi")
    numbered = lambda texts, words, num: cut(texts.filter(F.size(words) > 0).select("repo", words).distinct().withColumn(num, F.monotonically_increasing_id()))
    known = pairs.select("repo", "session_id", "turn", F.array_sort(F.array_distinct(topic_tokens(F.col("question")))).alias("target"))
    asked = questions.select("repo", "id", F.array_sort(topic_tokens(F.col("text"))).alias("query"))
    targets, queries = numbered(known, "target", "t"), numbered(asked, "query", "q")
    firsts = Window.partitionBy("t").orderBy("session_id", "turn")
    exchanges = known.join(targets, ["repo", "target"]).select("t", "session_id", "turn").withColumn("nth", F.row_number().over(firsts)).filter(F.col("nth") <= n).drop("nth")
    if targets.agg(F.coalesce(F.sum(F.size("target")), F.lit(0))).first()[0] <= _HELD:
        scored = _scored_in_memory(queries, targets, n, min_score)
    else:
        scored = _scored_by_joins(queries, targets, min_score)
    scored = scored.distinct()  # a pair may meet on several words
    first_n = lambda df, *key: df.withColumn(
        "nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "session_id", "turn"))
    ).filter(F.col("nth") <= n).drop("nth")
    best = first_n(scored.join(exchanges, "t").select("q", "session_id", "turn", "score"), "q")
    ids = asked.join(queries, ["repo", "query"]).select("repo", "id", "q")
    top = first_n(ids.join(best, "q").select("repo", "id", "session_id", "turn", "score"), "repo", "id")
    shorten = lambda c, i: F.col(c) if shown is None else F.left(c, F.lit(shown[i])).alias(c)
    return top.join(pairs, ["repo", "session_id", "turn"]).select("repo", "id", "session_id", "turn", shorten("question", 0), shorten("answer", 1), "score")


def rank_symbols(symbols: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Input columns + score: per term exact name 10, part of the name 5, part of the path 2; best first."""
    terms = [t for t in query.lower().split() if len(t) > 1]
    name, file = F.lower("name"), F.lower("file")
    points = [F.when(name == t, 10).when(name.contains(t), 5).when(file.contains(t), 2).otherwise(0) for t in terms]
    scored = symbols.withColumn("score", reduce(lambda a, b: a + b, points, F.lit(0)))
    return scored.filter("score > 0").orderBy(F.desc("score"), "repo", "name", "id").limit(k)


# ---------------------------------------------------------------- tokens and budgets


def tokens(text: Column | str) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN))


def token_usage(messages: DataFrame) -> DataFrame:
    """(repo, session_id, tokens): estimated tokens with a fixed overhead per message."""
    return messages.groupBy("repo", "session_id").agg(F.sum(tokens("text") + MESSAGE_OVERHEAD).alias("tokens"))


def context_budget(model: Column) -> Column:
    """Tokens a model's context may be filled with: exact name, else the first listed prefix, else the default."""
    name = F.lower(model)
    limit = F.lit(DEFAULT_LIMIT)
    for known, size in reversed(MODEL_LIMITS.items()):
        limit = F.when(name.startswith(known), size).otherwise(limit)
    for known, size in MODEL_LIMITS.items():
        limit = F.when(name == known, size).otherwise(limit)
    return F.floor(F.coalesce(limit, F.lit(DEFAULT_LIMIT)) * F.lit(USAGE_RATIO))


def over_budget(usage: DataFrame) -> DataFrame:
    """Adds budget, excess and over to (repo, session_id, tokens, model)."""
    return usage.withColumn("budget", context_budget(F.col("model"))).withColumn(
        "excess", F.greatest(F.lit(0), F.col("tokens") - F.col("budget"))
    ).withColumn("over", F.col("excess") > 0)


def compaction_plan(messages: DataFrame, models: DataFrame, keep: int = KEEP_RECENT) -> DataFrame:
    """(repo, session_id, turn, action): what to keep and what to summarise in sessions that fill their context."""
    shape = messages.groupBy("repo", "session_id").agg(
        F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"),
        F.sum(tokens("text") + MESSAGE_OVERHEAD).alias("tokens"),
    )
    full = (
        shape.join(models, ["repo", "session_id"], "left")
        .filter(F.col("tokens") > context_budget(F.col("model")) * COMPACTION_RATIO)
        .filter(F.col("n") > keep + 2)
    )
    kept = (F.col("turn") == F.col("lo")) | (F.col("turn") > F.col("hi") - keep)
    return messages.join(full.select("repo", "session_id", "lo", "hi"), ["repo", "session_id"]).select(
        "repo", "session_id", "turn", F.when(kept, "keep").otherwise("summarise").alias("action")
    )


def truncate_middle(text: Column, max_tokens: int) -> Column:
    """Texts over the budget cut to their first and last 45 %, with a note of what is missing."""
    keep = int(int(max_tokens * CHARS_PER_TOKEN) * 0.45)
    note = F.concat(F.lit("\n\n[… ~"), (tokens(text) - max_tokens).cast("string"), F.lit(" tokens omitted …]\n\n"))
    return F.when(tokens(text) <= max_tokens, text).otherwise(
        F.concat(F.left(text, F.lit(keep)), note, F.right(text, F.lit(keep)))
    )


def truncate_lines(text: Column, max_tokens: int = 1500) -> Column:
    """File contents over the budget cut to their first and last lines."""
    most = max_tokens // 10
    keep = int(most * 0.45)
    lines = split_lines(text)
    note = F.concat(F.lit("\n\n[… "), (F.size(lines) - 2 * keep).cast("string"), F.lit(" lines omitted …]\n\n"))
    cut = F.concat(F.array_join(F.slice(lines, 1, keep), "\n"), note, F.array_join(F.slice(lines, -keep, keep), "\n"))
    return F.when((tokens(text) <= max_tokens) | (F.size(lines) <= most), text).otherwise(cut)


def truncate_results(text: Column, max_tokens: int = 1500) -> Column:
    """Search results over the budget cut to their first lines."""
    most = max_tokens // 8
    lines = split_lines(text)
    note = F.concat(F.lit("\n\n[… "), (F.size(lines) - most).cast("string"), F.lit(" more results truncated]"))
    return F.when((tokens(text) <= max_tokens) | (F.size(lines) <= most), text).otherwise(
        F.concat(F.array_join(F.slice(lines, 1, most), "\n"), note)
    )


# ---------------------------------------------------------------- tool calls and answers


def loop_detection(calls: DataFrame, search: str = "search_text") -> DataFrame:
    """(repo, session_id, calls, repeats, errors, hint) of tool calls (repo, session_id, seq, name, args, error)."""
    same = calls.groupBy("repo", "session_id", "name", "args").agg(
        F.count("*").alias("n"), F.sum(F.col("error").cast("long")).alias("e")
    )
    totals = same.groupBy("repo", "session_id").agg(
        F.sum("n").alias("calls"), F.sum(F.col("n") - 1).alias("repeats"), F.sum("e").alias("errors")
    )
    latest = Window.partitionBy("repo", "session_id").orderBy(F.desc("seq"))
    last = (
        calls.select("repo", "session_id", "seq", "name").withColumn("nth", F.row_number().over(latest)).filter("nth <= 3")
        .groupBy("repo", "session_id").agg(F.count_if(F.col("name") == search).alias("searches"))
    )
    hint = (
        F.when(F.col("calls") < 2, None).when(F.col("errors") >= 2, "errors").when(F.col("repeats") >= 2, "repeats")
        .when(F.col("searches") == 3, "searching")
    )
    return totals.join(last, ["repo", "session_id"]).select("repo", "session_id", "calls", "repeats", "errors", hint.alias("hint"))


def validate_answers(pairs: DataFrame, had_tools: Column | bool = True) -> DataFrame:
    """Adds valid and reason (`empty`, `raw json`, `too short`, `off topic`) to question-answer pairs."""
    tools = F.lit(had_tools) if isinstance(had_tools, bool) else had_tools
    answer = trim("answer")
    stop = F.array(*[F.lit(w) for w in ANSWER_STOP_WORDS])
    clean = F.regexp_replace(F.lower("question"), r"[^a-z0-9\s]", " ")
    terms = F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    told = pairs.withColumn("_terms", terms).withColumn("_low", F.lower(answer))
    found = F.size(F.filter("_terms", lambda t: F.col("_low").contains(t)))
    off_topic = (F.size("_terms") >= 2) & (found / F.size("_terms") < 0.15)
    raw = (answer.startswith("{") | answer.startswith("[")) & ~answer.contains("```") & (F.length(answer) > 10)
    reason = (
        F.when(F.length(answer) == 0, "empty").when(raw, "raw json").when(tools & (F.length(answer) < 20), "too short")
        .when(tools & (F.length(answer) > 50) & off_topic, "off topic")
    )
    return told.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_terms", "_low")


def recent_tool_results(messages: DataFrame, k: int = 6, size: int = 300, is_tool: Column | None = None) -> DataFrame:
    """(repo, session_id, turn, text): the last tool results of each session, long ones cut."""
    if is_tool is None:
        is_tool = (F.col("role") == "user") & F.col("text").startswith("[Tool result:")
    latest = Window.partitionBy("repo", "session_id").orderBy(F.desc("turn"))
    last = messages.filter(is_tool).withColumn("nth", F.row_number().over(latest)).filter(F.col("nth") <= k)
    short = F.when(F.length("text") > size, F.concat(F.left("text", F.lit(size)), F.lit("…"))).otherwise(F.col("text"))
    return last.select("repo", "session_id", "turn", short.alias("text"))


# ---------------------------------------------------------------- response cache


def request_key(provider: Column, model: Column, messages: Column, temperature: Column, system_prompt: Column) -> Column:
    """Hash of everything an answer depends on; `messages` is an array of (role, content)."""
    payload = F.struct(
        provider.alias("provider"), F.coalesce(model, F.lit("")).alias("model"), messages.alias("messages"),
        F.coalesce(temperature, F.lit(0.0)).alias("temperature"), F.coalesce(system_prompt, F.lit("")).alias("systemPrompt"),
    )
    return F.sha2(F.to_json(payload), 256)


def repeated_requests(requests: DataFrame) -> DataFrame:
    """(repo, key, requests): how often each request was made."""
    return requests.groupBy("repo", "key").agg(F.count("*").alias("requests"))


PIECES = 64


def cache_lookup(requests: DataFrame, entries: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """(repo, id, key, hit, hit_ts, age): the latest entry of the key at or before the request, if young enough.

    Time is cut into pieces of a lifetime.  The search runs per key and piece; the last entry before a piece comes from a table with
    one row per key and piece, so a key with a third of all requests is spread over its pieces, however busy a lifetime is.
    """
    second = lambda ts: F.unix_micros(ts.cast("timestamp"))
    told = entries.select("repo", "key", F.col("created_at").alias("ts"), F.lit(True).alias("entry"), F.lit(None).cast("long").alias("id"))
    asked = requests.select("repo", "key", F.col("created_at").alias("ts"), F.lit(False).alias("entry"), "id")
    piece = F.greatest(F.lit(1), F.lit(ttl_seconds * 1_000_000) / PIECES)
    both = told.unionByName(asked).withColumn("us", second(F.col("ts"))).withColumn("slot", F.floor(F.col("us") / piece))
    earlier = Window.partitionBy("repo", "key", "slot").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("near", F.max(F.when(F.col("entry"), F.col("ts"))).over(earlier)).filter(~F.col("entry"))
    slots = both.groupBy("repo", "key", "slot").agg(F.max(F.when(F.col("entry"), F.col("ts"))).alias("newest"))
    ahead = Window.partitionBy("repo", "key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = slots.select("repo", "key", "slot", F.max("newest").over(ahead).alias("far"))
    found = here.join(before, ["repo", "key", "slot"], "left").withColumn("at", F.coalesce("near", "far"))
    age = (F.col("us") - second(F.col("at"))) / 1_000_000
    hit = F.coalesce(age <= ttl_seconds, F.lit(False))
    return found.select(
        "repo", "id", "key", hit.alias("hit"), F.when(hit, F.col("at")).alias("hit_ts"), F.when(hit, age).alias("age")
    )


def cache_stats(entries: DataFrame) -> DataFrame:
    """(repo, entries, bytes, oldest, newest); the newest entry of a key is the one stored."""
    stored = entries.groupBy("repo", "key").agg(F.max("created_at").alias("at"), F.max_by(F.octet_length("text"), F.struct("created_at", "id")).alias("size"))
    return stored.groupBy("repo").agg(
        F.count("*").alias("entries"), F.sum("size").cast("long").alias("bytes"), F.min("at").alias("oldest"), F.max("at").alias("newest")
    )


def cache_prune(entries: DataFrame, as_of: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Entries that outlived their time."""
    return entries.filter(F.col("created_at") < as_of - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def parse_verdicts(texts: DataFrame, col: str = "text") -> DataFrame:
    """Adds pass, confidence (0..1, default 0.5) and reason of a critic's answer; an empty answer passes at 0."""
    lines = F.filter(F.transform(split_lines(col), lambda x: trim(x)), lambda x: x != "")
    told = texts.withColumn("_l", lines)
    first = lambda word: F.get(F.filter("_l", lambda x: F.upper(x).startswith(word)), 0)
    number = F.regexp_extract(first("CONFIDENCE"), r"[\d.]+", 0).try_cast("double")
    empty = F.size("_l") == 0
    return (
        told.withColumn("pass", empty | F.upper(F.get("_l", 0)).contains("PASS"))
        .withColumn(
            "confidence",
            F.when(empty, 0.0).when(number.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))),
        )
        .withColumn(
            "reason",
            F.when(empty, "Empty critic response.").otherwise(
                F.coalesce(trim(F.regexp_replace(first("REASON"), r"(?i)^REASON:\s*", "")), F.lit("No reason provided."))
            ),
        )
        .drop("_l")
    )
