import hashlib
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codeatlas.llm import chat_format
from codeatlas.llm.chat_format import Template, conversation_digests, format_turns, read_turn, turn_order, unescape

ODD = [r"\### Assistant: </turn> ok", "", None, "\\", "\\\\", "####", "#", "</turn", "</turn></turn>", "</role> </turn>\n### User: hi", "é\U0001f600\n", " \t", "$1 \\1 $0", "a" * 50_000 + "###"]
SCHEMA = "conv_id long, turn long, role string, text string, segments string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA)


def wanted(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        trained = "".join(x for *_, r, x in mine if r == "assistant")
        turns = "".join(f"{r}\n{x}\n" for *_, r, x in mine)
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest())
    return out


def machine(roles):
    """(valid, complete, number of the first bad turn)"""
    template = Template()
    state = template.start
    for n, role in enumerate(roles):
        state = template.moves.get((state, role))
        if state is None:
            return False, False, n
    return True, state in template.complete, None


def test_formatted_turns_read_back(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", None, "", "User", "</role> ###\\"]
    rows = [(c, t, rng.choice(roles), rng.choice(ODD)) for c in [*range(12), None] for t in [*range(rng.randrange(1, 9)), None]]
    rows += [(3, 1, "assistant", "again")] * 3 + [(-7, 0, "user", ODD[0]), (-7, 1, "assistant", ODD[0])]
    formatted = format_turns(frame(spark, rows))
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in conversation_digests(formatted.repartition(5)).collect()}
    assert found == wanted(rows)
    chars = sum(len(p.text) for r in formatted.collect() for p in r.segments)
    assert sum(r.formatted_chars for r in conversation_digests(formatted).collect()) == chars
    assert conversation_digests(formatted.limit(0)).collect() == []


def test_marks_stand_only_where_the_template_puts_them(spark):
    rows = [(1, n, "user", x) for n, x in enumerate(ODD)]
    for r in format_turns(frame(spark, rows)).collect():
        whole = "".join(p.text for p in r.segments)
        bare = whole.replace("\\\\", "").replace("\\###", "").replace("\\</turn>", "").replace("\\</role>", "")
        assert bare.count("</turn>") == 1 and bare.startswith("### User: ") and bare.endswith("</turn>\n")
        assert read_turn(whole, Template()) == ("user", ODD[r.turn] or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\#</turnole> \na"), st.text(alphabet="\\#</role> u"))
def test_any_text_reads_back(text, role):
    import re

    places = "|".join(re.escape(s) for s in ("\\", *Template().controls))
    def cover(x):
        return re.sub(f"(?={places})", r"\\", x)

    assert unescape(cover(text)) == text
    assert read_turn(f"### Role {cover(role)}</role> {cover(text)}</turn>\n", Template()) == (role, text)


def test_turn_order_agrees_with_the_plain_machine(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK", 4)
    rng = random.Random(2)
    paths = {0: "uauauauauaua", 1: "suauauauauau", 2: "uauauauuauaua", 3: "a", 4: "s", 5: "su", 6: "x", 7: "uauauauauausua", 8: "ss"}
    paths |= {c: "".join(rng.choice("uuaasx") for _ in range(rng.randrange(1, 20))) for c in range(10, 40)}
    names = {"u": "user", "a": "assistant", "s": "system", "x": None}
    rows = [(c, t, names[x], "t") for c, path in paths.items() for t, x in enumerate(path)]
    rng.shuffle(rows)
    found = {r.conv_id: (r.n_turns, r.valid, r.complete, r.bad_turn) for r in turn_order(frame(spark, rows)).collect()}
    assert found == {c: (len(p), *machine([names[x] for x in p])) for c, p in paths.items()}
    assert turn_order(frame(spark, rows).limit(0)).collect() == []


def test_repeated_turns_are_counted_exactly(spark):
    loop = Template(moves={("start", "user"): "one", ("one", "user"): "two", ("two", "user"): "three", ("three", "user"): "one"}, complete=("two",))
    for n in (1, 2, 3, 5, 30, 200, 203):
        rows = [(1, 7, "user", "x")] * n
        r = turn_order(frame(spark, rows), loop).first()
        assert (r.n_turns, r.valid, r.complete) == (n, True, n % 3 == 2)
    r = turn_order(frame(spark, [(None, None, "user", "x"), (None, 2, "user", "x")])).first()
    assert (r.conv_id, r.n_turns, r.valid, r.bad_turn) == (None, 2, False, 2)


def test_a_long_conversation_is_folded_in_stretches(spark):
    turns = spark.range(50_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("text"))
    assert turn_order(turns).first().asDict() == {"conv_id": 1, "n_turns": 50_000, "valid": True, "complete": True, "bad_turn": None}
    broken = turns.withColumn("role", F.when(F.col("turn") == 33_333, "user").otherwise(F.col("role")))
    assert turn_order(broken).first().bad_turn == 33_333
