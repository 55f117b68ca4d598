"""Chat formatting: a finite-state machine over roles, and a declarative template whose text segments carry loss flags."""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 4096
"""Turn numbers that are folded in one group; a longer conversation is several groups."""

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What a conversation may look like and how its turns are written.

    `moves` names the states of the machine: (state, role) -> state.  What it doesn't name leads to an error, for good.
    `headings` opens a turn of a role; any other role is written out between `other` and `other_end`.  Texts of `trained`
    roles are under the loss.  `controls` are the strings that a text can't hold unescaped.
    """

    headings: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role "
    other_end: str = "</role> "
    end: str = "</turn>"
    between: str = "\n"
    controls: tuple[str, ...] = ("###", "</turn>", "</role>")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    complete: tuple[str, ...] = ("assistant",)


def escaped(text: Column, template: Template) -> Column:
    """The text with an escape sign before every place where a control string or an escape sign begins; null is empty."""
    places = "|".join(re.escape(s) for s in (ESCAPE, *template.controls))
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"(?={places})", ESCAPE * 2)


def format_turns(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, segments) of every turn, `segments` being an array of (text, loss).

    The segments of a conversation's turns, end to end in order of (turn, role, text), are its formatted text; a trainer
    counts loss on the segments that say so.  Control strings inside texts are escaped, and `read_turn` gives them back.

    A turn needs nothing but its own row, so nothing is shuffled and a conversation of any length is spread over all tasks.
    Null texts and roles are empty ones; rows with a null conversation or turn are formatted like others; repeated rows
    are formatted each; an empty frame gives no rows; other columns are ignored.
    """
    who, said = F.coalesce(F.col(f"`{role}`"), F.lit("")), escaped(F.col(f"`{text}`"), template)

    def piece(value: Column, loss: bool = False) -> Column:
        return F.struct(value.alias("text"), F.lit(loss).alias("loss"))

    end = piece(F.lit(template.end + template.between))
    segments = F.array(piece(F.lit(template.other)), piece(escaped(F.col(f"`{role}`"), template)), piece(F.lit(template.other_end)), piece(said), end)
    for name, heading in template.headings.items():
        segments = F.when(who == name, F.array(piece(F.lit(heading)), piece(said, name in template.trained), end)).otherwise(segments)
    return turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), who.alias("role"), segments.alias("segments"))


def _machine(template: Template) -> tuple[list[str], list[str], list[list[int]]]:
    """States (the error last), roles in order of their names, and for each state and role (any other role last) the next state."""
    states = list(dict.fromkeys([template.start, *(s for s, _ in template.moves), *template.moves.values()]))
    roles, error = sorted({r for _, r in template.moves}), len(states)
    table = [[states.index(template.moves[s, r]) if (s, r) in template.moves else error for r in roles] + [error] for s in states]
    return [*states, ""], roles, [*table, [error] * (len(roles) + 1)]


def _powers(table: list[list[int]]) -> tuple[int, int, list[int]]:
    """Where `n` equal roles in a row lead, for n = 1, 2, ... until it repeats: (first n of the cycle, its length, flat table by n, state, role)."""
    size = len(table)
    cycle = math.lcm(*range(1, size + 1))
    now, flat = [[s] * len(table[0]) for s in range(size)], []
    for _ in range(size + cycle):
        now = [[table[s][r] for r, s in enumerate(row)] for row in now]
        flat += [s for row in now for s in row]
    return size, cycle, flat


def turn_order(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """(conv_id, n_turns, valid, complete, bad_turn) of every conversation, in order of (turn, role).

    `valid`: the machine never meets a role it has no move for; `bad_turn` is the turn where it first does.  `complete`: it ends in
    a state that may be the last.  A null or unknown role is never valid.  Null turns come first; rows with a null
    conversation are one conversation; repeated rows are turns of their own; an empty frame gives no rows.

    Equal rows are counted before they are shuffled.  A stretch of turns is a map from the state before it to the state after it;
    stretches of `CHUNK` turn numbers are folded apart and their maps composed in order, so no group holds all turns of a long one.
    """
    states, roles, table = _machine(template)
    first, cycle, flat = _powers(table)
    code = F.lit(len(roles))
    for i, name in enumerate(roles):
        code = F.when(F.col(f"`{role}`") == name, i).otherwise(code)
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), code.alias("code"))
    counted = rows.groupBy("conv_id", "turn", "code").agg(F.count("*").alias("n"))
    leads = F.split(F.lit(",".join(map(str, flat))), ",").cast("array<int>")  # one constant
    size, width, error = len(table), len(roles) + 1, len(states) - 1

    def bad(was: Column, now: Column, at: Column) -> Column:
        return F.struct(now.alias("state"), F.when(was.state == error, was.bad).when(now == error, at).alias("bad"))

    def step(at: Column, x: Column) -> Column:
        times = F.when(x.n <= first, x.n).otherwise(first + 1 + (x.n - first - 1) % cycle)
        place = ((times - 1) * size * width + at.state * width + x.code).cast("int")
        return bad(at, F.get(leads, place), x.turn)

    begin = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(None).cast("long").alias("bad")) for s in range(size)])
    stretch = F.aggregate("rows", begin, lambda acc, x: F.transform(acc, lambda at: step(at, x)))
    chunks = counted.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("turn", "code", "n"))).alias("rows")
    ).select("conv_id", "chunk", "n", stretch.alias("map"))
    whole = F.aggregate("maps", begin[0], lambda at, x: F.struct(x.map[at.state].state.alias("state"), F.coalesce(at.bad, x.map[at.state].bad).alias("bad")))
    done = chunks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("chunk", "map"))).alias("maps")).select("conv_id", "n_turns", whole.alias("last"))
    finals = [i for i, s in enumerate(states) if s in template.complete]
    return done.select("conv_id", "n_turns", (F.col("last.state") != error).alias("valid"), F.col("last.state").isin(finals).alias("complete"), F.col("last.bad").alias("bad_turn"))


def unescape(text: str) -> str:
    """The text that was escaped: what follows an escape sign is itself."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if ESCAPE in text else text


def read_turn(formatted: str, template: Template) -> tuple[str, str]:
    """Role and text of a formatted turn, from its marks alone."""
    marks = re.compile("|".join([r"\\.", *(re.escape(s) for s in template.controls)]), re.DOTALL)

    def until(mark: str, at: int) -> int:
        for m in marks.finditer(formatted, at):
            if m[0][0] != ESCAPE and formatted.startswith(mark, m.start()):
                return m.start()
        raise ValueError("a turn without its end")

    for role, heading in template.headings.items():
        if formatted.startswith(heading):
            break
    else:
        if not formatted.startswith(template.other):
            raise ValueError("a turn without its heading")
        stop = until(template.other_end.strip(), len(template.other))
        role, heading = unescape(formatted[len(template.other) : stop]), formatted[: stop + len(template.other_end)]
    stop = until(template.end, len(heading))
    return role, unescape(formatted[len(heading) : stop])


def conversation_digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of the conversations in the result of `format_turns`.

    Everything is read back from the segments: turns from the marks of the joined segments, trained texts from the segments under the loss.
    A digest is one chain over a conversation, so its rows meet in one partition, in order; they are read as a stream with one
    open digest, and memory doesn't follow a conversation's length.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turns, under, counts, out = None, None, None, [0, 0, 0], []

        def closed():
            return {"conv_id": at, "n_turns": counts[0], "turns_sha256": turns.hexdigest(), "loss_chars": counts[1], "loss_sha256": under.hexdigest(), "formatted_chars": counts[2]}

        for batch in batches:
            for conv, segments in zip(batch.column(0).to_pylist(), batch.column(1)):
                if turns is None or conv != at:
                    if turns is not None:
                        out.append(closed())
                    at, turns, under, counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                pieces = segments.as_py()
                whole = "".join(p["text"] for p in pieces)
                role, text = read_turn(whole, template)
                turns.update(f"{role}\n{text}\n".encode())
                trained = "".join(unescape(p["text"]) for p in pieces if p["loss"])
                under.update(trained.encode())
                counts[0] += 1
                counts[1] += len(trained)
                counts[2] += len(whole)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if turns is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("conv_id", kinds[kind]), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segments").select("conv_id", "segments")
    return ordered.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
