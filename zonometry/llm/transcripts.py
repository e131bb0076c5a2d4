"""Transcript parsing by a hidden Markov model, and canonical turns.

A transcript is lines in order, with speaker markers on some. A line's state is its speaker and whether it
opens a turn; start, transition and emission tables are counted over all labelled conversations with
add-one smoothing; emissions are products over the marker and line features. Viterbi then recovers the
states from the lines alone.

A conversation may be far longer than a task should hold. It is cut into blocks of turns; a block's lines
reduce to one max-plus matrix (best score from each entering to each leaving state), matrices combine by
levels of ``FAN``, and going down again each block learns its entering and leaving state and walks its own lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.session import stage

ROLES = ["system", "user", "assistant"]
#: Speaker markers by the role that they name; the last class is a marker of no known speaker.
MARKERS = [("system", "system|instructions"), ("user", "user|human|q"), ("assistant", "assistant|ai|a")]
N = 2 * len(ROLES)  # state 2r opens a turn of role r, state 2r + 1 continues it
START = N  # before the first line
BLOCK_TURNS = 64
FAN = 512
GROUP_ROWS = 20_000
FEATURES = {"marker": 5, "size": 8, "last": 4, "first": 2}


def as_lines(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, line, raw, role``: the conversations as raw transcripts would hold them.

    Turns become lines; whether and how a turn's first line names its speaker hangs on the conversation:
    named roles, question and answer letters, a bare dash, or nothing. A null text is an empty line.
    """
    style = F.pmod(F.xxhash64(F.col(conv)), F.lit(4))
    named = F.when(style == 0, F.concat(F.initcap(role), F.lit(": ")))
    letter = F.when(style == 1, F.when(F.col(role) == "user", "Q: ").when(F.col(role) == "assistant", "A: ").otherwise("Instructions: "))
    mark = F.coalesce(named, letter, F.when(style == 2, F.lit("- ")), F.lit(""))
    rows = conversations.select(
        F.col(conv).cast("string").alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"), F.col(role).alias("role"), mark.alias("mark"),
        F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "raw"))
    return rows.select("conv", "turn", "line", F.when(F.col("line") == 0, F.concat("mark", "raw")).otherwise(F.col("raw")).alias("raw"), "role")


def marker_pattern() -> str:
    return r"(?i)^\s*(?:(" + ")|(".join(m for _, m in MARKERS) + r"))\s*:\s*"


def observed(lines: DataFrame) -> DataFrame:
    """``lines`` with their features (small integers), and ``body``: the raw line without its marker."""
    raw = F.coalesce("raw", F.lit(""))
    kinds = [F.when(F.regexp_extract(raw, marker_pattern(), i + 1) != "", i) for i in range(len(MARKERS))]
    dash = F.when(raw.rlike(r"^\s*[-*>] "), len(MARKERS))
    body = F.regexp_replace(F.regexp_replace(raw, marker_pattern(), ""), r"^\s*[-*>] ", "")
    words = F.size(F.split(F.trim(body), r"\s+"))
    size = F.when(F.trim(body) == "", 0).otherwise(F.least(F.lit(7), 1 + F.floor(F.log2(words))))
    last = F.when(body.rlike(r"[.!]\s*$"), 0).when(body.rlike(r"\?\s*$"), 1).when(body.rlike(r"[,;:]\s*$"), 2).otherwise(3)
    first = F.when(body.rlike(r"^[\p{Lu}]"), 1).otherwise(0)
    return lines.select("*", F.coalesce(*kinds, dash, F.lit(len(MARKERS) + 1)).cast("int").alias("marker"), size.cast("int").alias("size"), last.alias("last"), first.alias("first"), body.alias("body"))


def _state() -> Column:
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) - 1
    return F.when(role >= 0, 2 * role + F.when(F.col("line") == 0, 0).otherwise(1)).cast("int")


def learn(lines: DataFrame) -> dict[str, np.ndarray]:
    """Log tables of the model, counted over all lines whose role is known; each table has a fixed, small size.

    A turn's lines follow each other, so transitions inside a turn need only the line number, and those
    between turns only the roles of turns that are next to each other by number.
    """
    known = lines.withColumn("state", _state()).where("state is not null")
    out = {}
    for name, values in FEATURES.items():
        table = np.ones((N, values))
        for r in known.groupBy("state", name).agg(F.count(F.lit(1)).alias("c")).collect():
            table[r["state"], r[name]] += r["c"]
        out[name] = np.log(table / table.sum(1, keepdims=True))
    turns = known.where("line = 0").select("conv", "turn", "state")
    sizes = known.groupBy("conv", "turn").agg(F.max("line").alias("end"), F.min("state").alias("role"))
    move = np.ones((N + 1, N))
    for r in sizes.groupBy("role").agg(F.sum((F.col("end") > 0).cast("long")).alias("enter"), F.sum(F.greatest(F.col("end") - 1, F.lit(0))).alias("stay")).collect():
        k = 2 * (r["role"] // 2)
        move[k, k + 1] += r["enter"]
        move[k + 1, k + 1] += r["stay"]
    ended = sizes.select("conv", (F.col("turn") + 1).alias("turn"), (2 * F.floor(F.col("role") / 2) + (F.col("end") > 0).cast("int")).cast("int").alias("before"))
    for r in turns.join(ended, ["conv", "turn"]).groupBy("before", "state").agg(F.count(F.lit(1)).alias("c")).collect():
        move[r["before"], r["state"]] += r["c"]
    for r in turns.where("turn = 0").groupBy("state").agg(F.count(F.lit(1)).alias("c")).collect():
        move[START, r["state"]] += r["c"]
    out["move"] = np.log(move / move.sum(1, keepdims=True))
    return out


def _emissions(table: pa.Table, model: dict[str, np.ndarray]) -> np.ndarray:
    return sum(model[name][:, table.column(name).to_numpy()] for name in FEATURES).T


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def _split(table: pa.Table, keys: list[str]) -> list[tuple[tuple, pa.Table]]:
    """Runs of equal keys of a sorted table."""
    cols = [table.column(k).to_pylist() for k in keys]
    tags = list(zip(*cols))
    edge = [i for i in range(len(tags)) if i == 0 or tags[i] != tags[i - 1]] + [len(tags)]
    return [(tags[a], table.slice(a, b - a)) for a, b in zip(edge[:-1], edge[1:])]


def _grouped(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The frame dealt by a hash of the keys into groups of about ``GROUP_ROWS`` rows, so small groups share a task call."""
    return df.withColumn("__deal", F.pmod(F.xxhash64(*keys), F.lit(1 + rows // GROUP_ROWS))).groupBy("__deal")


def _best(steps: list[np.ndarray], enter: int, leave: int | None) -> list[int]:
    """States after each step on the best path from ``enter`` to ``leave`` (None: the best last state)."""
    score, back = np.full(N + 1, -np.inf), []
    score[enter] = 0
    for m in steps:
        way = score[:, None] + m
        back.append(way.argmax(0))
        score = way.max(0)
    state = int(score.argmax()) if leave is None else leave
    path = [state]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _step_matrices(table: pa.Table, model: dict[str, np.ndarray]) -> list[np.ndarray]:
    move = np.full((N + 1, N + 1), -np.inf)
    move[:, :N] = model["move"]
    return [move + np.append(e, -np.inf)[None, :] for e in _emissions(table, model)]


_ENDS = "conv string, block long, enter int, leave int, final boolean"


def _ends(mats: DataFrame) -> DataFrame:
    """``conv, block, enter, leave, final``: each block's states at both ends, from ``conv, block, m``."""
    most, rows = mats.agg(F.max("block"), F.count(F.lit(1))).first()
    deep = most is not None and most >= FAN

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by([("conv", "ascending"), ("up", "ascending"), ("block", "ascending")])
        out = []
        for (conv, up), part in _split(t, ["conv", "up"]):
            whole = None
            for m in part.column("m").to_pylist():
                m = np.array(m).reshape(N + 1, N + 1)
                whole = m if whole is None else _times(whole, m)
            out.append({"conv": conv, "block": up, "m": whole.ravel().tolist()})
        return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("m", pa.list_(pa.float64()))]))

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by([("conv", "ascending"), ("up", "ascending"), ("block", "ascending")])
        out = []
        for (conv, up), part in _split(t, ["conv", "up"]):
            steps = [np.array(m).reshape(N + 1, N + 1) for m in part.column("m").to_pylist()]
            enter, final = part.column("enter")[0].as_py(), part.column("final")[0].as_py()
            states = _best(steps, enter, part.column("leave")[0].as_py())
            for i, b in enumerate(part.column("block").to_pylist()):
                out.append({"conv": conv, "block": b, "enter": states[i - 1] if i else enter, "leave": states[i], "final": final and i == len(states) - 1})
        return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("final", pa.bool_())]))

    tall = mats.withColumn("up", F.floor(F.col("block") / FAN))
    if deep:
        above = stage(_grouped(tall, ["conv", "up"], rows).applyInArrow(combine, "conv string, block long, m array<double>"), "blocks")
        ends = stage(_ends(above), "ends").withColumnRenamed("block", "up")
        tall = tall.join(ends, tall["conv"].eqNullSafe(ends["conv"]) & (tall["up"] == ends["up"])).select(tall["*"], "enter", "leave", "final")
    else:
        tall = tall.select("*", F.lit(START).alias("enter"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("final"))
    return _grouped(tall, ["conv", "up"], rows).applyInArrow(walk, _ENDS)


def parse(lines: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``conv, turn, line, role, opens, piece`` of transcript lines (``conv, turn, line, raw``).

    ``turn`` and ``line`` only order the lines. ``piece`` is the line in canonical form: a line that opens a
    turn starts with ``<|role|>``, closing the turn before it with ``<|end|>``; the last line closes its own.
    The pieces of a conversation in order, joined, are its canonical text. A null conversation is
    one of its own; an empty table gives no rows; repeated rows stay.
    """
    shared = lines.sparkSession.sparkContext.broadcast(model)
    seen = observed(lines).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS)).select("conv", "turn", "line", "block", "body", *FEATURES)
    seen = stage(seen.withColumn("block", F.col("block") - F.least(F.lit(0), F.col("block"))), "lines")
    rows = seen.count()
    order = [("conv", "ascending"), ("block", "ascending"), ("turn", "ascending"), ("line", "ascending"), ("body", "ascending")]

    def reduce(t: pa.Table) -> pa.Table:
        out = []
        for (conv, block), part in _split(t.sort_by(order), ["conv", "block"]):
            steps = _step_matrices(part, shared.value)
            whole = steps[0]
            for m in steps[1:]:
                whole = _times(whole, m)
            out.append({"conv": conv, "block": block, "m": whole.ravel().tolist()})
        return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("m", pa.list_(pa.float64()))]))

    mats = stage(_grouped(seen, ["conv", "block"], rows).applyInArrow(reduce, "conv string, block long, m array<double>"), "blocks")
    ends = stage(_ends(mats), "ends")
    tall = seen.join(ends, seen["conv"].eqNullSafe(ends["conv"]) & (seen["block"] == ends["block"])).select(seen["*"], "enter", "leave", "final")

    def read(t: pa.Table) -> pa.Table:
        out = []
        for (_, _), part in _split(t.sort_by(order), ["conv", "block"]):
            enter = part.column("enter")[0].as_py()
            states = _best(_step_matrices(part, shared.value), enter, part.column("leave")[0].as_py())
            final, before = part.column("final")[0].as_py(), enter
            for i, r in enumerate(part.select(["conv", "turn", "line", "body"]).to_pylist()):
                s = states[i]
                role, opens = ROLES[s // 2], s % 2 == 0 or before == START or s // 2 != before // 2
                piece = (("" if before == START else "<|end|>\n") + f"<|{role}|>\n" if opens else "") + r.pop("body") + "\n"
                out.append(r | {"role": role, "opens": opens, "piece": piece + ("<|end|>\n" if final and i == len(states) - 1 else "")})
                before = s
        return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("line", pa.int32()), ("role", pa.string()), ("opens", pa.bool_()), ("piece", pa.string())]))

    return _grouped(tall, ["conv", "block"], rows).applyInArrow(read, "conv string, turn long, line int, role string, opens boolean, piece string")
