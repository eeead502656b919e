"""Transcript parsing: a hidden Markov model recovers the speakers' roles by Viterbi, then turns are rendered canonically.

A state is a role at the begin of a turn or inside one.  A line shows a speaker marker or none, how long it is, how it ends, and
whether it is the first.  A long conversation is cut into chunks: each chunk gives the best score from any state before it to any
state at its end, the chunks of a conversation are chained over these small tables, then each chunk is traced on its own.  The
result is that of one Viterbi pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import scan
from .common import cut

#: Lines of a chunk, whatever their numbers; a turn's lines follow each other from turn * 2^31 on, more than an array can hold.
CHUNK_LINES, TURN_LINES = 4096, 1 << 31
#: Columns made here; extra columns of these names come back with ``_in`` behind the name.
OWN = ("conv", "line_no", "text", "m", "o", "chunk", "role_pred", "turn_begin", "turn_no", "rendered")
#: Speaker markers at the begin of a line, by the group they fall in.
MARKERS = {"system": r"(?:system|instructions?)", "user": r"(?:user|human|prompter|customer|q|question|me)", "assistant": r"(?:assistant|bot|ai|model|agent|a|answer|gpt)", "other": r"[A-Z][\w .-]{0,20}"}
_LEAD, _TAIL = r"^[\s>#*\[<|]{0,6}", r"[\]>|*]{0,3}\s*:[\s*]*"
LENGTHS = 5


def marker(line: Column) -> Column:
    """1 + the number of the marker group that the line begins with, else 0."""
    out = F.lit(0)
    for i, (name, words) in reversed(list(enumerate(MARKERS.items()))):
        out = F.when(line.rlike(("" if name == "other" else "(?i)") + _LEAD + words + _TAIL), F.lit(i + 1)).otherwise(out)
    return out


def without_marker(line: Column, group: Column) -> Column:
    plain = F.regexp_replace(line, "(?i)" + _LEAD + "(?:" + "|".join(w for n, w in MARKERS.items() if n != "other") + ")" + _TAIL, "")
    return F.when((group > 0) & (group < len(MARKERS)), plain).otherwise(line)


def _extra(names: list[str], used: tuple[str, ...]) -> list[Column]:
    """The columns not ``used``; a name that is made here, in any case, gets ``_in`` until it is free."""
    taken, out = {*OWN, *(n.lower() for n in names if n not in used)}, []
    for name in names:
        if name in used:
            continue
        new = name
        while new.lower() in OWN or (new != name and new.lower() in taken):
            new += "_in"
        taken.add(new.lower())
        out.append(F.col(f"`{name}`").alias(new))
    return out


def observed(lines: DataFrame, conversation: str, number: str, line: str, first_number: int = 0) -> DataFrame:
    """(conv, line_no, text, m, o) and the other columns: lines with marker group and combined symbol.

    A null line counts as empty, null numbers as 0; repeated rows stay.  Other columns whose name is in ``OWN`` come back with
    ``_in`` behind it.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = lines.select(col(conversation).alias("conv"), F.coalesce(col(number).cast("long"), F.lit(0)).alias("line_no"), F.coalesce(col(line), F.lit("")).alias("text"), *_extra(lines.columns, (conversation, number, line)))
    n = F.length("text")
    size = F.when(n == 0, 0).when(n < 60, 1).when(n < 200, 2).when(n < 500, 3).otherwise(4)
    rows = rows.withColumn("m", marker(F.col("text")))
    asks = F.col("text").rlike(r"\?\s*$").cast("int")
    return rows.withColumn("o", ((F.col("m") * LENGTHS + size) * 2 + asks) * 2 + (F.col("line_no") == first_number).cast("int"))


def numbered(seen: DataFrame) -> DataFrame:
    """``observed`` lines with their chunk: ``CHUNK_LINES`` lines that follow each other by number, then text.

    Lines are counted in slices, so neither a long conversation nor lines that share a number meet in one chunk.
    """
    counted = scan(seen, ["conv"], "line_no", {"chunk": ("row_number", None)}, tie=["text"])
    return counted.withColumn("chunk", F.floor((F.col("chunk") - 1) / CHUNK_LINES).cast("long")).select(*[F.col(f"`{c}`") for c in seen.columns], "chunk")


SYMBOLS = (len(MARKERS) + 1) * LENGTHS * 4


@dataclass
class RoleModel:
    """Log probabilities; state 2 r is role r at the begin of a turn, 2 r + 1 inside one."""

    roles: list[str]
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def fit(lines: DataFrame, role: str, begins: str, previous: str) -> RoleModel:
    """Count states, moves and symbols over all labelled ``observed`` lines (role, whether it begins a turn, the role before).

    ``previous`` is the role of the turn before, null at the begin of a conversation.  Every count starts from one half.  Lines
    without a role are left out; without any, the model has one role, ``user``.
    """
    rows = lines.filter(F.col(role).isNotNull())
    counts = rows.groupBy(F.col(role).alias("r"), F.col(begins).alias("b"), F.col(previous).alias("p"), "o").count().collect()     # bounded by roles and symbols
    roles = sorted({r.r for r in counts}) or ["user"]
    of = {r: i for i, r in enumerate(roles)}
    n = 2 * len(roles)
    start, move, emit = np.full(n, 0.01), np.full((n, n), 0.5), np.full((n, SYMBOLS), 0.5)
    for r in counts:
        s = 2 * of[r.r] + (0 if r.b else 1)
        emit[s, r.o] += r["count"]
        if r.b and r.p is None:
            start[s] += r["count"]
        elif r.b and r.p in of:
            move[2 * of[r.p], s] += r["count"] / 2            # from a turn of one line or from inside
            move[2 * of[r.p] + 1, s] += r["count"] / 2
        elif not r.b:
            move[s, s] += r["count"]
            move[s - 1, s] += r["count"]
    start[1::2] = 1e-9
    for a in range(len(roles)):                               # a turn goes on with its own role only
        for b in range(len(roles)):
            if a != b:
                move[2 * a:2 * a + 2, 2 * b + 1] = 1e-9
    #: a symbol is marker x (length, question, first): the two parts count apart, so rare combinations keep sense
    parts = emit.reshape(n, len(MARKERS) + 1, LENGTHS * 4)
    joint = parts.sum(2)[:, :, None] * parts.sum(1)[:, None, :]
    emit = joint.reshape(n, SYMBOLS)
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return RoleModel(roles, norm(start), norm(move), norm(emit))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        edge = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            one = batch.slice(s, e - s)
            if held and tuple(held[-1].column(held[-1].schema.get_field_index(k))[0].as_py() for k in keys) != rows[s]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(one)
    if held:
        yield pa.Table.from_batches(held)


def recover_roles(seen: DataFrame, model: RoleModel) -> DataFrame:
    """``observed`` lines with role_pred, turn_begin and turn_no: the best path of each conversation.

    Ties go to the smaller state; lines of equal number follow each other by text.  Turns are counted from 1.  An empty table
    gives no rows; a null conversation is one conversation.
    """
    seen = cut(numbered(seen))
    kind = seen.schema["conv"].dataType.simpleString()
    s = len(model.roles) * 2
    order = lambda d: d.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "line_no", "text")

    def tables(batches):
        for g in _groups(batches, ("conv", "chunk")):
            o = g["o"].to_pylist()
            best = model.move + model.emit[:, o[0]]
            first = model.start + model.emit[:, o[0]]
            for x in o[1:]:
                best = (best[:, :, None] + model.move[None]).max(1) + model.emit[:, x]
                first = (first[:, None] + model.move).max(0) + model.emit[:, x]
            yield pa.RecordBatch.from_arrays([g["conv"].combine_chunks()[:1], g["chunk"].combine_chunks()[:1], pa.array([np.vstack([best, first]).ravel().tolist()], pa.list_(pa.float64()))], names=["conv", "chunk", "w"])
    chunks = cut(order(seen.select("conv", "chunk", "line_no", "text", "o")).mapInArrow(tables, f"conv {kind}, chunk long, w array<double>"))

    def chain(batches):
        for g in _groups(batches, ("conv",)):
            w = np.array(g["w"].to_pylist()).reshape(-1, s + 1, s)
            score, back = w[0, -1], []
            for x in w[1:]:
                total = score[:, None] + x[:-1]
                back.append(total.argmax(0))
                score = total.max(0)
            end = [int(score.argmax())]
            for b in reversed(back):
                end.append(int(b[end[-1]]))
            end = end[::-1]
            yield pa.RecordBatch.from_arrays([g["conv"].combine_chunks(), g["chunk"].combine_chunks(), pa.array([-1, *end[:-1]], pa.int32()), pa.array(end, pa.int32())], names=["conv", "chunk", "enter", "leave"])
    ends = chunks.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(chain, f"conv {kind}, chunk long, enter int, leave int")
    ends = ends.withColumnsRenamed({"conv": "_conv", "chunk": "_chunk"})
    bound = seen.join(ends, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))).drop("_conv", "_chunk")
    names = seen.columns

    def trace(batches):
        for g in _groups(batches, ("conv", "chunk")):
            o, enter, state = g["o"].to_pylist(), g["enter"][0].as_py(), g["leave"][0].as_py()
            score, back = (model.start if enter < 0 else model.move[enter]) + model.emit[:, o[0]], []
            for x in o[1:]:
                total = score[:, None] + model.move
                back.append(total.argmax(0))
                score = total.max(0) + model.emit[:, x]
            path = [state]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path = np.array(path[::-1])
            begin = path % 2 == 0
            if enter < 0:
                begin[0] = True
            roles = [model.roles[p // 2] for p in path]
            yield from g.select(names).append_column("role_pred", pa.array(roles, pa.string())).append_column("turn_begin", pa.array(begin)).append_column("_within", pa.array(np.cumsum(begin), pa.int64())).combine_chunks().to_batches()
    traced = cut(order(bound).mapInArrow(trace, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seen.schema) + ", role_pred string, turn_begin boolean, _within long"))
    ahead = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)       # a row for each chunk
    before = traced.groupBy("conv", "chunk").agg(F.max("_within").alias("t")).select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("t"))
    out = traced.join(before, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    return out.withColumn("turn_no", F.col("t") + F.col("_within")).drop("_conv", "_chunk", "_within", "t")


def rendered(parsed: DataFrame) -> DataFrame:
    """Canonical text of each line: its turn's header before the first, the line without its speaker marker.

    The lines of a conversation, in order, make ``<|role|>`` headers on lines of their own, each followed by the turn's text; a
    turn of any length needs no gathering.
    """
    clean = without_marker(F.col("text"), F.when(F.col("turn_begin"), F.col("m")).otherwise(F.lit(0)))
    return parsed.withColumn("rendered", F.concat(F.when(F.col("turn_begin"), F.concat(F.lit("<|"), F.col("role_pred"), F.lit("|>\n"))).otherwise(F.lit("")), clean, F.lit("\n")))


def transcript_lines(conversations: DataFrame, marked: float = 0.7) -> DataFrame:
    """Raw transcripts from conversations (conv_id, turn, role, text): lines with some speaker markers of changing form.

    About ``marked`` of the turns, by hash, begin with a marker of their role; role, begins and previous are the truth.  A line's
    number is turn * 2^31 plus its place, for turns below 2^32; a null turn counts as 0, extra columns are left out.
    """
    h = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(1000))
    forms = {"user": ["User: ", "Human: ", "### User: ", "Q: "], "assistant": ["Assistant: ", "AI: ", "**Bot**: ", "A: "], "system": ["System: ", "[System]: ", "Instructions: ", "System: "]}
    tag = F.coalesce(*[F.when(F.col("role") == r, F.element_at(F.array(*[F.lit(x) for x in f]), (h % 4 + 1).cast("int"))) for r, f in forms.items()], F.lit(""))
    rows = conversations.select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), "role", F.concat(F.when(h < int(1000 * marked), tag).otherwise(F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    last = rows.groupBy("conv_id", "turn").agg(F.max("role").alias("previous")).select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t"), "previous")
    rows = rows.join(last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t")
    lines = rows.select("conv_id", "turn", "role", "previous", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("conv_id", (F.col("turn").cast("long") * TURN_LINES + F.col("pos")).alias("line_no"), "line", "role", (F.col("pos") == 0).alias("begins"), "previous")
