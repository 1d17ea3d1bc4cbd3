"""Chat formatting by a black-box template, with the span of every turn found by rendering successive prefixes.

``render`` takes a list of (role, text) turns and returns a string; nothing else is known of it. The turns of a conversation, in order of
turn, role and text, are numbered and cut into segments of ``SEGMENT`` turns. Within a segment one turn after another is added and
rendered; what the output gained over the one before is that turn's piece. A segment after the first starts from the ``CONTEXT`` turns
before it, so that work grows with the number of turns and no task holds a conversation. If an output does not start with the one before,
the template rewrites history: the turn's ``keeps`` says how much of the earlier output stays. Where in a piece the text lies is found by
two more renderings with texts that share no character: what they have in common at both ends is the turn's header and footer.

The numbering: rows are dealt by ranges of (conversation, turn, role, text), so that one conversation may fill many tasks; counts of the
few conversations that cross ranges give the rest. What a template keeps from more than ``CONTEXT`` turns ago can be seen in the first
segment alone.

Null texts and roles are empty ones. Rows without a conversation's id form one conversation, whose id is null; null turns come last.
Equal rows are turns each. Other columns take no part. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import in_small_batches, stage, working_parts

SEGMENT, CONTEXT = 64, 4
#: Rows of a range.
RANGE_ROWS = 1 << 16

Turns = list[tuple[str, str]]

# ---- a template and its way back

OPEN, CLOSE, ESCAPE = "### ", "</turn>", "\\"
_CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(\\|### |</turn>)")
_TURN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|:|### |</turn>))*+): ((?:[^\\<]++|\\(?:\\|### |</turn>)|<(?!/turn>))*+)</turn>\n")


def escape(text: str) -> str:
    """A control string or a backslash gets a backslash before it."""
    return _CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def marked(turns: Turns) -> str:
    """``### role: text</turn>`` and a line end for each turn, control strings inside roles and texts escaped."""
    return "".join(f"{OPEN}{escape(role).replace(':', ESCAPE + ':')}: {escape(text)}{CLOSE}\n" for role, text in turns)


def parse(formatted: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, code points read) of each turn of an output of ``marked``."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}: {formatted[at:at + 40]!r}")
        yield unescape(m[1].replace(ESCAPE + ":", ":")), unescape(m[2]), m.end() - at
        at = m.end()


# ---- spans from renderings

def common_start(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def common_end(a: str, b: str) -> int:
    return len(os.path.commonprefix([a[::-1], b[::-1]]))


class Located:
    """One turn in the output: how much of the output before it stays (None: all), the piece behind that, and the text's place in the
    piece. Of a text the template has cut or changed, the place is that of what the template made of it."""

    __slots__ = ("keeps", "piece", "first", "after")

    def __init__(self, keeps: int | None, piece: str, first: int, after: int):
        self.keeps, self.piece, self.first, self.after = keeps, piece, first, after


def locate(render: Callable[[Turns], str], turns: Turns, known: int = 0) -> Iterator[Located]:
    """The turns from number ``known`` on, each by its own prefix of ``turns``."""
    before = render(turns[:known]) if known else ""
    for i in range(known, len(turns)):
        role, _ = turns[i]
        out = render(turns[:i + 1])
        stays = len(before) if out.startswith(before) else common_start(before, out)
        a, b = (render([*turns[:i], (role, probe)])[stays:] for probe in ("A", "B"))
        head, foot, piece = common_start(a, b), common_end(a, b), out[stays:]
        first = min(head, len(piece))
        yield Located(None if stays == len(before) else stays, piece, first, max(first, len(piece) - foot))
        before = out


# ---- numbering

def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): every turn with its place in its conversation, from 0. A written table."""
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    parts = max(working_parts(spark), conversations.count() // RANGE_ROWS + 1)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, some = TaskContext.get().partitionId(), None, 0, False
        for b in batches:
            ids, at = b.column("conv_id").to_pylist(), []
            for c in ids:
                n = n + 1 if some and c == last else 0
                last, some = c, True
                at.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), b.column("conv_id"), pa.array(at, pa.int64()), b.column("role"), b.column("text")],
                                             names=["part", "conv_id", "at", "role", "text"])

    dealt = in_small_batches(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = stage(dealt.mapInArrow(run, f"part int, conv_id {id_type}, at long, role string, text string"), "turns")
    up_to = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # rows of (range, conversation) that follow others of the conversation: one a range, as a range continues one conversation at most
    carried = (local.groupBy("conv_id", "part").count().withColumn("earlier", F.sum("count").over(up_to)).where("earlier > 0")
               .select(F.col("conv_id").alias("_id"), F.col("part").alias("_part"), "earlier"))
    joined = local.join(F.broadcast(carried), (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("conv_id", (F.col("at") + F.coalesce("earlier", F.lit(0))).alias("at"), "role", "text")


def formatted(conversations: DataFrame, render: Callable[[Turns], str] = marked, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, at, role, piece, first, after, learned, keeps): a row for each turn. The pieces of a conversation in order of ``at`` are
    its output, as long as ``keeps`` is null everywhere; else the output before the turn is cut to ``keeps`` code points of the output
    of its segment. ``first`` and ``after`` are the text's code points in the piece; the loss falls on them where ``learned``."""
    turns = numbered(conversations)
    id_type = turns.schema["conv_id"].dataType.simpleString()
    own = F.floor(F.col("at") / SEGMENT)
    to = F.when(F.col("at") % SEGMENT >= SEGMENT - CONTEXT, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = turns.withColumn("segment", F.explode(to)).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at")

    def rows_of(key: tuple, held: list[tuple[int, str, str]]) -> list[tuple]:
        known = sum(at < key[1] * SEGMENT for at, _, _ in held)
        found = locate(render, [(role, text) for _, role, text in held], known)
        return [(key[0], at, role, x.piece, x.first, x.after, role in learn, x.keeps) for (at, role, _), x in zip(held[known:], found, strict=True)]

    kinds = f"conv_id {id_type}, at long, role string, piece string, first int, after int, learned boolean, keeps int"
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        types = [None, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            types[0] = b.schema.field("conv_id").type
            out: list[tuple] = []
            for conv, segment, at, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "at", "role", "text")), strict=True):
                if (conv, segment) != key:
                    if held:
                        out += rows_of(key, held)
                    key, held = (conv, segment), []
                held.append((at, role, text))
            if out:
                yield batch(out)
        # a segment after the last full one may hold context alone
        if held and (rest := rows_of(key, held)):
            yield batch(rest)

    return in_small_batches(dealt).mapInArrow(run, kinds)


def rewriting(rows: DataFrame) -> DataFrame:
    """(conv_id, at) of the turns at which the template changed what it had put out before."""
    return rows.where("keeps IS NOT NULL").select("conv_id", "at")


# ---- reading back

def digests(rows: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Of each conversation that ``marked`` formatted: n_turns and turns_sha256 of what its output says, loss_chars and loss_sha256 of the
    text under the loss mask, formatted_chars. A conversation is read in order, one piece after another: a hash of it all cannot be
    worked out in parts. No task holds more than a batch of pieces."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    kinds = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, None     # open_: turns, their hash, loss characters, their hash, characters

        def row() -> tuple:
            return key, open_[0], open_[1].hexdigest(), open_[2], open_[3].hexdigest(), open_[4]

        def batch(done: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        for b in batches:
            kind, done = b.schema.field("conv_id").type, []
            for conv, piece, first, after, learned in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "first", "after", "learned")), strict=True):
                if open_ is None or conv != key:
                    if open_ is not None:
                        done.append(row())
                    key, open_ = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _ in parse(piece):
                    open_[0] += 1
                    open_[1].update(f"{role}\n{text}\n".encode())
                if learned:
                    loss = unescape(piece[first:after])
                    open_[2] += len(loss)
                    open_[3].update(loss.encode())
                open_[4] += len(piece)
            if done:
                yield batch(done)
        if open_ is not None:
            yield batch([row()])

    read = rows.select("conv_id", "at", "piece", "first", "after", "learned").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return in_small_batches(read).mapInArrow(run, kinds)


#: ``\`` and control strings get a backslash each; in a role, colons too.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (
  SELECT *, len(regexp_extract_all(text, '\\|### |</turn>')) AS marks, len(regexp_extract_all(role, '\\|### |</turn>|:')) AS role_marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + role_marks + length(text) + marks) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id"""
