"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Two first-order models are trained from labelled samples over the whole corpus. Strings that the patterns find are the samples of
random strings; other runs of identifier characters, too short to be judged, are the samples of ordinary ones. A run that no pattern has found is a
secret when the log-likelihood ratio of the two models is high enough, in all and per character. The models are two tables of the
alphabet's pairs; tasks sum their own counts first, so that only these tables reach the driver.

A null text is an empty one: no spans. Repeated rows are scanned each. Offsets are code points, ends exclusive. An empty table
trains the smoothing alone and gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import in_small_batches, replaced, slices, text_of

KINDS = ("assign", "access", "hex", "random")

# What the patterns match and how long a match must be.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Runs of at least so many characters are judged; shorter random strings are not told apart reliably.
RUN_LEAST = 20
#: Runs of at least so many characters, and fewer than those that are judged, are samples of ordinary identifiers.
SAMPLE_LEAST = 6
RATIO_LEAST, RATIO_PER_PAIR = 14.0, 0.7

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LETTER = np.zeros(256, np.uint8)
LETTER[list(ALPHABET)] = np.arange(1, len(ALPHABET) + 1)
SIZE = len(ALPHABET) + 1
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True


def runs(member: np.ndarray, cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least ``least`` members; a run ends at each of ``cuts`` (starts of texts)."""
    n = len(member)
    change = np.ones(n + 1, bool)
    change[1:n] = member[1:] != member[:-1]
    change[cuts] = True
    edge = np.flatnonzero(change)
    starts, ends = edge[:-1], edge[1:]
    keep = ends - starts >= least
    keep &= member[starts]
    return starts[keep], ends[keep]


def batch_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the batch's texts and the offsets of each."""
    values = batch.column("text")
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, kind)[values.offset: values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, at - at[0]


def patterns(flat: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """(start, kind, end, start of the value) of each text's pattern spans, in bytes from its start."""
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in at[1:]]
    starts, ends = runs(HEX[flat], at, HEX_LEAST)
    for doc, a, b in zip((np.searchsorted(at, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        base = int(at[doc])
        found[doc].append((a - base, 2, b - base, a - base))
    whole = flat.tobytes()
    low = whole.lower()
    likely, first = set(), at.tolist()
    for kind, words, text in ((0, KEYWORDS, low), (1, (b"AKIA",), whole)):
        for word in words:
            i = text.find(word)
            while i >= 0:
                doc = int(np.searchsorted(at, i, side="right")) - 1
                likely.add((kind, doc))
                i = text.find(word, first[doc + 1])
    for kind, doc in likely:
        own = whole[first[doc]:first[doc + 1]]
        if kind == 0:
            found[doc] += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(own) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        else:
            found[doc] += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(own) if m.end() - m.start() >= ACCESS_LEAST]
    return found


def pair_counts(docs: DataFrame) -> DataFrame:
    """(model, pair, n): pairs of neighbouring characters in the samples of both models (0 ordinary, 1 random), over all texts."""
    source = text_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for b in (s for whole in batches for s in slices(whole)):
            flat, at = batch_bytes(b)
            if not len(flat):
                continue
            letter = LETTER[flat]
            odd = np.zeros(len(flat), bool)
            for doc, spans in enumerate(patterns(flat, at)):
                for start, _, end, value in spans:
                    odd[at[doc] + start:at[doc] + end] = True
                    own = letter[at[doc] + value:at[doc] + end].astype(np.int64)
                    own = own[own > 0]
                    if len(own) >= SAMPLE_LEAST:
                        total[1] += np.bincount(own[:-1] * SIZE + own[1:], minlength=SIZE * SIZE)
            starts, ends = runs((letter > 0) & ~odd, at, SAMPLE_LEAST)
            short = ends - starts < RUN_LEAST
            starts, ends = starts[short], ends[short]
            inside = np.zeros(len(flat) + 1, np.int8)
            inside[starts] += 1
            inside[ends - 1] -= 1
            first = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
            total[0] += np.bincount(letter[first].astype(np.int64) * SIZE + letter[first + 1], minlength=SIZE * SIZE)
        model, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[model, pair])], names=["model", "pair", "n"])

    return source.mapInArrow(run, "model int, pair int, n long").groupBy("model", "pair").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of every pair of characters, random over ordinary. The model of random strings is half its samples, half
    the uniform one, so that it stands without samples too."""
    counts = np.zeros((2, SIZE, SIZE))
    for model, pair, n in pair_counts(docs).collect():      # at most 2 * SIZE * SIZE rows
        counts[model].flat[pair] = n
    counts = counts[:, 1:, 1:]
    k = len(ALPHABET)
    ordinary = (counts[0] + 0.5 / k) / (counts[0].sum(axis=1, keepdims=True) + 0.5)
    # a rare first letter says little of its own; part of the weight is on how common the second is
    common = (counts[0].sum(axis=0) + 0.5) / (counts[0].sum() + 0.5 * k)
    ordinary = 0.9 * ordinary + 0.1 * common
    sampled = (counts[1] + 1.0 / k) / (counts[1].sum(axis=1, keepdims=True) + 1.0)
    ratio = np.zeros((SIZE, SIZE))
    ratio[1:, 1:] = np.log(0.5 * sampled + 0.5 / k) - np.log(ordinary)
    return ratio


def scan(docs: DataFrame, ratio: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end, comma-joined, by start, then kind)."""
    source = text_of(docs, *keep)
    names = [*keep, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole)):
            rows = [described(s) for s in found_in(b, ratio)]
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=names)

    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kept}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def found_in(batch: pa.RecordBatch, ratio: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's spans in code points, in order."""
    flat, at = batch_bytes(batch)
    found = [[s[:3] for s in own] for own in patterns(flat, at)]
    letter = LETTER[flat]
    starts, ends = runs(letter > 0, at, RUN_LEAST)
    for doc, a, b in zip((np.searchsorted(at, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        total = ratio[letter[a:b - 1], letter[a + 1:b]].sum()
        base = int(at[doc])
        while b < at[doc + 1] and flat[b] == 61:      # the padding of a random string
            b += 1
        if total >= max(RATIO_LEAST, RATIO_PER_PAIR * (b - a)) and not any(s < b - base and a - base < e for s, _, e in found[doc]):
            found[doc].append((a - base, 3, b - base))
    for doc, own in enumerate(found):
        if own:
            points = np.concatenate([[0], np.cumsum((flat[at[doc]:at[doc + 1]] & 0xC0) != 0x80)])
            found[doc] = sorted((int(points[s]), k, int(points[e])) for s, k, e in own)
    return found


def described(spans: list[tuple[int, int, int]]) -> tuple:
    said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
    base = ",".join(x for x, (_, k, _) in zip(said, spans, strict=True) if k < 3)
    return (*(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(base.encode()).hexdigest(), ",".join(said))


def redact(docs: DataFrame, ratio: np.ndarray, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, each secret of a text replaced by ``mark`` (spans that overlap by one) and n_chars, if there is such
    a column, counted anew for changed texts. Texts without secrets, null ones too, are left alone."""
    order = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole)):
            text = b.column("text")
            found = found_in(pa.RecordBatch.from_arrays([text.fill_null("")], names=["text"]), ratio)
            hit = [i for i, s in enumerate(found) if s]
            if hit:
                new = {}
                for i in hit:
                    own, out, done = text[i].as_py(), [], 0
                    for s, _, e in found[i]:
                        if s >= done:
                            out += [own[done:s], mark]
                        done = max(done, e)
                    new[i] = "".join(out) + own[done:]
                b = replaced(b, "text", new)
                if "n_chars" in order:
                    b = replaced(b, "n_chars", {i: len(t) for i, t in new.items()})
            yield b

    return in_small_batches(docs).mapInArrow(run, docs.schema)
