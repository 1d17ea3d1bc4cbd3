"""Substring dedup by paragraph MinHash banding, and by shared passages inside paragraphs.

Paragraphs are lines of at least ``LEAST`` words. Blocks are the runs of lines between blank ones, so that wrapped text is compared whole:
those of several lines with each other and with those of one line, apart from the lines, as a block is like its own longest line. Their sets of five-word shingles get MinHash values in bands; 6 bands of 3 values find
a pair of Jaccard similarity 0.8 with probability 0.986, one of 0.9 with 0.9996. Equal paragraphs meet first, as one row. Paragraphs that
collide with others in a band, and only those, are read a second time, in one of their texts, for their shingles; a bitmap keeps most other
texts out of that exchange. They are compared by exact Jaccard similarity, and a spanning forest of the pairs of ``SIMILAR`` or more leaves the bucket; a
bucket above ``BUCKET`` different paragraphs is dealt out as pairs of blocks. Components of all forests are the classes.

A passage inside larger paragraphs has no paragraph of its own. So texts are also cut at content-chosen words, the least hash of three
words in every window of ``WINDOW``, into overlapping passages of ``PASSAGE`` words or more. Any run of 51 words holds one, cut alike
wherever the run stands; equal passages are a class.

Words are separated by spaces and tab to carriage return; A-Z count as a-z. Null and empty texts have no paragraphs, blocks or passages.
Repeated rows have equal ones and are of one class. The member of least (doc_id, start) stays, the others are marked removed; a null id
comes last. Offsets are bytes of the text. Two hashes of 64 bits stand for a paragraph or passage, 32 bits for a shingle. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import likely, rows_of, stage, text_of
from lodestat.llm.components import components

SHINGLE = 5
LEAST = SHINGLE
SIMILAR = 0.8
BANDS, ROWS = 6, 3
BUCKET = 512
WINDOW, PASSAGE = 16, 14
#: Bytes of a text that are cut at once.
TOGETHER = 1 << 20

#: Shingles whose MinHash values are taken at once; bounds the memory of a very long block.
AT_ONCE = 1 << 16
#: Sets the numbers and bands of blocks apart from those of lines.
APART = 0x2545F4914F6CDD1D

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = tuple(both)
    return _POWERS[base]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of the values of each range, from prefix sums of a polynomial."""
    power, inverse = _powers(base, len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:len(values)], dtype=np.uint64)])
        return _mix((sums[ends] - sums[starts]) * inverse[starts])


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word."""
    b = np.frombuffer(data.lower(), np.uint8)
    word = np.concatenate([[False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    return starts, ends, range_hashes(b.astype(np.uint64) + np.uint64(1), starts, ends, _ODD[0])


def passages(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, two hashes) of a text's passages."""
    out = []
    for first in range(0, max(1, len(data)), TOGETHER):
        # from a word's start, and far enough to hold all windows that start in this part
        part = data[first:first + TOGETHER + (1 << 14)] if first else data[:TOGETHER + (1 << 14)]
        s, e, h = words_of(part)
        if first and len(s) and not data[first - 1:first].isspace() and s[0] == 0:
            s, e, h = s[1:], e[1:], h[1:]
        if first + len(part) < len(data) and len(s):
            s, e, h = s[:-1], e[:-1], h[:-1]
        if len(h) < PASSAGE + 3:
            continue
        with np.errstate(over="ignore"):
            three = _mix(h[:-2] + h[1:-1] * np.uint64(_ODD[1]) + h[2:] * np.uint64(_ODD[2]))
        key = three & ~np.uint64((1 << 21) - 1) | np.arange(len(three), dtype=np.uint64)
        width, done = min(WINDOW, len(key)), 1
        least = key
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        cuts = np.unique((least & np.uint64((1 << 21) - 1)).astype(np.int64))
        nxt = np.searchsorted(cuts, cuts + PASSAGE)
        a, b = cuts[nxt < len(cuts)], cuts[nxt[nxt < len(cuts)]]
        out.append((s[a] + first, e[b - 1] + first, range_hashes(h, a, b, _ODD[1]), range_hashes(h, a, b, _ODD[2])))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    start, end, h1, h2 = (np.concatenate(x) for x in zip(*out, strict=True))
    _, keep = np.unique(start, return_index=True)
    return start[keep], end[keep], h1[keep], h2[keep]


def passage_rows(source: DataFrame) -> DataFrame:
    """(doc_id, start, end, h1, h2) of every passage."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [passages(own.tobytes()) for own in rows_of(b)]
            if not found:
                continue
            start, end, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            cols = [b.column("doc_id").take(rows), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "end", "h1", "h2"])

    return source.mapInArrow(run, f"doc_id {kind}, start int, end int, h1 long, h2 long")


def signature_constants(n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, n + 1, dtype=np.uint64)
    a = _mix(k * np.uint64(_ODD[0] & 0xFFFFFFFF)) | np.uint64(1)
    return (a & np.uint64(0xFFFFFFFF))[:, None], (_mix(k * np.uint64(_ODD[2] & 0xFFFFFFFF)) & np.uint64(0xFFFFFFFF))[:, None]


def bands_of(own: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The bands' hashes of a set of shingles."""
    mul, add = signature_constants(bands * rows)
    sig = np.full(bands * rows, 1 << 32, np.uint64)
    for i in range(0, len(own), AT_ONCE):
        sig = np.minimum(sig, ((own[i:i + AT_ONCE] * mul + add) & np.uint64(0xFFFFFFFF)).min(axis=1))
    return _banded(sig.reshape(1, bands, rows))[0]


def _banded(sig: np.ndarray) -> np.ndarray:
    """The bands' hashes of MinHash values by set, band and row."""
    bands, rows = sig.shape[1:]
    factors = np.asarray([1, _ODD[1], _ODD[2], *(_mix(np.arange(3, max(rows, 3), dtype=np.uint64)) | np.uint64(1)).tolist()], np.uint64)[:rows]
    with np.errstate(over="ignore"):
        return _mix((sig * factors).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def bands_of_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``bands_of`` the unsigned 32-bit values of each range, none of them empty; a row of bands for each."""
    mul, add = (x.astype(np.uint32)[:, 0] for x in signature_constants())
    sig = np.empty((len(starts), BANDS * ROWS), np.uint64)
    both = np.stack([starts, ends], axis=1).ravel()
    padded = np.append(values, np.uint32(0))
    for k in range(BANDS * ROWS):
        sig[:, k] = np.minimum.reduceat(padded * mul[k] + add[k], both)[::2]
    return _banded(sig.reshape(-1, BANDS, ROWS))


def fives(h: np.ndarray) -> np.ndarray:
    """Unsigned 32-bit hashes of the shingles of words with the given hashes, in order."""
    n = len(h) - SHINGLE + 1
    return (range_hashes(h, np.arange(n), np.arange(n) + SHINGLE, _ODD[0]) >> np.uint64(32)).astype(np.uint32)


def units(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, is a line, is a block) of lines and blocks of ``LEAST`` words or more; lines: their bounds in words."""
    p, q = lines[:-1], lines[1:]
    has = np.concatenate([[False], q > p, [False]])
    top, last = np.flatnonzero(has[1:] & ~has[:-1]), np.flatnonzero(has[:-1] & ~has[1:]) - 1
    alone = np.zeros(len(p), bool)
    alone[top[top == last]] = True
    several = top != last
    a, b = np.concatenate([p, p[top[several]]]), np.concatenate([q, q[last[several]]])
    line = np.arange(len(a)) < len(p)
    block = np.concatenate([alone, np.ones(int(several.sum()), bool)])
    keep = b - a >= LEAST
    return a[keep], b[keep], line[keep], block[keep]


def paragraph_rows(source: DataFrame) -> DataFrame:
    """(doc_id, _at, start, end, h1, h2, line, block, bands) of every line and block; _at: the text's row in ``source``."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "end", "h1", "h2", "line", "block"]
        for b in batches:
            found, values, before = [], [], 0
            for i, own in enumerate(rows_of(b)):
                s, e, h = words_of(own.tobytes())
                if len(h) < LEAST:
                    continue
                lines = np.concatenate([[0], np.searchsorted(s, np.flatnonzero(own == 10)), [len(s)]])
                p, q, line, block = units(lines)
                if not len(p):
                    continue
                values.append(fives(h))
                h1, h2 = range_hashes(h, p, q, _ODD[1]).view(np.int64), range_hashes(h, p, q, _ODD[2]).view(np.int64)
                found.append((s[p].astype(np.int32), e[q - 1].astype(np.int32), h1, h2, line, block, np.full(len(p), i), p + before, q - SHINGLE + 1 + before))
                before += len(values[-1])
            if not found:
                continue
            *cols, rows, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
            bands = bands_of_ranges(np.concatenate(values), starts, ends)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in ("doc_id", "_at")), *map(pa.array, cols), bands], names=["doc_id", "_at", *names, "bands"])

    return source.mapInArrow(run, f"doc_id {kind}, _at long, start int, end int, h1 long, h2 long, line boolean, block boolean, bands array<long>")


def shingle_rows(wanted: DataFrame) -> DataFrame:
    """(no, bands, shingles) of the paragraphs ``own`` (start, end, no, bands) of each text; shingles: sorted unsigned 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, asked = [], b.column("own")
            for text, paragraphs in zip(rows_of(b), asked, strict=True):
                s, e, h = words_of(text.tobytes())
                five = fives(h)
                first = np.searchsorted(s, paragraphs.values.field("start").to_numpy())
                last = np.searchsorted(e, paragraphs.values.field("end").to_numpy())
                sets += [np.unique(five[x:y - SHINGLE + 2]).astype("<u4").tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            every = asked.flatten()
            yield pa.RecordBatch.from_arrays([every.field("no"), every.field("bands"), pa.array(sets, pa.binary())], names=["no", "bands", "shingles"])

    return wanted.select("own", "text").mapInArrow(run, "no long, bands array<long>, shingles binary")


def forest(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Places of pairs that span all pairs of sets whose Jaccard similarity reaches ``similar``. Common elements are counted through the
    places of each element."""
    sizes = np.asarray([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(at, kind="stable")
    posting, bounds = owner[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(values)))])
    own = np.split(at, np.cumsum(sizes)[:-1])
    fresh, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not fresh[first]:
            continue
        fresh[first] = False
        stack = [first]
        while stack and fresh.any():
            i = stack.pop()
            met = np.concatenate([posting[bounds[v]:bounds[v + 1]] for v in own[i]])
            common = np.bincount(met, minlength=len(sets))
            near = np.flatnonzero(fresh & (common > 0) & (common >= similar * (sizes[i] + sizes - common) - 1e-9))
            fresh[near] = False
            out += [(i, int(j)) for j in near]
            stack += near.tolist()
    return out


def buckets(keys: DataFrame) -> DataFrame:
    """(band, n): the bands (no, band) in which n > 1 numbers meet, one of those that hold the same numbers."""
    held = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("no")).alias("_x"), F.bit_xor(F.xxhash64("no", F.lit(1))).alias("_y"))
    return held.where("n > 1").groupBy("n", "_x", "_y").agg(F.min("band").alias("band")).select("band", "n")


def meeting(keys: DataFrame) -> DataFrame:
    """The keys (no, band) whose band another number has too. One exchange of the two numbers."""
    return keys.select("no", "band", F.count(F.lit(1)).over(Window.partitionBy("band")).alias("_n")).where("_n > 1").select("no", "band")


def links(lines: DataFrame) -> DataFrame:
    """(a, b): pairs of numbers of different paragraphs (no, bands, shingles), a written table, that connect all similar ones that collide."""
    keys = lines.select("no", F.explode("bands").alias("band"))
    counts = buckets(keys)
    blocks = F.ceil(F.col("n") / BUCKET)
    met = keys.join(counts, "band").join(lines.select("no", "shingles"), "no")
    dealt = (met.withColumn("_own", F.pmod(F.xxhash64("no"), blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .groupBy("band", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j")).agg(F.collect_list(F.struct("no", "shingles")).alias("members")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for row in b.column("members"):
                found = dict(zip(row.values.field("no").to_pylist(), row.values.field("shingles").to_pylist(), strict=True))
                numbers = list(found)
                for x, y in forest([np.frombuffer(s, "<u4") for s in found.values()], SIMILAR):
                    a.append(numbers[x])
                    c.append(numbers[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return dealt.where(F.size("members") > 1).select("members").mapInArrow(run, "a long, b long")


def _marked(rows: DataFrame, *by: str) -> DataFrame:
    """Adds class_doc, class_start (the class's least member), members and removed; classes of one member go. Rows are exchanged once."""
    own = Window.partitionBy(*by)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    first = Window.partitionBy(*by, "doc_id", "start").orderBy("end")      # equal rows: one of them stays
    rows = rows.withColumn("members", F.count(F.lit(1)).over(own)).where("members > 1").withColumn("_least", F.min(place).over(own))
    at_least = F.col("doc_id").eqNullSafe(F.col("_least.doc_id")) & (F.col("start") == F.col("_least.start"))
    return rows.withColumn("_no", F.row_number().over(first)).select(
        "doc_id", "start", "end", F.col("_least.doc_id").alias("class_doc"), F.col("_least.start").alias("class_start"), "members", (~(at_least & (F.col("_no") == 1))).alias("removed"))


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, class_doc, class_start, members, removed): every paragraph (kind "paragraph") that has a similar one, every
    block (kind "block") of a class that holds one of several lines, and every passage (kind "passage") that has an equal one."""
    source = text_of(docs, "doc_id")
    named = source.withColumn("_at", F.xxhash64("doc_id", "text"))
    rows = stage(paragraph_rows(named), "paragraphs")
    number = F.xxhash64("h1", "h2")
    lines = stage(rows.groupBy("h1", "h2").agg(F.max("line").alias("line"), F.max("block").alias("block"), F.first("bands").alias("bands"), F.min(F.struct("_at", "start", "end")).alias("place"))
                  .select(number.alias("no"), "line", "block", "bands", "place.*"), "lines")
    apart = F.lit(APART)
    blocks = lines.where("block").select(F.col("no").bitwiseXOR(apart).alias("no"), F.transform("bands", lambda x: x.bitwiseXOR(apart)).alias("bands"), "_at", "start", "end")
    every = lines.where("line").select("no", "bands", "_at", "start", "end").unionByName(blocks)
    met = stage(meeting(every.select("no", F.explode("bands").alias("band"))), "met")
    wanted = met.join(buckets(met).select("band"), "band", "left_semi").groupBy("no").agg(F.collect_list("band").alias("bands"))
    asked = stage(every.select("no", "_at", "start", "end").join(wanted, "no").groupBy("_at").agg(F.collect_list(F.struct("start", "end", "no", "bands")).alias("own")), "asked")
    once = likely(named.select("_at", "text"), asked, "_at").join(asked, "_at").groupBy("_at").agg(F.first("text").alias("text"), F.first("own").alias("own"))
    similar = stage(shingle_rows(once), "similar")
    roots = stage(components(links(similar)), "roots")

    def classed(own: DataFrame) -> DataFrame:
        return own.join(roots, own["no"] == roots["node"], "left").select("doc_id", "start", "end", "line", F.coalesce("root", "no").alias("class"))

    paragraphs = _marked(classed(rows.where("line").select("doc_id", "start", "end", "line", number.alias("no"))).drop("line"), "class").withColumn("kind", F.lit("paragraph"))
    of_blocks = classed(rows.where("block").select("doc_id", "start", "end", "line", number.bitwiseXOR(apart).alias("no")))
    several = F.bool_or(~F.col("line")).over(Window.partitionBy("class"))
    blocks = _marked(of_blocks.withColumn("_several", several).where("_several").drop("line", "_several"), "class").withColumn("kind", F.lit("block"))
    spans = _marked(passage_rows(source), "h1", "h2").withColumn("kind", F.lit("passage"))
    return paragraphs.unionByName(blocks).unionByName(spans).select("doc_id", "kind", "start", "end", "class_doc", "class_start", "members", "removed")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the removed (start, end) of each document."""
    return repeated(docs).where("removed").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
