"""Suffix-array removal of long passages that occur more than once.

Every string of ``length`` bytes has an anchor: the substring of ``GRAM`` bytes in it whose hash is least, the leftmost of equals. Equal
strings have equal anchors at equal distances, so anchors deal the strings out to shards: an anchor that occurs once anywhere settles the
strings it stands for. The bytes around the others, once for each different surrounding, form the texts of the shards. A shard's suffix
array is built by induced sorting, and the permuted common prefixes tell which strings have an equal one. Surroundings that occur
several times need no sorting to be known as repeated. An anchor with more than ``SURROUNDINGS`` different ones is counted string by
string over all tasks instead, so that no shard grows without bound. At last each text loses the bytes of its repeated strings.

Texts are UTF-8 bytes, null ones empty. A text shorter than ``length`` keeps all its bytes; one that occurs in several rows loses all of
them if it is long enough. Strings never reach across texts and are judged on the input. Repeated rows are copies of each other.
Two keys of 64 bits stand for a text and for a surrounding. Empty tables give empty results.

Passages counted in words are found alike: a text becomes four bytes for each word, so that ``words`` words are a string of 4 * ``words``
bytes. Words are as in ``paragraphs``: separated by spaces and tab to carriage return, A-Z as a-z. 32 bits of a hash stand for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import in_small_batches, likely, rows_of, run_ids, stage, working_parts
from lodestat.llm.paragraphs import words_of
from lodestat.llm.suffixes import common_prefixes, suffix_array

LENGTH = 400
GRAM = 128
#: Words of a passage, and of its anchors.
WORDS, WORD_GRAM = 51, 16
#: Bytes that stand for a word.
PER_WORD = 4
#: Different surroundings of one anchor that a shard takes; beyond that strings are counted one by one.
SURROUNDINGS = 4096
SHARD_BYTES = 4 << 20
#: Bytes of a text whose anchors are found at once.
TOGETHER = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)      # odd, so powers have inverses


def _powers(n: int, of: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.multiply.accumulate(np.full(n - 1, of, np.uint64)) if n > 1 else out[1:]
    return out


_TABLES: list[np.ndarray] = []


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place, from prefix sums of a polynomial."""
    if not _TABLES:
        _TABLES.extend((_powers(TOGETHER + 2 * LENGTH, int(_BASE)), _powers(TOGETHER + 2 * LENGTH, pow(int(_BASE), -1, 1 << 64))))
    power, inverse = _TABLES
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * inverse[:len(data) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def anchors_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first start, last start) of the runs of strings that share an anchor."""
    width = length - gram + 1
    out = []
    for first in range(0, max(0, len(data) - length + 1), TOGETHER):
        part = data[first:first + TOGETHER + length - 1]
        h = gram_hashes(part, gram)
        low = np.uint64((1 << 22) - 1)
        key = h & ~low | np.arange(len(h), dtype=np.uint64)
        least, done = key, 1
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        at = (least & low).astype(np.int64)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        out.append((h[at[starts]], starts + first, np.append(starts[1:], len(at)) - 1 + first))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text as bytes)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return in_small_batches(docs).select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.cast("binary").alias("text"))


def worded(texts: DataFrame) -> DataFrame:
    """The rows of ``keyed`` with ``PER_WORD`` bytes for each word instead of the text."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [(words_of(own.tobytes())[2] >> np.uint64(32)).astype("<u4").tobytes() for own in rows_of(b, "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), pa.array(some, pa.binary())], names=["doc_id", "k1", "k2", "text"])

    return texts.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, text binary")


def anchor_rows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, anchor, around, first, last): every run of strings with its anchor and a hash of all bytes of its strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, counts = [], []
            for own in rows_of(b, "text"):
                if len(own) < length:
                    counts.append(0)
                    continue
                h, first, last = anchors_of(own, length, gram)
                whole = own.tobytes()
                around = np.fromiter((xxhash.xxh3_64_intdigest(whole[i:j]) for i, j in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(first))
                found.append((h, around, first, last))
                counts.append(len(h))
            if found:
                h, around, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([b.column("k1").take(rows), b.column("k2").take(rows), pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(first), pa.array(last)],
                                                 names=["k1", "k2", "anchor", "around", "first", "last"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, anchor long, around long, first long, last long")


def repeated_starts(passages: list[bytes], length: int) -> list[np.ndarray]:
    """For each of different passages, whether the string from each place (that has one) occurs elsewhere among them."""
    sizes = np.asarray([len(p) for p in passages], np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()) + 1, np.int32)      # 1 between passages, 0 at the end
    text[:-1] = 1
    text[np.repeat(at, sizes) + run_ids(sizes)] = np.frombuffer(b"".join(passages), np.uint8).astype(np.int32) + 2
    runs = sizes - length + 1
    places = np.repeat(at, runs) + run_ids(runs)
    own = np.zeros(len(text), bool)
    own[places] = True
    order = suffix_array(text, 258)
    order = order[own[order]]
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(len(text), np.int64)
    prefix[places] = common_prefixes(text, places, before[places], length)
    hit = np.zeros(len(text), bool)
    second = order[1:][prefix[order[1:]] >= length]
    hit[second] = True
    hit[before[second]] = True
    return [hit[a:a + n] for a, n in zip(at.tolist(), runs.tolist(), strict=True)]


def as_runs(hit: np.ndarray) -> list[list[int]]:
    """[first, last] of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [[a, b - 1] for a, b in edge.reshape(-1, 2).tolist()]


RUNS = "array<array<long>>"


def listed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (doc_id, k1, k2, n_bytes, sha256) of every row, and (k1, k2, copies, least doc_id) of every text."""
    rows = stage(keyed(docs).select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha256")), "rows")
    return rows, stage(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id")), "texts")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, k1, k2, n_bytes, sha256, copies) of every row, and (k1, k2, runs of starts of repeated strings) of
    texts that occur in one row and have any. Strings of texts with copies count too."""
    rows, per = listed(docs)
    return rows.join(per.select("k1", "k2", "copies"), ["k1", "k2"]), repeats(docs, per, length, gram)[0]


def repeats(docs: DataFrame, per: DataFrame, length: int, gram: int, of: Callable[[DataFrame], DataFrame] = lambda texts: texts) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (k1, k2, runs) as ``repeated`` has them, and ``anchor_rows`` whose anchor occurs elsewhere. ``of`` makes the
    strings' bytes from the rows of ``keyed``; texts and copies of them (``per``) are those of ``keyed``."""
    texts = keyed(docs)
    found = stage(anchor_rows(of(texts), length, gram), "anchors")
    # a table of its own, so that a join with a very common anchor can be split
    often = stage(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor"), "anchors-often")
    found = stage(found.join(often, "anchor", "left_semi"), "anchors-met")

    around = stage(found.groupBy("anchor", "around").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("k1", "k2", "first", "last")).alias("one")), "around")
    kinds = around.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.last") - F.col("one.first") + length).alias("size")).where("kinds > 1")
    shards = max(1, -(-int(kinds.where(F.col("kinds") <= SURROUNDINGS).agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES))
    shards = max(shards, working_parts(docs.sparkSession))
    wanted = stage(around.join(kinds, "anchor").select("anchor", "around", "kinds", "one.*").join(per.select("k1", "k2", "doc_id"), ["k1", "k2"])
                   .groupBy("k1", "k2", "doc_id").agg(F.collect_list(F.struct("anchor", "around", "kinds", "first", "last")).alias("cuts")), "cuts")
    pieces = stage(_passages(_of_rows(of(likely(texts, wanted, "k1")), wanted), length), "passages")

    def sort_shard(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        seen = {}
        for r, pair in enumerate(zip(rows["anchor"].to_pylist(), rows["around"].to_pylist(), strict=True)):
            seen.setdefault(pair, r)       # rows equal in all, ids too, give a passage each
        rows = rows.take(pa.array(list(seen.values())))
        got = [as_runs(h) for h in repeated_starts(rows["passage"].to_pylist(), length)]
        keep = [i for i, r in enumerate(got) if r]
        yield from pa.table({"anchor": rows["anchor"].take(pa.array(keep, pa.int64())), "around": rows["around"].take(pa.array(keep, pa.int64())),
                             "runs": pa.array([got[i] for i in keep], pa.list_(pa.list_(pa.int64())))}).to_batches()

    few = pieces.where(F.col("kinds") <= SURROUNDINGS)
    sorted_ = (few.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
               .applyInArrow(sort_shard, f"anchor long, around long, runs {RUNS}"))
    strings = _strings(pieces.where(F.col("kinds") > SURROUNDINGS), length)
    twice = strings.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("s1", "s2")
    counted = strings.join(twice, ["s1", "s2"]).groupBy("anchor", "around").agg(F.transform(F.collect_set("at"), lambda x: F.array(x, x)).alias("runs"))
    known = sorted_.unionByName(counted)

    # where a surrounding occurs, its repeated strings do; all its strings if it occurs twice
    alone = per.where("copies = 1").select("k1", "k2")
    told = stage(around.select("anchor", "around", "met").join(known, ["anchor", "around"], "left").where("met > 1 OR runs IS NOT NULL"), "around-known")
    hits = found.join(told, ["anchor", "around"])       # one join alone, which can be split where a surrounding is very common
    hits = hits.withColumn("runs", F.expr("if(met > 1, array(array(first, last)), transform(runs, r -> array(first + r[0], first + r[1])))"))
    runs = hits.join(alone, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return stage(runs, "runs"), found


def repeated_words(docs: DataFrame, per: DataFrame, words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """(k1, k2, n_repeated_words): words of a text in runs of ``words`` or more that occur elsewhere too, of texts that have any."""
    length = words * PER_WORD
    runs, found = repeats(docs, per, length, gram * PER_WORD, worded)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [spans_of(np.asarray(r.values.flatten(), np.int64).reshape(-1, 2), length) for r in b.column("runs")]
            n = [sum(j // PER_WORD - -(-i // PER_WORD) for i, j in s) for s in spans]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(n, pa.int64())], names=["k1", "k2", "n_repeated_words"])

    # a copy repeats all words of its text, and so all of its anchors
    copies = found.join(per.where("copies > 1").select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2")
    whole = copies.agg(F.expr(f"(max(last) + {length}) div {PER_WORD}").alias("n_repeated_words"))
    return runs.select("k1", "k2", "runs").mapInArrow(count, "k1 long, k2 long, n_repeated_words long").unionByName(whole)


def _of_rows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` that ``wanted`` names by key and id, with its other columns. Ids keep copies of one text apart."""
    w = wanted.withColumnRenamed("doc_id", "_id")
    return texts.join(w, [texts["k1"] == w["k1"], texts["k2"] == w["k2"], texts["doc_id"].eqNullSafe(w["_id"])]).select("doc_id", texts["k1"], texts["k2"], "text", *[c for c in w.columns if c not in ("k1", "k2", "_id")])


def _passages(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, around, kinds, passage): the bytes of each cut of (text, cuts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, cuts in zip(rows_of(b, "text"), b.column("cuts"), strict=True):
                c = cuts.values
                whole = own.tobytes()
                some = [whole[i:j + length] for i, j in zip(c.field("first").to_pylist(), c.field("last").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.field("anchor"), c.field("around"), c.field("kinds"), pa.array(some, pa.binary())], names=["anchor", "around", "kinds", "passage"])

    return rows.select("text", "cuts").mapInArrow(run, "anchor long, around long, kinds long, passage binary")


def _strings(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, around, at, s1, s2): two hashes of every string of the passages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, own in enumerate(rows_of(b, "passage")):
                whole, n = own.tobytes(), len(own) - length + 1
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[k:k + length]) for k in range(n)), ">i8").astype(np.int64).reshape(-1, 2)
                cols = [np.full(n, b.column("anchor")[i].as_py()), np.full(n, b.column("around")[i].as_py()), np.arange(n), d[:, 0].copy(), d[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "around", "at", "s1", "s2"])

    return pieces.select("anchor", "around", "passage").mapInArrow(run, "anchor long, around long, at long, s1 long, s2 long")


def spans_of(runs: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal (start, end) covered by the strings that start in [first, last] of ``runs``."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    starts, ends = runs[:, 0], np.maximum.accumulate(runs[:, 1] + length)
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(runs) - 1)
    return list(zip(starts[new].tolist(), ends[last].tolist(), strict=True))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept][, n_repeated_words]) of every row; kept: the bytes that are left, as binary.
    With ``words``, words of the text in runs of so many or more that occur elsewhere too are counted; they are not removed."""
    rows, per = listed(docs)
    runs, _ = repeats(docs, per, length, gram)
    rows = stage(rows.join(per.select("k1", "k2", "copies"), ["k1", "k2"]), "rows-copies")
    wanted = stage(rows.where("copies = 1").join(runs, ["k1", "k2"]).select("k1", "k2", "doc_id", "runs"), "wanted")
    hit = _of_rows(likely(keyed(docs), wanted, "k1"), wanted)
    kind = hit.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own, r in zip(rows_of(b, "text"), b.column("runs"), strict=True):
                spans = spans_of(np.asarray(r.values.flatten(), np.int64).reshape(-1, 2), length)
                whole, edges = own.tobytes(), [0, *(x for s in spans for x in s), len(own)]
                kept = b"".join(whole[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(own), len(own) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("doc_id"), *cols[:len(names) - 1]], names=["k1", "k2", *names])

    done = hit.select("k1", "k2", "doc_id", "text", "runs").mapInArrow(cut, f"k1 long, k2 long, doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    rest = rows.join(runs.select("k1", "k2"), ["k1", "k2"], "left_anti").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), whole.cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("sha256"))).alias("kept_sha256"), "k1", "k2")
    if with_text:
        rest = _of_rows(keyed(docs), rest).withColumn("kept", F.when(F.col("n_removed") > 0, F.lit(b"")).otherwise(F.col("text")))
    every = done.unionByName(rest.select("k1", "k2", *names))
    if words is None:
        return every.select(names)
    found = stage(repeated_words(docs, per, words), "words")       # a table of its own, so that a join with a very common text can be split
    return every.join(found, ["k1", "k2"], "left").select(*names, F.coalesce("n_repeated_words", F.lit(0).cast("long")).alias("n_repeated_words"))
