"""Resampling towards a target corpus by importance weights, the draws ranked by parallel sorting with regular sampling.

Weights. Runs of 1 to ``grams`` consecutive words are hashed into buckets. A bucket's gain is the logarithm of how much more often it
comes up in the target than in the documents, both smoothed by one, in thousandths as a whole number; a document's weight is the sum over
its features. Bucket counts (``buckets`` numbers) are the only thing that reaches the driver of either corpus; the gains are an array
that scores a document's features by position. Features are hashed once: the buckets of each document are written and read twice.

Draws. A document's score is its weight plus Gumbel noise drawn from a hash of its id, so that the highest scores are a sample without
replacement in proportion to the weights. Runs of up to ``RUN`` scores are sorted where they are and give samples at regular steps; the
sorted samples give splitters, again at regular steps. A run is cut at the splitters, equal cuts of all runs meet in one task and are
merged there, and counts of the cuts before it are added to a row's place: an exact rank. Ties of scores go to the smaller id, and those
of both to the run and place in it, so that no value is too common for a cut. Cuts that lie behind the draws are not sent anywhere. If
there are more samples than ``SAMPLES``, they are themselves sampled in the same way.

Null texts have no features, nor have texts without words: weight 0. Rows without an id are hashed as if it were empty text and come last
in a tie. Ids are whole numbers. Equal rows are ranked each. Other columns take no part. Without documents the result is empty; without
targets every gain is that of an empty target.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import in_small_batches, stage, text_of, texts, working_parts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Scores of a sorted run at most, and samples that it gives at regular steps.
RUN, PER_RUN = 1 << 16, 64
#: Rows of a merged cut, about.
CUT_ROWS = 1 << 16
#: Samples that may reach the driver.
SAMPLES = 1 << 18
#: Features whose bucket a worker remembers; bounds its memory, never its results.
KEPT = 200_000


class Hasher:
    """The buckets of texts."""

    def __init__(self, buckets: int, grams: int):
        self.buckets, self.grams, self.known = buckets, grams, {}

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of every feature."""
        words = WORD.findall(text.translate(LOWER) if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        runs = words if self.grams == 1 else [" ".join(words[i:i + n]) for n in range(1, self.grams + 1) for i in range(len(words) - n + 1)]
        found = list(map(self.known.get, runs))
        if None in found:
            if len(self.known) > KEPT:
                self.known = {}
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.known[runs[i]] = zlib.crc32(runs[i].encode()) % self.buckets
        return len(words), np.asarray(found, np.uint32)


def gumbel(seed: int, doc_id: int | None) -> int:
    """Noise in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def hashed(docs: DataFrame, id_column: str, buckets: int, grams: int) -> DataFrame:
    """(doc_id, n_words, n_features, features: the bucket numbers, two or four bytes each)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    source = text_of(docs.withColumn("doc_id", F.col(id_column).cast("long")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Hasher(buckets, grams)
        for b in batches:
            for first, some in texts(b):
                got = [of(t) for t in some]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(some)), pa.array([n for n, _ in got], pa.int64()), pa.array([len(x) for _, x in got], pa.int64()),
                                                  pa.array([x.astype(kind).tobytes() for _, x in got], pa.binary())], names=["doc_id", "n_words", "n_features", "features"])

    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, features binary")


def _flat(b: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch, and where each row's begin."""
    values = b.column("features")
    _, offsets, data = values.buffers()
    wide = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    at = np.frombuffer(offsets, wide)[values.offset: values.offset + len(values) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind) if len(values) and at[-1] > at[0] else np.zeros(0, kind)
    return flat, (at - at[0]) // np.dtype(kind).itemsize


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket comes up; tasks sum first, and ``buckets`` rows at most reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_flat(b, kind)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in in_small_batches(features.select("features")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down."""
    b = len(of_docs)
    s_all, t_all = int(of_docs.sum()), int(of_target.sum())
    return np.asarray([math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)))) for s, t in zip(of_docs.tolist(), of_target.tolist(), strict=True)], np.int64)


def scored(features: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score)."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = _flat(b, kind)
            sums = np.concatenate([[0], np.cumsum(gain[flat])])
            weight = sums[at[1:]] - sums[at[:-1]]
            noise = np.fromiter((gumbel(seed, i) for i in b.column("doc_id").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight), pa.array(weight + noise)],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    return in_small_batches(features).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


# ---- sorting by regular sampling

#: Columns that order rows: the score from the highest down, the id, and what tells equal ones apart.
ORDER = ("down", "last", "id", "run", "place")


def sorted_runs(rows: DataFrame, least_words: int) -> DataFrame:
    """``rows`` with the columns of ``ORDER``. Rows to rank lie in sorted runs; the others have no run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, n = TaskContext.get().partitionId(), 0, [], 0

        def done(some: list[pa.RecordBatch], no: int) -> pa.RecordBatch:
            b = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            ids, down = b.column("doc_id"), -b.column("score").to_numpy()
            last, id_ = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            order = np.lexsort((id_, last, down))
            b = b.take(pa.array(order))
            size = b.num_rows
            steps = min(size, PER_RUN)
            at = (2 * np.arange(steps) + 1) * size // (2 * steps)
            stands = np.zeros(size)
            stands[at] = size / steps
            key = [pa.array(down[order]), pa.array(last[order]), pa.array(id_[order]), pa.array(np.full(size, (part << 32) + no, np.int64)), pa.array(np.arange(size, dtype=np.int64))]
            return pa.RecordBatch.from_arrays([*b.columns, *key, pa.array(stands)], names=[*b.schema.names, *ORDER, "stands"])

        for b in batches:
            enough = np.asarray(b.column("n_words")) >= least_words
            rest = b.filter(pa.array(~enough))
            if rest.num_rows:
                none = [pa.nulls(rest.num_rows, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*rest.columns, *none], names=[*rest.schema.names, *ORDER, "stands"])
            some = b.filter(pa.array(enough))
            for a in range(0, some.num_rows, RUN):
                held.append(some.slice(a, RUN))
                n += held[-1].num_rows
                if n >= RUN:
                    yield done(held, no)
                    held, n, no = [], 0, no + 1
        if n:
            yield done(held, no)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, down long, last boolean, id long, run long, place long, stands double")


def splitters(runs: DataFrame, parts: int) -> list[tuple]:
    """At most ``parts - 1`` keys that cut the rows into about equal parts: samples, in order, at regular steps of the rows they stand for."""
    samples = runs.where("stands > 0").select(*ORDER, "stands")
    while samples.count() > SAMPLES:      # sorted samples give samples in turn
        thin = samples.sortWithinPartitions(*ORDER).withColumn("_at", F.monotonically_increasing_id()).where("_at % 16 = 8").drop("_at")
        samples = stage(thin, "samples")
    got = sorted(tuple(r) for r in samples.collect())
    filled = np.cumsum([r[-1] for r in got])
    steps = [int(np.searchsorted(filled, filled[-1] * i / parts)) for i in range(1, parts)] if got else []
    return [got[i][:-1] for i in sorted(set(steps))]


def cut_of(b: pa.RecordBatch, cuts: list[tuple]) -> np.ndarray:
    """The number of splitters that are not after each row. Splitters are searched for in the batch's sorted runs."""
    run, out = np.asarray(b.column("run")), np.zeros(b.num_rows, np.int32)
    edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    columns = [np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in ORDER]
    for first, after in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for cut in cuts:
            low, high = first, after
            for values, x in zip(columns, cut, strict=True):        # narrow to rows equal so far
                side = values[low:high]
                low, high = low + int(np.searchsorted(side, x, "left")), low + int(np.searchsorted(side, x, "right"))
                if low == high:
                    break
            out[low:after] += 1
    return out


def ranked(rows: DataFrame, draws: int, least_words: int, eligible: int) -> DataFrame:
    """``rows`` (a written table) with ``rank`` of the ``draws`` highest scores among rows of ``least_words`` words, null for others."""
    if not draws:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    names = rows.columns
    runs = stage(sorted_runs(in_small_batches(rows), least_words), "runs")
    parts = max(working_parts(rows.sparkSession), math.ceil(eligible / CUT_ROWS))
    cuts = splitters(runs, parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = b.filter(pa.compute.is_valid(b.column("run")))
            rest = b.filter(pa.compute.is_null(b.column("run")))
            for some, of in ((ranks, lambda: pa.array(cut_of(ranks, cuts))), (rest, lambda: pa.nulls(rest.num_rows, pa.int32()))):
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([*some.columns, of()], names=[*some.schema.names, "cut"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    dealt = stage(runs.mapInArrow(cut, f"{kinds}, cut int"), "cuts")
    sizes = {r["cut"]: r["count"] for r in dealt.where("cut IS NOT NULL").groupBy("cut").count().collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(len(cuts) + 1)])])
    drawn = int(np.searchsorted(before, draws, "left"))        # cuts that hold draws

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            of = np.asarray(b.column("cut"))
            rank = np.empty(len(of), np.int64)
            for c in np.unique(of).tolist():
                mine = np.flatnonzero(of == c)
                n = n if c == last else int(before[c])
                rank[mine] = np.arange(n + 1, n + 1 + len(mine))
                last, n = c, n + len(mine)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(rank, mask=rank > draws)], names=[*names, "rank"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    high = dealt.where(F.col("cut") < drawn).repartitionById(drawn, "cut").sortWithinPartitions("cut", *ORDER)
    low = dealt.where(F.col("cut").isNull() | (F.col("cut") >= drawn)).select(*names, F.lit(None).cast("long").alias("rank"))
    return high.mapInArrow(number, f"{kinds}, rank long").unionByName(low)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, grams: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn. ``target`` needs a text alone."""
    features = stage(hashed(docs, "doc_id", buckets, grams), "features")
    wanted = hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "doc_id", buckets, grams)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    rows = stage(scored(features, gain, seed), "scores")
    eligible = rows.where(F.col("n_words") >= least_words).count()
    return ranked(rows, eligible * percent // 100, least_words, eligible).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by bytes of UTF-8: the table of its 256 steps follows from the polynomial.
SQL = r"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
  FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS n FROM {docs}),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {target}),
u AS (SELECT n, unnest(words) AS word FROM d),
t AS (SELECT unnest(words) AS word FROM b),
h AS (SELECT word, hex(word) AS h FROM (SELECT word FROM u UNION SELECT word FROM t)),
c AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
      lambda i: 16 * (instr('123456789ABCDEF', substr(h, 2 * i + 1, 1))) + instr('123456789ABCDEF', substr(h, 2 * i + 2, 1)))),
    lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h CROSS JOIN steps),
s AS (SELECT bucket, count(*) AS n FROM u JOIN c USING (word) GROUP BY bucket),
q AS (SELECT bucket, count(*) AS n FROM t JOIN c USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(q.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN q USING (bucket)),
w AS (SELECT u.n, sum(gain) AS weight FROM u JOIN c USING (word) JOIN g USING (bucket) GROUP BY u.n),
r AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', CAST(doc_id AS VARCHAR))), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (n)),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM r WHERE n_features >= 20) THEN place END AS rank FROM k"""
