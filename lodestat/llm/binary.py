"""Token-ID output: canonical length-limited Huffman coding of ids from global counts.

A written folder holds two tables: ``code`` (id, bits), the lengths from which canonical codes follow, and ``blocks``, one row a
block: the ids of neighbouring documents as one bit string, with the bit offset of every ``EVERY``-th id, so that a block is
decoded by itself, from all its checkpoints at once, through one table look-up an id. Blocks follow ascending doc_id: (part, block)
is their order. The rows are Parquet rows because Spark's writer commits them task by task: a lost executor leaves no half file.

Null and empty texts have the end id alone. Rows with equal doc_id are all kept, in any order among them; null ids come first. An
empty table gives empty tables. A document lies in one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestat.llm.common import rows_of, shared_dir, working_parts
from lodestat.llm.tokens import crc32, encoder, token_rows

MOST_BITS = 20
BLOCK = 1 << 19
EVERY = 128
PART_IDS = 1 << 26


def id_counts(rows: DataFrame, width: int) -> DataFrame:
    """(id, n) over all rows of (ids binary). Every task sums its own rows first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            n = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), f"<u{width}"))
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[:len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_bits(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths up to ``most`` for positive counts, by packages of pairs over ``most`` levels."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} ids do not fit codes of {most} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    packages, is_leaf = np.zeros(0, np.int64), []
    for _ in range(most):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        is_leaf.append(by < n)
        both = both[by]
        packages = both[:len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(is_leaf):
        own = int(level[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


class Code:
    """Canonical codes of (ids, bits): by length, then by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = np.asarray(ids, np.int64)[order], np.asarray(bits, np.int64)[order]
        self.most = int(self.bits[-1]) if len(ids) else 1
        firsts = np.cumsum(1 << (self.most - self.bits)) - (1 << (self.most - self.bits))     # as fractions of 2^most
        self.codes = (firsts >> (self.most - self.bits)).astype(np.uint64)
        room = int(self.ids.max()) + 1 if len(ids) else 0
        self.code_of, self.bits_of = np.zeros(room, np.uint64), np.zeros(room, np.int64)
        self.code_of[self.ids], self.bits_of[self.ids] = self.codes, self.bits
        self._table = None

    def table(self) -> np.ndarray:
        """id * 32 + length for every string of ``most`` bits."""
        if self._table is None:
            self._table = np.repeat(self.ids << 5 | self.bits, 1 << (self.most - self.bits))
        return self._table

    def encode(self, ids: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
        """The bit string, highest bit first, and the bit offsets of ids 0, every, 2 * every, ..."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        bits, codes = self.bits_of[ids], self.code_of[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        word, over = at >> 6, (at & 63) + bits - 64
        high = np.where(over > 0, codes >> np.maximum(over, 0).astype(np.uint64), codes << np.maximum(-over, 0).astype(np.uint64))
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[firsts]] = np.add.reduceat(high, firsts)
        split = np.flatnonzero(over > 0)
        out[word[split] + 1] += codes[split] << (64 - over[split]).astype(np.uint64)
        return out.astype(">u8").tobytes()[:int(ends[-1] + 7) // 8], at[::every]

    def decode(self, data: np.ndarray, n: int, checkpoints: np.ndarray, every: int = EVERY) -> np.ndarray:
        """The n ids of a bit string; all checkpoints advance together, an id a step."""
        table, most = self.table(), self.most
        b = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at = np.asarray(checkpoints, np.int64)
        out = np.zeros((every, len(at)), np.int64)
        last = n - every * (len(at) - 1) if len(at) else 0
        for k in range(min(every, n)):
            if k == last:
                at = at[:-1]      # the last run is shorter
            found = table[window[at >> 3] >> (32 - most - (at & 7)).astype(np.uint32) & np.uint32((1 << most) - 1)]
            out[k, :len(at)] = found >> 5
            at = at + (found & 31)
        return out.T.reshape(-1)[:n]


def write(docs: DataFrame, path: str, end_id: int, folder: str) -> None:
    """Writes every document's ids and ``end_id`` below ``folder``. Texts are tokenized once, into a table of the shared folder."""
    spark = docs.sparkSession
    spot = shared_dir(spark, "ids")
    token_rows(docs, path, end_id).write.option("compression", "zstd").parquet(spot)
    rows = spark.read.parquet(spot)
    width = encoder(path).width
    found = id_counts(rows, width).toPandas().sort_values("id")       # at most the vocabulary
    ids, bits = found["id"].to_numpy(np.int64), code_bits(found["n"].to_numpy(np.int64))
    spark.createDataFrame(pa.table({"id": ids, "bits": bits.astype(np.int32)}).to_pandas(), "id long, bits int").coalesce(1).write.parquet(f"{folder}/code")
    parts = max(working_parts(spark), -(-int(found["n"].sum()) // PART_IDS))
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow_kind = pa.list_(spark.createDataFrame([], rows.select("doc_id").schema).toArrow().schema.field(0).type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, block = Code(ids, bits), TaskContext.get().partitionId(), 0
        names, held, n = [], [], 0

        def flush() -> pa.RecordBatch:
            data, points = code.encode(np.concatenate(held).astype(np.int64))
            row = [[part], [block], [names], [[len(x) for x in held]], [points.tolist()], [data]]
            kinds = (pa.int32(), pa.int64(), arrow_kind, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["part", "block", "doc_ids", "sizes", "checkpoints", "data"])

        for b in batches:
            for key, own in zip(b.column("doc_id").to_pylist(), rows_of(b, "ids"), strict=True):
                names.append(key)
                held.append(np.frombuffer(own.tobytes(), f"<u{width}"))
                n += len(held[-1])
                if n >= BLOCK:
                    yield flush()
                    names, held, n, block = [], [], 0, block + 1
        if held:
            yield flush()

    (rows.withColumn("_h", F.xxhash64("ids")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
     .mapInArrow(run, f"part int, block long, doc_ids array<{kind}>, sizes array<long>, checkpoints array<long>, data binary")
     .write.option("compression", "uncompressed").parquet(f"{folder}/blocks"))


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array]) decoded from the files; start counts the ids of all documents before."""
    found = spark.read.parquet(f"{folder}/code").toPandas()
    ids, bits = found["id"].to_numpy(np.int64), found["bits"].to_numpy(np.int64)
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(ids, bits)
        for b in batches:
            for i, data in enumerate(rows_of(b, "data")):
                sizes = np.asarray(b.column("sizes")[i].values, np.int64)
                n = int(sizes.sum())
                out = code.decode(data, n, np.asarray(b.column("checkpoints")[i].values, np.int64)).astype("<u4")
                cuts = np.cumsum(sizes) - sizes
                own = [out[a:a + k] for a, k in zip(cuts.tolist(), sizes.tolist(), strict=True)]
                cols = [b.column("doc_ids")[i].values, pa.array(np.full(len(own), b.column("part")[i].as_py(), np.int32)), pa.array(np.full(len(own), b.column("block")[i].as_py())),
                        pa.array(cuts), pa.array(sizes), pa.array([crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "part", "block", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = blocks.mapInArrow(run, f"doc_id {kind}, part int, block long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    sums = blocks.select("part", "block", F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)       # a row for each part
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(up_to), F.lit(0))).drop("n")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select("part", "block", (F.col("base") + F.col("ahead")).alias("base"))
    return rows.join(bases, ["part", "block"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
