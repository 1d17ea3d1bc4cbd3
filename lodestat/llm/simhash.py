"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint becomes the vector of the numbers of set bits in its segments. Their Manhattan distance never exceeds the Hamming
distance, so fingerprints within the radius differ in the counts of at most as many segments, hence of at most as many groups of
segments. The grid's cells fix the counts of all groups but ``radius`` of them; two fingerprints within the radius share a cell. In
a cell, pairs within the Manhattan distance are verified by Hamming distance. Only a spanning forest of a cell's links leaves it, so
that a dense cell gives no more rows than it holds. A cell above ``CELL`` fingerprints is dealt out as pairs of blocks. Fingerprints
are distinct before all this: copies meet in one row.

Null and empty texts, and those without words, have fingerprint 0 and are linked like any other. Repeated rows keep a row each. A
null doc_id is kept; it names its component only if there is no other id. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import rows_of, stage, text_of
from lodestat.llm.components import components

WORDS = 3
SEED = 42
RADIUS = 3
GROUPS = 6
#: Fingerprints that one task compares with each other.
CELL = 8192
#: Shingles hashed before their bits are counted; bounds the memory of a very long text.
TOGETHER = 1 << 18


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is 1 if it is 1 in over half the hashes of the text's word shingles."""
    found = data.lower().split()       # of bytes: A-Z alone, and space, tab to carriage return
    if not found:
        return 0
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(found) >= words:
        starts, ends = starts[:len(found) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for i in range(0, len(starts), TOGETHER):
        some = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i:i + TOGETHER].tolist(), ends[i:i + TOGETHER].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(some, np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, fp): the fingerprint's 64 bits as a signed long."""
    source = text_of(docs, "doc_id", *keep)
    names = ["doc_id", *keep, "fp"]
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(own.tobytes(), words) for own in rows_of(b)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(fp.view(np.int64))], names=names)

    return source.mapInArrow(run, f"{kinds}, fp long")


LOW = np.uint64(0x5555555555555555)


def embed(fp: np.ndarray) -> np.ndarray:
    """Set bits of each of 32 segments of two bits, two bits a count."""
    return fp - (fp >> np.uint64(1) & LOW)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between embeddings: counts of 0 to 2 differ by 1 where the xor's low bit is set, by 2 where only the high one is."""
    z = a ^ b
    low, high = z & LOW, z >> np.uint64(1) & LOW
    return np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high & ~low).astype(np.int16)


def cell_masks(radius: int = RADIUS, groups: int = GROUPS) -> list[int]:
    """For every choice of ``groups - radius`` groups of segments, the bits of the embedding that hold their counts."""
    if not 0 <= radius < groups <= 32:
        raise ValueError("more groups than the radius are needed, 32 at most")
    parts = np.array_split(np.arange(32), groups)
    masks = [sum(3 << 2 * int(s) for s in part) for part in parts]
    return [sum(c) for c in combinations(masks, groups - radius)]


def forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places of linked fingerprints that span all links among ``fp``. A reached fingerprint is compared with those not reached yet."""
    emb, rest, out = embed(fp), np.arange(len(fp)), []
    while len(rest) > 1:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            near = manhattan(emb[rest], emb[i]) <= radius
            near[near] = np.bitwise_count(fp[rest[near]] ^ fp[i]) <= radius
            if near.any():
                found = rest[near].tolist()
                out += [(i, j) for j in found]
                stack += found
                rest = rest[~near]
    return out


def links(fps: DataFrame, radius: int = RADIUS, groups: int = GROUPS, cell: int = CELL) -> DataFrame:
    """(a, b): pairs of fingerprints within the radius that connect all that are. ``fps``: a written table of distinct fp."""
    masks = np.asarray(cell_masks(radius, groups), np.uint64)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64)
            keys = embed(fp)[:, None] & masks
            kind = np.tile(np.arange(len(masks), dtype=np.int32), len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp.view(np.int64), len(masks)))], names=["kind", "key", "fp"])

    cells = fps.select("fp").mapInArrow(to_cells, "kind int, key long, fp long")
    counts = cells.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / cell)
    own = F.pmod(F.xxhash64("fp"), blocks)
    dealt = (cells.join(counts, ["kind", "key"]).withColumn("_own", own)
             .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .groupBy("kind", "key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j")).agg(F.collect_list("fp").alias("fps")))

    def to_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.column("fps"):
                fp = np.unique(np.asarray(row.values)).view(np.uint64)
                pairs = forest(fp, radius)
                if pairs:
                    out.append(fp.view(np.int64)[np.asarray(pairs)])
            found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    return dealt.where(F.size("fps") > 1).select("fps").mapInArrow(to_links, "a long, b long")


def classes(rows: DataFrame, radius: int = RADIUS, groups: int = GROUPS, first: Column | None = None) -> DataFrame:
    """Adds component_id, the smallest doc_id (or ``first``, a minimum) reachable over links, to (doc_id, fp, ...), a written table."""
    fps = stage(rows.groupBy("fp").agg((F.min("doc_id") if first is None else first).alias("least")), "fingerprints")
    roots = stage(components(links(fps, radius, groups)), "roots")
    joined = fps.join(roots, fps["fp"] == roots["node"]).select("fp", "root", "least")
    tops = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stage(joined.join(tops, "root").select("fp", "component_id")
                  .unionByName(fps.join(roots, fps["fp"] == roots["node"], "left_anti").select("fp", F.col("least").alias("component_id"))), "classes")
    return rows.join(found, "fp")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id) of every row."""
    rows = stage(fingerprints(docs, words), "simhash")
    return classes(rows, radius, groups).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """The row of smallest doc_id (ids before nulls, then by text hash) of each class, with all its columns; of rows equal in id and
    text one."""
    rows = stage(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("_text")), words, ("_text",)), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text"))
    return rows_at(docs, classes(rows, radius, groups, first).select("component_id.*").distinct())


def rows_at(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` of the given (doc_id, _text), text hashes; of rows equal in both one."""
    kept = kept.withColumnRenamed("doc_id", "_id").withColumnRenamed("_text", "_at")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.to_json(F.struct(*rest)).alias("_rest") if rest else F.lit("").alias("_rest"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = named.join(kept.select("_id", "_at"), named["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_at")))
    once = Window.partitionBy("_id", "_text").orderBy("_rest")
    return found.withColumn("_no", F.row_number().over(once)).where("_no = 1").select("_row.*")
