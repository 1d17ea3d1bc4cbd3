"""Best-fit packing by the best-two-fit rule, over counts of lengths.

Lengths are whole numbers up to the sequence's, so the packing is decided on a table of at most that many counts: it does not
grow with the data. A bin is filled greedily with the largest lengths that fit; then its smallest document gives way, as long as
that fills the bin better, to the two unpacked documents that fill the larger gap best. One such bin is repeated as often as the
counts allow. Every piece then finds its place by its rank among the pieces of its length; ranks come from counts per hash range, so
that a length shared by very many pieces is spread over all tasks.

Null and empty texts have the end id alone. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import stage, text_of
from lodestat.llm.tokens import crc32, encoder

LENGTH = 1024
RANGE_ROWS = 20_000


def pieces(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut into pieces of ``length`` counted
    from its end, so that only the first may be shorter. ids: little-endian unsigned, two bytes each (four for large vocabularies)."""
    source = text_of(docs, "doc_id")
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows, cols = [], [[] for _ in names[1:]]
            for i, own in enumerate(enc.encode(batch.column("text"))):
                ids = np.append(np.frombuffer(own, enc.kind).astype("<u4"), np.uint32(end_id))
                cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append(i)
                    for c, v in zip(cols, (k, a, b - a, crc32(ids[a:b]), *[ids[a:b].astype(enc.kind).tobytes()] * with_ids), strict=True):
                        c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]], names=names)

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_two_fit(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in the bin, number of such bins) that together hold ``counts[n]`` documents of each length n."""
    left = np.zeros(length + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    bins = []
    while left.any():
        free = left.copy()
        own: list[int] = []
        gap = length
        while (fits := np.flatnonzero(free[1:gap + 1])).size:
            own.append(int(fits[-1]) + 1)
            free[own[-1]] -= 1
            gap -= own[-1]
        while gap and (pair := _two_for(free, own[-1], gap + own[-1])):
            gap += own.pop() - sum(pair)
            own = sorted([*own, *pair], reverse=True)
            free[list(pair)] -= 1 if pair[0] != pair[1] else 2
        used = np.bincount(own, minlength=length + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        bins.append((tuple(own), times))
        left -= used * times
    return bins


def _two_for(free: np.ndarray, smallest: int, room: int) -> tuple[int, int] | None:
    """Two free lengths whose sum is the largest up to ``room``, if it is above ``smallest``."""
    a = np.flatnonzero(free[:room])
    if not a.size:
        return None
    below = np.maximum.accumulate(np.where(free[:room + 1] > 0, np.arange(room + 1), 0))
    b = below[np.minimum(a, room - a)]
    b = np.where((b == a) & (free[a] < 2), below[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    i = int(total.argmax())
    return (int(a[i]), int(b[i])) if total[i] > smallest else None


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds rank (from 0) among the rows of one value of ``key``, by counts of hash ranges and ranks within a range. ``rows`` is read
    twice: pass a written table. ``order`` must tell rows apart, but for rows equal in all that counts."""
    n = max(1, math.ceil(rows.count() / RANGE_ROWS))
    spread = rows.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = spread.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    return spread.withColumn("_in", inside).join(counts, [key, "_range"]).withColumn("rank", F.col("_base") + F.col("_in")).drop("_range", "_in", "_base")


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``parts`` (doc_id, piece, start, length, ids_crc32, ...), a written table."""
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}      # at most ``length`` rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    seen = dict.fromkeys(counts, 0)
    sequence = 0
    for own, times in best_two_fit(counts, length):
        for n in dict.fromkeys(own):
            each = own.count(n)
            slots.setdefault(n, []).append((seen[n], sequence, each, sum(x for x in own if x > n)))
            seen[n] += each * times
        sequence += times
    table = {n: np.asarray(v, np.int64).T for n, v in slots.items()}
    rows = ranked(parts, "length", "doc_id", "piece", "start", "ids_crc32")
    out = rows.drop("rank")
    kept = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            where, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in np.unique(size).tolist():
                mine = np.flatnonzero(size == n)
                first, base, each, offset = table[n]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                turn = rank[mine] - first[k]
                where[mine], at[mine] = base[k] + turn // each[k], offset[k] + turn % each[k] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(where), pa.array(at)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", sequence_id long, offset long"
    return rows.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence's pieces in order, at most ``length`` of them, from a ``pack`` of pieces with ids."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places. The texts are tokenized once; the pieces are written to the shared folder."""
    return pack(stage(pieces(docs, path, end_id, length, with_ids), "pieces"), length)
