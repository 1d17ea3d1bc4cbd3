"""Exact top-k inner products by reading sorted lists without random access.

Candidates lie in blocks; a block has a list for every component, from the largest down (for a query's negative components it is read
from the smallest up). All lists are read to a depth. What has been read gives each candidate a lower and an upper bound of its score:
an unread component lies between the list's far end and the last value read. A query stops when no candidate outside has an upper bound
that reaches the k-th lower bound; the scores of those that are left are then worked out. Otherwise the lists are read on, to their end if
need be. Bounds of all queries and candidates of a pair of blocks are two matrix products. The k-th best score of earlier blocks is a lower
bound, too.

Every block of candidates must meet every block of queries. Query blocks lie in groups, candidate blocks in shares; a task takes one of
each: it holds the group with the best so far, at most about ``GROUP_BYTES``, and reads the share block by block. So what is exchanged are
a few copies of either table, not the pairs, and the best of a share leave it as one row for each query block. There are about as many
tasks as shuffle partitions; the driver sees numbers of blocks alone.

Components are scaled and rounded down to whole numbers; scores are exact (whole numbers beyond the range of a long become its ends).
Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. A query is compared with vectors
of its length only, and never with rows of its own id. Equal rows are candidates each; equal query rows are one query. Ties go to the
smaller id. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import in_small_batches, stage, working_parts

CANDIDATES, QUERIES = 8192, 1024
#: Parts of the lists that are read before bounds are compared.
DEPTHS = (1 / 16, 1 / 4, 1 / 2)
#: Bytes of a group of query blocks, and of the best so far of its queries.
GROUP_BYTES = 64 << 20


def blocks(vectors: DataFrame, size: int, scale: float = 64.0) -> DataFrame:
    """(part, seq, dim, ids, kind, data): up to ``size`` rows of (vec_id, embedding) a row, as whole numbers of type ``kind``."""
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    names = ["part", "seq", "dim", "ids", "kind", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, {}

        def row(dim: int, seq: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            most = np.abs(data).max(initial=0)
            kind = "i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, seq, dim, ids.astype("<i8").tobytes(), kind, data.astype(kind).tobytes()),
                                               (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.binary()), strict=True)], names=names)

        for b in batches:
            column = b.column("embedding")
            if not len(column):
                continue
            at = np.asarray(column.offsets, np.int64)
            flat = column.values.to_numpy(zero_copy_only=False).astype(float)       # null components become NaN
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ids, sizes = np.asarray(b.column("vec_id")), np.diff(at)
            good = bad[at[1:]] == bad[at[:-1]]
            for dim in np.unique(sizes[good]).tolist():
                mine = np.flatnonzero(good & (sizes == dim))
                own = flat[at[mine][:, None] + np.arange(dim)]
                for i in range(0, len(mine), size):
                    held.setdefault(dim, []).append((ids[mine[i:i + size]], own[i:i + size]))
                    while (n := sum(len(x) for x, _ in held[dim])) >= size:
                        x, y = (np.concatenate(z) for z in zip(*held[dim], strict=True))
                        held[dim] = [(x[:size], y[:size])]
                        yield row(dim, seq)
                        seq += 1
                        if n > size:
                            held[dim] = [(x[size:], y[size:])]
                        else:
                            break
        for dim in sorted(held):
            yield row(dim, seq)
            seq += 1

    return source.mapInArrow(run, "part int, seq long, dim int, ids binary, kind string, data binary")


class Lists:
    """The sorted lists of a block's components."""

    def __init__(self, x: np.ndarray, kind: type):
        self.x = x.astype(kind)
        order = np.argsort(-self.x, axis=0, kind="stable")
        self.down = np.take_along_axis(self.x, order, axis=0)
        self.rank = np.empty(order.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every candidate, the components' lower and upper values after ``depth`` steps: those for positive weights, then those for
        negative ones (there the larger value gives the lower score)."""
        n = len(self.x)
        above, below = self.rank < depth, self.rank >= n - depth
        return (np.concatenate([np.where(above, self.x, self.down[-1]), np.where(below, self.x, self.down[0])], axis=1),
                np.concatenate([np.where(above, self.x, self.down[depth - 1]), np.where(below, self.x, self.down[n - depth])], axis=1))


def best_of_block(q: np.ndarray, q_ids: np.ndarray, lists: Lists, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score): the k best candidates of each query, and those that tie with the last; none below ``floor``."""
    n = len(ids)
    floor = (np.full(len(q), -np.inf) if floor is None else floor).astype(lists.x.dtype)
    signed = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1).astype(lists.x.dtype)
    open_, out = np.arange(len(q)), []
    for depth in (*(max(1, int(n * d)) for d in DEPTHS if n > 8 * (k + 1)), n):
        if not len(open_):
            break
        low, high = lists.read(depth)
        lower = signed[open_] @ low.T
        lower[q_ids[open_][:, None] == ids] = -np.inf
        least = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf, lower.dtype)
        least = np.maximum(least, floor[open_])
        if depth < n:
            upper = signed[open_] @ high.T
            upper[q_ids[open_][:, None] == ids] = -np.inf
            inside = upper >= least[:, None]
            done = inside.sum(axis=1) <= 8 * k
        else:
            inside, done = (lower >= least[:, None]) & (lower > -np.inf), np.ones(len(open_), bool)
        a, c = np.nonzero(inside[done])
        a = open_[done][a]
        out.append((a, c, np.einsum("ij,ij->i", q[a], lists.x[c].astype(q.dtype))))
        open_ = open_[~done]
    a, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = q_ids[a] != ids[c]
    return a[keep], c[keep], s[keep]


def exact_pairs(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score as long) of the k best of each query, for numbers too large for exact floating-point sums."""
    clip = lambda s: min(max(s, -1 << 63), (1 << 63) - 1)
    rows, other = [], [[int(v) for v in own] for own in x]
    for i, own in enumerate([int(u) for u in own] for own in q):
        found = ((i, j, clip(sum(u * v for u, v in zip(own, other[j], strict=True)))) for j in range(len(ids)) if ids[j] != q_ids[i])
        rows += sorted(found, key=lambda r: (-r[2], ids[r[1]]))[:k]
    a, c, s = (np.asarray([r[i] for r in rows], np.int64) for i in range(3))
    return a, c, s


class Best:
    """The k best (score, vec_id) so far of each query of a block: flat arrays by row, best first."""

    def __init__(self, part: int, seq: int, q_ids: np.ndarray, k: int):
        self.part, self.seq, self.q_ids, self.k = part, seq, q_ids, k
        self.row, self.ids, self.scores = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(len(q_ids), -np.inf)

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(row):
            return
        row, ids, scores = (np.concatenate(x) for x in ((self.row, row.astype(np.int32)), (self.ids, ids), (self.scores, scores.astype(np.int64))))
        order = np.lexsort((ids, ~scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        counts = np.bincount(row, minlength=len(self.q_ids))
        keep = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < self.k
        self.row, self.ids, self.scores = row[keep], ids[keep], scores[keep]
        full = np.flatnonzero(counts >= self.k)
        self.floor[full] = self.scores[np.cumsum(np.minimum(counts, self.k))[full] - 1]


def meet(best: Best, q: np.ndarray, x: np.ndarray, ids: np.ndarray, lists: dict[type, Lists]) -> None:
    """Lets a block of candidates take part; ``lists`` keeps its lists for the next block of queries."""
    top, dim = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)), x.shape[1]
    if dim and top * dim < 1 << 53:
        kind = np.float32 if top * dim < 1 << 24 else np.float64
        if kind not in lists:
            lists[kind] = Lists(x, kind)
        a, c, s = best_of_block(q.astype(float), best.q_ids, lists[kind], ids, best.k, best.floor)
    else:
        a, c, s = exact_pairs(q, best.q_ids, x, ids, best.k)
    best.add(a, ids[c], s)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds no, from 0, to a written table of blocks. A row for each block is sorted and sent to all tasks: 20 bytes for thousands of vectors."""
    numbers = rows.select("part", "seq").withColumn("no", F.row_number().over(Window.orderBy("part", "seq")) - 1)
    return rows.join(F.broadcast(numbers), ["part", "seq"])


def _grid(v: DataFrame, q: DataFrame, k: int, parts: int) -> tuple[int, int]:
    """(groups of query blocks, shares of candidate blocks): about ``parts`` pairs, of those within ``GROUP_BYTES`` the pair for which least
    is exchanged."""
    n, size = v.agg(F.count(F.lit(1)), F.sum(F.octet_length("data"))).first()
    m, held = q.agg(F.count(F.lit(1)), F.sum(F.octet_length("data") + 2 * k * F.octet_length("ids"))).first()
    if not n or not m:
        return 1, 1
    groups = max(math.ceil(held / GROUP_BYTES), round(math.sqrt(parts * held / max(size, 1))), math.ceil(parts / n), 1)
    groups = min(m, groups)
    return groups, min(n, math.ceil(parts / groups))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k highest inner products of each query with the vectors of other ids."""
    v = stage(blocks(vectors, CANDIDATES, scale), "vectors")
    q = stage(blocks(queries.select("vec_id", "embedding").distinct(), QUERIES, scale), "queries")
    parts = working_parts(vectors.sparkSession)
    groups, shares = _grid(v, q, k, parts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = ["part", "seq", "dim", "ids", "kind", "data"]
    asked = _numbered(q).withColumn("_share", every(shares)).select((F.col("no") % groups * shares + F.col("_share")).alias("slot"), F.lit(False).alias("candidate"), *data)
    given = _numbered(v).withColumn("_group", every(groups)).select((F.col("_group") * shares + F.col("no") % shares).alias("slot"), F.lit(True).alias("candidate"), *data)
    slots = asked.unionByName(given).repartitionById(groups * shares, F.col("slot").cast("int")).sortWithinPartitions("slot", "candidate")

    def rows(b: pa.RecordBatch) -> Iterator[dict]:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}

    def told(best: list[Best]) -> Iterator[pa.RecordBatch]:
        for x in best:
            values = (x.part, x.seq, *(y.tobytes() for y in (x.q_ids, x.row, x.ids, x.scores)))
            yield pa.RecordBatch.from_arrays([pa.array([y], t) for y, t in zip(values, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["part", "seq", "q_ids", "row", "ids", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, {}
        for r in (r for b in batches for r in rows(b)):
            if r["slot"] != slot:
                yield from told([x for own in held.values() for x, _ in own])
                slot, held = r["slot"], {}
            ids = np.frombuffer(r["ids"], "<i8")
            x = np.frombuffer(r["data"], r["kind"]).reshape(len(ids), r["dim"])
            if not r["candidate"]:
                held.setdefault(r["dim"], []).append((Best(r["part"], r["seq"], ids, k), x))
                continue
            lists = {}
            for best, own in held.get(r["dim"], []):
                meet(best, own, x, ids, lists)
        yield from told([x for own in held.values() for x, _ in own])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(x: Best) -> pa.RecordBatch:
            counts = np.bincount(x.row, minlength=len(x.q_ids))
            rank = np.arange(len(x.row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            return pa.RecordBatch.from_arrays([pa.array(x.q_ids[x.row]), pa.array(rank.astype(np.int32)), pa.array(x.ids), pa.array(x.scores)], names=["query_id", "rank", "vec_id", "score"])

        best = None
        for r in (r for b in batches for r in rows(b)):
            if best is None or (r["part"], r["seq"]) != (best.part, best.seq):
                if best is not None:
                    yield ranked(best)
                best = Best(r["part"], r["seq"], np.frombuffer(r["q_ids"], "<i8"), k)
            best.add(np.frombuffer(r["row"], "<i4"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["scores"], "<i8"))
        if best is not None:
            yield ranked(best)

    found = in_small_batches(slots).mapInArrow(run, "part int, seq long, q_ids binary, row binary, ids binary, scores binary")
    together = found.repartition(parts, "part", "seq").sortWithinPartitions("part", "seq")
    return together.mapInArrow(merged, "query_id long, rank int, vec_id long, score long")


def asks(column: str = "vec_id", every: int = 20) -> Column:
    return F.pmod(F.col(column), F.lit(every)) == 0


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM {vectors}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
