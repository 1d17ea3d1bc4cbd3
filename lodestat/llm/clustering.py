"""Centroid clustering of whole-number vectors with an incremental matrix of dot products.

Vectors become whole numbers, floor(scale * x), and lie in blocks of up to ``BLOCK`` rows. A block carries its vectors, their exact dot
products with every centroid, and their clusters. When centroids move, a dot product changes by the vector's components where that
centroid changed, times the change: only those columns are read into the product. The nearest centroid follows from
|v|^2 - 2 v.c + |c|^2, all in whole numbers. A round's blocks are written to the shared folder with the sums of vectors that came to and
went from each cluster, so that the next centroids need the moved vectors alone; the table of the round before is removed then. A lost
executor costs the blocks of one round. The driver holds the centroids and their sums: k * dim numbers.

Kept are vectors of ``dim`` components, none null or non-finite; other rows take no part and are not returned. Rows without an id are
kept, the id counting as empty text where it is hashed; equal rows are clustered each, equal hashes ordered by the vector. Ties of
distances go to the smaller number. With fewer than k vectors there are as many centroids as vectors; an empty table gives an empty
result. A centroid that no vector is nearest to stays where it is. Whole numbers beyond 2**27 would not leave room for exact distances:
such a table is refused with a ValueError. Sums of distances beyond the range of a long are reported as its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import in_small_batches, shared_dir

BLOCK = 4096
#: Magnitude of components up to which distances over 1,000 components are exact in 64 bits.
MOST = 1 << 27
LONG_END = (1 << 63) - 1


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors with ``dim`` components, none null or non-finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where((F.size("embedding") == dim) & ~F.exists("embedding", bad))


def first_centroids(rows: DataFrame, k: int, scale: float, seed: int) -> list[list[int]]:
    """The k vectors whose id has the smallest sha256 behind ``seed:``, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    some = rows.select(F.sha2(name, 256).alias("at"), "embedding").orderBy("at", "embedding").limit(k).collect()
    return [[int(x) for x in whole(np.asarray(r["embedding"], float), scale).tolist()] for r in some]


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * x), -2.0 * MOST, 2.0 * MOST).astype(np.int64)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact x @ y: by floating point where every partial sum is below 2**53, else by whole numbers."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, len(y))
    return (x.astype(float) @ y.astype(float)).astype(np.int64) if most < 1 << 53 else x.astype(np.int64) @ y


class Block:
    """The arrays of a block row."""

    def __init__(self, row: dict, dim: int):
        self.ids, self.kind = row["ids"], row["kind"]
        self.x = np.frombuffer(row["data"], self.kind).reshape(-1, dim)
        n = len(self.x)
        self.dots = np.frombuffer(row["dots"], "<i8").reshape(n, -1) if row["dots"] is not None else None
        self.of = np.frombuffer(row["clusters"], "<i4") if row["clusters"] is not None else np.full(n, -1, np.int32)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        x = self.x.astype(np.int64)
        return (x * x).sum(axis=1)[:, None] - 2 * self.dots + (centroids * centroids).sum(axis=1)

    def move(self, centroids: np.ndarray, before: np.ndarray | None) -> list[int]:
        """Updates dot products and clusters. Returns, for each cluster, by how much its count and its sum of vectors changed."""
        if before is None:
            self.dots = product(self.x, centroids.T)
        else:
            self.dots = self.dots.copy()
            for c, change in enumerate(centroids - before):
                at = np.flatnonzero(change)
                if len(at):
                    self.dots[:, c] += product(self.x[:, at], change[at])
        new = self.distances(centroids).argmin(axis=1).astype(np.int32)
        moved = np.flatnonzero(new != self.of)
        signs = (new[moved] == np.arange(len(centroids))[:, None]).astype(np.int64) - (self.of[moved] == np.arange(len(centroids))[:, None])
        self.of = new
        return np.concatenate([signs.sum(axis=1)[:, None], product(signs, self.x[moved].astype(np.int64))], axis=1).ravel().tolist()


def block_type(rows: DataFrame) -> str:
    return f"ids array<{rows.schema['vec_id'].dataType.simpleString()}>, kind string, data binary, dots binary, clusters binary, most long, changes array<long>"


def blocks(rows: DataFrame, dim: int, scale: float) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors; no dot products and clusters yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                some = b.slice(a, BLOCK)
                x = whole(some.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                most = int(np.abs(x).max(initial=0))
                kind = "<i2" if most < 1 << 15 else "<i4"
                ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("vec_id"))
                none = pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([x.astype(kind).tobytes()]), none, none, pa.array([most]), pa.array([None], pa.list_(pa.int64()))],
                                                 names=["ids", "kind", "data", "dots", "clusters", "most", "changes"])

    return in_small_batches(rows).mapInArrow(run, block_type(rows))


def rounds_of(b: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for i in range(b.num_rows):
        row = b.slice(i, 1)
        yield row, Block({c: row.column(c)[0].as_py() for c in ("kind", "data", "dots", "clusters")} | {"ids": row.column("ids")}, dim)


def assigned(table: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The blocks after one assignment."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, block in rounds_of(b, dim):
                changes = block.move(centroids, before)
                new = {"dots": pa.array([block.dots.astype("<i8").tobytes()], pa.binary()), "clusters": pa.array([block.of.astype("<i4").tobytes()], pa.binary()),
                       "changes": pa.array([changes], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([new.get(c, row.column(c)) for c in row.schema.names], names=row.schema.names)

    return table.mapInArrow(run, table.schema)


def write(table: DataFrame) -> tuple[str, DataFrame]:
    spark, path = table.sparkSession, shared_dir(table.sparkSession, "centroids")
    table.write.parquet(path)
    return path, spark.read.schema(table.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of an earlier round, which nothing reads any more."""
    of_jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    of_jvm.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(of_jvm, True)


def summed(table: DataFrame, size: int) -> list[int]:
    """The element-wise sum of the blocks' changes; tasks sum first."""
    got = table.select(F.posexplode("changes").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = [0] * size
    for r in got:
        out[r["at"]] = r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector after ``rounds`` rounds and one more
    assignment. A round in which no centroid moves is the last one that is worked out: the others would repeat it."""
    spark, rows = vectors.sparkSession, usable(vectors, dim)
    path, table = write(blocks(rows, dim, scale))
    if (table.agg(F.max("most")).first()[0] or 0) > MOST:
        raise ValueError(f"components times {scale} must not exceed {MOST}")
    centroids, before = np.asarray(first_centroids(rows, k, scale, seed), np.int64).reshape(-1, dim), None
    k = len(centroids)
    totals = np.zeros((k, 1 + dim), object)
    for r in range(rounds + 1 if k else 0):
        if before is not None and (before == centroids).all():
            break
        old, (path, table) = path, write(assigned(table, centroids, before))
        remove(spark, old)
        before = centroids
        if r < rounds:
            totals += np.asarray(summed(table, k * (1 + dim)), object).reshape(k, 1 + dim)
            centroids = np.asarray([[s // t[0] for s in t[1:]] if t[0] else own for t, own in zip(totals.tolist(), before.tolist(), strict=True)], np.int64)
    return _result(table, centroids)


def _result(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]
    id_type = table.schema["ids"].dataType.elementType.simpleString()

    def inertia(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of distances by cluster, in two halves of 31 bits so that none overflows."""
        for b in batches:
            for _, block in rounds_of(b, dim):
                d = block.distances(centroids)[np.arange(len(block.of)), block.of]
                found = np.unique(block.of)
                yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array([int(half[block.of == c].sum()) for c in found], pa.int64()) for half in (d >> 31, d & 0x7FFFFFFF))],
                                                 names=["cluster", "high", "low"])

    if not len(centroids):
        return table.sparkSession.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sums = table.mapInArrow(inertia, "cluster int, high long, low long").groupBy("cluster").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    by = {r["cluster"]: (r["high"] << 31) + r["low"] for r in sums}
    all_ = min(sum(by.values()), LONG_END)
    of = [min(by.get(c, 0), LONG_END) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, block in rounds_of(b, dim):
                n = len(block.of)
                d = block.distances(centroids)[np.arange(n), block.of]
                yield pa.RecordBatch.from_arrays([block.ids.flatten(), pa.array(block.of), pa.array(d), pa.array(np.asarray(of, np.int64)[block.of]), pa.array(np.full(n, all_, np.int64)),
                                                  pa.array(digests).take(pa.array(block.of))],
                                                 names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return table.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def sql(vectors: str, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same by plain distances: one pair of steps a round."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) AS n, vec_id, e FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e, sha256(concat('{seed}:', CAST(vec_id AS VARCHAR))) AS h FROM {vectors}
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c0 AS MATERIALIZED (SELECT n - 1 AS c, e FROM v WHERE n <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT v.n, v.vec_id, v.e, o.c, CAST(list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, o.e) + list_inner_product(o.e, o.e) AS BIGINT) AS d
  FROM v CROSS JOIN c{r} o QUALIFY row_number() OVER (PARTITION BY v.n ORDER BY d, o.c) = 1)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  WITH u AS (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}),
  s AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u GROUP BY c, i),
  f AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS e FROM s GROUP BY c)
  SELECT c, coalesce(f.e, o.e) AS e FROM c{r} o LEFT JOIN f USING (c))""")
    return f"""WITH {",".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(o.e, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} o ON a.c = o.c"""
