"""Mixing sources to target weights.

Hash-random keys order the rows of each source; sums of sizes per key range give every row the number of words before it in its
source, and each source is cut at its exact budget, after as many whole epochs as the budget holds. A source's rows lie in many key
ranges, so that one large source is spread over all tasks; only range sums are kept per source.

Null or empty texts have size 0 and take 0. A null source is a source of its own, the last one. Equal keys (repeated rows) are
ordered by id and size; equal rows are interchangeable. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import in_small_batches, replaced, rows_of, stage, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Rows of a key range, about; the number of ranges follows the number of rows.
RANGE_ROWS = 20_000


def count_words(data: np.ndarray) -> int:
    """Runs of bytes other than space and tab to carriage return."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    return int(np.count_nonzero(word[1:] > word[:-1]) + word[0]) if len(data) else 0


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row."""
    source = text_of(docs, "doc_id", "source")
    names = ["doc_id", "source", "size"]
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in names[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter(map(count_words, rows_of(b)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n)], names=names)

    return source.mapInArrow(run, f"{kinds}, size long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target), one row a source: ``share`` of all sizes divided by weight, no source above ``most`` times its
    size; what is above goes to the others by weight. Sources by code point, nulls last, take the weights in turn. Sorted by the
    level at which a source is full, the first one that isn't sets the level of all behind it."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order, full = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("full_at", "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    t = (per.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", w)
         .withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
         .withColumn("filled", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         .withColumn("left", F.sum("weight").over(rest))
         .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                               - F.lit(float(most)) * F.col("filled")) / F.col("left")))
    open_level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(
        full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return t.withColumn("open", open_level["level"]).select(
        "source", "source_size", F.when((F.col("level") > F.col("full_at")) | F.col("open").isNull(), F.lit(float(most)) * F.col("source_size"))
        .otherwise(F.col("open") * F.col("weight")).alias("target"))


def mix(sizes: DataFrame, goals: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds source_size, target and taken (words that the mix takes of the row, repeats counted) to (doc_id, source, size, *keep).

    ``sizes`` is read several times: pass a written table. ``goals``: (source, source_size, target), by default ``targets``.
    """
    goals = targets(sizes) if goals is None else goals
    digits = max(0, math.ceil(math.log(max(1, sizes.count() / RANGE_ROWS), 16)))
    keyed = sizes.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("range", F.substring("key", 1, digits))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("of_range"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("of_range").over(up_to), F.lit(0))).drop("of_range")
    facts = (sums.alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source"))
             .select("s.source", "range", "base", "source_size", "target"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    before = F.col("base") + F.col("inside")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - before))
    return (keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("k")
            .join(facts.alias("f"), F.expr("k.source <=> f.source AND k.range = f.range"))
            .select("doc_id", "k.source", "size", *keep, "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document is repeated for each whole time it is taken, and the one at a source's
    cut ends after its last word taken (its n_chars, if there is such a column, is that of the text left). Rows that share an id are
    told apart by their order, so that repeated rows stay."""
    same = Window.partitionBy("doc_id").orderBy("source", "_hash")
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_copy", F.row_number().over(same))
    sizes = stage(sized_copies(docs), "mix-sizes")
    chosen = mix(sizes, keep=("_copy",)).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("_copy").alias("_no"), "size", "taken")
    joined = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_copy") == F.col("_no")))
    whole = F.floor(F.col("taken") / F.col("size"))
    times = F.when(F.col("taken") % F.col("size") > 0, whole + 1).otherwise(whole)
    words = F.when(F.col("_turn") <= whole, F.lit(-1)).otherwise(F.col("taken") % F.col("size"))
    out = joined.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("_row", words.cast("long").alias("_words"))
    order = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = np.asarray(b.column("_words"))
            b = pa.RecordBatch.from_struct_array(b.column("_row"))
            for i in np.flatnonzero(left >= 0).tolist():
                text = first_words(b.column("text")[i].as_py(), int(left[i]))
                for name, value in (("text", text), ("n_chars", len(text))):
                    if name in order:
                        b = replaced(b, name, {i: value})
            yield b

    return in_small_batches(out).mapInArrow(cut, docs.schema)


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    data = np.frombuffer(text.encode(), np.uint8)
    word = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    ends = np.flatnonzero(word[:-1] & ~word[1:])
    return data[:ends[n - 1]].tobytes().decode() if n else ""


def sized_copies(docs: DataFrame) -> DataFrame:
    """``sized`` with the number of each row among those of its id, as ``mixture`` counts them."""
    base = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter(map(count_words, rows_of(b)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("_hash"), pa.array(n)], names=["doc_id", "source", "_hash", "size"])

    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in ("doc_id", "source"))
    counted = in_small_batches(base).mapInArrow(run, f"{kinds}, _hash long, size long")
    same = Window.partitionBy("doc_id").orderBy("source", "_hash")
    return counted.withColumn("_copy", F.row_number().over(same)).drop("_hash")


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM p),
x AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM w),
f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM x),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
o AS (SELECT level AS open FROM l WHERE level <= full_at ORDER BY full_at, place LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN level > full_at OR (SELECT open FROM o) IS NULL THEN 2.0::DOUBLE * source_size ELSE (SELECT open FROM o) * weight END AS target FROM l),
r AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
e AS (
  SELECT r.*, t.source_size, t.target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
    CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e"""
