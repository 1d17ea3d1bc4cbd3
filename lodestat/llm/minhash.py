"""Document fingerprints by one-permutation MinHash, with DataFrame functions alone.

Each shingle of five words is hashed once. The hash's high bits are its bin, the least hash of a bin is kept. An empty bin borrows from
a filled one by optimal densification: probes that depend on the bin alone, up to the first filled one; after ``PROBES`` of them the
filled bin whose hash with the empty one is least, which is as even a choice. The low bits of the bins make up the fingerprint. Chance
makes bins agree with probability 2^-bits; likeness takes that out: (m - 2^-bits) / (1 - 2^-bits) for a share m of equal bins, not below 0.

A text of fewer words is one shingle, an empty or null one the shingle of no words. The text after a row is that of the next
doc_id (a number; nulls first, equal ids by text), after the last that of the first. Every row sits in one range of ids, together with
the first row of the next range; ranges come from approximate quantiles, so that none holds more than its share. Repeated rows are
kept. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import text_of, working_parts

WORDS = 5
BIN_BITS = 8
LOW_BITS = 8
PROBES = 8


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once for each row, however often it is used: a generator is not merged with what reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def least_of_bins(text: str, words: int = WORDS, bin_bits: int = BIN_BITS) -> Column:
    """For each bin in order (of signed hashes), the least hash in it; an empty bin has its largest value, a mark that is sorted in
    with the hashes so that every bin has a first one."""
    shift = 64 - bin_bits
    parts = ", ".join(f"h[i + {k}]" for k in range(words))
    return F.expr(rf"""
      transform(array(
        transform(array(transform(filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w != ''), w -> xxhash64(w))),
          h -> if(size(h) < {words}, array(xxhash64(h)), transform(sequence(0, size(h) - {words}), i -> xxhash64({parts}))))[0]),
        s -> transform(array(sort_array(concat(s, transform(sequence(0, {(1 << bin_bits) - 1}), b -> shiftleft(cast(b as bigint), {shift}) | {(1 << shift) - 1}L)))),
          o -> filter(o, (x, i) -> i = 0 OR shiftright(x, {shift}) != shiftright(o[i - 1], {shift})))[0])[0]""")


def filled_bins(least: str, bin_bits: int = BIN_BITS, low_bits: int = LOW_BITS, probes: int = PROBES) -> Column:
    """The low bits of all bins after densification, less 2^(low_bits - 1) to fit a byte."""
    shift, bins = 64 - bin_bits, 1 << bin_bits
    mark = (1 << shift) - 1
    empty = lambda x: f"({x} & {mark}L) = {mark}L"
    tries = ", ".join(f"nullif({least}[cast(pmod(xxhash64(i, {p}), {bins}) as int)] & {mark}L, {mark}L)" for p in range(probes))
    last = f"array_min(transform(filter({least}, y -> NOT {empty('y')}), y -> named_struct('g', xxhash64(i, -1, shiftright(y, {shift})), 'y', y))).y"
    value = f"if({empty('x')}, coalesce({tries}, {last}), x)"
    return F.expr(f"transform({least}, (x, i) -> cast(({value} & {(1 << low_bits) - 1}L) - {1 << (low_bits - 1)} as tinyint))")


def with_bins(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the low bits of the text's bins as an array of bytes."""
    df = once(df, "_least", least_of_bins(text))
    return once(df, name, filled_bins("_least")).drop("_least")


def packed(bins: str, low_bits: int = LOW_BITS) -> Column:
    """The fingerprint: the bins' low bits as hexadecimal digits."""
    digits = -(-low_bits // 4)
    return F.expr(f"array_join(transform({bins}, x -> lpad(lower(hex(x + {1 << (low_bits - 1)})), {digits}, '0')), '')")


def likeness(a: str, b: str, low_bits: int = LOW_BITS) -> Column:
    chance = 2.0 ** -low_bits
    same = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)") / F.size(F.expr(a))
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, bins, next_text, next_bins): every text, its bins, and those of the next document."""
    spark = docs.sparkSession
    base = text_of(docs, "doc_id")
    n = ranges or max(2, working_parts(spark))
    cuts = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]       # as many as there are tasks
    cuts = sorted(set(cuts or []))
    place = F.expr(f"coalesce(size(filter(array({', '.join(f'{c!r}' for c in cuts)}), c -> c < doc_id)), 0)") if cuts else F.lit(0)
    firsts = {r[0]: r[1] for r in base.select("doc_id").withColumn("_range", place).where("doc_id IS NOT NULL").groupBy("_range").agg(F.min("doc_id")).collect()}     # a row for each range
    order = [F.asc_nulls_first("doc_id"), F.asc("text")]
    # where there are null ids, the first of them is the first row; it stands in for its range's
    nulls = base.where("doc_id IS NULL").orderBy("text").limit(1)
    has_null = bool(nulls.select(F.lit(1)).collect())
    held = sorted(set(firsts) | ({0} if has_null else set()))
    wanted = [v for k, v in firsts.items() if not (has_null and k == 0)]
    guards = base.where(F.col("doc_id").isin(wanted)) if wanted else base.limit(0)
    guards = guards.groupBy("doc_id").agg(F.min("text").alias("text"))
    if has_null:
        guards = guards.unionByName(nulls)
    before = {k: held[i - 1] for i, k in enumerate(held)}
    moved = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_range")] if before else F.lit(0)
    rows = base.withColumn("_range", place).withColumn("_guard", F.lit(0)).unionByName(
        guards.withColumn("_range", place).withColumn("_range", moved).withColumn("_guard", F.lit(1)))
    rows = with_bins(rows, "text", "bins")
    w = Window.partitionBy("_range").orderBy("_guard", *order)
    return rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_bins", F.lead("bins").over(w)).where("_guard = 0").drop("_range", "_guard")


def compared(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, that of its edited text (the last half of the code points replaced by the first as many of the next
    document), and the likeness of the two and to the next document's."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half))
    rows = with_bins(once(rows, "edited", edited).drop("next_text"), "edited", "edited_bins")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"),
                       likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return with_bins(text_of(docs, "doc_id"), "text", "bins").select("doc_id", packed("bins").alias("fingerprint"))
