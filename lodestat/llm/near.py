"""One document of each class of near copies, by SimHash fingerprints and by five-word shingles.

Texts of equal words meet first, as one row. Two texts are linked if their fingerprints (``simhash``) lie within a radius, as in
``simhash.one_of_each``, and also if the Jaccard similarity of their shingles is ``paragraphs.SIMILAR`` or more. For the latter, ``BANDS``
bands of ``ROWS`` MinHash values find a pair of similarity 0.8 with probability 0.99996; only texts that meet another one in a band are
read a second time, for their shingles, and their similarity is worked out exactly. Components of all links are the classes.

Words are those of ``paragraphs``. A text of under five words has one shingle, all of it; null and empty texts are alike. Two hashes of 64
bits stand for a text, 32 bits for a shingle. A null doc_id is kept only if its class has no other id. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import simhash
from lodestat.llm.common import rows_of, stage, text_of
from lodestat.llm.components import components
from lodestat.llm.paragraphs import _ODD, SHINGLE, bands_of, links, range_hashes, words_of

BANDS, ROWS = 14, 3


def shingles_of(h: np.ndarray) -> np.ndarray:
    """Sorted unsigned 32-bit hashes of the shingles of a text's word hashes."""
    n = max(len(h) - SHINGLE + 1, 1)
    five = range_hashes(h, np.arange(n), np.minimum(np.arange(n) + SHINGLE, len(h)), _ODD[0])
    return np.unique((five >> np.uint64(32)).astype(np.uint32))


def text_rows(source: DataFrame, keep: tuple[str, ...], whole: bool) -> DataFrame:
    """(*keep, h1, h2) of every text, and its bands and fingerprint, or with ``whole`` its shingles."""
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    last, kind = ("shingles", "binary") if whole else ("bands", "array<long>, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, values, fp = [], [], [], []
            for own in rows_of(b):
                data = own.tobytes()
                h = words_of(data)[2]
                start, end = np.zeros(1, np.int64), np.asarray([len(h)])
                h1.append(int(range_hashes(h, start, end, _ODD[1]).view(np.int64)[0]))
                h2.append(int(range_hashes(h, start, end, _ODD[2]).view(np.int64)[0]))
                some = shingles_of(h)
                values.append(some.astype("<u4").tobytes() if whole else bands_of(some, BANDS, ROWS).tolist())
                if not whole:
                    fp.append(simhash.fingerprint(data))
            cols = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(values, pa.binary() if whole else pa.list_(pa.int64()))]
            more = [] if whole else [pa.array(np.asarray(fp, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols, *more], names=[*keep, "h1", "h2", last, *["fp"] * len(more)])

    return source.mapInArrow(run, f"{kinds}, h1 long, h2 long, {last} {kind}")


def fingerprint_links(texts: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of numbers of texts (no, fp), a written table, that connect all whose fingerprints lie within the radius."""
    fps = stage(texts.groupBy("fp").agg(F.min("no").alias("least")), "fingerprints")
    equal = texts.join(fps, "fp").where("no != least").select(F.col("no").alias("a"), F.col("least").alias("b"))
    near = simhash.links(fps, radius, max(simhash.GROUPS, radius + 1))
    a, b = (fps.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("a", "b"))
    return equal.unionByName(near.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def classes(docs: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """(doc_id, _text, first): each row's id, text hash, and the least (none, doc_id, _text) of its class."""
    named = text_of(docs.select("doc_id", "text", F.xxhash64("text").alias("_text")), "doc_id", "_text")
    number = F.xxhash64("h1", "h2")
    rows = stage(text_rows(named, ("doc_id", "_text"), False).select("doc_id", "_text", number.alias("no"), "bands", "fp"), "similar")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")
    each = stage(rows.groupBy("no").agg(F.min(place).alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
                 .select("no", "least", "bands", "fp", F.col("least.doc_id").alias("_id"), F.col("least._text").alias("_at")), "texts")

    keys = each.select("no", "_id", "_at", F.explode("bands").alias("band"))
    often = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    met = stage(keys.join(often, "band", "left_semi").groupBy("no", "_id", "_at").agg(F.collect_list("band").alias("bands")), "met")
    again = named.join(met, named["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_at"))).select("no", "bands", "text")
    lines = stage(text_rows(again, ("no", "bands"), True).dropDuplicates(["no"]).select("no", "bands", "shingles"), "lines")

    roots = stage(components(links(lines).unionByName(fingerprint_links(each.select("no", "fp"), radius))), "roots")
    classed = each.join(roots, each["no"] == roots["node"], "left").select("no", "least", F.coalesce("root", "no").alias("class"))
    tops = classed.groupBy("class").agg(F.min("least").alias("first"))
    return rows.select("doc_id", "_text", "no").join(classed.join(tops, "class").select("no", "first"), "no").select("doc_id", "_text", "first")


def one_of_each(docs: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """The row of smallest doc_id (ids before nulls, then by text hash) of each class, with all its columns; of rows equal in id and
    text one."""
    return simhash.rows_at(docs, classes(docs, radius).select("first.doc_id", "first._text").distinct())
