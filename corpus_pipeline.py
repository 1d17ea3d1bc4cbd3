"""From raw documents to packed training sequences: five stages, each over all rows that the one before has kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; the last returns the places of the pieces. What a
stage returns is written as Parquet to the shared folder and read back as the next one's documents.

* toxicity: rows predicted toxic go. The model learns from the labels of ``sf_dir`` and the documents at hand.
* near_duplicates: of each class of texts linked by SimHash fingerprints within three bits, or by a Jaccard similarity of 0.8 or more of
  five-word shingles, the row with the smallest id stays.
* secrets: every secret of a text becomes a mark; rows without secrets are left as they are.
* mix: rows are taken, repeated or cut as the sources' target weights ask.
* pack: texts become token ids, cut into pieces and packed into sequences.

Nulls, empty and repeated rows are treated as the operators' docstrings say; an empty table passes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import mixing, near, packing, secret_scan, simhash, toxicity
from lodestat.llm.common import stage

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs, radius=simhash.RADIUS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("secrets", without_secrets), ("mix", mixed), ("pack", packed)]

#: Fingerprints, models and packing are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
