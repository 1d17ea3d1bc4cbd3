"""The registered queries of this folder: each applies one operator to a whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import binary, chat, clustering, importance, minhash, mixing, packing, paragraphs, secret_scan, simhash, suffix_dedup, topk, toxicity
from lodestat.llm.common import shared_dir, stage

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(documents(spark, sf_dir), words=suffix_dedup.WORDS)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END_ID)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(stage(mixing.sized(documents(spark, sf_dir)), "mix-sizes")).drop("source")


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(documents(spark, sf_dir))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    binary.write(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END_ID, folder)
    return binary.read(spark, folder)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(topk.asks()))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compared(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.train(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(turns.unionByName(more)))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline      # at the repository's top

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_source_mix": op3_source_mix,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_token_ids": op5_token_ids,
    "op6_simhash": op6_simhash,
    "op7_top_k": op7_top_k,
    "op8_fingerprints": op8_fingerprints,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_centroids": op11_centroids,
    "op12_chat": op12_chat,
    "op13_importance": op13_importance,
    "pipeline": pipeline,
}

SQL = {
    "op3_source_mix": mixing.SQL.format(docs="documents"),
    "op7_top_k": topk.SQL.format(vectors="embeddings"),
    "op13_importance": importance.SQL.format(docs="documents", target="benchmark"),
    "op12_chat": chat.SQL.format(conversations="conversations"),
    "op11_centroids": clustering.sql("embeddings"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
