"""The operators over the whole driver tables, with the digests their contracts ask for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import decontaminate, language_id, recompression, suffix_dedup, toxicity
from meterlake.llm.bpe import encode_documents
from meterlake.llm.embedding_dedup import near_duplicates
from meterlake.llm.jaccard_join import similar_components
from meterlake.llm.lexical_search import rank_documents
from meterlake.llm.line_dedup import remove_lines
from meterlake.llm.phrase_mining import mine_phrases
from meterlake.llm.url_filter import Rule, filter_urls
from meterlake.llm.vector_search import top_products

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of the URL contract (fixed values).
URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.matches(docs, items)
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start_word", "similarity"
    )


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def _language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    network = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, network)
    return found.withColumn("held_out", language_id.held_out(F.col("doc_id")))


def _jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(_table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def _suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def _substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.remove_repeats(_table(spark, sf_dir, "documents"), window=20)
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = remove_lines(docs)
    return kept.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def _phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"), threshold=100, top=2000)


def _lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def _vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"), k=5, every=50)


QUERIES: dict[str, Query] = {
    "op1_embedding_near_dedup": _embedding_dedup,
    "op2_benchmark_decontamination": _decontamination,
    "op3_toxicity": _toxicity,
    "op4_byte_bpe": _bpe,
    "op5_url_filters": _url_filters,
    "op6_ngram_jaccard_join": _jaccard_join,
    "op7_language_id": _language_id,
    "op8_suffix_array_dedup": _suffix_dedup,
    "op9_line_dedup": _line_dedup,
    "op10_substring_dedup": _substring_dedup,
    "op11_phrase_mining": _phrase_mining,
    "op12_lexical_search": _lexical_search,
    "op13_vector_search": _vector_search,
}
