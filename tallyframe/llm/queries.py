"""The registered queries of the subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import bpe, chat_format, embedding_dedup, line_dedup, ngram_join, packing, topk_search, toxicity, url_filter, warc
from tallyframe.llm.common import for_every_id, table


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary is: ``TALLYFRAME_TOKENIZERS``, else /opt/tokenizers, else the
    installed package of vocabularies."""
    at = os.environ.get("TALLYFRAME_TOKENIZERS", "/opt/tokenizers")
    if not os.path.exists(f"{at}/{name}") and (spec := importlib.util.find_spec("public_tokenizers")):
        at = os.path.dirname(spec.origin)
    return f"{at}/{name}"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's group at cosine 0.95, its nearest partner, their cosine and its number of links."""
    vectors = table(spark, sf_dir, "embeddings")
    return for_every_id(embedding_dedup.embedding_near_dedup(vectors, threshold=0.95), vectors.select("vec_id"))


def op2_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return topk_search.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back as a chunk table."""
    return warc.pages_through_warc(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deciding rule of every page's URL."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op8_chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of every turn of every conversation in ChatML."""
    return chat_format.chat_spans(table(spark, sf_dir, "conversations"), chat_format.chatml)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 2,048 words."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group at 0.6 on word trigrams, its best partner, coefficient and number of links."""
    docs = table(spark, sf_dir, "documents")
    return for_every_id(ngram_join.ngram_jaccard_join(docs, threshold=0.6, n=3), docs.select("doc_id"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's windows, toxic windows, their share and the decision."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_score(docs, model).select("doc_id", "toxicity.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_exact_topk_search,
        op3_warc_chunks,
        op4_best_fit_packing,
        op5_byte_bpe,
        op6_ngram_jaccard_join,
        op7_url_filter,
        op8_chat_spans,
        op9_line_dedup,
        op10_toxicity,
    )
}

ORACLES: dict[str, str] = {
    "op2_exact_topk_search": topk_search.ORACLE,
    "op3_warc_chunks": warc.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_chat_spans": chat_format.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
