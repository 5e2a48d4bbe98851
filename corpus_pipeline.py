"""A training corpus from the documents table: four stages, each written and read again.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last returns the sequences of token ids with the documents' places in them.

Defined cases: a null or empty text passes the first three stages and is in no sequence. A document
with a null id passes them as well, and its id in ``doc_ids`` is null. Rows equal in id and text become one at line
dedup, further rows of an id at the n-gram join. An empty table gives an empty result. Other columns are
carried along to the last stage, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import bpe, line_dedup, ngram_join, packing, toxicity
from tallyframe.llm.common import new_path, small_batches, table
from tallyframe.llm.queries import vocabulary_path


def texts_in_small_batches(spark: SparkSession) -> None:
    """A stage's result is made when it is written, after the stage's function, so this setting stays
    with the session; ``run`` puts it back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled rows, doesn't reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    texts_in_small_batches(spark)
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line only where it occurs first; documents of repeats alone go."""
    texts_in_small_batches(spark)
    return line_dedup.line_dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that matches at 0.6 on word trigrams."""
    return ngram_join.one_of_each_group(docs, threshold=0.6, n=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 token ids: their tokens, and the documents in them with their boundaries."""
    ids = bpe.encode(docs.select("doc_id", "text"), bpe.Vocabulary(spark, vocabulary_path()))
    return packing.pack_sequences(ids, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]

#: Compression lengths, signature trees and packing have no SQL form; the tests hold run() against
#: brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for k, (_, stage) in enumerate(STAGES):
            path = new_path(spark, f"pipeline-{k}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
