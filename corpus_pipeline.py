"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, BPE encoding, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet in the
shared folder and gives it to the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import op3_bpe_chunks, op4_quality, op5_mix, op6_minhash, op9_pii
from tracemill.llm.common import bound_batches, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The line labels are learnt from ``labels``.

    Null and empty texts have no words and go; repeated rows are judged alike and stay or go together; an empty table stays
    empty. All columns are kept, those of ``documents`` and others, whatever their names.
    """
    bound_batches(spark)
    return op4_quality.good_documents(docs, op4_quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest doc_id stays.

    Rows without words and rows linked with nothing stay; of repeated rows one stays; a row without doc_id stays only where
    its group has no other. An empty table stays empty; all columns are kept.
    """
    bound_batches(spark)
    return op6_minhash.first_of_each_group(docs, width=5)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; no document goes.

    Null and empty texts stay as they are, repeated rows are redacted alike, an empty table stays empty; all columns are kept,
    and n_chars follows the text.
    """
    bound_batches(spark)
    return op9_pii.redacted_documents(docs, op9_pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words are taken from the sources to their target weights; a document that is taken twice gives two rows.

    A null source is a source of its own; null and empty texts hold no words and are not taken; repeated rows are documents of
    their own; an empty table stays empty. All columns are kept.
    """
    return op5_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the mixed texts, with the digests of the ids and of what they decode to.

    Every row gives a row, repeated doc_ids and null ones too; null texts are empty; other columns are left out; an empty
    table gives an empty result.
    """
    import public_tokenizers

    bound_batches(spark)
    return op3_bpe_chunks.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", keep_good), ("near-duplicates", keep_one_of_each_group), ("personal data", hide_personal_data), ("mixing", mix_sources), ("encoding", encode)]

#: SQL cannot express the models, hash functions and tokenizer of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
