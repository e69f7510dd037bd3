"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import mixing, packing, pii, probminhash, quality
from sitewright.llm.queries import PII_KEY, trainable
from sitewright.llm.shared import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels that may be used, does not reject.

    Null and empty texts are scored like any other; a row without an id has no label. Rows that repeat are kept or go
    together. An empty table gives none. Columns of other names go.
    """
    network, _ = quality.learn(docs, trainable(table(spark, sf_dir, "labels")))
    return quality.score(docs, network, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Null and empty texts are one group. Of rows that repeat an id one stays; rows without an id take part by their text,
    and one with a null id stays of a group of none but such. An empty table gives none.
    """
    return probminhash.first_of_class(docs).select(*COLUMNS)


def pseudonymous_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data as pseudonyms; ``n_chars`` is counted anew.

    A null text stays null, with null ``n_chars``; other columns are as they were. Equal values have equal pseudonyms in all
    rows, so rows that repeat stay equal. An empty table gives none.
    """
    made = pii.pseudonymise(docs, PII_KEY)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, with ``position``, in training order.

    A null source is a source; null and empty texts have no words and are never taken. Ties of position are in the order of ids. Rows that repeat are taken each. An empty table gives none. All columns of documents come along.
    """
    return mixing.curriculum(docs, keep=COLUMNS, schedules=mixing.SCHEDULES)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 1024 tokens, numbered in training order.

    A null or empty text is its end token alone. Rows that repeat, as copies of the mix do, are packed each. Sequences are
    numbered by the least position in them. An empty table gives none; of other columns only ``position`` plays a part.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), max_tokens=1024, order_col="position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("pii", pseudonymous_documents),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]

#: A trained classifier, sketches and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
