"""A training-data pipeline over documents: toxicity, language, near copies, secrets, packing.

In every stage repeated rows are treated alike, empty tables give empty tables, texts are
read whole, and columns beyond those of documents are carried along, whatever their
names; the stages' own lines say what null and empty texts and null ids come to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorequery.llm import langid, packing, secret_scan, simhash, toxicity
from lorequery.llm.common import durable, held_out, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; learns from the labelled ones outside the held-out fold. Null and empty texts stay."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.keep_clean(docs, machine)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known; learns from their lang outside the held-out fold. Null texts and those without letters go."""
    return langid.keep_identified(docs, langid.fit(docs, ~held_out()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; groups without any id stay whole."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars brought up to date; null and empty texts stay as they are."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; null and empty texts are one token, null ids are carried along."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]
#: Models and a tokenizer take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
