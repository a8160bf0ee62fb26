"""A corpus pipeline of five of the llm operators, each stage over all that the one before it kept.

Rejected documents go (1), one document of each near-duplicate group stays (2), contaminated documents go (3),
secrets are masked in the texts (4), and what is left is encoded (5). All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import decontamination, quality_rules, queries, secret_scan, sentencepiece_codec, simhash
from loomtext.llm.common import read_table
from loomtext.session import durable, shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the line field is trained on the labelled ones of ``docs``."""
    sample = quality_rules.training_sample(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, quality_rules.fit_field(sample))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark item go."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is masked in its text, by a new ledger of what was scanned; n_chars follows the text."""
    ledger = shared_path(spark, "pipeline-ledger")
    return secret_scan.redact(docs, ledger_path=ledger).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ends_sha256) of every text that is left."""
    return sentencepiece_codec.encode_documents(
        docs,
        queries.tokenizer_path("piece_bpe_32k.model"),
        schema="n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string",
        project=sentencepiece_codec.digests,
    )


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the checkpoint folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs


#: The trained line field and the tokenizer are beyond SQL; tests hold each stage against plain loops.
ORACLE_SQL = None
