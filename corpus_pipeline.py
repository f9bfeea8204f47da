"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import byte_bpe, decontamination, exact_dedup, jaccard_join, toxicity
from quantloom.llm.shared import materialize, read

#: Near copies here: shingles of five words and a Jaccard similarity of 0.8; op5's own query has its own contract.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts are scored too, and without labels all stay."""
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the row with the largest doc_id stays; null and empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (80 % of the runs of five words alike) the document with the smallest doc_id stays.
    Texts without words stay; so do all rows of a doc_id of which one is kept."""
    return jaccard_join.drop_near_copies(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; texts without words stay, and with an empty benchmark all."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), mode="drop")


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and digests, with doc_id, lang and source. Null texts give no ids; every row stays."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", jaccard_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", byte_bpe_stage),
]

#: Toxicity scores are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
