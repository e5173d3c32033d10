"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes all that the one before it kept. Stages 1 to 4 return the
columns of documents; the last returns a row per piece of a packed sequence with
its token ids. SQL can't express trained rules, suffix arrays or a tokenizer, so
the stages are tested against brute-force versions (tests/llm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, jaccard, packing, quality, repeats
from corvane.llm.common import small_batches, stored, table
from corvane.llm.queries import TOKENIZER


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of 200 bytes or more; the first copy stays."""
    small_batches(spark)
    return repeats.drop_repeats(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents made mostly of them go."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of bounded length."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), reuse=False)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", cut_benchmark_passages),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stored in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
