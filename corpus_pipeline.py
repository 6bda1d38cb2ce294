"""A corpus pipeline: reject toxic texts, keep one of each group of near duplicates, drop benchmark leaks, mask secrets, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents. Rows that a stage keeps stay as they are, but that masking secrets changes text and n_chars. Null texts pass every
filter. Rows without a doc_id are rows like others; where rows share a doc_id and their texts differ, each is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm import decontamination, jaccard_join, packing, secret_scan, toxicity
from leadmill.llm._shared import staged
from leadmill.llm.queries import table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT_FROM = 0.7
#: No SQL expresses the models and packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that score 0.7 or more."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.flagged(docs, model, "toxic_score").where(F.col("toxic_score") < REJECT_FROM).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of 5-word shingle sets with a similarity of 0.8 or more: that with the smallest doc_id, then the smallest text hash."""
    return jaccard_join.without_similar(docs.select(*COLUMNS), size=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that hold a passage of the benchmark."""
    return decontamination.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With a mark in place of each secret."""
    docs = docs.select(*COLUMNS)
    found = secret_scan.scan(docs, secret_scan.train(docs))
    hit = F.size("spans") > 0
    text = secret_scan.redacted(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(hit, F.char_length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their sequences and places."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), ranks_path=tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a staged table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
