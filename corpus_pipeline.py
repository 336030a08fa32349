"""A corpus pipeline: each stage works on what the one before it has kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of
documents, whatever they are named and in their order; n_chars, where there is
one, follows the text. A null text counts as empty, and an empty table gives an
empty one. Rows of one id are one document to line dedup, and rows of their own
to all other stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe_lexicon, decontaminate, line_dedup, quality_rules, simhash
from termloom.llm.common import table, written

TOKENIZER = "byte_bpe_50k.json"


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and n_chars, if there is such a column, to match."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return docs.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; repeated rows stay or go together."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents stay in the one of the smallest id only; documents without any text left go, so of equal texts one stays, with all rows of its id; a null id comes last."""
    out = line_dedup.line_dedup(docs, keep=[c for c in docs.columns if c != "text"]).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns)), F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; null ids come last, and of repeated rows one stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that stand in benchmark windows; those without any word left go. Each row is judged alone; an empty benchmark leaves all."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _with_text(out, F.col("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, one row for each of docs; a null text has no tokens."""
    return bpe_lexicon.encode(docs, public_tokenizers.path(TOKENIZER), digests=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("decontamination", benchmark), ("encoding", encode)]

#: Two stages have no SQL: near-duplicates and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
