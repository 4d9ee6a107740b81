"""Cleaning and packing a corpus: language, toxicity, near-duplicates, secrets, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, neardup, packing, secret_scan, toxicity
from quarry.llm._util import checkpoint, table
from quarry.llm.queries import tokenizer

#: A text whose best language knows less of its n-grams than this isn't in a known language.
LEAST_COVERAGE = 0.25


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null texts and texts without letters go; null and repeated ids stay; an empty table gives no rows."""
    return langid.select(docs, langid.fit(docs), LEAST_COVERAGE)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic; null and repeated ids stay, each row by its text; an empty table gives no rows."""
    return toxicity.select(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), steep=toxicity.STEEP))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, null ids last, then by the row's hashes.

    Links join texts whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more; texts without words, null ones too, are one group.
    """
    # Rows are told apart by all they hold, so null and repeated ids lose none; rows alike in everything are one.
    rest = [F.col(c) for c in docs.columns if c != "text"]
    row = F.concat_ws(":", F.xxhash64("text"), F.xxhash64(F.col("text").isNull(), *[x for c in rest for x in (c.isNull(), c)]), F.col("doc_id").cast("string"))
    key = "__row"
    while key in docs.columns:
        key += "_"
    marked = docs.withColumn(key, row)
    found = neardup.near_copies(marked, ["doc_id", key], shingle=5, similarity=0.8)
    stays = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first")).select(f"first.{key}")
    return marked.join(stays, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def secretless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars that of the masked text; a null text stays null."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null or empty text is the separator alone."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), window=2048, separator=1)


STAGES = [("language", languages), ("toxicity", civil), ("near_dedup", unique), ("secrets", secretless), ("packing", packed)]

#: The models and the tokenizer can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep of `documents`.

    Null and repeated ids, null, empty and repeated texts, and other columns,
    whatever their names, go through as each stage tells; an empty table gives
    no rows.  A stage's rows are written before the next stage reads them, so
    none is made twice.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
