"""Corpus pipeline: toxicity, near-duplicates, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents; the last returns the packed pieces. A stage's result is written as Parquet and read again.

1. toxicity: documents that the network scores 0.7 or more go.
2. near_dedup: documents are linked by fingerprints within 2 bits and by five-word shingles of a similarity of 0.8 or more; of
   each component the document with the smallest doc_id stays; one without an id only where no document of its component
   has one. Of repeated rows one stays.
3. substring_dedup: words of windows of 13 that also start in a document with a smaller doc_id are removed; a document that
   loses all its words goes. n_chars follows the text.
4. mixing: documents are drawn towards tempered shares of source, language and topic.
5. packing: best-fit sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, nearcopies, packing, queries, shared, simhash, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity(docs, shared.table(spark, sf_dir, "labels"), carry=True)
    return scores.where(F.col("score") < toxicity.REJECT).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By fingerprints alone; they miss most near copies of short and middling texts."""
    return simhash.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.without_repeats(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*(F.col("kept").alias("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"row.{shared.quoted(c)}") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, queries.default_tokenizer(), 2048)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_copies), ("substring_dedup", substring_dedup), ("mixing", mix), ("packing", pack)]

#: A trained network decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
