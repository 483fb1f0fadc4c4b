"""A corpus's way from raw documents to token ids, in stages that each apply one operator of wordsonar.llm.

Every stage takes the documents that the one before it kept, whole, and all but the last return the columns of
documents. Null and empty texts: language ID drops them, as it can name no language; texts that a later stage empties
stay, with no words. Near-dedup judges each text for itself, also under equal ids, and keeps one of equal rows; an empty
table passes through; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordsonar.llm import bpe, langid, near, rlz, wumanber
from wordsonar.llm.common import Table, held
from wordsonar.sources.records import spread

VOCABULARY = "byte_bpe_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be named, by profiles of the labelled ones among them; others go."""
    rows = docs.select(held([c for c in docs.columns if c != "text"]).alias("_held"), "text")
    found = langid.predict(rows, langid.learn(docs))
    kept = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_held.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't near copies (0.8 or more of their five-word shingles) of others, by SimHash in tiles and exact sets."""
    return near.without_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that occur elsewhere; n_chars follows the text."""
    cut = rlz.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window (13 words) of the benchmark's items, and with no more than a little of its shorter items."""
    return wumanber.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their count and digest, and the digest of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The rows need hashes of word runs, links over bits and merges over ranks that SQL cannot express within bounds;
#: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each one's result written to the shared folder and read by the next; it goes
    when the next one's has been written."""
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES[:-1]:
        made = Table(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
