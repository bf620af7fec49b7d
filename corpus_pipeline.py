"""Corpus cleaning in five stages: quality, near copies, benchmark leaks, secrets, token ids.

Each stage works on all that the one before it kept. Near copies are sought on
five-word shingles: by SimHash, and by a Jaccard similarity of 0.8 or more; of each
group the document with the smallest doc_id stays.
Documents with a benchmark leak go. Secrets are replaced in the text, and n_chars
follows. The last stage gives token ids, and digests of them and of what they
decode to.

Defined results: a null text is scored, fingerprinted and encoded as an empty one;
rows without doc_id go only by their own text; repeated rows are decided alike; an
empty table gives an empty result. Columns besides those of documents pass through
all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, quality, secrets, simhash
from riskloom.llm.common import stash, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, width=5)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, decoded=True).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_copies", without_copies),
    ("benchmark_leaks", without_leaks),
    ("secrets", without_secrets),
    ("token_ids", token_ids),
]

#: SQL cannot train the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs)
    return docs
