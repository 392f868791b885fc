"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents that hold benchmark
items go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import byte_bpe, decontam, neardup, toxicity
from sedimenta.session import discard, release, scratch, scratch_mark, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict toxic. It's fitted on the whole documents table's labels."""
    ship(spark)
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels")}
    model = toxicity.fit(tables["documents"], tables["labels"])
    return toxicity.reject(docs, model)


#: Share of common five-word shingles, in percent, from which documents are near-duplicates here.
SIMILAR = 80


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group.

    A row goes if its own id and text aren't kept, so a text of its own stays though it shares an id with a copy that goes;
    rows that repeat both stay or go together. Null ids stay.
    """
    ship(spark)
    return neardup.keep_one(docs, percent=SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every document that is left."""
    ship(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The classifier and the retrieval can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents, each written and read again; what a stage read and left behind goes after it."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        mark = scratch_mark(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        release(spark, mark)
        if before:
            discard(spark, before)
        before = f"{folder}/{k}-{name}"
    return docs
