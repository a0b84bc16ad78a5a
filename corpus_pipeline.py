"""A training-data pipeline over `documents`: toxic documents go, one of each near-copy group stays, documents with benchmark
passages go, and the rest is packed into sequences of tokens. Every stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm import decontam, minhash, residual_pack, toxicity
from folioflux.llm.queries import TOXIC_FROM, tokenizer_path, toxicity_model
from folioflux.llm.shared import keep


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches TOXIC_FROM, by a model of the labelled ones among them."""
    names = [c for c in docs.columns]
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.where(F.col("toxicity_score") < TOXIC_FROM).select(*[F.col(f"`{c}`") for c in names])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of sets of five-word shingles with a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("contamination.n_hit = 0").drop("contamination")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its place in a sequence of at most 1024 tokens."""
    packed = residual_pack.pack_documents(docs.select("doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", remove_toxic), ("near_dedup", remove_near_duplicates), ("decontamination", remove_contaminated), ("packing", pack)]

#: The score of compressed windows and the packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
