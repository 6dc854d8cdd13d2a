"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import exact, langid, minhash, mixing, packing
from strandline.llm.common import scratch, whole_row
from strandline.llm.queries import MIX_SWEEPS, MIX_TARGETS
from strandline.session import shipped


@shipped
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, which fills a null ``lang``; texts without a letter go."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    told = langid.predict(docs.select(whole_row(docs), "text"), model, keep=("row",))
    labelled = F.col("row").withField("lang", F.coalesce(F.col("row.lang"), F.col("lang_pred")))
    return told.where(F.col("lang_pred") != langid.UNKNOWN).select(labelled.alias("row")).select("row.*")


@shipped
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the smallest id."""
    return exact.survivors(docs)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id."""
    return minhash.representatives(docs)


@shipped
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of sources, languages and topics."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.content_topic(F.col("text"))}
    return mixing.sample(docs, dims, MIX_TARGETS, sweeps=MIX_SWEEPS)


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, with their place in the training sequences."""
    return packing.harmonic_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Verification of near duplicates, tokenising and packing have no SQL form; the
#: stages are tested against brute force instead.
ORACLE_SQL: str | None = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
