"""The corpus pipeline: stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.llm import decontam, mixing, neardup, pii, quality
from cueforge.llm.common import id_hash_in, materialize, unused


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the label is learned from two ids in three.

    A score of one half stays. Null and empty texts are scored as such; null ids are never learned from; repeated
    rows get the same score; without labels of both kinds, and on an empty table, all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_hash_in(3, lambda r: r != 1))
    name = unused("quality_score", docs.columns)
    return quality.score(docs, quality.fit(docs, labels), name).where(F.col(name) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles have a Jaccard similarity of 0.8 the smallest doc_id stays.

    SimHash values within two bits, found by pigeonring, link first, and whole sets confirm; pairs of 0.8 that are further apart follow by their
    rarest shingles. Texts without words are equal to each other. Rows with a null doc_id stay; rows that repeat a doc_id stay or go
    together; an empty table stays empty.
    """
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, one of a few tokens too.

    Null and empty texts and null ids hold none; rows that repeat a doc_id go together; an empty table, or an empty
    benchmark, changes nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=0)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts; n_chars, if there, follows.

    All rows stay; null and empty texts stay as they are; repeated rows are changed alike; of overlapping spans the
    first and longest names the replacement.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mix, with topic, tokens, weight and probability.

    Null margins are 'unknown'; documents without words have their cell's probability; rows that repeat a doc_id are
    drawn together; an empty table stays empty. An added column whose name is taken gets the prefix ``mix_``.
    """
    added = [F.col(c).alias(c if c == unused(c, docs.columns) else unused(f"mix_{c}", docs.columns)) for c in ("topic", "tokens", "weight", "probability")]
    return mixing.weighted(docs).where("sampled").select("row.*", *added)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("source_mixing", source_mixing),
]

#: No SQL: the stages hold trained models and hashes that DuckDB lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
