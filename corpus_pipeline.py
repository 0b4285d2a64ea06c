"""A training corpus from raw documents: five stages, each one operator of readloom.llm over all that the last one kept.

Every stage but the last returns the columns of documents; the last returns the packing of what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import materialise
from readloom.llm.exact_dedup import exact_dedup
from readloom.llm.jaccard import jaccard_components
from readloom.llm.language import UNKNOWN, fit, predictor
from readloom.llm.mixing import mix_sources
from readloom.llm.packing import pack


#: Share of a text's n-grams that some learned language must have. The least of 256,410 documents in learned languages
#: was 0.48 (a short text around a key); texts in other scripts or of random letters have under 0.2.
LEAST_HIT_SHARE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with few n-grams of any language that the corpus has labels for, go.

    Null and empty texts go, as they have no letter. Each row is judged by its text alone, so equal rows share their
    fate. Without any labelled text, all rows go; an empty table stays empty.
    """
    predict = predictor(spark, fit(docs))
    judged = docs.select(F.struct("*").alias("row"), predict("text").alias("p"))
    return judged.filter((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.hit_share") >= LEAST_HIT_SHARE)).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the one with the largest id stays.

    Null counts as the empty text; null ids come last; of rows with equal id and text one stays.
    """
    return exact_dedup(docs, nested=True).filter("kept").select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays.

    Rows are told apart by id and text, so of rows with one id only those go whose own text is near another's. Null
    ids come last; of equal ids the smaller hash of the text stays; of rows with equal id and text one stays. Texts
    without words are linked with nothing and stay.
    """
    found = jaccard_components(docs.select("doc_id", "text"), width=5, threshold=Fraction(8, 10))
    found = found.filter("component IS NOT NULL").select("component", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").alias("key"))
    best = found.groupBy("component").agg(F.min("key").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(found.join(best, "component").select("key", (F.col("key") == F.col("best")).alias("stays")), "near")
    same = lambda x: F.col("d.doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.xxhash64("d.text") == F.col(f"{x}.text_hash"))
    gone = members.filter("NOT stays").select("key.doc_id", "key.text_hash").distinct()
    kept = docs.alias("d").join(gone.alias("g"), same("g"), "left_anti")
    twice = members.filter("stays").groupBy("key").count().filter("count > 1").select("key.doc_id", "key.text_hash")
    if twice.isEmpty():
        return kept.select("d.*")
    once = kept.join(twice.alias("t"), same("t"), "left_semi").select("d.*").dropDuplicates(["doc_id", "text"])
    return kept.join(twice.alias("t"), same("t"), "left_anti").select("d.*").unionByName(once)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to shares proportional to the square root of their sizes.

    A null source is a source; rows with equal id draw alike, null ids like an empty one.
    """
    return mix_sources(docs, nested=True).select("row.*")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words without two documents of one source or two equal texts; see readloom.llm.packing for the rules."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("pack", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hash functions, fitted filters and best-fit search have no SQL form; tests compare the run with brute force.
ORACLE_SQL = None
