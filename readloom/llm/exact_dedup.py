"""Exact deduplication by content sort, with DataFrame operations only.

Sampled splitters range-partition the rows by their normalised text, an external sort puts equal texts side by
side, and a window that compares whole neighbouring texts marks groups. Splitters are drawn on the first
64 characters and a 64-bit hash, so what the driver sees of a sample is short; equality always compares the
whole texts. Texts that occur very often are spread over ``n_salts`` ranges by a hash of their id, and the few
partial results of those are added up (by SHA-256 and length) and joined back.

Rules: null text counts as empty; texts are equal when identical after lower-casing A-Z; the largest id stays;
ids of null come last; of repeated rows with equal id and text one stays. All input columns are carried along;
result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import ascii_lower, partitions


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_hot: int = 4096, min_hot: int = 200, n_salts: int = 64, nested: bool = False) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; if nested, all columns of docs lie in one, ``row``.

    A text is hot from ``max(min_hot, rows / max_hot)`` copies on, so at most ``max_hot`` hashes are broadcast.
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    total = docs.count()
    least = max(min_hot, -(-total // max_hot))
    hashes = docs.select(F.xxhash64(norm).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = hashes.filter(F.col("n") >= least).select("h", F.lit(True).alias("is_hot"))

    packed = docs.select(F.struct("*").alias("row"), norm.alias("norm")).select("row", F.substring("norm", 1, 64).alias("head"), F.xxhash64("norm").alias("h"))
    packed = packed.join(F.broadcast(hot), "h", "left")
    key = F.col(f"row.`{id_col}`")
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n_salts)) + 1).otherwise(F.lit(0))
    packed = packed.select("row", "head", "h", salt.cast("int").alias("salt"))
    dealt = packed.repartitionByRange(partitions(spark), "head", "h", "salt")
    sorted_ = dealt.withColumn("norm", ascii_lower(F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))))
    group = Window.partitionBy("head", "h", "salt", "norm")
    marked = sorted_.select(
        "row", "salt",
        F.row_number().over(group.orderBy(key.desc_nulls_last())).alias("rn"),
        F.max(key).over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("norm").alias("n_bytes"),
    )
    # Pieces of hot texts: few rows, as there are at most max_hot texts of n_salts pieces each.
    pieces = marked.filter((F.col("salt") > 0) & (F.col("rn") == 1))
    whole = pieces.groupBy("text_sha256", "n_bytes").agg(
        F.max("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"),
        F.max(F.struct(F.col("keep_id"), F.col("salt"))).getField("salt").alias("keep_salt"),
    ).withColumn("is_hot", F.lit(1))
    joined = marked.withColumn("is_hot", F.when(F.col("salt") > 0, F.lit(1)))
    joined = joined.join(F.broadcast(whole), ["text_sha256", "n_bytes", "is_hot"], "left")
    kept = (F.col("rn") == 1) & (F.col("keep_salt").isNull() | (F.col("salt") == F.col("keep_salt")))
    results = {"keep_id": F.coalesce("all_keep", "keep_id"), "group_size": F.coalesce("all_size", "group_size"), "kept": kept, "text_sha256": F.col("text_sha256")}
    if nested:
        return joined.select("row", *[v.alias(k) for k, v in results.items()])
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in results], *[v.alias(k) for k, v in results.items()])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op10_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    WINDOW w AS (PARTITION BY t)
    """
}
