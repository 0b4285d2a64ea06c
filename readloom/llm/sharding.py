"""Sharding by rendezvous hashing of record keys over weighted shards, with DataFrame operations only.

Shard i of weight w draws for key k the uniform number u from a hash of seed, i and k, and scores -w / ln(u); the
highest score wins. A shard's share is that of its weight, and a record's shard depends on its key and the weights
alone. One more shard draws for itself only: a record moves to it or stays. Taking a shard away moves only its own
records. No count of the data enters, so any part of a table can be dealt out by itself.

Slots number the records of a shard without gaps, in order of their keys: sampled splitters cut the key order into
ranges, counts per range and shard are added up, and row numbers are taken inside each range and shard. So no task
holds a shard, and a key that a third of all rows share is spread over ranges, as every row has a number of its own
behind the key.

Rules: a null key counts as the empty text and comes last in a shard; rows with equal keys share a shard, in order of
the text's crc32 and size. A null text has no bytes (size 1). Shards of weight 0 get nothing; equal scores go to the
lower number. All columns asked for are carried along; result columns replace input columns of the same name. An
empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import spread
from readloom.operators.ordered import ranges

HEX = 13
SHARDS, SEED = 16, 29


def _score(key: Column, shard: int, weight: float, seed: int) -> Column:
    """A struct of the score and the negative number of the shard: the largest wins."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(shard), key).cast("binary")), 1, HEX), 16, 10).cast("double")
    score = F.lit(-float(weight)) / F.log((bits + 0.5) / F.lit(float(16**HEX)))
    return F.struct(score.alias("score"), F.lit(-shard).alias("minus"))


def rendezvous(key: Column, weights: list[float], seed: int = SEED) -> Column:
    """A struct of the winning shard's score and its negative number; null if no weight is above 0."""
    if any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights are finite and not below 0")
    scores = [_score(key, i, w, seed) for i, w in enumerate(weights) if w > 0]
    return F.array_max(F.array(*scores)) if scores else F.lit(None).cast("struct<score: double, minus: int>")


def assign_shards(docs: DataFrame, weights: list[float] | None = None, new_weight: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns to carry (all, if not given) with size, text_crc32, law, shard, and grown_shard: the shard if one of new_weight were added."""
    weights = [1.0] * SHARDS if weights is None else weights
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    carry = docs.columns if carry is None else carry
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).alias("none"))
    rows = docs.select(row.alias("row"), key.alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("best", rendezvous(F.col("key"), weights, seed))
    new = _score(F.col("key"), len(weights), new_weight, seed)
    grown = F.when(F.coalesce(new["score"] > F.col("best.score"), F.lit(True)), F.lit(len(weights))) if new_weight > 0 else F.when(F.lit(False), F.lit(0))
    shard = (-F.col("best.minus")).cast("int")
    results = {"size": F.col("size"), "text_crc32": F.col("text_crc32"), "law": F.lit("key"), "shard": shard, "grown_shard": grown.otherwise(shard).cast("int")}
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in carry if c not in results], *[v.alias(k) for k, v in results.items()])


def number_slots(sharded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sharded (shard, text_crc32, size, ...) with slot, the number of each row in its shard in order of the ids."""
    order = ["_last", "_key", "text_crc32", "size", "_at"]
    key = F.coalesce(F.col(id_col), F.lit("0").cast(sharded.schema[id_col].dataType))
    rows = sharded.filter("shard IS NOT NULL").withColumns({"_last": F.col(id_col).isNull().cast("int"), "_key": key, "_at": F.monotonically_increasing_id()})
    rows = ranges(rows, *order)  # written once, so numbers stay with their rows
    counts = rows.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("range", "shard", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("range", "shard").orderBy(*order)
    numbered = rows.withColumn("_slot", F.row_number().over(inside) - 1).join(before, ["range", "shard"])
    return numbered.withColumn("slot", (F.col("_before") + F.col("_slot")).cast("long")).select(*[c for c in sharded.columns if c != "slot"], "slot")


def write_shards(numbered: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A folder for each shard, in it files of consecutive slots in order: no file is larger, whatever a shard's size."""
    part = F.floor(F.col("slot") / rows_per_file)
    numbered.repartition("shard", part).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op12_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    return number_slots(assign_shards(docs, carry=["doc_id"])).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: crc32 in SQL goes by half bytes, the low half first; the table of 16 remainders comes from the polynomial.
SQL = {
    "op12_shard": f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS key, row_number() OVER () AS row_no FROM documents),
    scores AS (SELECT row_no, i, -1.0::DOUBLE / ln((('0x' || substr(md5('{SEED}:' || i || ':' || key), 1, {HEX}))::BIGINT + 0.5::DOUBLE) / {16**HEX}.0::DOUBLE) AS score FROM t, range({SHARDS + 1}) r(i)),
    best AS (SELECT row_no, arg_max(i, score) FILTER (i < {SHARDS}) AS shard, arg_max(i, score) AS grown FROM scores GROUP BY row_no),
    crc16 AS (SELECT k, list_reduce([1, 2, 3, 4], lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k::BIGINT) AS t FROM range(16) r(k)),
    halves AS (SELECT row_no, string_split(hex(encode(text)), '') AS h FROM t),
    crcs AS (SELECT row_no, xor(list_reduce(list_transform(range(CASE WHEN h = [''] THEN 0 ELSE len(h) END), lambda i: ('0x' || h[xor(i, 1) + 1])::BIGINT), lambda c, b: xor(c >> 4, tbl[(xor(c, b) & 15) + 1]), 4294967295), 4294967295) AS crc FROM halves, (SELECT list(t ORDER BY k) AS tbl FROM crc16)),
    rows AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, crc AS text_crc32, shard, grown FROM t JOIN best USING (row_no) JOIN crcs USING (row_no))
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot, grown::INTEGER AS grown_shard FROM rows
    """
}
