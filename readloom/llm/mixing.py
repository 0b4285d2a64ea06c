"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

Source s with n_s rows and target share w_s of ``size`` rows gets the mean repetition rate r_s = w_s * size / n_s.
Each row draws a uniform number from a hash of seed and id, inverts the Poisson distribution of mean r_s with it,
and is exploded by that count; a sort by a hash of seed, id and replica shuffles all copies globally.

Rules: a null source is a source of its own; without target weights shares are proportional to n_s ** alpha;
sources that are not in given weights get weight 0; a rate of 0 yields no copy. Rows with equal id draw alike.
Means over 500 are split into equal Poisson parts below the underflow limit. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import materialise, partitions

#: Up to so many sources, a table of one row each is broadcast; beyond, only those of at least 1 / so many of all rows.
MAX_BROADCAST_SOURCES = 10_000
HEX = 13


def _uniform(*parts) -> F.Column:
    """52 bits of an md5, in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, HEX), 16, 10).cast("double") / F.lit(float(16**HEX))


def _cdf(rate: F.Column) -> F.Column:
    """Poisson probabilities of at most k, for k from 0 until what is left is under 1e-17."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))
    return F.aggregate(steps, start, step, lambda acc: acc["c"])


def source_rates(docs: DataFrame, source_col: str, weights: dict | None, size: float | None, alpha: float) -> DataFrame:
    """source, n_rows, rate, parts, cdf: one row per source."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n_rows").cast("double"), F.lit(float(alpha))))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        known = F.create_map(*pairs)[F.coalesce("source", F.lit(""))] if pairs else F.lit(0.0)
        counts = counts.withColumn("w", F.coalesce(known, F.lit(0.0)))
    totals = counts.agg(F.sum("w").alias("w"), F.sum("n_rows").alias("n")).first()
    scale = (size if size is not None else totals["n"] or 0) / totals["w"] if totals["w"] else 0.0
    rate = F.col("w") * F.lit(float(scale)) / F.col("n_rows")
    rated = counts.select("source", "n_rows", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / 500)).cast("int"))
    return rated.withColumn("cdf", _cdf(F.col("rate") / F.col("parts")))


def mix_sources(docs: DataFrame, weights: dict | None = None, size: float | None = None, alpha: float = 0.5, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", nested: bool = False) -> DataFrame:
    """Rows of docs, each as often as its draw says, in a global random order; adds replica, rate and shuffle_key.

    If nested, all columns of docs lie in one, ``row``; else result columns replace columns of the same name.
    """
    spark = docs.sparkSession
    rates = materialise(source_rates(docs, source_col, weights, size, alpha), "rates")
    n_sources, n_rows = rates.agg(F.count(F.lit(1)), F.sum("n_rows")).first()
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("s"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"))
    same = F.col("s").eqNullSafe(F.col("source"))
    columns = ["row", "key", "rate", "parts", "cdf"]
    if n_sources <= MAX_BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), same).select(columns)
    else:  # of many sources, the few hot ones are broadcast, so that no task gets all rows of one
        hot = F.col("n_rows") >= n_rows / MAX_BROADCAST_SOURCES
        rows = rows.join(F.broadcast(rates.filter(hot)), same, "left")
        cold = rows.filter("n_rows IS NULL").select("row", "s", "key").join(rates.filter(~hot), same)
        rows = rows.filter("n_rows IS NOT NULL").select(columns).union(cold.select(columns))
    draw = lambda j: F.size(F.filter("cdf", lambda c: _uniform(F.lit(seed), j, F.col("key")) >= c))
    one = F.size(F.filter("cdf", lambda c: F.col("u") >= c))
    many = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, j: acc + draw(j))
    rows = rows.withColumn("u", _uniform(F.lit(seed), F.lit(1), F.col("key")))
    rows = rows.withColumn("copies", F.when(F.col("rate") <= 0, 0).when(F.col("parts") == 1, one).otherwise(many)).filter("copies > 0")
    rows = rows.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "key", "replica").cast("binary")))
    results = ["replica", "rate", "shuffle_key"]
    shuffled = rows.select("row", *results).repartitionByRange(partitions(spark), "shuffle_key").sortWithinPartitions("shuffle_key")
    if nested:
        return shuffled
    return shuffled.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in results], *results)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "source", "replica", F.round("rate", 6).alias("rate"), "shuffle_key", "text")


SQL = {
    "op7_mix_sources": """
    WITH RECURSIVE n AS (SELECT source, count(*) AS n_rows, sqrt(count(*)) AS w FROM documents GROUP BY source),
    r AS (SELECT source, w * ((SELECT sum(n_rows) FROM n) / (SELECT sum(w) FROM n)) / n_rows AS rate FROM n),
    cdf(source, rate, k, p, c) AS (
      SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 10 * sqrt(rate) + 30)),
    u AS (SELECT doc_id, source, text, ('0x' || substr(md5('17:1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents)
    SELECT u.doc_id, u.source, (cdf.k + 1)::INTEGER AS replica, round(cdf.rate, 6) AS rate, md5('17:order:' || u.doc_id || ':' || (cdf.k + 1)) AS shuffle_key, u.text
    FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND u.u >= cdf.c
    """
}
