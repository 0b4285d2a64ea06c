"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Texts over the capacity are cut into pieces. Pieces are dealt by a hash of their content and of their row's number into
shards of about ``shard_items`` pieces, so a shard's size depends neither on the input nor on long texts, a hot source
or repeated rows. Inside a shard, pieces go longest first into the
bin with the smallest sufficient residual; each bin carries a bitmap of its sources and one of its duplicate
clusters, and the search moves on to the next larger residual until a bin shares neither with the piece.
Only ids, lengths and two hashes travel; no text does.

Rules: a null text is empty; an empty text is a piece of length 0 and takes a place like any other; a null source
is a source; without a cluster column, texts that are equal after lower-casing A-Z form a cluster, so repeated
rows never share a bin. Nulls in the id are kept. Other columns are ignored. The row's number depends on how the table
is split into tasks; equal input files and settings give equal bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import WORD, ascii_lower, materialise, spread

RESULT = "doc_id long, piece int, n_tokens long, shard long, bin int, bin_offset long"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces come in the order in which they are placed."""
    bits: dict = {}
    residuals: list[tuple[int, int]] = []  # by residual, then bin
    masks: list[list[int]] = []
    out = []
    for n, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = 1 << bits.setdefault(("s", source), len(bits)), 1 << bits.setdefault(("c", cluster), len(bits))
        for at in range(bisect_left(residuals, (n, -1)), len(residuals)):
            room, b = residuals[at]
            held = masks[b]
            if not (held[0] & s or held[1] & c):
                del residuals[at]
                break
        else:
            room, b = capacity, len(masks)
            masks.append([0, 0])
        masks[b][0] |= s
        masks[b][1] |= c
        out.append((b, capacity - room))
        insort(residuals, (room - n, b))
    return out


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, shard_items: int = 4096) -> DataFrame:
    """doc_id, piece, n_tokens (of the piece), shard, bin (within the shard), bin_offset."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.xxhash64(ascii_lower(text)).cast("string")
    n_words = F.regexp_count(text, F.lit(f"{WORD}+")).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_words.alias("n"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"), F.coalesce(cluster, F.lit("\0")).alias("cluster"), F.monotonically_increasing_id().alias("number"))
    rows = materialise(rows, "lengths")
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")
    n_shards = max(1, -(-(rows.agg(F.sum(last.cast("long") + 1)).first()[0] or 0) // shard_items))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("number", "doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * F.lit(capacity)).cast("long").alias("n_tokens"), "source", "cluster")
    shard = F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source", "number"), F.lit(n_shards))

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending"), ("number", "ascending")])
        placed = best_fit(*(table[c].to_pylist() for c in ("n_tokens", "source", "cluster")), capacity)
        bins, offsets = zip(*placed, strict=True)
        return table.select(["doc_id", "piece", "n_tokens", "shard"]).append_column("bin", pa.array(bins, pa.int32())).append_column("bin_offset", pa.array(offsets, pa.int64()))

    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(pack_shard, RESULT)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), "doc_id"))
