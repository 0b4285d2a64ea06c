"""From reads to unique reads with counts: ambiguity, dereplication, prefix compaction, k-mer support.

Reads are rows of ``read_id, sample, seq``. Results stay in long form, one row per sequence and sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.sequences import MOST_PACKED, is_ambiguous, kmer_numbers, kmers, spelt, support_numbers, support_words, without_ambiguity
from readloom.operators import words
from readloom.operators.ordered import by_range, earlier, later, of_ranges, ranges
from readloom.tables import materialise


def reject_ambiguous(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean reads, and the others' read_id with a reason."""
    bad = is_ambiguous(F.col("seq"))
    return reads.filter(~bad), reads.filter(bad).select("read_id", F.lit("AMBIGUOUS").alias("reason"))


def convert_ambiguous(reads: DataFrame) -> DataFrame:
    return reads.withColumn("seq", without_ambiguity(F.col("seq")))


def single_sample_fallback(reads: DataFrame, name: str = "AllSamps") -> DataFrame:
    """If every read has a sample of its own, all become one sample."""
    n = reads.agg(F.count(F.lit(1)).alias("reads"), F.count_distinct("sample").alias("samples")).first()
    return reads.withColumn("sample", F.lit(name)) if n["reads"] and n["reads"] == n["samples"] else reads


def sample_histogram(reads: DataFrame, key: str = "seq") -> DataFrame:
    return reads.groupBy(key, "sample").agg(F.count(F.lit(1)).alias("n"))


def dereplicate(reads: DataFrame, keys: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Equal sequences become one; mates are passed as two keys, so the split between them counts."""
    return reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def prefix_representatives(unique: DataFrame) -> DataFrame:
    """seq, rep: rep is the first sequence in order, from seq on, that is no prefix of the one after it.

    Windows run inside ranges of the order; the next range's first sequence, and the first representative of the ranges
    behind, are carried over. So a primer that all reads share makes no task larger.
    """
    rows = ranges(unique.select("seq"), "seq")
    rows = of_ranges(rows, F.min("seq"), F.lead("after").over(by_range()), "after")
    down = Window.partitionBy("range").orderBy(F.desc("seq"))
    following = F.coalesce(F.lag("seq").over(down), F.col("after"))
    rows = rows.withColumn("final", F.when(~F.coalesce(following.startswith(F.col("seq")), F.lit(False)), F.col("seq")))
    rows = of_ranges(rows, F.min("final"), F.last("carried", ignorenulls=True).over(later()), "carried")
    rep = F.last("final", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("seq", F.coalesce(rep, "carried").alias("rep"))


def prefix_runs(found: DataFrame) -> DataFrame:
    """found (seq, each once, n; written) with run, the number of its representative among all in order, and, for representatives alone, copies, the sum of n over their run.

    A run is consecutive in the order, so its number and its sum are differences of running sums: one shuffle by range
    does the work of joins and groups by sequence. What goes before a range, and the sequence behind it, are carried over.
    """
    up = Window.partitionBy("range").orderBy("seq")
    so_far, before = up.rowsBetween(Window.unboundedPreceding, Window.currentRow), up.rowsBetween(Window.unboundedPreceding, -1)
    ends = lambda seq, following: ~F.coalesce(following.startswith(seq), F.lit(False))
    rows = ranges(found, "seq", written=True).withColumn("following", F.lead("seq").over(up)).withColumn("upto", F.sum("n").over(so_far))
    inner = F.col("following").isNotNull() & ends(F.col("seq"), F.col("following"))
    sums = rows.groupBy("range").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_if(inner).alias("inner"), F.sum("n").alias("n"), F.max(F.when(inner, F.col("upto"))).alias("ended"))
    sums = sums.withColumn("after", F.lead("first").over(by_range())).withColumn("closed", ends(F.col("last"), F.col("after")))
    sums = sums.withColumn("n_before", F.coalesce(F.sum("n").over(earlier()), F.lit(0))).withColumn("ended", F.col("n_before") + F.when(F.col("closed"), F.col("n")).otherwise(F.col("ended")))
    runs_before = F.coalesce(F.sum(F.col("inner") + F.col("closed").cast("int")).over(earlier()), F.lit(0)).alias("runs_before")
    sums = sums.select("range", "after", "n_before", runs_before, F.coalesce(F.max("ended").over(earlier()), F.lit(0)).alias("ended_before"))
    rows = rows.join(F.broadcast(sums), "range").withColumn("ends", ends(F.col("seq"), F.coalesce("following", "after")))
    rows = rows.withColumn("at", F.when(F.col("ends"), F.col("n_before") + F.col("upto")))
    run = (F.col("runs_before") + F.count_if("ends").over(before)).cast("long")
    copies = F.col("at") - F.coalesce(F.max("at").over(before), F.col("ended_before"))
    return rows.select("seq", "n", run.alias("run"), copies.alias("copies"))


def prefix_compact(reads: DataFrame) -> DataFrame:
    """rep, sample, n: every read counted for its representative."""
    counts = materialise(sample_histogram(reads), "counts")
    reps = prefix_representatives(counts.select("seq").distinct())
    return counts.join(reps, "seq").groupBy("rep", "sample").agg(F.sum("n").alias("n"))


def in_runs(k: int) -> bool:
    return words.LEAST <= k <= words.MOST


def _weighted(reads: DataFrame) -> DataFrame:
    return convert_ambiguous(reads).groupBy("seq").agg(F.count(F.lit(1)).alias("w"))


def count_kmers(reads: DataFrame, k: int, as_numbers: bool = False) -> DataFrame:
    """kmer, n over all reads, ambiguous ones too, with A for other letters. Equal reads are counted once and weighted.

    Words of up to 32 bases are counted as longs; as_numbers leaves them so. Those of 12 and more are shuffled in runs.
    """
    weighted = _weighted(reads)
    if in_runs(k):
        return words.counted_words(weighted, k, as_numbers)
    short = k <= MOST_PACKED
    found = kmer_numbers(F.col("seq"), k) if short else kmers(F.col("seq"), k)
    counts = weighted.select(F.explode(found).alias("kmer"), "w").groupBy("kmer").agg(F.sum("w").alias("n"))
    return counts.select(spelt(F.col("kmer"), k).alias("kmer"), "n") if short and not as_numbers else counts


def kmer_support(unique: DataFrame, counts: DataFrame, k: int, mode: str = "aligned", head: Column | None = None, keys: tuple[str, ...] = ("seq",)) -> DataFrame:
    """unique with min_kmer, the count of its rarest word; null if it has no word, 0 for unknown words. head is as in support_words; counts may hold numbers."""
    as_numbers = counts.schema["kmer"].dataType.typeName() == "long"
    found = (support_numbers if as_numbers else support_words)(F.col("seq"), k, mode, head)
    asked = unique.select(*keys, F.explode(F.array_distinct(found)).alias("kmer"))
    found = asked.join(counts, "kmer", "left").groupBy(*keys).agg(F.min(F.coalesce("n", F.lit(0))).alias("min_kmer"))
    return unique.join(found, list(keys), "left")


def read_support(unique: DataFrame, reads: DataFrame, k: int, mode: str = "aligned", head: Column | None = None, keys: tuple[str, ...] = ("seq",), write: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """kmer_support by the words of reads; the words are counted where they are looked up, so their counts are not written.

    write may store what ``rarest_counts`` gives and count its words, for k that is ``in_runs``.
    """
    if not in_runs(k):
        return kmer_support(unique, count_kmers(reads, k, as_numbers=True), k, mode, head, keys)
    unique = materialise(unique.withColumn("_id", F.monotonically_increasing_id()), "asked")
    asked = unique.select("seq", F.col("_id").alias("id"), *([] if head is None else [head.cast("int").alias("head")]))
    rows = write(words.rarest_counts(_weighted(reads), asked, k, mode)).filter("id IS NOT NULL")
    found = rows.groupBy(F.col("id").alias("_id")).agg(F.min("low").alias("min_kmer"))
    return unique.join(found, "_id", "left").drop("_id")


def denoise(unique: DataFrame, min_copies: int | None, min_kmer: int | None) -> DataFrame:
    """Keeps copies >= min_copies; with min_kmer, at that number of copies only reads with so much support.

    min_copies None or 0 leaves support alone to decide; reads without a word are supported.
    """
    if min_copies is not None and min_copies < 0:
        raise ValueError("min_copies is negative")
    support = F.coalesce("min_kmer", F.lit(2**62)) >= (min_kmer or 0)
    if not min_copies:
        return unique.filter(support) if min_kmer else unique
    if not min_kmer:
        return unique.filter(F.col("copies") >= min_copies)
    return unique.filter((F.col("copies") > min_copies) | ((F.col("copies") == min_copies) & support))


def reject_log(reads: DataFrame, kept: DataFrame) -> DataFrame:
    """read_id, reason of reads that are ambiguous, or (FILTERED) whose sequence is not among those kept (seq)."""
    clean, ambiguous = reject_ambiguous(reads)
    return ambiguous.union(clean.join(kept.select("seq"), "seq", "left_anti").select("read_id", F.lit("FILTERED").alias("reason")))


def representative_totals(counts: DataFrame) -> DataFrame:
    """rep, n: the reads of each representative over all samples."""
    return counts.groupBy("rep").agg(F.sum("n").alias("n"))


def kmer_metrics(reads: DataFrame, k: int) -> DataFrame:
    """One row: all k-mers of the reads and how many differ."""
    return count_kmers(reads, k, as_numbers=True).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_kmers"), F.count(F.lit(1)).alias("n_distinct_kmers"))


def run_metrics(reads: DataFrame) -> DataFrame:
    """One row: reads, ambiguous reads and bases, samples, distinct sequences."""
    seq = F.col("seq")
    return reads.agg(
        F.count(F.lit(1)).alias("n_reads"), F.count_if(is_ambiguous(seq)).alias("n_ambiguous"),
        F.sum(F.length(F.regexp_replace(seq, "[ACGT]", ""))).cast("long").alias("ambiguous_bases"),
        F.count_distinct("sample").alias("n_samples"), F.count_distinct("seq").alias("n_distinct"),
    )
