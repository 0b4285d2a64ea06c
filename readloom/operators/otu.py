"""From alignments to the OTU table: window compaction, counts, taxonomy, read maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.database import chimera_flag, locate, windows
from readloom.operators.ordered import by_range, earlier, number, of_ranges, ranges
from readloom.sources.files import write_stream_file
from readloom.tables import materialise

UNMAPPED = "UNSUPPORTED_MAPPING"
#: What reads without a sample are listed under.
NO_SAMPLE = "(none)"


def compact_positions(hits: DataFrame) -> DataFrame:
    """hits (win, pos, ...) with new_pos: in order of window and position, a hit takes the position of the first of the run in which each window is a prefix of the next.

    Windows run inside ranges of that order; the last window of the range before, and the last run begun there, are
    carried over.
    """
    last = F.max(F.struct("win", "pos"))
    rows = of_ranges(ranges(hits, "win", "pos"), last, F.lag(F.col("before.win")).over(by_range()), "before")
    order = Window.partitionBy("range").orderBy("win", "pos")
    begins = ~F.coalesce(F.col("win").startswith(F.coalesce(F.lag("win").over(order), F.col("before"))), F.lit(False))
    rows = rows.withColumn("begin", F.when(begins, F.col("pos")))
    begun = F.max(F.when(F.col("begin").isNotNull(), F.struct("win", "pos")))
    rows = of_ranges(rows, begun, F.last(F.col("carried.pos"), ignorenulls=True).over(earlier()), "carried")
    new_pos = F.last("begin", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("new_pos", F.coalesce(new_pos, "carried")).select(*hits.columns, "new_pos")


def compact_alignment(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """Alignment lines (pos from 1 in all references end to end, seq, ...) with the positions of compact_positions.

    Of equal windows the least position counts. Lines that are not aligned (pos 0 or null) stay as they are.
    """
    lines = materialise(lines, "alignment")
    aligned = lines.filter("pos > 0").withColumn("len", F.length("seq").cast("long"))
    found = materialise(windows(aligned.select("pos", "len").distinct(), refs), "window-texts")
    moved = compact_positions(found.select("win", "pos").distinct())
    places = found.join(moved, ["win", "pos"]).select(F.col("pos").alias("_pos"), F.col("len").alias("_len"), "new_pos")
    out = aligned.join(places, (F.col("pos") == F.col("_pos")) & (F.col("len") == F.col("_len"))).withColumn("pos", F.col("new_pos"))
    return out.select(*lines.columns).union(lines.filter("pos IS NULL OR pos <= 0"))


def assign_positions(places: DataFrame, refs: DataFrame, tolerance: int = 0, flush_end: str = "reject", pe_count: str = "pairs") -> DataFrame:
    """rix, otu_id, is_chimera of aligned sequences or mates (rix, pos from 1, len), looked up by position.

    With "pairs" a sequence with several places counts once, for the best of them (no chimera, then the lowest
    position); with "lines" each place counts, so both mates of a pair add to the table.
    """
    at = F.col("pos") - (0 if flush_end == "reject" else 1)
    found = chimera_flag(locate(places.select("rix", at.alias("pos"), "len"), refs), tolerance)
    if pe_count == "lines":
        return found.select("rix", F.col("ref_id").alias("otu_id"), "is_chimera")
    first = F.min(F.struct("is_chimera", "pos", "ref_id")).alias("b")
    return found.groupBy("rix").agg(first).select("rix", F.col("b.ref_id").alias("otu_id"), "b.is_chimera")


def assign_alignment(lines: DataFrame, refs: DataFrame, tolerance: int = 0, flush_end: str = "reject", pe_count: str = "pairs") -> DataFrame:
    """assign_positions of alignment lines (rix, rname, pos, seq); those with rname * are left out."""
    return assign_positions(lines.filter("rname <> '*' AND pos > 0").select("rix", "pos", F.length("seq").cast("long").alias("len")), refs, tolerance, flush_end, pe_count)


def write_otu_map(passed: DataFrame, path: str) -> None:
    """One file with a line for each OTU in order of ids: the id and its reads (otu_id, read_id), a tab behind each."""
    named = passed.select("otu_id").distinct().select("otu_id", F.lit(0).alias("kind"), F.lit("").alias("read_id"), F.col("otu_id").alias("value"))
    reads = passed.select("otu_id", F.lit(1).alias("kind"), "read_id", F.col("read_id").alias("value"))
    write_stream_file(named.union(reads), path, ["otu_id"], ["kind", "read_id"])


def otu_table(counts: DataFrame, hits: DataFrame) -> DataFrame:
    """otu_id, sample, n from counts (seq, sample, n) and hits (seq, ref_id); sparse, so no row is all zero."""
    return counts.join(hits.select("seq", F.col("ref_id").alias("otu_id")), "seq").groupBy("otu_id", "sample").agg(F.sum("n").alias("n"))


def pivot_table(table: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """otu_id and a column per sample, by default all that the table has; Spark refuses more than pivotMaxValues."""
    named = table.withColumn("sample", F.coalesce("sample", F.lit(NO_SAMPLE)))
    pivot = named.groupBy("otu_id").pivot("sample", samples) if samples is not None else named.groupBy("otu_id").pivot("sample")
    return pivot.agg(F.sum("n")).na.fill(0)


def sample_numbers(counts: DataFrame) -> DataFrame:
    """sample, ix: the samples' numbers in order of their names, a null sample as ``NO_SAMPLE``."""
    return number(counts.select(F.coalesce("sample", F.lit(NO_SAMPLE)).alias("sample")).distinct(), "ix", "sample")


def _numbered(counts: DataFrame, samples: DataFrame) -> DataFrame:
    return counts.withColumn("sample", F.coalesce("sample", F.lit(NO_SAMPLE))).join(samples, "sample")


def count_lines(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """rix, line ``ix:n:ix:n:`` from counts (rix, sample, n)."""
    cell = F.struct("ix", F.concat(F.col("ix").cast("string"), F.lit(":"), F.col("n").cast("string"), F.lit(":")).alias("cell"))
    return _numbered(counts, samples).groupBy("rix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["cell"]), "").alias("line"))


def decode_count_lines(lines: DataFrame) -> DataFrame:
    """rix, ix, n from count lines."""
    cells = F.regexp_extract_all("line", F.lit("([0-9]+:[0-9]+):"), 1)
    cell = F.split("cell", ":")
    return lines.select("rix", F.explode(cells).alias("cell")).select("rix", cell[0].cast("long").alias("ix"), cell[1].cast("long").alias("n"))


def legacy_lines(table: DataFrame, samples: DataFrame, order: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """line_no, value: the tab-separated table, its header first, OTUs in database order (otu_id, ref_ord).

    A line has a cell for each sample, zeros too; a sample without any count keeps its column.
    """
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "sample"))), lambda x: x["sample"]), "\t")
    head = F.concat_ws("\t", F.lit("#OTU ID"), names, *([F.lit("taxonomy")] if taxonomy is not None else []))
    header = samples.agg(head.alias("value"), F.count(F.lit(1)).alias("n_samples"))
    n_samples = header.first()["n_samples"]
    cells = F.map_from_entries(F.collect_list(F.struct("ix", "n")))
    rows = _numbered(table, samples).groupBy("otu_id").agg(cells.alias("cells")).join(order, "otu_id")
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long")), lambda i: F.coalesce(F.element_at("cells", i), F.lit(0)).cast("string")), "\t") if n_samples else F.lit("")
    parts = [F.col("otu_id").cast("string"), line]
    if taxonomy is not None:
        rows = with_taxonomy(rows, taxonomy)
        parts.append(F.col("taxonomy"))
    body = number(rows.select("ref_ord", F.concat_ws("\t", *parts).alias("value")), "line_no", "ref_ord")
    return header.select(F.lit(0).cast("long").alias("line_no"), "value").union(body.select(F.col("line_no") + 1, "value"))


def with_taxonomy(table: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return table.join(taxonomy, "otu_id", "left").withColumn("taxonomy", F.coalesce("taxonomy", F.lit(UNMAPPED)))


def otu_map(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """otu_id, reads: ids of an OTU's reads in order, tab-separated."""
    named = reads.join(hits.select("seq", F.col("ref_id").alias("otu_id")), "seq")
    return named.groupBy("otu_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("read_id")), lambda x: x.cast("string")), "\t").alias("reads"))


def pass_fail(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """read_id and otu_id of every read, null for reads without a hit."""
    return reads.join(hits.select("seq", F.col("ref_id").alias("otu_id")), "seq", "left").select("read_id", "otu_id")


def fail_log(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """read_id of reads (read_id, seq) without a hit (seq, is_chimera) or with a chimeric one only."""
    return reads.join(hits.filter("NOT is_chimera").select("seq"), "seq", "left_anti").select("read_id")


def duplicate_lists(reads: DataFrame, unique: DataFrame) -> DataFrame:
    """rix, reads: tab-separated ids of the reads (read_id, seq) of each kept sequence (rix, seq)."""
    named = reads.join(unique.select("seq", "rix"), "seq")
    return named.groupBy("rix").agg(F.array_join(F.transform(F.array_sort(F.collect_list("read_id")), lambda x: x.cast("string")), "\t").alias("reads"))
