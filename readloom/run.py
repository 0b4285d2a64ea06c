"""A whole run: reads and a database in, the OTU table and its logs out. ``python -m readloom.run --help``.

With ``--alignment`` and ``--counts`` the run begins at lines of an aligner instead of reads.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readloom.config import Config, from_arguments, parse_denoise
from readloom.functions.sequences import is_ambiguous, reverse_complement, trim_head, trim_tail
from readloom.operators import align, filtering, otu
from readloom.operators.ordered import number
from readloom.sources import fasta
from readloom.sources.database_files import open_database
from readloom.sources.files import write_file, write_stream_file
from readloom.tables import materialise, scratch


class RunLog:
    """What a run did: counters, observed while its tables are written, seconds of its stages, and remarks."""

    def __init__(self) -> None:
        self.counters: dict[str, int] = {}
        self.seconds: dict[str, float] = {}
        self.remarks: list[str] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        yield
        self.seconds[name] = round(time.monotonic() - began, 3)

    def table(self, df: DataFrame, name: str, **counters: Column) -> DataFrame:
        """df, written, with the counters taken from the rows that pass: no scan of their own."""
        if not counters:
            return materialise(df, name)
        seen = Observation()
        out = materialise(df.observe(seen, *[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in counters.items()]), name)
        self.counters |= seen.get
        return out

    def text(self) -> str:
        return json.dumps({"counters": self.counters, "seconds": self.seconds, "remarks": self.remarks})


def checked(spark: SparkSession, path: str, mended: str, log: RunLog) -> str:
    """The path, or that of a mended file if a line of it is wrong."""
    bad = fasta.bad_lines(spark, path).orderBy("line").first()
    if bad is None:
        return path
    log.remarks.append(f"{path}: {bad['reason']} in line {bad['line']}; {mended} is used")
    fasta.mend_fasta(spark, path, mended)
    return mended


def read_input(spark: SparkSession, c: Config, log: RunLog | None = None) -> DataFrame:
    """read_id, sample, seq (both mates joined), seq2 (the second mate or empty), trimmed."""
    first, second = c.reads, c.reads2
    if c.check:
        out, log = c.out.rstrip("/"), log or RunLog()
        first = checked(spark, first, f"{out}/formatted_input_fasta.fna", log)
        second = checked(spark, second, f"{out}/formatted_input2_fasta.fna", log) if second else None
    if not second:
        rows = fasta.read_reads(spark, first)
        return rows.select("read_id", "sample", trim_head(F.col("seq"), c.trim).alias("seq"), F.lit("").alias("seq2"))
    rows = fasta.read_pairs(spark, first, second)
    head, tail = trim_head(F.col("seq"), c.trim), trim_tail(F.col("seq2"), c.trim2)
    return rows.select("read_id", "sample", F.concat(head, tail).alias("seq"), tail.alias("seq2"))


def unique_reads(reads: DataFrame, c: Config, log: RunLog) -> tuple[DataFrame, DataFrame]:
    """Kept sequences (rix, seq, seq2, copies), and for every sequence the rix that stands for it (seq, seq2, rix).

    Single reads with a copy threshold are compacted by prefix. Words are counted over all reads, each mate by itself.
    With the key "joined" mates with an equal joined sequence are one, whatever their split; the least second mate stands.
    """
    copies, support = parse_denoise(c.denoise, c.denoise_float)
    clean = filtering.reject_ambiguous(reads)[0] if c.ambiguous == "reject" else filtering.convert_ambiguous(reads)
    found = log.table(clean.groupBy("seq", "seq2").agg(F.count(F.lit(1)).alias("n")), "found", n_distinct=F.count(F.lit(1)))
    if copies and not c.reads2:
        stands = materialise(filtering.prefix_runs(found.select("seq", "n")), "runs").withColumn("seq2", F.lit(""))
        groups = stands.filter("copies IS NOT NULL").select("seq", "seq2", "copies", "run")
        if copies == 1 and not support:  # all are kept
            kept = log.table(groups.withColumnRenamed("run", "rix"), "kept", n_sequences=F.count(F.lit(1)), n_committed=F.sum("copies"))
            return kept, stands.select("seq", "seq2", F.col("run").alias("rix"))
        by, order = ["run"], ["run"]
    else:
        stands = found.withColumn("rep", F.col("seq")).withColumn("rep2", F.col("seq2"))
        if c.pe_key == "joined" and c.reads2:
            stands = found.join(found.groupBy(F.col("seq").alias("rep")).agg(F.min("seq2").alias("rep2")), F.col("seq") == F.col("rep"))
        groups = stands.groupBy("rep", "rep2").agg(F.sum("n").alias("copies")).withColumns({"seq": F.col("rep"), "seq2": F.col("rep2")})
        by, order = ["rep", "rep2"], ["seq", "seq2"]
    head = F.length("seq") - F.length("seq2")
    if support:
        mates = reads.select(F.explode(F.array(F.substr("seq", F.lit(1), head), "seq2")).alias("seq")).filter("seq <> ''")
        counted = lambda rows: log.table(rows, "looked-up", n_kmers=F.sum("n_words"), n_distinct_kmers=F.sum("n_distinct"))
        if not filtering.in_runs(c.k):
            log.counters |= filtering.kmer_metrics(mates, c.k).first().asDict()
        groups = filtering.read_support(groups, mates, c.k, c.support, head if c.reads2 else None, ("seq", "seq2"), counted)
    else:
        groups = groups.withColumn("min_kmer", F.lit(None).cast("long"))
    kept = number(filtering.denoise(groups, copies, support).select(*dict.fromkeys(["seq", "seq2", "copies", *by])), "rix", *order)
    kept = log.table(kept, "kept", n_sequences=F.count(F.lit(1)), n_committed=F.sum("copies"))
    named = stands.select("seq", "seq2", *by).join(kept.select(*by, "rix"), by).select("seq", "seq2", "rix")
    return kept.drop(*by), materialise(named, "named")


def align_unique(kept: DataFrame, refs: DataFrame, c: Config) -> DataFrame:
    """rix, ref_id, pos (in the reference), len and g_pos (in all of them end to end) of each aligned sequence or mate.

    Mates read towards each other: the second is turned before it is compared, and both must lie on one reference.
    """
    finder = align.edit_hits if c.indels else align.hamming_hits

    def hits_of(seqs: DataFrame) -> DataFrame:
        one = lambda r, f: finder(r, f, c.similarity, c.least_read, written=c.both_strands or not c.reads2)
        return align.both_strands(one, seqs, refs) if c.both_strands else one(seqs, refs)

    turn = lambda s: reverse_complement(s) if c.rc else s
    if not c.reads2:
        queries = kept.select("rix", turn(F.col("seq")).alias("seq"))
        # the sequences differ already; of a written table Spark knows whether it is small, and so need not shuffle them
        best = materialise(align.best_hit(hits_of(queries.select("seq")), refs), "best")
        return queries.join(best, "seq").select("rix", "ref_id", "pos", F.length("seq").cast("long").alias("len"), "g_pos")
    first = turn(F.substr("seq", F.lit(1), F.length("seq") - F.length("seq2")))
    queries = kept.select("rix", first.alias("first"), reverse_complement(turn(F.col("seq2"))).alias("second"))
    offsets = refs.select("ref_id", "start_off")
    hits = materialise(align.on_references(hits_of(queries.select(F.explode(F.array("first", "second")).alias("seq")).distinct()), offsets, F.lit(align.OFFSET_BYTES)), "hits")
    mate = lambda name: queries.select(F.col("rix").alias("pair_id"), F.col(name).alias("seq")).join(hits, "seq").select("pair_id", "ref_id", "pos", F.length("seq").cast("long").alias("len"), "ed", (F.col("start_off") + F.col("pos")).alias("g_pos"))
    best = align.best_pair(align.concordant_pairs(mate("first"), mate("second"), c.max_insert))
    placed = best.join(queries, best["pair_id"] == queries["rix"])
    sides = F.explode(F.array(F.struct("pos", F.length("first").cast("long").alias("len")), F.struct(F.col("pos2").alias("pos"), F.length("second").cast("long").alias("len")))).alias("side")
    lines = placed.select("rix", "ref_id", sides).select("rix", "ref_id", "side.pos", "side.len")
    return align.on_references(lines, offsets, F.lit(align.OFFSET_BYTES)).select("rix", "ref_id", "pos", "len", (F.col("start_off") + F.col("pos")).alias("g_pos"))


def assign(hits: DataFrame, refs: DataFrame, c: Config) -> DataFrame:
    """rix, otu_id, is_chimera: hits are compacted by their reference windows, then looked up by position.

    Both mates of a pair count once, for the first of them, or each by itself if lines are counted.
    """
    pos = hits.select("rix", "len", "g_pos")
    if c.compact:
        text = align.on_references(hits, refs.select("ref_id", F.col("seq").alias("ref")), F.length("ref"))
        windows = materialise(text.select("rix", "len", F.col("g_pos").alias("pos"), F.substr("ref", F.col("pos").cast("int"), F.col("len").cast("int")).alias("win")), "windows")
        moved = otu.compact_positions(windows.select("win", "pos").distinct())
        pos = windows.join(moved, ["win", "pos"]).select("rix", "len", F.col("new_pos").alias("g_pos"))
    return otu.assign_positions(pos.select("rix", F.col("g_pos").alias("pos"), "len"), refs, c.tolerance, c.flush_end, c.pe_count)


def run(spark: SparkSession, c: Config) -> dict[str, DataFrame]:
    """Computes the tables of a run and writes its files below ``c.out``; returns the tables.

    What is written in between is deleted at the end, but for the tables returned.
    """
    c.validate()
    log = RunLog()
    with scratch(spark) as keep:
        results = from_alignment(spark, c, log) if c.alignment else from_reads(spark, c, log)
        return keep(results)


def from_reads(spark: SparkSession, c: Config, log: RunLog) -> dict[str, DataFrame]:
    base = open_database(spark, c.database, c.name)
    refs, seq = base.references, F.col("seq")
    with log.stage("filter"):
        unknown = F.length(F.regexp_replace(seq, "[ACGT]", ""))
        rows = read_input(spark, c, log).withColumn("read_no", F.monotonically_increasing_id())
        reads = log.table(rows, "reads", n_reads=F.count(F.lit(1)), n_ambiguous=F.count_if(is_ambiguous(seq)), ambiguous_bases=F.sum(unknown))
        reads = filtering.single_sample_fallback(reads)
        samples = log.table(otu.sample_numbers(reads), "samples", n_samples=F.count(F.lit(1)))
        kept, named = unique_reads(reads, c, log)
        clean = reads if c.ambiguous == "reject" else filtering.convert_ambiguous(reads)
        members = materialise(clean.join(named, ["seq", "seq2"]).select("rix", "read_no", "read_id", "sample"), "members")
        counts = materialise(members.groupBy("rix", "sample").agg(F.count(F.lit(1)).alias("n")), "counts")
        log.counters["n_rejected"] = log.counters["n_reads"] - log.counters["n_ambiguous"] * (c.ambiguous == "reject") - log.counters["n_committed"]
    with log.stage("align"):
        hits = materialise(align_unique(kept, refs, c), "aligned")
    with log.stage("compact and look up"):
        found = log.table(assign(hits, refs, c), "assigned", n_chimeras=F.count_if("is_chimera"), n_assigned=F.count_if(~F.col("is_chimera")))
    results = {"kept": kept, "counts": counts, "assigned": found, "samples": samples, "members": members} | write_table(spark, counts, samples, found, base, c, log)
    if c.logs:
        with log.stage("logs"):
            write_logs(reads, results, c)
    return finish(spark, results, c, log)


def from_alignment(spark: SparkSession, c: Config, log: RunLog) -> dict[str, DataFrame]:
    """The table from lines of an aligner (with positions in all references end to end) and the counts of their sequences."""
    base = open_database(spark, c.database, c.name)
    samples, decoded = fasta.read_counts(spark, c.counts)
    samples = log.table(samples, "samples", n_samples=F.count(F.lit(1)))
    counts = materialise(decoded.join(samples, "ix").select("rix", "sample", "n"), "counts")
    lines = log.table(fasta.read_sam(spark, c.alignment), "lines", n_lines=F.count(F.lit(1)), n_unaligned=F.count_if(F.col("rname") == "*"))
    with log.stage("compact and look up"):
        if c.compact:
            lines = materialise(otu.compact_alignment(lines, base.references), "compacted")
            fasta.write_sam(lines, f"{c.out.rstrip('/')}/compacted.sam")
        placed = otu.assign_alignment(lines, base.references, c.tolerance, c.flush_end, c.pe_count)
        found = log.table(placed, "assigned", n_chimeras=F.count_if("is_chimera"), n_assigned=F.count_if(~F.col("is_chimera")))
    results = {"counts": counts, "assigned": found, "samples": samples} | write_table(spark, counts, samples, found, base, c, log)
    return finish(spark, results, c, log)


def write_table(spark: SparkSession, counts: DataFrame, samples: DataFrame, found: DataFrame, base, c: Config, log: RunLog) -> dict[str, DataFrame]:
    """The OTU table, also as one file."""
    out = c.out.rstrip("/")
    with log.stage("table"):
        cells = counts.join(found.filter("NOT is_chimera"), "rix").groupBy("otu_id", "sample").agg(F.sum("n").alias("n"))
        table = log.table(cells, "table", n_expanded=F.sum("n"))
        order = base.references.select(F.col("ref_id").alias("otu_id"), "ref_ord")
        if c.legacy:
            write_file(otu.legacy_lines(table, samples, order, base.taxonomy), f"{out}/otutable.txt", "line_no")
        else:
            rows = materialise(fasta.biom_rows(table, base.taxonomy, samples, order), "biom")
            date = spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
            write_file(fasta.biom_lines(rows, samples, date), f"{out}/otutable.biom", "section", "r")
    return {"table": table}


def finish(spark: SparkSession, results: dict[str, DataFrame], c: Config, log: RunLog) -> dict[str, DataFrame]:
    line = spark.createDataFrame([(0, log.text())], "i int, value string")
    write_file(line, f"{c.out.rstrip('/')}/metrics.json", "i")
    return results


def write_logs(reads: DataFrame, results: dict[str, DataFrame], c: Config) -> None:
    """The filter's sequences, counts, duplicates and rejects; passed and failed reads; reads by OTU."""
    out, kept, members = c.out.rstrip("/"), results["kept"], results["members"]
    first = F.substr("seq", F.lit(1), F.length("seq") - F.length("seq2"))
    turn = lambda s: reverse_complement(s) if c.rc else s
    for name, seq in [("filt.fa", first)] + [("2_filt.fa", F.col("seq2"))] * bool(c.reads2):
        write_file(kept.select("rix", F.concat(F.lit(">"), F.col("rix").cast("string"), F.lit("\n"), turn(seq)).alias("value")), f"{out}/{name}", "rix")
    fasta.write_counts(results["counts"], results["samples"], f"{out}/filt.db")
    write_stream_file(members.select("rix", "read_id", F.col("read_id").alias("value")), f"{out}/dupes.txt", ["rix"], ["read_id"])
    gone = reads.join(members.select("read_no"), "read_no", "left_anti")
    bad = is_ambiguous(F.col("seq")) if c.ambiguous == "reject" else F.lit(False)
    write_file(gone.select("read_id", F.concat_ws("\t", "read_id", F.when(bad, "AMBIGUOUS").otherwise("FILTERED")).alias("value")), f"{out}/filtered.txt", "read_id")
    passed = members.join(results["assigned"].filter("NOT is_chimera"), "rix").select("rix", "read_id", F.col("otu_id").cast("string").alias("otu_id"))
    write_file(passed.select("read_id", F.concat_ws("\t", "read_id", "otu_id").alias("value")), f"{out}/pass.log", "read_id")
    failed = members.join(passed.select("rix").distinct(), "rix", "left_anti")
    write_file(failed.select("read_id", F.col("read_id").alias("value")), f"{out}/fail.txt", "read_id")
    otu.write_otu_map(passed, f"{out}/otumap.txt")


def main(arguments: list[str]) -> None:
    c = from_arguments(arguments)
    spark = SparkSession.builder.appName("readloom").getOrCreate()
    run(spark, c)["table"].explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
