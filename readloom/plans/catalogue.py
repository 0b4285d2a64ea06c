"""Queries over the supplied tables, and the same in SQL.

Each document's whole text becomes a sequence (letters mapped to bases) that is cut into reads of ``TILE`` bases; the
document's source is the sample. ``benchmark`` texts are the references, ordered by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.sequences import read_id_of, reverse_complement, sample_of, taxonomy_levels, trim_head, trim_tail
from readloom.config import Config
from readloom.operators import align, database, filtering, otu
from readloom.operators.ordered import number
from readloom.operators.tiles import tiles
from readloom.run import run
from readloom.sources import database_files, fasta, lzw
from readloom.sources.files import read_stream_file, write_lines
from readloom.tables import materialise, new_path, spread

TILE, K, SIMILARITY = 60, 16, 0.97
#: Reads of one document have consecutive ids; a text has fewer than 2^31 bytes and so fewer tiles than this.
TILES = 1 << 26
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLEAN, WITH_N = "ACGTACGTACGTACGTACGTACGTAC", "ACGTACGTACGTACGTACGTACGTAN"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bases(text: str, bases: str) -> F.Column:
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", ""), LETTERS, bases)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(_table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select("doc_id", F.col("source").alias("sample"), "text")


def _whole(spark: SparkSession, sf: str, bases: str = CLEAN) -> DataFrame:
    return _documents(spark, sf).select("doc_id", "sample", _bases("text", bases).alias("seq"))


def _lower(spark: SparkSession, sf: str, *others: str) -> DataFrame:
    return _documents(spark, sf).select(*others, F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def _reads(spark: SparkSession, sf: str, bases: str = CLEAN, keep=None) -> DataFrame:
    """Whole texts are cut in one pass, and their letters turned into bases as arrays."""
    rows = tiles(_lower(spark, sf, "doc_id", "sample"), LETTERS, bases, TILE, keep)
    return rows.select((F.col("doc_id") * TILES + F.col("i")).alias("read_id"), "sample", "seq")


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("ref_ord"), F.col("item_id").alias("ref_id"), _bases("text", CLEAN).alias("seq"))


def _offsets(spark: SparkSession, sf: str, spacer: int = 0) -> DataFrame:
    return database.concat_offsets(_refs(spark, sf), spacer)


def _taxonomy(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Three of four references have an entry, or all."""
    names = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tax = F.concat(F.lit("k__"), F.col("r_name"), F.lit("; p__"), F.col("n_name"))
    return _refs(spark, sf).filter("true" if whole else "ref_id % 4 <> 3").join(names, F.expr("ref_id % 25") == F.col("n_nationkey")).select(F.col("ref_id").alias("otu_id"), tax.alias("taxonomy"))


def _unique(spark: SparkSession, sf: str) -> DataFrame:
    return filtering.dereplicate(_reads(spark, sf))


def _unique_near(spark: SparkSession, sf: str, similarity: float = SIMILARITY) -> DataFrame:
    """The distinct reads that may have a hit; the others are dropped where texts are cut, and not shuffled."""
    near = tiles(_lower(spark, sf), LETTERS, CLEAN, TILE, align.seed_test(_refs(spark, sf), similarity))
    return filtering.dereplicate(near)


def _best_of(unique: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return align.best_hit(align.hamming_hits(unique, _refs(spark, sf), SIMILARITY), _offsets(spark, sf))


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return _best_of(_unique_near(spark, sf), spark, sf)


def _written_reads(spark: SparkSession, sf: str, bases: str = CLEAN) -> DataFrame:
    """Reads that a query needs more than once."""
    return materialise(_reads(spark, sf, bases), "reads")


def _counts_and_best(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Reads by sequence and sample, and the best hits of the sequences; the documents are cut up once.

    The hits are written, so Spark knows their size, and a small table of them meets the counts without a shuffle of these.
    """
    counts = materialise(filtering.sample_histogram(_reads(spark, sf)), "counts")
    return counts, materialise(_best_of(counts.select("seq").distinct(), spark, sf), "best")


def _otu(spark: SparkSession, sf: str) -> DataFrame:
    return otu.otu_table(*_counts_and_best(spark, sf))


def _reads_and_best(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    reads = _written_reads(spark, sf)
    return reads, materialise(_best_of(filtering.dereplicate(reads), spark, sf), "best")


def _near_and_best(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """_reads_and_best without the reads that have no seed, for queries in which a read without a hit has no part."""
    reads = materialise(_reads(spark, sf, keep=align.seed_test(_refs(spark, sf), SIMILARITY)), "reads")
    return reads, materialise(_best_of(filtering.dereplicate(reads), spark, sf), "best")


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    total = _refs(spark, sf).agg(F.sum(F.length("seq"))).first()[0]
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.pmod(F.col("o_orderkey") * 7919, F.lit(total + 1)).alias("pos"))


def _support(mode: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        reads = _written_reads(spark, sf)
        return filtering.read_support(filtering.dereplicate(reads), reads, K, mode).select("seq", "min_kmer")

    return query


def q01(spark, sf):
    header = F.concat(F.lit(">"), "source", F.lit("_"), "doc_id", F.lit(" x=1"))
    return _table(spark, sf, "documents").select(sample_of(header).alias("sample"), read_id_of(header).alias("read_id"))


def q02(spark, sf):
    seq = F.lower("seq")
    return _whole(spark, sf).select("doc_id", F.upper(trim_head(seq, 100)).alias("head"), F.upper(trim_tail(seq, 80)).alias("tail"))


def q03(spark, sf):
    return filtering.reject_ambiguous(_reads(spark, sf, WITH_N))[1]


def q04(spark, sf):
    return filtering.convert_ambiguous(_reads(spark, sf, WITH_N)).select("read_id", "seq")


def q05(spark, sf):
    return _reads(spark, sf).select("read_id", reverse_complement(F.col("seq")).alias("rc"))


def q08(spark, sf):
    return filtering.prefix_compact(_reads(spark, sf))


def q09(spark, sf):
    return filtering.denoise(_unique(spark, sf).withColumn("min_kmer", F.lit(None).cast("long")), 2, None).select("seq", "copies")


def q14(spark, sf):
    return _denoised(_written_reads(spark, sf)).select("seq", "copies", "min_kmer")


def _denoised(reads: DataFrame) -> DataFrame:
    unique = filtering.dereplicate(filtering.reject_ambiguous(reads)[0])
    return filtering.denoise(filtering.read_support(unique, reads, K), 1, 3)


def q15(spark, sf):
    """Each document a sample of its own: all fall into one."""
    rows = _table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("sample"))
    return filtering.single_sample_fallback(rows).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


def q16(spark, sf):
    return _offsets(spark, sf).select("ref_id", "start_off", "end_off")


def q17(spark, sf):
    return _offsets(spark, sf, 50).select("ref_id", "start_off", "end_off")


def q18(spark, sf):
    return database.locate(_positions(spark, sf), _offsets(spark, sf)).select("key", "pos", "ref_id")


def q19(spark, sf):
    hits = database.locate(_positions(spark, sf), _offsets(spark, sf)).withColumn("len", F.lit(60))
    return database.chimera_flag(hits).select("key", "pos", "is_chimera")


def q20(spark, sf):
    return align.hamming_hits(_unique_near(spark, sf, 1.0), _refs(spark, sf), 1.0).select("seq", "ref_id", "pos")


def q21(spark, sf):
    return _best(spark, sf)


def q22(spark, sf):
    return align.best_hit(align.edit_hits(_unique_near(spark, sf), _refs(spark, sf), SIMILARITY), _offsets(spark, sf))


def q23(spark, sf):
    return align.both_strands(lambda r, f: align.hamming_hits(r, f, 1.0), _unique(spark, sf), _refs(spark, sf)).select("seq", "ref_id", "pos", "strand")


def q24(spark, sf):
    """Neighbouring reads of a document as mates."""
    reads, best = _reads_and_best(spark, sf)
    placed = reads.join(best, "seq").select("read_id", "ref_id", "pos", F.length("seq").cast("long").alias("len"))
    first = placed.withColumn("pair_id", F.col("read_id"))
    second = placed.withColumn("pair_id", F.col("read_id") - 1)
    return align.concordant_pairs(first, second).select("pair_id", "ref_id", "pos", "pos2", "span")


def q25(spark, sf):
    best, refs = _best(spark, sf), _refs(spark, sf).select("ref_id", F.col("seq").alias("ref"))
    hits = best.join(refs, "ref_id").select(F.col("g_pos").alias("pos"), F.substring("ref", F.col("pos").cast("int"), F.length("seq")).alias("win")).distinct()
    return otu.compact_positions(hits).select("win", "pos", "new_pos")


def q27(spark, sf):
    """A column for every sample that has reads; the list of samples is short (Spark's limit for pivots holds)."""
    counts, best = _counts_and_best(spark, sf)
    samples = otu.sample_numbers(counts).orderBy("ix").select("sample").collect()
    return otu.pivot_table(otu.otu_table(counts, best), [r["sample"] for r in samples])


def q28(spark, sf):
    return otu.with_taxonomy(_otu(spark, sf), _taxonomy(spark, sf)).select("otu_id", "sample", "n", "taxonomy")


def q29(spark, sf):
    return _taxonomy(spark, sf, whole=True).select("otu_id", F.array_join(taxonomy_levels(F.col("taxonomy")), "|").alias("levels"))


def q30(spark, sf):
    return otu.otu_map(*_reads_and_best(spark, sf))


def q31(spark, sf):
    return otu.pass_fail(*_reads_and_best(spark, sf))


def q32(spark, sf):
    return filtering.run_metrics(_reads(spark, sf, WITH_N))


def q33(spark, sf):
    return fasta.biom_rows(*_table_parts(spark, sf))


def _table_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """OTU table, taxonomy, numbered samples (those without a hit too), database order."""
    counts, best = _counts_and_best(spark, sf)
    table = materialise(otu.otu_table(counts, best), "otus")
    order = _refs(spark, sf).select(F.col("ref_id").alias("otu_id"), "ref_ord")
    return table, _taxonomy(spark, sf), materialise(otu.sample_numbers(counts), "samples"), order


def q34(spark, sf):
    path = new_path(spark, "fasta")
    rows = _whole(spark, sf).select(F.concat_ws("_", "sample", F.col("doc_id").cast("string")).alias("name"), F.lower("seq").alias("seq"))
    fasta.write_fasta(rows, path, "name")
    return fasta.read_reads(spark, path)


def q35(spark, sf):
    """Best hits as alignment lines, written and read back; rix numbers the sequences in order."""
    hits = number(_best(spark, sf), "rix", "seq")
    lines = hits.select("rix", F.lit(0).alias("flag"), F.col("ref_id").cast("string").alias("rname"), "pos", F.lit(255).alias("mapq"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), "seq", F.lit("*").alias("qual"))
    path = new_path(spark, "sam")
    fasta.write_sam(lines, path)
    return fasta.read_sam(spark, path).select("rix", "rname", "pos", "cigar", "seq")


def q36(spark, sf):
    path = new_path(spark, "codes")
    lzw.compress_references(_refs(spark, sf)).write.parquet(path)
    return lzw.read_compressed(spark.read.parquet(path)).select(F.col("header").cast("long").alias("ref_id"), "seq")


def q37(spark, sf):
    """Some records get a second line, a blank or a foreign letter."""
    seq, n = F.col("seq"), F.col("doc_id")
    seq = F.when(n % 7 == 0, F.concat(F.lit("AC\n"), seq)).when(n % 11 == 0, F.concat(F.lit("A C"), seq)).when(n % 13 == 0, F.concat(F.lit("AXC"), seq)).otherwise(seq)
    path = new_path(spark, "fasta")
    fasta.write_fasta(_whole(spark, sf, WITH_N).filter("seq <> ''").select(n.alias("name"), seq.alias("seq")), path, "name")
    return fasta.validate_fasta(spark, path)


def q38(spark, sf):
    return filtering.kmer_metrics(_reads(spark, sf, WITH_N), K)


def q39(spark, sf):
    return filtering.representative_totals(filtering.prefix_compact(_reads(spark, sf)))


def q40(spark, sf):
    """Two files, read in step: the two halves of each document."""
    rows = materialise(_whole(spark, sf).filter("seq <> ''"), "whole")
    header = F.concat(F.lit(">"), "sample", F.lit("_"), F.col("doc_id").cast("string"), F.lit("\n"))
    paths = [new_path(spark, "mates") for _ in range(2)]
    half = F.floor(F.length("seq") / 2).cast("int")
    for path, seq in zip(paths, (F.substr("seq", F.lit(1), half), F.substr("seq", half + 1)), strict=True):
        write_lines(rows.select("doc_id", F.concat(header, seq).alias("value")), path, "doc_id")
    return fasta.read_pairs(spark, *paths)


def _database(spark: SparkSession, sf: str) -> database_files.Database:
    folder = new_path(spark, "database")
    database_files.write_database(_refs(spark, sf), folder, "bench", _taxonomy(spark, sf))
    return database_files.open_database(spark, folder, "bench")


def q41(spark, sf):
    """A database written as files and read again: offsets with taxonomy."""
    base = _database(spark, sf)
    return base.offsets.join(base.taxonomy, "otu_id", "left")


def q42(spark, sf):
    """Count lines encoded and decoded; sequences and samples are numbered in order."""
    counts = materialise(filtering.sample_histogram(_reads(spark, sf)), "counts")
    numbers = number(counts.select("seq").distinct(), "rix", "seq")
    samples = materialise(otu.sample_numbers(counts), "samples")
    return otu.decode_count_lines(otu.count_lines(counts.join(numbers, "seq"), samples))


def q43(spark, sf):
    reads = _written_reads(spark, sf, WITH_N)
    return filtering.reject_log(reads, _denoised(reads))


def q44(spark, sf):
    """Reads without a hit, and those whose hit runs over a reference's end (by the 0-based reading of positions)."""
    reads, best = _reads_and_best(spark, sf)
    return otu.fail_log(reads, _chimeras(best, spark, sf))


def _chimeras(best: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    hits = best.select("seq", F.col("g_pos").alias("pos"), F.length("seq").alias("len"))
    return database.chimera_flag(database.locate(hits, _offsets(spark, sf))).select("seq", "is_chimera")


def q45(spark, sf):
    table, taxonomy, samples, order = _table_parts(spark, sf)
    return otu.legacy_lines(table, samples, order, taxonomy)


def q46(spark, sf):
    table, taxonomy, samples, order = _table_parts(spark, sf)
    return fasta.biom_lines(materialise(fasta.biom_rows(table, taxonomy, samples, order), "biom"), samples, "2024-01-01T00:00:00")


def q47(spark, sf):
    reads = _written_reads(spark, sf)
    return otu.duplicate_lists(reads, number(filtering.denoise(filtering.dereplicate(reads).withColumn("min_kmer", F.lit(None).cast("long")), 2, None), "rix", "seq"))


def q48(spark, sf):
    """From files to the OTU table: compaction of reads and of positions, chimera test, taxonomy."""
    reads, folder = new_path(spark, "reads"), new_path(spark, "database")
    rows = _reads(spark, sf).select(F.concat_ws("_", "sample", F.col("read_id").cast("string")).alias("name"), "seq")
    fasta.write_fasta(rows, reads, "name")
    database_files.write_database(_refs(spark, sf), folder, "bench", _taxonomy(spark, sf))
    c = Config(reads=reads, out=new_path(spark, "out"), database=folder, name="bench", similarity=SIMILARITY, indels=False, legacy=True)
    taxonomy = database_files.open_database(spark, folder, "bench").taxonomy
    table = run(spark, c)["table"].withColumn("otu_id", F.col("otu_id").cast("string"))
    return otu.with_taxonomy(table, taxonomy).select("otu_id", "sample", "n", "taxonomy")


def q49(spark, sf):
    """References without a sequence hand their header on to the next one."""
    rows = _refs(spark, sf).select(F.col("ref_ord").alias("ord"), F.concat(F.lit("h"), F.col("ref_id").cast("string")).alias("header"), F.when(F.col("ref_ord") % 5 < 2, "").otherwise(F.col("seq")).alias("seq"))
    return database.drop_empty_headers(rows)


def _wild_refs(spark: SparkSession, sf: str) -> DataFrame:
    """References in which every 23rd base, and in every fourth one a run of four, is unknown."""
    unknown = lambda i: ((i * 7 + F.col("ref_id")) % 23 == 0) | ((F.col("ref_id") % 4 == 1) & i.between(20, 23))
    letters = F.transform(F.split("seq", ""), lambda x, i: F.when(unknown(i), "N").otherwise(x))
    return _refs(spark, sf).withColumn("seq", F.array_join(letters, ""))


def q50(spark, sf):
    """Unknown bases of the references cost nothing, up to 15 % of a read."""
    return align.best_hit(align.hamming_hits(_unique(spark, sf), _wild_refs(spark, sf), SIMILARITY), _offsets(spark, sf))


def _repeats(seq: F.Column) -> F.Column:
    """Runs of A with single C between."""
    return F.translate(seq, "ACGT", "AACA")


def q51(spark, sf):
    """Reads and references of low complexity: nearly every word is repeated many times."""
    reads = _reads(spark, sf).withColumn("seq", _repeats(F.col("seq")))
    refs = _refs(spark, sf).withColumn("seq", _repeats(F.col("seq")))
    return align.best_hit(align.hamming_hits(filtering.dereplicate(reads), refs, SIMILARITY, least_read=TILE), _offsets(spark, sf))


def _sam(rix, rname, pos, seq) -> list[F.Column]:
    """The columns of an alignment line."""
    return [F.col(rix).cast("long").alias("rix"), F.lit(0).alias("flag"), rname.alias("rname"), pos.cast("long").alias("pos"), F.lit(255).alias("mapq"), F.concat(F.length(seq).cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), seq.alias("seq"), F.lit("*").alias("qual")]


def q52(spark, sf):
    """Lines of an aligner with windows of 20 to 219 bases, most over borders of references, moved to common positions; every tenth is not aligned."""
    total = _refs(spark, sf).agg(F.sum(F.length("seq"))).first()[0]
    key, none = F.col("o_orderkey"), F.col("o_orderkey") % 10 == 0
    seq = F.repeat(F.lit("A"), (20 + key % 200).cast("int"))
    lines = _table(spark, sf, "orders").select(*_sam("o_orderkey", F.when(none, "*").otherwise("all"), F.when(none, 0).otherwise(F.pmod(key * 7919, F.lit(total)) + 1), seq))
    paths = [new_path(spark, "sam") for _ in range(2)]
    fasta.write_sam(lines, paths[0])
    fasta.write_sam(otu.compact_alignment(fasta.read_sam(spark, paths[0]), _offsets(spark, sf)), paths[1])
    return fasta.read_sam(spark, paths[1]).select("rix", "rname", "pos", F.length("seq").alias("len"))


def q53(spark, sf):
    """The OTU table from lines of an aligner and a file of counts; every third sequence has two lines, and lines are counted."""
    counts, best = _counts_and_best(spark, sf)
    counts = materialise(counts.join(number(counts.select("seq").distinct(), "rix", "seq"), "seq"), "counts")
    files = [new_path(spark, x) for x in ("sam", "counts", "database", "out")]
    lines = counts.select("rix", "seq").distinct().join(best.select("seq", "g_pos"), "seq", "left").withColumn("line", F.explode(F.sequence(F.lit(0), F.when(F.col("rix") % 3 == 0, 1).otherwise(0))))
    fasta.write_sam(lines.select(*_sam("rix", F.when(F.col("g_pos").isNull(), "*").otherwise("all"), F.coalesce("g_pos", F.lit(0)), F.col("seq"))), files[0])
    fasta.write_counts(counts, otu.sample_numbers(counts), files[1])
    database_files.write_database(_refs(spark, sf), files[2], "bench", compress=False)
    c = Config(reads="", out=files[3], database=files[2], name="bench", alignment=files[0], counts=files[1], compact=False, pe_count="lines", legacy=True)
    return run(spark, c)["table"].select(F.col("otu_id").cast("string").alias("otu_id"), "sample", "n")


def _faulty(spark: SparkSession, sf: str) -> str:
    """A file in which some records have a second line, a blank, a foreign letter, a carriage return or a second header."""
    seq, n = F.col("seq"), F.col("doc_id")
    seq = F.when(n % 7 == 0, F.concat(F.lit("AC\n"), seq)).when(n % 11 == 0, F.concat(F.lit("A C"), seq)).when(n % 13 == 0, F.concat(F.lit("AXC"), seq)).when(n % 17 == 0, F.concat(seq, F.lit("\r"))).when(n % 19 == 0, F.concat(F.lit(">again\n"), seq)).otherwise(seq)
    path = new_path(spark, "faulty")
    rows = _whole(spark, sf, WITH_N).filter("seq <> ''")
    write_lines(rows.select("doc_id", F.concat(F.lit(">"), n.cast("string"), F.lit("\n"), seq).alias("value")), path, "doc_id")
    return path


def q54(spark, sf):
    return fasta.bad_lines(spark, _faulty(spark, sf))


def q55(spark, sf):
    """The same file, mended and read strictly."""
    path = new_path(spark, "mended")
    fasta.mend_fasta(spark, _faulty(spark, sf), path)
    return fasta.read_reads(spark, path).select("read_id", "seq")


def q56(spark, sf):
    """Reads by OTU as one file of lines that are written as streams, and read back record by record."""
    reads, best = _near_and_best(spark, sf)
    path = new_path(spark, "otumap")
    name = F.coalesce(F.lpad(F.col("read_id").cast("string"), 20, "0"), F.lit("none"))  # behind all numbers
    otu.write_otu_map(reads.join(best, "seq").select(F.lpad(F.col("ref_id").cast("string"), 12, "0").alias("otu_id"), name.alias("read_id")), path)
    return read_stream_file(spark, path).select(F.col("line").cast("long").alias("otu_id"), "place", F.expr("try_cast(value AS long)").alias("read_id"))


def q57(spark, sf):
    """The counters of a run with denoising by copies and words, from its log."""
    reads, folder, out = (new_path(spark, x) for x in ("reads", "database", "out"))
    fasta.write_fasta(_reads(spark, sf, WITH_N).select(F.concat_ws("_", "sample", F.col("read_id").cast("string")).alias("name"), "seq"), reads, "name")
    database_files.write_database(_refs(spark, sf), folder, "bench", compress=False)
    c = Config(reads=reads, out=out, database=folder, name="bench", similarity=SIMILARITY, indels=False, compact=False, denoise="1.003", k=K)
    run(spark, c)
    names = ["n_reads", "n_ambiguous", "ambiguous_bases", "n_samples", "n_distinct", "n_kmers", "n_distinct_kmers", "n_sequences", "n_committed", "n_rejected", "n_chimeras", "n_assigned", "n_expanded"]
    log = F.from_json("value", "counters struct<" + ", ".join(f"{x}: long" for x in names) + ">")
    return spark.read.text(f"{out}/metrics.json").select(log.alias("log")).select("log.counters.*")


QUERIES = {
    "q01_sample_extract": q01, "q02_trim": q02, "q03_ambiguity_reject": q03, "q04_convert_ambiguous": q04, "q05_revcomp": q05,
    "q06_dereplicate": lambda s, d: _unique(s, d), "q07_sample_histogram": lambda s, d: filtering.sample_histogram(_reads(s, d)),
    "q08_prefix_compact": q08, "q09_min_copies": q09, "q10_kmer_count": lambda s, d: filtering.count_kmers(_reads(s, d, WITH_N), K),
    "q11_kmer_support": _support("aligned"), "q12_support_endpiece": _support("endpiece"), "q13_support_deep": _support("deep"),
    "q14_denoise_xy": q14, "q15_single_sample_fallback": q15, "q16_concat_offsets": q16, "q17_concat_offsets_spacers": q17,
    "q18_offset_lookup": q18, "q19_chimera_filter": q19, "q20_exact_align": q20, "q21_similarity_join": q21, "q22_similarity_edit": q22,
    "q23_both_strands": q23, "q24_paired_insert": q24, "q25_compact_positions": q25, "q26_otu_table_long": lambda s, d: _otu(s, d),
    "q27_otu_table_pivot": q27, "q28_taxonomy_join": q28, "q29_taxonomy_split": q29, "q30_otu_map": q30, "q31_pass_fail": q31,
    "q32_run_metrics": q32, "q33_biom_rows": q33, "q34_fasta_roundtrip": q34, "q35_sam_roundtrip": q35, "q36_lzw_roundtrip": q36,
    "q37_validate_fasta": q37, "q38_kmer_metrics": q38, "q39_representative_totals": q39, "q40_paired_scan": q40, "q41_database_files": q41,
    "q42_count_lines": q42, "q43_reject_log": q43, "q44_fail_log": q44, "q45_legacy_lines": q45, "q46_biom_lines": q46, "q47_duplicate_lists": q47,
    "q48_full_run": q48, "q49_empty_headers": q49, "q50_unknown_bases": q50, "q51_repeats": q51,
    "q52_compact_alignment": q52, "q53_table_from_alignment": q53, "q54_bad_lines": q54, "q55_mended_fasta": q55, "q56_otu_map_file": q56, "q57_run_counters": q57,
}

# ---- SQL -------------------------------------------------------------------------------------------------------


def _seq_sql(bases: str) -> str:
    return f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LETTERS}', '{bases}')"


_TILES = "SELECT doc_id * 67108864 + i AS read_id, sample, substr(s, (i * 60 + 1)::BIGINT, 60) AS seq FROM (SELECT doc_id, sample, s, unnest(range((length(s) + 59) // 60)) AS i FROM (SELECT doc_id, source AS sample, {seq} AS s FROM documents) WHERE s <> '')"
_CTE = {
    "whole": f"SELECT doc_id, source AS sample, {_seq_sql(CLEAN)} AS seq FROM documents",
    "reads": _TILES.format(seq=_seq_sql(CLEAN)),
    "nreads": _TILES.format(seq=_seq_sql(WITH_N)),
    "refs": f"SELECT item_id AS ref_id, {_seq_sql(CLEAN)} AS seq FROM benchmark",
    "offs": "SELECT ref_id, seq, (coalesce(sum(length(seq)) OVER (ORDER BY ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_off FROM refs",
    "uniq": "SELECT seq, count(*) AS copies FROM reads GROUP BY seq",
    "kc": f"SELECT substr(s, (p)::BIGINT, {K}) AS kmer, count(*) AS n FROM (SELECT s, unnest(range(1, length(s) - {K} + 2)) AS p FROM (SELECT regexp_replace(seq, '[^ACGT]', 'A', 'g') AS s FROM {{src}}) WHERE length(s) >= {K}) GROUP BY 1",
    "pieces": "SELECT seq, e, length(seq) // (e + 1) AS k, i * (length(seq) // (e + 1)) AS off, substr(seq, (i * (length(seq) // (e + 1)) + 1)::BIGINT, length(seq) // (e + 1)) AS piece FROM (SELECT seq, e, unnest(range(e + 1)) AS i FROM (SELECT seq, floor({gap} * length(seq) + 1e-9)::BIGINT AS e FROM uniq))",
    "words": "SELECT ref_id, k, p0, substr(ref, (p0 + 1)::BIGINT, k) AS piece FROM (SELECT ref_id, seq AS ref, k, unnest(range(length(seq) - k + 1)) AS p0 FROM refs JOIN (SELECT DISTINCT k FROM pieces) ON length(seq) >= k)",
    "cand": "SELECT DISTINCT p.seq, p.e, w.ref_id, w.p0 - p.off AS start FROM pieces p JOIN words w ON p.k = w.k AND p.piece = w.piece",
    "hits": "SELECT seq, ref_id, start + 1 AS pos, ed FROM (SELECT seq, e, c.ref_id, start, hamming(seq, substr(r.ref, (start + 1)::BIGINT, length(seq))) AS ed FROM (SELECT DISTINCT p.seq, p.e, w.ref_id, w.p0 - p.off AS start FROM pieces p JOIN words w ON p.k = w.k AND p.piece = w.piece) c JOIN (SELECT ref_id, seq AS ref FROM refs) r ON r.ref_id = c.ref_id WHERE start >= 0 AND start + length(seq) <= length(r.ref)) WHERE ed <= e",
    "best": "SELECT seq, ref_id, pos, ed, g_pos FROM (SELECT h.*, start_off + pos AS g_pos, row_number() OVER (PARTITION BY h.seq ORDER BY ed, start_off + pos) AS rn FROM hits h JOIN (SELECT ref_id, start_off FROM offs) o ON o.ref_id = h.ref_id) WHERE rn = 1",
    "otus": "SELECT ref_id AS otu_id, sample, count(*) AS n FROM reads JOIN best ON reads.seq = best.seq GROUP BY 1, 2",
    "tax": "SELECT ref_id AS otu_id, 'k__' || r_name || '; p__' || n_name AS taxonomy FROM refs JOIN nation ON ref_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE ref_id % 4 <> 3",
    "places": "SELECT o_orderkey AS key, (o_orderkey * 7919) % ((SELECT sum(length(seq)) FROM refs)::BIGINT + 1) AS pos FROM orders",
    "unread": "SELECT u.seq, copies, m.min_kmer FROM (SELECT seq, count(*) AS copies FROM nreads WHERE seq <> '' AND NOT regexp_matches(seq, '[^ACGT]') GROUP BY seq) u LEFT JOIN (SELECT seq, min(coalesce(n, 0)) AS min_kmer FROM (SELECT seq, substr(seq, (i * 16 + 1)::BIGINT, 16) AS word FROM (SELECT seq, unnest(range(length(seq) // 16)) AS i FROM (SELECT DISTINCT seq FROM nreads) WHERE length(seq) >= 16)) w LEFT JOIN kc ON w.word = kc.kmer GROUP BY seq) m ON u.seq = m.seq WHERE copies >= 2 OR coalesce(m.min_kmer, 4611686018427387904) >= 3",
    "reps": "SELECT seq, last_value(seq) OVER (PARTITION BY grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rep FROM (SELECT seq, sum(brk) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM (SELECT seq, CASE WHEN starts_with(seq, lag(seq) OVER (ORDER BY seq)) THEN 0 ELSE 1 END AS brk FROM uniq))",
    "chim": "SELECT seq, len > start_off + n - pos AS is_chimera FROM (SELECT best.seq, length(best.seq) AS len, g_pos AS pos, o.start_off, length(o.seq) AS n FROM best ASOF JOIN (SELECT * FROM offs WHERE seq <> '') o ON best.g_pos >= o.start_off)",
    "snames": "SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS ix FROM (SELECT DISTINCT coalesce(sample, '(none)') AS sample FROM reads)",
    "biom": "SELECT r, a.otu_id, '{\"id\":\"' || a.otu_id || '\",\"metadata\":{\"taxonomy\":[' || CASE WHEN taxonomy IS NULL THEN '\"UNSUPPORTED_MAPPING\"' ELSE '\"' || replace(taxonomy, '; ', '\",\"') || '\"' END || ']}}' AS entry, data FROM (SELECT otu_id, row_number() OVER (ORDER BY otu_id) - 1 AS r FROM (SELECT DISTINCT otu_id FROM otus)) a JOIN (SELECT otu_id, r2, string_agg('[' || r2 || ',' || ix || ',' || n || ']', ',' ORDER BY ix) AS data FROM otus JOIN snames ON otus.sample = snames.sample JOIN (SELECT otu_id AS o2, row_number() OVER (ORDER BY otu_id) - 1 AS r2 FROM (SELECT DISTINCT otu_id FROM otus)) ON o2 = otu_id GROUP BY otu_id, r2) d ON a.otu_id = d.otu_id LEFT JOIN tax ON tax.otu_id = a.otu_id",
    "located": "SELECT key, pos, ref_id, start_off, length(seq) AS len FROM places ASOF JOIN (SELECT * FROM offs WHERE seq <> '') o ON places.pos >= o.start_off",
}
_NEEDS = {"offs": ["refs"], "uniq": ["reads"], "pieces": ["uniq"], "words": ["refs", "pieces"], "cand": ["refs", "pieces", "words"], "hits": ["refs", "pieces", "words"], "best": ["hits", "offs"], "otus": ["reads", "best"], "tax": ["refs"], "places": ["refs"], "located": ["places", "offs"], "unread": ["nreads", "kc"], "reps": ["uniq"], "chim": ["best", "offs"], "snames": ["reads"], "biom": ["otus", "snames", "tax"]}


def _sql(body: str, *names: str, gap: str = "(1 - 0.97::DOUBLE)", src: str = "reads") -> str:
    def closure(n: str) -> list[str]:
        return reduce(lambda out, x: out + [y for y in closure(x) if y not in out], _NEEDS.get(n, []) + ([src] if n == "kc" else []), []) + [n]

    order = list(dict.fromkeys(y for n in names for y in closure(n)))
    parts = [f"{n} AS ({_CTE[n].replace('{gap}', gap).replace('{src}', src)})" for n in order]
    return f"WITH {', '.join(parts)} {body}"


def _support_sql(words: str) -> str:
    return _sql(f"SELECT u.seq, m.min_kmer FROM uniq u LEFT JOIN (SELECT seq, min(coalesce(n, 0)) AS min_kmer FROM (SELECT seq, word FROM ({words})) w LEFT JOIN kc ON w.word = kc.kmer GROUP BY seq) m ON u.seq = m.seq", "uniq", "kc")


_ALIGNED = f"SELECT seq, substr(seq, (i * {K} + 1)::BIGINT, {K}) AS word FROM (SELECT seq, unnest(range(length(seq) // {K})) AS i FROM uniq WHERE length(seq) >= {K})"
SQL = {
    "q01_sample_extract": "SELECT regexp_extract(source || '_' || doc_id || ' x=1', '^([^_ ]*)', 1) AS sample, source || '_' || doc_id AS read_id FROM documents",
    "q02_trim": _sql("SELECT doc_id, substr(seq, 1, 100) AS head, substr(seq, greatest(length(seq) - 79, 1)::BIGINT, 80) AS tail FROM whole", "whole"),
    "q03_ambiguity_reject": _sql("SELECT read_id, 'AMBIGUOUS' AS reason FROM nreads WHERE seq = '' OR regexp_matches(seq, '[^ACGT]')", "nreads"),
    "q04_convert_ambiguous": _sql("SELECT read_id, regexp_replace(seq, '[^ACGT]', 'A', 'g') AS seq FROM nreads", "nreads"),
    "q05_revcomp": _sql("SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads", "reads"),
    "q06_dereplicate": _sql("SELECT seq, copies FROM uniq", "uniq"),
    "q07_sample_histogram": _sql("SELECT seq, sample, count(*) AS n FROM reads GROUP BY 1, 2", "reads"),
    "q08_prefix_compact": _sql("SELECT rep, sample, count(*)::BIGINT AS n FROM reads JOIN (SELECT seq, last_value(seq) OVER (PARTITION BY grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rep FROM (SELECT seq, sum(brk) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM (SELECT seq, CASE WHEN starts_with(seq, lag(seq) OVER (ORDER BY seq)) THEN 0 ELSE 1 END AS brk FROM uniq))) r ON reads.seq = r.seq GROUP BY 1, 2", "reads", "uniq"),
    "q09_min_copies": _sql("SELECT seq, copies FROM uniq WHERE copies >= 2", "uniq"),
    "q10_kmer_count": _sql("SELECT kmer, n FROM kc", "kc", src="nreads"),
    "q11_kmer_support": _support_sql(_ALIGNED),
    "q12_support_endpiece": _support_sql(f"{_ALIGNED} UNION ALL SELECT seq, substr(seq, (length(seq) - {K} + 1)::BIGINT, {K}) FROM uniq WHERE length(seq) >= {K}"),
    "q13_support_deep": _support_sql(f"SELECT seq, substr(seq, p::BIGINT, {K}) AS word FROM (SELECT seq, unnest(range(1, length(seq) - {K} + 2)) AS p FROM uniq WHERE length(seq) >= {K})"),
    "q14_denoise_xy": _sql(f"SELECT u.seq, copies, m.min_kmer FROM uniq u LEFT JOIN (SELECT seq, min(coalesce(n, 0)) AS min_kmer FROM ({_ALIGNED}) w LEFT JOIN kc ON w.word = kc.kmer GROUP BY seq) m ON u.seq = m.seq WHERE copies >= 2 OR coalesce(m.min_kmer, 4611686018427387904) >= 3", "uniq", "kc"),
    "q15_single_sample_fallback": "SELECT 'AllSamps' AS sample, count(*) AS n FROM documents",
    "q16_concat_offsets": _sql("SELECT ref_id, start_off, start_off + length(seq) AS end_off FROM offs", "offs"),
    "q17_concat_offsets_spacers": _sql("SELECT ref_id, s AS start_off, s + length(seq) AS end_off FROM (SELECT ref_id, seq, (coalesce(sum(length(seq) + 100) OVER (ORDER BY ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM refs)", "refs"),
    "q18_offset_lookup": _sql("SELECT key, pos, ref_id FROM located", "located"),
    "q19_chimera_filter": _sql("SELECT key, pos, 60 > start_off + len - pos AS is_chimera FROM located", "located"),
    "q20_exact_align": _sql("SELECT seq, ref_id, pos FROM hits", "hits", gap="0.0"),
    "q21_similarity_join": _sql("SELECT seq, ref_id, pos, ed, g_pos FROM best", "best"),
    "q24_paired_insert": _sql("SELECT a.read_id AS pair_id, a.ref_id, a.pos, b.pos AS pos2, b.pos + b.len - a.pos AS span FROM pl a JOIN pl b ON b.read_id = a.read_id + 1 AND a.ref_id = b.ref_id WHERE b.pos >= a.pos AND b.pos + b.len - a.pos <= 1400", "reads", "best").replace(" SELECT a.read_id", ", pl AS (SELECT read_id, ref_id, pos, length(reads.seq) AS len FROM reads JOIN best ON reads.seq = best.seq) SELECT a.read_id"),
    "q25_compact_positions": _sql("SELECT win, pos, first_value(pos) OVER (PARTITION BY grp ORDER BY win, pos) AS new_pos FROM (SELECT win, pos, sum(brk) OVER (ORDER BY win, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM (SELECT win, pos, CASE WHEN starts_with(win, lag(win) OVER (ORDER BY win, pos)) THEN 0 ELSE 1 END AS brk FROM (SELECT DISTINCT g_pos AS pos, substr(refs.seq, best.pos::BIGINT, length(best.seq)) AS win FROM best JOIN refs ON refs.ref_id = best.ref_id)))", "best", "refs"),
    "q26_otu_table_long": _sql("SELECT otu_id, sample, n FROM otus", "otus"),
    "q27_otu_table_pivot": _sql("SELECT otu_id, " + ", ".join(f"coalesce(sum(CASE WHEN sample = 'src{i}' THEN n END), 0)::BIGINT AS src{i}" for i in range(20)) + " FROM otus GROUP BY otu_id", "otus"),
    "q28_taxonomy_join": _sql("SELECT otus.otu_id, sample, n, coalesce(taxonomy, 'UNSUPPORTED_MAPPING') AS taxonomy FROM otus LEFT JOIN tax ON otus.otu_id = tax.otu_id", "otus", "tax"),
    "q29_taxonomy_split": _sql("SELECT otu_id, replace(taxonomy, '; ', '|') AS levels FROM tax", "tax").replace(" WHERE ref_id % 4 <> 3", ""),
    "q30_otu_map": _sql("SELECT ref_id AS otu_id, string_agg(read_id::VARCHAR, chr(9) ORDER BY read_id) AS reads FROM reads JOIN best ON reads.seq = best.seq GROUP BY 1", "reads", "best"),
    "q31_pass_fail": _sql("SELECT read_id, ref_id AS otu_id FROM reads LEFT JOIN best ON reads.seq = best.seq", "reads", "best"),
    "q32_run_metrics": _sql("SELECT count(*) AS n_reads, count(*) FILTER (regexp_matches(seq, '[^ACGT]')) AS n_ambiguous, sum(length(regexp_replace(seq, '[ACGT]', '', 'g')))::BIGINT AS ambiguous_bases, count(DISTINCT sample) AS n_samples, count(DISTINCT seq) AS n_distinct FROM nreads", "nreads"),
    "q22_similarity_edit": _sql("SELECT seq, ref_id, pos, ed, g_pos FROM (SELECT h.*, start_off + pos AS g_pos, row_number() OVER (PARTITION BY h.seq ORDER BY ed, start_off + pos) AS rn FROM edits h JOIN (SELECT ref_id, start_off FROM offs) o ON o.ref_id = h.ref_id) WHERE rn = 1", "cand", "offs").replace(" SELECT seq, ref_id, pos, ed, g_pos FROM (SELECT h.*", ", edits AS (SELECT seq, ref_id, s + 1 AS pos, min(levenshtein(seq, substr(ref, (s + 1)::BIGINT, n::BIGINT))) AS ed FROM (SELECT DISTINCT c.seq, c.e, c.ref_id, r.ref, s, n FROM (SELECT seq, e, ref_id, start, unnest(range(start - e, start + e + 1)) AS s FROM cand) c JOIN (SELECT ref_id, seq AS ref FROM refs) r ON r.ref_id = c.ref_id, (SELECT unnest(range(-2, 3)) AS d), LATERAL (SELECT length(c.seq) + d AS n) WHERE abs(d) <= c.e AND s >= 0 AND s + n <= length(r.ref) AND n > 0) GROUP BY seq, e, ref_id, s HAVING min(levenshtein(seq, substr(ref, (s + 1)::BIGINT, n::BIGINT))) <= e) SELECT seq, ref_id, pos, ed, g_pos FROM (SELECT h.*"),
    "q23_both_strands": _sql("SELECT seq, ref_id, pos, '+' AS strand FROM hits UNION ALL SELECT reverse(translate(seq, 'ACGT', 'TGCA')) AS seq, ref_id, pos, '-' AS strand FROM rhits", "hits", gap="0.0").replace(" SELECT seq, ref_id, pos, '+' AS strand", ", rpieces AS (SELECT seq, length(seq) AS k, seq AS piece FROM (SELECT DISTINCT reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM uniq)), rhits AS (SELECT seq, ref_id, p0 + 1 AS pos FROM rpieces p JOIN words w ON p.k = w.k AND p.piece = w.piece) SELECT seq, ref_id, pos, '+' AS strand"),
    "q33_biom_rows": _sql("SELECT r, otu_id, entry, data FROM biom", "biom"),
    "q34_fasta_roundtrip": _sql("SELECT sample || '_' || doc_id AS read_id, sample, seq FROM whole", "whole"),
    "q35_sam_roundtrip": _sql("SELECT row_number() OVER (ORDER BY seq) - 1 AS rix, ref_id::VARCHAR AS rname, pos, length(seq) || 'M' AS cigar, seq FROM best", "best"),
    "q36_lzw_roundtrip": _sql("SELECT ref_id, seq FROM refs", "refs"),
    "q37_validate_fasta": f"SELECT doc_id::VARCHAR AS header, CASE WHEN doc_id % 7 = 0 THEN 'sequence lines' WHEN doc_id % 11 = 0 THEN 'blank' ELSE 'letter' END AS reason FROM documents WHERE {_seq_sql(WITH_N)} <> '' AND (doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0)",
    "q38_kmer_metrics": _sql("SELECT coalesce(sum(n), 0)::BIGINT AS n_kmers, count(*) AS n_distinct_kmers FROM kc", "kc", src="nreads"),
    "q39_representative_totals": _sql("SELECT rep, count(*) AS n FROM reads JOIN reps ON reads.seq = reps.seq GROUP BY rep", "reads", "reps"),
    "q40_paired_scan": _sql("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, sample || '_' || doc_id AS read_id, sample, substr(seq, 1, length(seq) // 2) AS seq, substr(seq, length(seq) // 2 + 1) AS seq2 FROM whole WHERE seq <> ''", "whole"),
    "q41_database_files": _sql("SELECT offs.ref_id::VARCHAR AS otu_id, start_off, taxonomy FROM offs LEFT JOIN tax ON tax.otu_id = offs.ref_id", "offs", "tax"),
    "q42_count_lines": _sql("SELECT dense_rank() OVER (ORDER BY seq) - 1 AS rix, dense_rank() OVER (ORDER BY sample) - 1 AS ix, n FROM (SELECT seq, sample, count(*) AS n FROM reads GROUP BY 1, 2)", "reads"),
    "q43_reject_log": _sql("SELECT read_id, CASE WHEN seq = '' OR regexp_matches(seq, '[^ACGT]') THEN 'AMBIGUOUS' ELSE 'FILTERED' END AS reason FROM nreads WHERE seq NOT IN (SELECT seq FROM unread)", "nreads", "unread", src="nreads"),
    "q44_fail_log": _sql("SELECT read_id FROM reads WHERE seq NOT IN (SELECT seq FROM chim WHERE NOT is_chimera)", "reads", "chim"),
    "q45_legacy_lines": _sql("SELECT 0::BIGINT AS line_no, '#OTU ID' || chr(9) || string_agg(sample, chr(9) ORDER BY ix) || chr(9) || 'taxonomy' AS value FROM snames UNION ALL SELECT row_number() OVER (ORDER BY o) AS line_no, o || chr(9) || string_agg(coalesce(n, 0)::VARCHAR, chr(9) ORDER BY ix) || chr(9) || coalesce(any_value(taxonomy), 'UNSUPPORTED_MAPPING') AS value FROM (SELECT DISTINCT otu_id AS o FROM otus) CROSS JOIN snames LEFT JOIN otus ON otus.otu_id = o AND otus.sample = snames.sample LEFT JOIN tax ON tax.otu_id = o GROUP BY o", "otus", "snames", "tax"),
    "q46_biom_lines": _sql("SELECT 0 AS section, 0::BIGINT AS r, '{\"id\":null,\"format\":\"Biological Observation Matrix 1.0.0\",\"format_url\":\"http://biom-format.org\",\"type\":\"OTU table\",\"generated_by\":\"readloom\",\"date\":\"2024-01-01T00:00:00\",\"matrix_type\":\"sparse\",\"matrix_element_type\":\"int\",\"shape\":[' || (SELECT count(*) FROM biom) || ',' || (SELECT count(*) FROM snames) || '],\"rows\":[' AS value UNION ALL SELECT 1, r, CASE WHEN r > 0 THEN ',' ELSE '' END || entry FROM biom UNION ALL SELECT 2, 0, '],\"columns\":[' UNION ALL SELECT 3, ix, CASE WHEN ix > 0 THEN ',' ELSE '' END || '{\"id\":\"' || sample || '\",\"metadata\":null}' FROM snames UNION ALL SELECT 4, 0, '],\"data\":[' UNION ALL SELECT 5, r, CASE WHEN r > 0 THEN ',' ELSE '' END || data FROM biom UNION ALL SELECT 6, 0, ']}'", "biom"),
    "q47_duplicate_lists": _sql("SELECT rix, string_agg(read_id::VARCHAR, chr(9) ORDER BY read_id) AS reads FROM reads JOIN (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS rix FROM uniq WHERE copies >= 2) u ON u.seq = reads.seq GROUP BY rix", "reads", "uniq"),
    "q49_empty_headers": _sql("SELECT min(ref_id) AS ord, 'h' || min(ref_id) AS header, max(s) AS seq FROM (SELECT ref_id, CASE WHEN ref_id % 5 < 2 THEN '' ELSE seq END AS s, min(CASE WHEN ref_id % 5 >= 2 AND seq <> '' THEN ref_id END) OVER (ORDER BY ref_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM refs) WHERE target IS NOT NULL GROUP BY target", "refs"),
}
#: All windows of the references against all reads of their length; an unknown base differs from every base of a read.
_ALL_WINDOWS = ", lens AS (SELECT DISTINCT length(seq) AS n FROM {reads}), wins AS MATERIALIZED (SELECT ref_id, n, s, substr(seq, (s + 1)::BIGINT, n) AS win, n - length(replace(substr(seq, (s + 1)::BIGINT, n), 'N', '')) AS w FROM (SELECT ref_id, n, seq, unnest(range(length(seq) - n + 1)) AS s FROM {refs}, lens WHERE length(seq) >= n)), found AS (SELECT u.seq, o.ref_id, s + 1 AS pos, hamming(u.seq, win) - w AS ed, start_off + s + 1 AS g_pos FROM {reads} u JOIN wins ON length(u.seq) = n JOIN (SELECT ref_id, start_off FROM offs) o ON o.ref_id = wins.ref_id WHERE w <= floor(0.15 * n + 1e-9) AND hamming(u.seq, win) - w <= floor((1 - 0.97::DOUBLE) * n + 1e-9)) SELECT seq, ref_id, pos, ed, g_pos FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ed, g_pos) AS rn FROM found) WHERE rn = 1"
SQL["q50_unknown_bases"] = _sql("", "uniq", "offs") + ", nrefs AS (SELECT ref_id, string_agg(CASE WHEN (i * 7 + ref_id) % 23 = 0 OR (ref_id % 4 = 1 AND i BETWEEN 20 AND 23) THEN 'N' ELSE substr(seq, (i + 1)::BIGINT, 1) END, '' ORDER BY i) AS seq FROM (SELECT ref_id, seq, unnest(range(length(seq))) AS i FROM refs) GROUP BY ref_id)" + _ALL_WINDOWS.format(reads="uniq", refs="nrefs")
SQL["q51_repeats"] = _sql("", "reads", "offs") + ", rreads AS (SELECT DISTINCT translate(seq, 'ACGT', 'AACA') AS seq FROM reads WHERE length(seq) >= 60), rrefs AS (SELECT ref_id, translate(seq, 'ACGT', 'AACA') AS seq FROM refs)" + _ALL_WINDOWS.format(reads="rreads", refs="rrefs")
SQL["q52_compact_alignment"] = _sql("SELECT o_orderkey AS rix, CASE WHEN o_orderkey % 10 = 0 THEN '*' ELSE 'all' END AS rname, coalesce(new_pos, 0) AS pos, (20 + o_orderkey % 200)::INTEGER AS len FROM orders LEFT JOIN moved ON o_orderkey % 10 <> 0 AND moved.pos = (o_orderkey * 7919) % total + 1 AND moved.len = 20 + o_orderkey % 200", "refs").replace(" SELECT o_orderkey", ", ends AS (SELECT string_agg(seq, '' ORDER BY ref_id) AS t, sum(length(seq))::BIGINT AS total FROM refs), wins AS (SELECT DISTINCT (o_orderkey * 7919) % total + 1 AS pos, 20 + o_orderkey % 200 AS len, total, substr(t, (o_orderkey * 7919) % total + 1, 20 + o_orderkey % 200) AS win FROM orders, ends WHERE o_orderkey % 10 <> 0), steps AS (SELECT win, pos, sum(brk) OVER (ORDER BY win, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM (SELECT win, pos, CASE WHEN starts_with(win, lag(win) OVER (ORDER BY win, pos)) THEN 0 ELSE 1 END AS brk FROM (SELECT DISTINCT win, pos FROM wins))), firsts AS (SELECT win, pos, first_value(pos) OVER (PARTITION BY grp ORDER BY win, pos) AS new_pos FROM steps), moved AS (SELECT wins.pos, len, total, new_pos FROM wins JOIN firsts ON firsts.win = wins.win AND firsts.pos = wins.pos) SELECT o_orderkey", 1).replace("(o_orderkey * 7919) % total + 1 AND moved", "(o_orderkey * 7919) % (SELECT total FROM ends) + 1 AND moved")
SQL["q53_table_from_alignment"] = _sql("SELECT ref_id::VARCHAR AS otu_id, sample, sum(n * times)::BIGINT AS n FROM placed JOIN (SELECT seq, sample, count(*) AS n FROM reads GROUP BY 1, 2) c ON c.seq = placed.seq WHERE NOT length(placed.seq) > start_off + bases - g_pos GROUP BY 1, 2", "reads", "best").replace(" SELECT ref_id::VARCHAR", ", rixes AS (SELECT seq, CASE WHEN (row_number() OVER (ORDER BY seq) - 1) % 3 = 0 THEN 2 ELSE 1 END AS times FROM uniq), placed AS (SELECT b.seq, b.times, b.g_pos, o.ref_id, o.start_off, length(o.seq) AS bases FROM (SELECT best.seq, times, g_pos FROM best JOIN rixes ON rixes.seq = best.seq) b ASOF JOIN (SELECT * FROM offs WHERE seq <> '') o ON b.g_pos >= o.start_off) SELECT ref_id::VARCHAR", 1)
_FAULTY = f"WITH w AS (SELECT doc_id, {_seq_sql(WITH_N)} AS s FROM documents), texts AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ['AC', s] WHEN doc_id % 11 = 0 THEN ['A C' || s] WHEN doc_id % 13 = 0 THEN ['AXC' || s] WHEN doc_id % 17 = 0 THEN [s || chr(13)] WHEN doc_id % 19 = 0 THEN ['>again', s] ELSE [s] END AS body FROM w WHERE s <> ''), lines AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS line, doc_id, value FROM (SELECT doc_id, unnest(range(len(body) + 1)) AS i, unnest(['>' || doc_id] || body) AS value FROM texts))"
SQL["q54_bad_lines"] = f"{_FAULTY} SELECT line, reason FROM (SELECT line, CASE WHEN title AND before THEN 'title after title' WHEN title THEN NULL WHEN regexp_matches(value, '[^ACGTNacgtn]') THEN 'letter' WHEN NOT before THEN 'sequence after sequence' END AS reason FROM (SELECT line, value, starts_with(value, '>') AS title, coalesce(lag(starts_with(value, '>')) OVER (ORDER BY line), false) AS before FROM lines)) WHERE reason IS NOT NULL"
SQL["q55_mended_fasta"] = f"{_FAULTY}, recs AS (SELECT line, value, sum(CASE WHEN starts_with(value, '>') THEN 1 ELSE 0 END) OVER (ORDER BY line) AS rec FROM lines) SELECT max(CASE WHEN starts_with(value, '>') THEN substr(value, 2) END) AS read_id, coalesce(string_agg(CASE WHEN NOT starts_with(value, '>') THEN rtrim(value, chr(13)) END, '' ORDER BY line), '') AS seq FROM recs GROUP BY rec"
SQL["q56_otu_map_file"] = _sql("SELECT ref_id AS otu_id, row_number() OVER (PARTITION BY ref_id ORDER BY read_id) - 1 AS place, read_id FROM reads JOIN best ON reads.seq = best.seq", "reads", "best")
#: Clean reads and their representatives, those that denoising leaves, their best hits, and what became of them.
SQL["q57_run_counters"] = (
    f"WITH nreads AS ({_CTE['nreads']}), refs AS ({_CTE['refs']}), offs AS ({_CTE['offs']}), kc AS MATERIALIZED ({_CTE['kc'].replace('{src}', 'nreads')}), clean AS (SELECT seq FROM nreads WHERE NOT regexp_matches(seq, '[^ACGT]')), "
    f"creps AS ({_CTE['reps'].replace('uniq', '(SELECT DISTINCT seq FROM clean)')}), grouped AS (SELECT rep AS seq, count(*) AS copies FROM clean JOIN creps ON creps.seq = clean.seq GROUP BY rep), "
    f"mins AS (SELECT seq, min(coalesce(n, 0)) AS m FROM (SELECT seq, substr(seq, (i * {K} + 1)::BIGINT, {K}) AS word FROM (SELECT seq, unnest(range(length(seq) // {K})) AS i FROM grouped)) x LEFT JOIN kc ON kc.kmer = word GROUP BY seq), "
    f"uniq AS MATERIALIZED (SELECT g.seq, copies FROM grouped g LEFT JOIN mins ON mins.seq = g.seq WHERE copies > 1 OR coalesce(m, 4611686018427387904) >= 3), pieces AS ({_CTE['pieces'].replace('{gap}', '(1 - 0.97::DOUBLE)')}), words AS ({_CTE['words']}), hits AS ({_CTE['hits']}), best AS ({_CTE['best']}), chim AS ({_CTE['chim']}) "
    "SELECT r.*, (SELECT count(DISTINCT seq) FROM clean) AS n_distinct, (SELECT sum(n)::BIGINT FROM kc) AS n_kmers, (SELECT count(*) FROM kc) AS n_distinct_kmers, (SELECT count(*) FROM uniq) AS n_sequences, (SELECT sum(copies)::BIGINT FROM uniq) AS n_committed, (SELECT count(*) FROM clean) - (SELECT sum(copies)::BIGINT FROM uniq) AS n_rejected, count(*) FILTER (is_chimera) AS n_chimeras, count(*) FILTER (NOT is_chimera) AS n_assigned, coalesce(sum(copies) FILTER (NOT is_chimera), 0)::BIGINT AS n_expanded FROM chim JOIN uniq ON uniq.seq = chim.seq, "
    "(SELECT count(*) AS n_reads, count(*) FILTER (regexp_matches(seq, '[^ACGT]')) AS n_ambiguous, sum(length(regexp_replace(seq, '[ACGT]', '', 'g')))::BIGINT AS ambiguous_bases, count(DISTINCT coalesce(sample, '(none)')) AS n_samples FROM nreads) r GROUP BY ALL"
)
#: The full run: representatives are aligned, windows compacted, positions looked up, chimeras dropped.
SQL["q48_full_run"] = (
    _sql("SELECT o.ref_id::VARCHAR AS otu_id, sample, count(*) AS n, coalesce(any_value(taxonomy), 'UNSUPPORTED_MAPPING') AS taxonomy FROM reads JOIN ureps ON ureps.seq = reads.seq JOIN placed ON placed.seq = ureps.rep JOIN (SELECT ref_id, start_off, length(seq) AS n_bases FROM offs) o ON o.start_off = placed.start_off LEFT JOIN tax ON tax.otu_id = o.ref_id WHERE o.n_bases > 0 AND NOT length(placed.seq) > placed.start_off + o.n_bases - new_pos GROUP BY 1, 2", "reads", "reps", "best", "tax")
    .replace("pieces AS (", "ureps AS (SELECT * FROM reps), pieces AS (", 1)
    .replace(" SELECT o.ref_id::VARCHAR", ", hw AS (SELECT best.seq, g_pos AS pos, substr(refs.seq, best.pos::BIGINT, length(best.seq)) AS win FROM best JOIN refs ON refs.ref_id = best.ref_id), moved AS (SELECT win, pos, first_value(pos) OVER (PARTITION BY grp ORDER BY win, pos) AS new_pos FROM (SELECT win, pos, sum(brk) OVER (ORDER BY win, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM (SELECT win, pos, CASE WHEN starts_with(win, lag(win) OVER (ORDER BY win, pos)) THEN 0 ELSE 1 END AS brk FROM (SELECT DISTINCT win, pos FROM hw)))), placed AS (SELECT m.seq, new_pos, f.start_off FROM (SELECT hw.seq, moved.new_pos FROM hw JOIN moved ON moved.win = hw.win AND moved.pos = hw.pos) m ASOF JOIN (SELECT start_off FROM offs WHERE seq <> '') f ON m.new_pos >= f.start_off) SELECT o.ref_id::VARCHAR", 1)
    .replace("floor((1 - 0.97::DOUBLE) * length(seq) + 1e-9)::BIGINT AS e FROM uniq)", "floor((1 - 0.97::DOUBLE) * length(seq) + 1e-9)::BIGINT AS e FROM (SELECT DISTINCT rep AS seq FROM reps))", 1)
)
