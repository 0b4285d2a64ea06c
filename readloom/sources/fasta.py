"""FASTA and alignment text as DataFrames, and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.sequences import read_id_of, sample_of, taxonomy_levels
from readloom.operators.ordered import by_range, number, of_ranges, ranges
from readloom.operators.otu import NO_SAMPLE, UNMAPPED, count_lines, decode_count_lines
from readloom.sources.files import first_bytes, write_file
from readloom.tables import materialise

SAM = "rix LONG, flag INT, rname STRING, pos LONG, mapq INT, cigar STRING, rnext STRING, pnext LONG, tlen INT, seq STRING, qual STRING"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, seq, n_lines. A record ends where the next line starts with >; sequence lines are joined."""
    records = spark.read.option("lineSep", "\n>").text(path).filter("trim(value) <> ''")
    return _records(records)


def _records(records: DataFrame, *others: str) -> DataFrame:
    lines = F.transform(F.split(F.regexp_replace("value", "^>", ""), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    body = F.filter(F.slice("lines", 2, 2**30), lambda x: x != "")
    return records.select(lines.alias("lines"), *others).select(F.element_at("lines", 1).alias("header"), F.array_join(body, "").alias("seq"), F.size(body).alias("n_lines"), *others)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """Like read_fasta, with ord, the record's number in order of file name and place in the file."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    records = spark.read.option("lineSep", "\n>").text(path).select("value", *place).filter("trim(value) <> ''")
    return number(_records(records, "file", "block", "at"), "ord", "file", "block", "at").drop("file", "block", "at")


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """ord, read_id, sample, seq, seq2: records of two files matched by their place; the second's headers are not used.

    A file that is longer than the other stops the job.
    """
    one = read_numbered(spark, first).select("ord", "header", F.upper("seq").alias("seq"))
    two = read_numbered(spark, second).select("ord", F.upper("seq").alias("seq2"))
    both = one.join(two, "ord", "full")
    alone = F.raise_error(F.concat(F.lit("no mate for record "), F.col("ord").cast("string")))
    header = F.when(F.col("seq").isNotNull() & F.col("seq2").isNotNull(), F.col("header")).otherwise(alone)
    return both.select("ord", read_id_of(header).alias("read_id"), sample_of(header).alias("sample"), "seq", "seq2")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """read_id, sample, seq of strict two-line records: a header line that begins with >, then one line of sequence, which may be empty.

    A file that begins otherwise, and a record with another number of sequence lines, stop the job. A header that ends
    its file counts as one with an empty sequence.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    for file, byte in first_bytes(spark, records.inputFiles()).items():
        if byte not in (-1, ord(">")):
            raise ValueError(f"{file} does not begin with >")
    lines = F.transform(F.split(F.regexp_replace("value", "^>", ""), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    rows = records.filter("value <> ''").select(lines.alias("lines")).withColumn("header", F.element_at("lines", 1))
    ended = (F.size("lines") == 3) & (F.element_at("lines", -1) == "")  # the file's last line feed
    seq = F.when((F.size("lines") == 2) | ended, F.upper(F.get("lines", 1))).otherwise(F.raise_error(F.concat(F.lit("not one line of sequence: "), F.col("header"))))
    return rows.select(read_id_of(F.col("header")).alias("read_id"), sample_of(F.col("header")).alias("sample"), seq.alias("seq"))


def write_fasta(rows: DataFrame, path: str, name: str = "rix", seq: str = "seq") -> None:
    rows.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq))).write.text(path)


def validate_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Offending records with a reason: no or several sequence lines, blanks, letters other than A C G T N."""
    rows = read_fasta(spark, path)
    reason = F.when(F.col("n_lines") != 1, "sequence lines").when(F.col("seq").rlike(r"\s"), "blank").when(~F.col("seq").rlike("^[ACGTNacgtn]*$"), "letter")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select("header", "reason")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, reason of lines that break the alternation of header and sequence, or hold a letter other than A C G T N.

    A line is judged by the one before it, as if all were right up to there; the first bad line is so the one at
    which a reader that goes line by line would stop. A carriage return is a letter; an empty line is a sequence.
    """
    rows = numbered_lines(spark, path, keep_returns=True)
    rows = rows.withColumn("title", F.col("value").startswith(">"))
    rows = of_ranges(ranges(rows.select("line", "value", "title"), "line"), F.max_by("title", "line"), F.lag("_before").over(by_range()), "_before")
    before = F.coalesce(F.lag("title").over(Window.partitionBy("range").orderBy("line")), "_before", F.lit(False))
    reason = F.when(F.col("title") & before, "title after title").when(F.col("title"), F.lit(None)).when(F.col("value").rlike("[^ACGTNacgtn]"), "letter").when(~before, "sequence after sequence")
    return rows.select("line", reason.alias("reason")).filter("reason IS NOT NULL")


def mend_fasta(spark: SparkSession, path: str, target: str) -> None:
    """Writes the file's records anew in order, each as a header line and one line of sequence, as one file."""
    records = spark.read.option("lineSep", "\n>").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = F.transform(F.split(F.regexp_replace("value", "^>", ""), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = records.select(lines.alias("lines"), *place).filter("array_join(lines, '') <> ''")
    value = F.concat(F.lit(">"), F.element_at("lines", 1), F.lit("\n"), F.array_join(F.slice("lines", 2, 2**30), ""))
    write_file(rows.select("file", "block", "at", value.alias("value")), target, "file", "block", "at")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed fields and the rest as tags; header lines are left out, unaligned rows (rname *) kept."""
    parts = F.split("value", "\t")
    names = [x.split() for x in SAM.split(", ")]
    fixed = [F.expr(f"try_cast(parts[{i}] AS {kind})").alias(name) for i, (name, kind) in enumerate(names)]
    rows = spark.read.text(path).filter("value <> '' AND NOT startswith(value, '@')").select(parts.alias("parts"))
    return rows.select(*fixed, F.array_join(F.slice("parts", 12, 2**30), "\t").alias("tags"))


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples (sample, ix) and counts (rix, ix, n) of one file: the number of samples, their names, then a count line per sequence."""
    lines = materialise(numbered_lines(spark, path), "count-lines")
    first = lines.filter("line = 1").first()
    if first is None or not first["value"].strip().isdecimal():
        raise ValueError(f"{path} does not begin with the number of samples")
    n = int(first["value"])
    samples = lines.filter((F.col("line") > 1) & (F.col("line") <= n + 1)).select(F.col("value").alias("sample"), (F.col("line") - 2).alias("ix"))
    counts = decode_count_lines(lines.filter(F.col("line") > n + 1).select((F.col("line") - n - 2).alias("rix"), F.col("value").alias("line")))
    return samples, counts


def write_counts(counts: DataFrame, samples: DataFrame, path: str) -> None:
    """The file that read_counts reads, of counts (rix, sample, n); rix numbers all sequences from 0."""
    n = samples.count()
    head = samples.sparkSession.createDataFrame([(0, 0, str(n))], "section int, i long, value string")
    rows = head.union(samples.select(F.lit(1), F.col("ix"), F.col("sample"))).union(count_lines(counts, samples).select(F.lit(2), F.col("rix"), F.col("line")))
    write_file(rows, path, "section", "i")


def write_sam(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", *[F.coalesce(F.col(x.split()[0]).cast("string"), F.lit("*")) for x in SAM.split(", ")])).write.text(path)


def numbered_lines(spark: SparkSession, path: str, keep_returns: bool = False) -> DataFrame:
    """line (from 1, in order of file name and place), value: lines end at line feeds alone; a carriage return before one is dropped, if not kept."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    rows = number(spark.read.option("lineSep", "\n").text(path).select("value", *place), "line", "file", "block", "at")
    return rows.select((F.col("line") + 1).alias("line"), (F.col("value") if keep_returns else F.regexp_replace("value", "\r$", "")).alias("value"))


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """otu_id, start_off: the number behind the line's last tab, so that quotes and tabs of an id stay."""
    line = F.regexp_replace("value", "\r$", "")
    rows = spark.read.option("lineSep", "\n").text(path).select(F.regexp_extract(line, "^(.*)\t([0-9]+)$", 1).alias("otu_id"), F.regexp_extract(line, "^(.*)\t([0-9]+)$", 2).alias("off"), "value").filter("value <> ''")
    off = F.when(F.col("off") != "", F.col("off").cast("long")).otherwise(F.raise_error(F.concat(F.lit("no offset in line "), "value")))
    return rows.select("otu_id", off.alias("start_off"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("otu_id STRING, taxonomy STRING").option("sep", "\t").option("quote", "").csv(path)


def biom_rows(table: DataFrame, taxonomy: DataFrame | None, samples: DataFrame, order: DataFrame) -> DataFrame:
    """One row per OTU of a sparse BIOM 1.0 table in database order: r, otu_id, JSON of its row entry, JSON of its data triples.

    ``samples`` (sample, ix) numbers the columns; rows are numbered densely in order of ``order`` (otu_id, ref_ord).
    Without taxonomy the rows' metadata are null.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.col("ix").alias("c"), F.col("n").alias("n"))))
    named = table.withColumn("sample", F.coalesce("sample", F.lit(NO_SAMPLE))).join(samples, "sample")
    rows = named.groupBy("otu_id").agg(cells.alias("cells")).join(order, "otu_id")
    metadata = F.lit(None).cast("struct<taxonomy: array<string>>")
    if taxonomy is not None:
        rows = rows.join(taxonomy, "otu_id", "left")
        metadata = F.struct(taxonomy_levels(F.coalesce("taxonomy", F.lit(UNMAPPED))).alias("taxonomy"))
    rows = number(rows, "r", "ref_ord")
    entry = F.to_json(F.struct(F.col("otu_id").cast("string").alias("id"), metadata.alias("metadata")), {"ignoreNullFields": "false"})
    data = F.array_join(F.transform("cells", lambda x: F.concat(F.lit("["), F.col("r").cast("string"), F.lit(","), x["c"].cast("string"), F.lit(","), x["n"].cast("string"), F.lit("]"))), ",")
    return rows.select("r", "otu_id", entry.alias("entry"), data.alias("data"))


def biom_lines(rows: DataFrame, samples: DataFrame, date: str) -> DataFrame:
    """section, r, value: the lines of the BIOM document in that order. Nothing but two counts passes through the driver."""
    shape = f"[{rows.count()},{samples.count()}]"
    head = f'{{"id":null,"format":"Biological Observation Matrix 1.0.0","format_url":"http://biom-format.org","type":"OTU table","generated_by":"readloom","date":"{date}","matrix_type":"sparse","matrix_element_type":"int","shape":{shape},"rows":['
    listed = lambda df, section, n, value: df.select(F.lit(section).alias("section"), F.col(n).alias("r"), F.concat(F.when(F.col(n) > 0, ",").otherwise(""), value).alias("value"))
    columns = F.to_json(F.struct(F.col("sample").alias("id"), F.lit(None).cast("string").alias("metadata")), {"ignoreNullFields": "false"})
    fixed = rows.sparkSession.createDataFrame([(0, 0, head), (2, 0, '],"columns":['), (4, 0, '],"data":['), (6, 0, "]}")], "section int, r long, value string")
    return fixed.union(listed(rows, 1, "r", F.col("entry"))).union(listed(samples, 3, "ix", columns)).union(listed(rows, 5, "r", F.col("data")))
