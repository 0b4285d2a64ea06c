"""Text in a given order: folders of part files, lines that are streams of many rows, and single files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.operators.ordered import by_range, earlier, of_ranges, ranges

#: File systems on which part files become one file without being read.
JOINS_BLOCKS = ("hdfs", "webhdfs", "swebhdfs")


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Column value as text files that, read in order of their names, follow the given order."""
    lines.orderBy(*order).select("value").write.text(path)


def write_streams(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """A line for each value of the keys (ascending, not null): column value of its rows in the given order, a tab behind each.

    No line is ever put together: a row is a record that ends with a tab, and the first of each line but the very
    first begins with a line feed. So a line may be longer than any machine's memory, and it may span part files; only
    the line feed behind the last line is left to ``join_files``.
    """
    rows = rows.select(*keys, *order, "value", F.monotonically_increasing_id().alias("_at"))
    key = F.struct(*keys)
    rows = of_ranges(ranges(rows, *keys, *order, "_at"), F.max(key), F.lag("_before").over(by_range()), "_before")
    inside = Window.partitionBy("range").orderBy(*keys, *order, "_at")
    before = F.coalesce(F.lag(key).over(inside), "_before")
    value = F.when(before.isNull() | (before == key), F.col("value")).otherwise(F.concat(F.lit("\n"), "value"))
    rows.withColumn("value", value).orderBy(*keys, *order, "_at").select("value").write.option("lineSep", "\t").text(path)


def join_files(spark: SparkSession, folder: str, target: str, head: str = "", end: str = "", drop_last: int = 0) -> None:
    """Makes one file of a folder's part files in order of their names, and deletes the folder.

    head and end are short texts around it; drop_last bytes of each part are left out. Where the file system can join
    the blocks of files it does so and no byte is read; else the bytes are copied file by file through a buffer.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, made = hadoop.fs.Path(folder), hadoop.fs.Path(target)
    fs = source.getFileSystem(conf)
    parts = sorted((s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-") and s.getLen() > drop_last), key=lambda p: p.getName())
    if fs.getScheme() in JOINS_BLOCKS and parts and not (head or end or drop_last):
        fs.rename(parts[0], made)
        if parts[1:]:
            rest = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(parts) - 1)
            for i, p in enumerate(parts[1:]):
                rest[i] = p
            fs.concat(made, rest)
    else:
        out = fs.create(made, True)
        out.write(bytearray(head.encode()))
        for p in parts:
            read = fs.open(p)
            some = spark._jvm.org.apache.commons.io.input.BoundedInputStream(read, fs.getFileStatus(p).getLen() - drop_last)
            hadoop.io.IOUtils.copyBytes(some, out, 1 << 20, False)
            read.close()
        out.write(bytearray(end.encode()))
        out.close()
    fs.delete(source, True)


def write_file(lines: DataFrame, path: str, *order: str) -> None:
    """Like write_lines, as one file."""
    write_lines(lines, f"{path}-parts", *order)
    join_files(lines.sparkSession, f"{path}-parts", path)


def write_stream_file(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Like write_streams, as one file."""
    write_streams(rows, f"{path}-parts", keys, order)
    join_files(rows.sparkSession, f"{path}-parts", path, end="\n")


def read_stream_file(spark: SparkSession, path: str) -> DataFrame:
    """line, place, value: a row for each record of a file of write_stream_file but the first of its line, which is ``line``; ``place`` counts the others from 0.

    Records end at tabs, so the file is cut anywhere and no task holds a line. What goes before a range, and the line
    begun last, are carried over.
    """
    rows = spark.read.option("lineSep", "\t").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    order = Window.partitionBy("range").orderBy("block", "at")
    rows = of_ranges(ranges(rows, "block", "at"), F.count(F.lit(1)), F.coalesce(F.sum("before").over(earlier()), F.lit(0)), "before")
    rows = rows.withColumn("no", F.col("before") + F.row_number().over(order))
    text = F.regexp_replace("value", "^\n", "").alias("text")
    rows = rows.withColumn("begun", F.when((F.col("no") == 1) | F.col("value").startswith("\n"), F.struct("no", text)))
    rows = of_ranges(rows, F.max("begun"), F.last("carried", ignorenulls=True).over(earlier()), "carried")
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("line", F.coalesce(F.last("begun", ignorenulls=True).over(inside), "carried")).filter("begun IS NULL")
    return rows.select(F.col("line.text").alias("line"), (F.col("no") - F.col("line.no") - 1).alias("place"), "value")


def write_one_line(pieces: DataFrame, path: str, head: str, *order: str) -> None:
    """head, a line feed, and then all of column value in order on one line, as one file.

    What is joined in memory is the values of a range, a small share of all.
    """
    rows = ranges(pieces.select(*order, "value"), *order)
    parts = F.array_sort(F.collect_list(F.struct(*order, "value")))
    texts = rows.groupBy("range").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("value"))
    texts.orderBy("range").select("value").write.option("maxRecordsPerFile", 1).text(f"{path}-parts")
    join_files(pieces.sparkSession, f"{path}-parts", path, head=head + "\n", end="\n", drop_last=1)


def first_bytes(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """The first byte of each file (-1 for none); the driver opens them one after the other."""
    found = {}
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
        found[path] = stream.read()
        stream.close()
    return found
