"""A reference database as files: concatenated FASTA, offset map, taxonomy, compressed text.

``folder/name/`` holds ``name.fa`` (one record, all references end to end on one line), ``name.db`` (id, offset) and
``name.taxonomy`` (id, levels; may be missing) as single files, and ``name.tcf`` (blocks of codes) and ``name.refs`` (for
joins) as Parquet. ``python -m readloom.sources.database_files references.fna folder name [taxonomy]`` builds one.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.database import concat_offsets, drop_empty_headers
from readloom.sources.fasta import read_numbered, read_offsets, read_taxonomy
from readloom.sources.files import write_file, write_one_line
from readloom.sources.lzw import compress_references

#: Unknown bases on each side of a gap between references, if spacers are asked for.
SPACER = 50


@dataclass
class Database:
    references: DataFrame  # ref_ord, ref_id, seq, start_off, end_off, next_off
    offsets: DataFrame  # otu_id, start_off, as the map file has them
    taxonomy: DataFrame | None  # otu_id, taxonomy


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """ref_ord, ref_id (the whole header line), seq of reference FASTA; sequences may have many lines."""
    rows = drop_empty_headers(read_numbered(spark, path).select("ord", "header", "seq"))
    return rows.select(F.col("ord").alias("ref_ord"), F.col("header").alias("ref_id"), F.upper("seq").alias("seq"))


def write_database(refs: DataFrame, folder: str, name: str, taxonomy: DataFrame | None = None, spacer: int = 0, compress: bool = True) -> str:
    """Writes refs (ref_ord, ref_id, seq); returns the database's folder."""
    top = f"{folder.rstrip('/')}/{name}/{name}"
    rows = concat_offsets(refs, spacer)
    rows.write.parquet(f"{top}.refs")
    rows = refs.sparkSession.read.parquet(f"{top}.refs")
    gap = "N" * spacer
    write_one_line(rows.select("ref_ord", F.concat(F.lit(gap), "seq", F.lit(gap)).alias("value")), f"{top}.fa", f">{name}", "ref_ord")
    write_file(rows.select("ref_ord", F.concat_ws("\t", F.col("ref_id").cast("string"), F.col("start_off").cast("string")).alias("value")), f"{top}.db", "ref_ord")
    if compress:
        compress_references(rows).write.parquet(f"{top}.tcf")
    if taxonomy is not None:
        write_file(taxonomy.select("otu_id", F.concat_ws("\t", F.col("otu_id").cast("string"), "taxonomy").alias("value")), f"{top}.taxonomy", "otu_id")
    return top.rsplit("/", 1)[0]


def open_database(spark: SparkSession, folder: str, name: str) -> Database:
    """The database called name below folder; without a taxonomy file its taxonomy is None."""
    top = f"{folder.rstrip('/')}/{name}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}.taxonomy")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    taxonomy = read_taxonomy(spark, f"{top}.taxonomy") if there else None
    return Database(spark.read.parquet(f"{top}.refs"), read_offsets(spark, f"{top}.db"), taxonomy)


def main() -> None:
    parser = argparse.ArgumentParser(prog="readloom-database")
    for name in ("references", "folder", "name"):
        parser.add_argument(name)
    parser.add_argument("taxonomy", nargs="?")
    parser.add_argument("--spacer", type=int, default=0, help=f"unknown bases on each side of a gap, usually {SPACER}")
    parser.add_argument("--compress", action=argparse.BooleanOptionalAction, default=True)
    a = parser.parse_args()
    spark = SparkSession.builder.appName("readloom-database").getOrCreate()
    taxonomy = read_taxonomy(spark, a.taxonomy) if a.taxonomy else None
    write_database(read_references(spark, a.references), a.folder, a.name, taxonomy, a.spacer, a.compress)


if __name__ == "__main__":
    main()
