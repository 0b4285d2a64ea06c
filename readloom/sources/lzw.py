"""Sixteen-bit LZW codes of reference text, as tables of blocks and as files for exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: References of one block: a block is one code stream, coded and decoded in one task.
BLOCK = 64

#: Fixed values of the format: 256 single bytes first, at most 65,535 codes, then the dictionary stays as it is.
FIRST, MOST = 256, 65_535


def compress(data: bytes) -> bytes:
    known = {bytes([i]): i for i in range(FIRST)}
    codes, held = [], b""
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in known:
            held = longer
            continue
        codes.append(known[held])
        if len(known) < MOST:
            known[longer] = len(known)
        held = data[i : i + 1]
    if held:
        codes.append(known[held])
    return np.asarray(codes, "<u2").tobytes()


def decompress(data: bytes) -> bytes:
    known = [bytes([i]) for i in range(FIRST)]
    out: list[bytes] = []
    for code in np.frombuffer(data, "<u2").tolist():
        if code < len(known):
            word = known[code]
        else:  # the word that is just being defined
            word = out[-1] + out[-1][:1]
        if out and len(known) < MOST:
            known.append(out[-1] + word[:1])
        out.append(word)
    return b"".join(out)


def _map_column(df: DataFrame, name: str, function, kind: pa.DataType, sql: str) -> DataFrame:
    """df (key, payload) with a function of the payload in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([function(batch.column(1)[i].as_py())], kind)], names=["key", name])

    return df.mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, {name} {sql}")


def compress_references(refs: DataFrame) -> DataFrame:
    """key (the block's number), payload: codes of the FASTA text of ``BLOCK`` consecutive references (ref_ord, ref_id, seq)."""
    record = F.concat(F.lit(">"), F.col("ref_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n"))
    texts = refs.groupBy(F.floor(F.col("ref_ord") / BLOCK).alias("key")).agg(F.array_sort(F.collect_list(F.struct("ref_ord", record.alias("text")))).alias("x"))
    texts = texts.select("key", F.array_join(F.transform("x", lambda x: x["text"]), "").cast("binary").alias("payload"))
    return _map_column(texts, "payload", compress, pa.binary(), "binary")


def read_compressed(blocks: DataFrame) -> DataFrame:
    """key, header, seq of the records in code streams (key, payload)."""
    texts = _map_column(blocks, "text", lambda x: decompress(x).decode(), pa.string(), "string")
    records = texts.select("key", F.explode(F.split(F.regexp_replace("text", "^>", ""), "\n>")).alias("record"))
    lines = F.split("record", "\n")
    return records.select("key", F.element_at(lines, 1).alias("header"), F.array_join(F.slice(lines, 2, 2**30), "").alias("seq"))


def read_compressed_files(spark: SparkSession, path: str) -> DataFrame:
    """key (the file's path), header, seq of files of one code stream each."""
    return read_compressed(spark.read.format("binaryFile").load(path).select(F.col("path").alias("key"), F.col("content").alias("payload")))
