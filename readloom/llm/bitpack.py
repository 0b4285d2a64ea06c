"""Token ids in fixed-width bit packing.

Texts are range-partitioned by id, encoded, and cut into blocks of whole documents of about ``block_ids`` ids.
A block is a row of a Parquet file: its number within its shard, the documents' ids and lengths, and the payload,
in which each id takes the minimum number of bits of the vocabulary, high bit first. A second table has the
global position of each shard's first id, so any block can be found and unpacked with numpy by itself; with
all ids of one width, id k of a block starts at bit k * width.

Rules: null text is empty and yields the end id alone; ids ascend, null ids first; rows with equal id are ordered
by their text. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import new_path, partitions
from readloom.llm.textbatch import slices, tidy

BLOCK = "shard int, block int, n_ids long, first long, width int, doc_ids array<long>, lengths array<int>, payload binary"


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint32) >> np.arange(width - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack_bits(payload: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """Ids start .. start + n of a block."""
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(payload, f">u{size}", n, start * size).astype(np.uint32)
    low, high = start * width // 8, -(-(start + n) * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low))[start * width - 8 * low :][: n * width]
    return bits.reshape(n, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width - 1, -1, -1, dtype=np.uint32))


#: A letter, then ASCII punctuation other than an apostrophe up to a blank or the end: the tokenizer always cuts between the two.
LETTER_STOP = r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~]+)([ \x09-\x0d]|\z)"


#: A word that neither the normaliser nor the splitter of the tokenizer changes.
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes | None) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordCache:
    """Ids of words that white space separates, each encoded once.

    Valid for byte-level tokenizers that lower-case, drop white space, and keep a run of letters in one piece; see
    ``splits_at_spaces``.
    """

    def __init__(self, definition: str, end_id: int, most: int = 600_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.end_id, self.most = Tokenizer.from_str(definition), end_id, most
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers({None: 0})  # the end of a text
        self.numbers.new = []
        self.flat, self.starts, self.lengths = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def learn(self) -> None:
        """Encodes the words that have a number but no ids yet."""
        known, texts = len(self.starts), [w.decode("utf-8", "replace") for w in self.numbers.new]
        plain = np.fromiter(map(bool, map(LETTERS.fullmatch, texts)), bool, len(texts))
        for tokenizer, these in ((self.letters, np.flatnonzero(plain)), (self.tokenizer, np.flatnonzero(~plain))):
            encoded = [e.ids for e in tokenizer.encode_batch_fast([texts[i] for i in these.tolist()], add_special_tokens=False)]
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self._append(these + known, np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum())), lengths, known + len(texts))
        self.numbers.new = []

    def _append(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray, total: int) -> None:
        if len(self.starts) < total:
            more = np.zeros(total - len(self.starts), np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        self.starts[numbers] = len(self.flat) + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8 bytes), an end id after each, and the number of ids of each text."""
        if len(self.numbers) > self.most:
            self.clear()
        texts = texts.view(pa.string())
        # Texts that may hold a special token stay as they are, as capitals and blanks decide whether it is one.
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), LETTER_STOP, r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, cut))
        words, of = split.flatten(), np.repeat(np.arange(len(split)), pc.list_value_length(split))
        full = pc.greater(pc.binary_length(words), 0)
        counts = np.bincount(of[np.asarray(full)], minlength=len(split))
        coded = words.filter(full).dictionary_encode()
        distinct = coded.dictionary.view(pa.binary()).to_pylist()
        numbers = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        if self.numbers.new:
            self.learn()
        numbers = np.insert(numbers, np.cumsum(counts), 0)
        ends = np.cumsum(self.lengths[numbers])[np.cumsum(counts + 1) - 1]
        return self.ids_of(numbers), np.diff(ends, prepend=0)


#: The pattern of the one kind of splitter that the word cache knows.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_spaces(definition: str) -> bool:
    """Whether a tokenizer's definition is of the kind whose ids can be put together word by word."""
    parts = json.loads(definition)
    norm, pre = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm])
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if {"type": "Lowercase"} not in steps or any(x not in ({"type": "NFC"}, {"type": "Lowercase"}, spaces) for x in steps):
        return False
    split, *rest = pre.get("pretokenizers", [pre])
    if split != {"type": "Split", "pattern": {"Regex": KNOWN_SPLIT}, "behavior": "Removed", "invert": True} or len(rest) != 1:
        return False
    return rest[0]["type"] == "ByteLevel" and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex") and parts.get("truncation") is None


class WholeTexts:
    """Ids of whole texts by the tokenizer itself, for any other tokenizer."""

    def __init__(self, definition: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id = Tokenizer.from_str(definition), end_id

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encoded = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch_fast(texts.view(pa.string()).to_pylist(), add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum())), lengths


@lru_cache(maxsize=1)
def encoder(definition: str, end_id: int) -> WordCache | WholeTexts:
    """A Python worker keeps its encoder from task to task."""
    return (WordCache if splits_at_spaces(definition) else WholeTexts)(definition, end_id)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 16) -> str:
    """Writes ``path/blocks`` and ``path/shards``; returns path. The driver sees one number per shard.

    Only the driver opens the file ``tokenizer``; executors get the definition, which has the size of the vocabulary.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    width = max(1, (Tokenizer.from_str(definition).get_vocab_size(True) - 1).bit_length())
    shared = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard, block, first = encoder(shared.value, end_id), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(1)))
            for low, high in slices(sizes, 4 << 20):
                ids, lengths = cache.encode(batch.column(1).slice(low, high - low))
                ends, keys = np.cumsum(lengths), batch.column(0).slice(low, high - low)
                cut = np.flatnonzero(np.diff(ends // block_ids, prepend=0))
                for a, b in zip([0, *cut], [*cut, len(ends)], strict=True):
                    if a < b:
                        part = ids[ends[a] - lengths[a] : ends[b - 1]]
                        yield pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "n_ids": len(part), "first": first, "width": width, "doc_ids": keys.slice(a, b - a).to_pylist(), "lengths": lengths[a:b].tolist(), "payload": pack_bits(part, width)}], schema=ARROW_BLOCK)
                        block, first = block + 1, first + len(part)

    rows.mapInArrow(tidy(encode), BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    start, shards = 0, []
    for shard, n in sizes:
        shards.append((shard, start))
        start += n
    spark.createDataFrame(shards, "shard int, shard_start long").coalesce(1).write.parquet(f"{path}/shards")
    return path


ARROW_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("first", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids, of every document in the files.

    The table of shards has one row per file and is broadcast, as are file lists by Spark itself.
    """
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                row = {k: batch.column(k)[b] for k in ("n_ids", "width", "payload", "start", "lengths", "doc_ids")}
                lengths = row["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                raw = unpack_bits(row["payload"].as_py(), row["width"].as_py(), row["n_ids"].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                parts = [raw[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                columns = [row["doc_ids"].values, pa.array(row["start"].as_py() + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))] * with_ids, schema=pa.schema(fields))

    rows = blocks.select("doc_ids", "lengths", "n_ids", "width", "payload", (F.col("shard_start") + F.col("first")).alias("start"))
    return rows.mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(spark, write_ids(docs, new_path(spark, "ids"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))
