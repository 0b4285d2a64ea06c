"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of each text: ``h = 2 h + gear[byte]`` modulo 2^16, so it depends on the last
16 bytes. A chunk ends after a byte whose hash has ``CUT_BITS`` leading zeros, unless another such byte is among
the ``MIN_GAP`` before it; boundaries therefore depend on nearby bytes alone and an insertion moves no
boundary beyond its neighbourhood. Stretches of over ``LONG`` bytes without a boundary, as in a word said over and
over, are cut after bytes whose hash is the least of ``SPAN`` and those before it; where such bytes come at a steady
pace with one hash, several periods make a chunk. What is still longer is cut every ``MAX_CHUNK`` bytes. Cuts move
forward to the start of a character. Chunks are equal when their 128-bit BLAKE2b digests are; the smallest id
that holds a chunk owns it and every other occurrence is a repeat.

Only digests of chunks travel, first to find owners (summed inside map tasks), then to meet them again. A chunk that
very many texts hold is dealt over several keys in that join, its owner repeated for each. A row's chunks then meet in
its runs; they are about as large as its text. A common passage ends somewhere in the chunks beside its run, so a run
of ``min_bytes`` is reported if ``min_words`` words touch it, these two chunks and a few bytes more, or if it has ``long_bytes`` itself.

Rules: null and empty texts have no chunks; repeats within one text lengthen a run when they follow the first
occurrence, and are reported by themselves with ``within`` only; rows with a null id are not compared. Of rows with equal id and different texts, the one with the smaller hash of its
text comes first; rows with equal id and text are one document, met twice: each has the same runs. A text is known by
its id, or id and hash where ids repeat, never by its place in a task, so a task that runs again changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import materialise, spread
from readloom.llm.textbatch import mix, tidy

CUT_BITS, MIN_GAP, MAX_CHUNK = 4, 12, 512
LONG, SPAN = 64, 32
#: Passages of over 50 words; bytes decide where a text has no blanks.
MIN_BYTES, MIN_WORDS, LONG_BYTES = 64, 51, 1024
#: How far into a passage what stands before it can move a cut, in bytes: the hash's memory and ``MIN_GAP``.
SLACK = 16 + MIN_GAP
#: Occurrences of a chunk that share a key; at least so many (or 1 / MAX_HOT of all) make a chunk hot.
HOT, MAX_HOT = 10_000, 4096
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def _least(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cuts inside stretches of the hashes that have no boundary."""
    low = np.maximum(starts - SPAN, 0)
    sizes = ends - low
    place = np.repeat(low - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    own = least = h[place]
    for step in (1, 2, 4, 8, 16):  # of 32 hashes, the own one last; the first of a stretch, which see less, are not used
        least = np.concatenate([least[:step], np.minimum(least[step:], least[:-step])])
    which = np.repeat(np.arange(len(sizes)), sizes)
    found = np.flatnonzero((own == least) & (place >= starts[which] + MIN_GAP) & (place < ends[which] - MIN_GAP))
    at, own, which = place[found], own[found], which[found]
    if not len(at):
        return at
    gaps = np.diff(at)
    same = (own[1:] == own[:-1]) & (gaps < SPAN) & (which[1:] == which[:-1])
    steady = same.copy()
    steady[1:] &= (gaps[1:] == gaps[:-1]) | ~same[:-1]
    head = np.append(True, ~steady)  # a steady run's first byte
    heads, run = np.flatnonzero(head), np.cumsum(head) - 1
    pace = np.append(np.where(steady, gaps, SPAN), SPAN)[heads]
    return at[(np.arange(len(at)) - heads[run]) % -(-SPAN // pace[run]) == 0] + 1


def boundaries(data: bytes) -> np.ndarray:
    """End positions of the chunks, the last being the length of data."""
    if not data:
        return np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step)
        h = h + shifted
    found = np.flatnonzero(h < np.uint16(1 << (16 - CUT_BITS))) + 1
    found = found[np.diff(found, prepend=-MAX_CHUNK) > MIN_GAP]
    edges = np.concatenate([[0], found, [len(raw)]])
    bare = np.flatnonzero(np.diff(edges) > LONG)
    if len(bare):
        found = np.sort(np.append(found, _least(h, edges[bare], edges[bare + 1])))
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of characters
    found = np.unique(np.append(starts[np.searchsorted(starts, found)], len(raw)))
    gaps = np.diff(found, prepend=0)
    if gaps.max() > MAX_CHUNK:
        forced = np.concatenate([np.arange(e - g + MAX_CHUNK, e, MAX_CHUNK) for e, g in zip(found, gaps, strict=True) if g > MAX_CHUNK])
        found = np.unique(np.concatenate([found, starts[np.searchsorted(starts, forced)]]))
    return found[found > 0]


def chunk_digests(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends and their digests as an array of two 64-bit halves."""
    ends = boundaries(data)
    low, joined = 0, []
    for e in ends.tolist():
        joined.append(hashlib.blake2b(data[low:e], digest_size=16).digest())
        low = e
    return ends, np.frombuffer(b"".join(joined), np.int64).reshape(-1, 2)


def reach(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk the number of the first word that touches it, the chunk before or ``SLACK`` more bytes, and of the first one behind the next chunk and so much more."""
    raw = np.frombuffer(data, np.uint8)
    inside = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    begins = inside & ~np.append(False, inside[:-1])
    count = np.append(0, np.cumsum(begins, dtype=np.int32))
    starts = np.maximum(np.append([0, 0], ends)[: len(ends)] - SLACK, 0)
    behind = np.minimum(np.append(ends, ends[-1:])[1:] + SLACK, len(raw))
    return count[starts] - (inside & ~begins)[starts], count[behind]


def _chunks(docs: DataFrame, id_col: str, text_col: str, places: bool, keyed: bool) -> DataFrame:
    """doc_id, a, b (halves of the digest); keyed, text_hash and key, another hash of the text; with places i, start and end (the chunk's place in the text), low and high (its reach in words)."""
    text = F.col(text_col)
    rows = docs.filter(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), *[F.xxhash64(text).alias("key")] * keyed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column(1).to_pylist()
                parts = [chunk_digests(t) for t in texts]
                n = [len(e) for e, _ in parts]
                if not sum(n):
                    continue
                digests = np.concatenate([d for _, d in parts])
                out = [np.repeat(part.column(0).to_numpy(zero_copy_only=False), n), digests[:, 0].copy(), digests[:, 1].copy()]
                if keyed:
                    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
                    out += [np.repeat(hashes, n), np.repeat(part.column(2).to_numpy(), n)]
                if places:
                    starts = [np.append(0, e[:-1]) if len(e) else e for e, _ in parts]
                    words = zip(*[reach(t, e) for t, (e, _) in zip(texts, parts, strict=True)], strict=True)
                    out += [np.concatenate(x).astype(np.int32) for x in ([np.arange(k) for k in n], starts, [e for e, _ in parts], *words)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    longs = ["doc_id", "a", "b"] + ["text_hash", "key"] * keyed
    names = longs + ["i", "start", "end", "low", "high"] * places
    return rows.mapInArrow(tidy(cut), ", ".join(f"{x} {'long' if x in longs else 'int'}" for x in names))


def _repeated_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, times of rows that occur more than once with one id and text."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.groupBy(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def _ids_repeat(docs: DataFrame, id_col: str) -> bool:
    return not docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty()


def chunk_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids_repeat: bool = True) -> DataFrame:
    """a, b, owner, owner_hash (of its text), n_seen of chunks that occur more than once, written to the shared folder.

    If no id repeats, ids alone decide, and the sums need no sort; owner_hash is null then.
    """
    chunks = _chunks(docs, id_col, text_col, False, ids_repeat)
    if ids_repeat:
        owner = F.min(F.struct("doc_id", "text_hash")).alias("first")
        found = ["first.doc_id", "first.text_hash"]
    else:
        owner, found = F.min("doc_id").alias("first"), ["first", F.lit(None).cast("long")]
    sums = chunks.groupBy("a", "b").agg(owner, F.count(F.lit(1)).alias("n_seen")).filter("n_seen > 1")
    names = [(F.col(x) if isinstance(x, str) else x).alias(n) for x, n in zip(found, ("owner", "owner_hash"), strict=True)]
    return materialise(sums.select("a", "b", *names, "n_seen"), "chunks")


def _equal(*columns: np.ndarray) -> np.ndarray:
    """Whether each row but the first equals the one before it."""
    return np.logical_and.reduce([x[1:] == x[:-1] for x in columns])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, min_words: int = MIN_WORDS, long_bytes: int = LONG_BYTES, within: bool = False) -> DataFrame:
    """doc_id, owner_id, start, end, n_chunks: runs of chunks that belong to an earlier text or place; start and end in bytes.

    owner_id is the id of the earlier text that owns most of the run's chunks (the smallest of equals), or the text's own
    if it repeats itself only.
    """
    ids_repeat = _ids_repeat(docs, id_col)
    owners = chunk_owners(docs, id_col, text_col, ids_repeat)
    least = max(HOT, -(-(owners.agg(F.sum("n_seen")).first()[0] or 0) // MAX_HOT))
    keys = F.floor(F.col("n_seen") / least).cast("int")
    hot = owners.filter(F.col("n_seen") >= least).select("a", "b", keys.alias("keys"))
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), keys))).drop("n_seen")
    chunks = _chunks(docs, id_col, text_col, True, ids_repeat).join(F.broadcast(hot), ["a", "b"], "left")
    text = ["doc_id"] + ["key"] * ids_repeat  # what a text is known by, however often it occurs
    chunks = chunks.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*text, "i"), F.col("keys") + 1), F.lit(0)).cast("int"))
    other = F.col("owner") != F.col("doc_id")
    if ids_repeat:  # else the texts' hashes need not travel
        other |= F.col("owner_hash") != F.col("text_hash")
    found = chunks.join(owners, ["a", "b", "salt"]).select(*text, F.struct("i", "start", "end", "low", "high", "owner", other.alias("other"), "a", "b").alias("chunk"))
    gather = F.collect_set if ids_repeat else F.collect_list  # rows with equal id and text have the same chunks
    per_doc = found.groupBy(*text).agg(F.array_sort(gather("chunk")).alias("chunks"), *([] if ids_repeat else [F.lit(0).cast("long").alias("key")])).select("doc_id", "chunks", "key")

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            c = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
            c["row"] = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(1)).to_numpy())
            seen = np.zeros(len(flat), bool)
            order = np.lexsort((c["i"], c["b"], c["a"], c["row"]))
            seen[order[1:]] = _equal(*(c[x][order] for x in ("row", "a", "b")))
            c = {k: x[c["other"] | seen] for k, x in c.items()}
            if not len(c["row"]):
                continue
            doc, key = (batch.column(i).to_numpy()[c["row"]] for i in (0, 2))
            head = np.append(True, (np.diff(c["row"]) != 0) | (np.diff(c["i"]) != 1))
            heads, run = np.flatnonzero(head), np.cumsum(head) - 1
            tails = np.append(heads[1:], len(run)) - 1
            start, end = c["start"][heads], c["end"][tails]
            counted = end - start if within else np.add.reduceat(c["other"] * (c["end"] - c["start"]), heads)
            keep = (counted >= min_bytes) & ((c["high"][tails] - c["low"][heads] >= min_words) | (end - start >= long_bytes))
            if not keep.any():
                continue
            c = {"run": run[keep[run]], "other": c["other"][keep[run]], "owner": c["owner"][keep[run]]}
            order = np.lexsort((c["owner"], c["other"], c["run"]))
            c = {k: x[order] for k, x in c.items()}
            groups = np.flatnonzero(np.append(True, ~_equal(*c.values())))
            n = np.diff(np.append(groups, len(order)))
            c = {k: x[groups] for k, x in c.items()}
            order = np.lexsort((~c["owner"], n, c["other"], c["run"]))
            best = order[np.append(np.diff(c["run"][order]) != 0, True)]
            out = [doc[heads][keep], c["owner"][best], start[keep], end[keep], (tails - heads + 1)[keep].astype(np.int32), key[heads][keep]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc_id", "owner_id", "start", "end", "n_chunks", "key"])

    runs = per_doc.mapInArrow(tidy(join_runs), "doc_id long, owner_id long, start int, end int, n_chunks int, key long")
    if not ids_repeat:
        return runs.drop("key")
    again = runs.join(_repeated_rows(docs, id_col, text_col), ["doc_id", "key"], "left")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long"))))
    return again.withColumn("time", times).select("doc_id", "owner_id", "start", "end", "n_chunks")


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the given byte ranges."""
    if text is None:
        return None
    data, out, low = text.encode(), [], 0
    for start, end in sorted(spans):
        out.append(data[low:start])
        low = max(low, end)
    return b"".join([*out, data[low:]]).decode()


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id"))
