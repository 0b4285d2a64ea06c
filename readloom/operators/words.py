"""Words of k bases of many reads, counted and looked up without a shuffled row for each word.

Neighbouring words share most bases, and most share their least part of ``part_length(k)`` bases (by a hash). A run of
such words has its bases in a long and is dealt by that part, so equal words meet wherever they lie in a read. Parts are
hashed to ``GROUPS`` groups, and a row is up to ``MOST_RUNS`` runs of one group from some thousand reads. In a task rows
come sorted by group; words are unfolded, counted and looked up group by group, so what a task holds is bounded by the
different words of one group and by ``BATCH`` runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of fewer bases are too few to be many rows; those of more do not fit a long.
LEAST, MOST = 12, 32
GROUPS, MOST_RUNS = 4096, 1024
#: So many runs are unfolded at a time, or as many as there are different words of their group before.
BATCH = 100_000
#: Letters of equally long reads that are worked on at a time, and runs that are dealt to groups at a time.
LETTERS, GATHERED = 4_000_000, 500_000


def part_length(k: int) -> int:
    return (k + 1) // 2


def _codes(texts: pa.Array, length: int) -> np.ndarray:
    """Texts of one length in bytes, an array of their own, as numbers 0 to 3, other letters as 4."""
    table = np.full(256, 4, np.uint8)
    table[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    return table[np.frombuffer(texts.buffers()[2], np.uint8, len(texts) * length).reshape(len(texts), length)]


def _rolled(codes: np.ndarray, k: int, kind: type = np.uint64) -> np.ndarray:
    """Each place's word of k letters, packed; a word is put together of two halves."""
    out, width = codes.astype(kind), 1
    for odd in bin(k)[3:]:
        out, width = (out[:, :-width] << kind(2 * width)) | out[:, width:], 2 * width
        if odd == "1":
            out, width = (out[:, :-1] << kind(2)) | codes[:, width:], width + 1
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of width columns."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:, : x.shape[1] - step], x[:, step:])
        have += step
    return x


def _keys(codes: np.ndarray, k: int) -> np.ndarray:
    """Each word's least part: a number of 32 bits that tells parts apart, in an order unlike that of letters."""
    m = part_length(k)
    x = _rolled(codes, m, np.uint32) * np.uint32(0x9E3779B1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return _least(x ^ (x >> np.uint32(13)), k - m + 1)


def _runs(codes: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row, key, bases and number of words of each run; letters are clean."""
    keys, most = _keys(codes, k), MOST + 1 - k
    n, places = keys.shape
    first = np.ones((n, places), bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(starts, append=n * places)
    parts = -(-sizes // most)  # a run that does not fit a long is cut
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, sizes = np.repeat(starts, parts) + nth * most, np.minimum(np.repeat(sizes, parts) - nth * most, most)
    longest = _rolled(np.pad(codes, ((0, 0), (0, MOST - k))), MOST)
    bases = longest.ravel()[starts] >> (2 * (MOST + 1 - k - sizes)).astype(np.uint64)
    return starts // places, keys.ravel()[starts], bases, sizes


def _chosen(codes: np.ndarray, k: int, mode: str, heads: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """The same for single words at the places that ``support_words`` names; words with other letters count as none (size 0)."""
    length = codes.shape[1]
    if mode == "deep":
        at = np.arange(length - k + 1)
        keep = np.ones((len(codes), len(at)), bool)
    else:
        at = np.arange(length // k) * k
        keep = np.ones((len(codes), len(at)), bool)
        if heads is not None:
            keep = (at + k <= heads[:, None]) | (at >= heads[:, None])
        if mode == "endpiece" and length % k:
            at, keep = np.append(at, length - k), np.concatenate([keep, np.ones((len(codes), 1), bool)], axis=1)
    row, col = np.nonzero(keep)
    place = at[col]
    wild = np.cumsum(np.pad(codes > 3, ((0, 0), (1, 0))), axis=1)
    sizes = (wild[row, place + k] == wild[row, place]).astype(np.int64)
    clean = codes & 3
    return row, _keys(clean, k)[row, place], _rolled(clean, k)[row, place], sizes


def _rows(df: DataFrame, k: int, value: int, mode: str = "", head: bool = False) -> DataFrame:
    """part (group and role), bases, sizes and v of some runs as binaries, for the rows seq, v[, head] of df; role 0 is counted, 1 looked up."""

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        seqs, values = batch.column(0), batch.column(1).to_numpy()
        heads = batch.column(2).to_numpy() if head else None
        lengths = pc.binary_length(seqs).to_numpy()
        for length in np.unique(lengths[lengths >= k]):
            same = np.flatnonzero(lengths == length)
            for low in range(0, len(same), max(1, LETTERS // int(length))):
                rows = same[low : low + max(1, LETTERS // int(length))]
                codes = _codes(seqs.take(pa.array(rows)), int(length))
                whole = not value or (mode == "deep" and not (codes > 3).any())
                row, key, bases, sizes = _runs(codes, k) if whole else _chosen(codes, k, mode, heads[rows] if head else None)
                yield (key & np.uint32(GROUPS - 1)).astype(np.uint16), bases, sizes.astype(np.uint8), values[rows][row]

    def rows_of(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        group, *columns = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(group, kind="stable")
        group = group[order]
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(begins, append=len(group))
        parts = -(-sizes // MOST_RUNS)
        begins = np.repeat(begins, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST_RUNS
        places = np.append(begins, len(group))
        packed = [pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((places * c.itemsize).astype(np.int32)), pa.py_buffer(c[order])]) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(group[begins].astype(np.int32) * 2 + value), *packed], names=["part", "bases", "sizes", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for found in runs(batch):
                held.append(found)
                n_held += len(found[0])
                if n_held >= GATHERED:
                    yield rows_of(held)
                    held, n_held = [], 0
        if n_held:
            yield rows_of(held)

    return df.filter("seq IS NOT NULL").mapInArrow(cut, "part int, bases binary, sizes binary, v binary")


def _unfolded(bases: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """All words of the runs, run after run."""
    back = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(sizes.sum())
    return (np.repeat(bases, sizes) >> (2 * back).astype(np.uint64)) & np.uint64(2 ** (2 * k) - 1)


#: The letters of each word of eight, as the bytes of a number.
EIGHTS = np.frombuffer(b"ACGT", np.uint8)[(np.arange(1 << 16)[:, None] >> np.arange(14, -1, -2)) & 3].view(np.uint64).ravel()


def _texts(words: np.ndarray, k: int) -> pa.Array:
    eights = -(-k // 8)
    letters = np.empty((len(words), eights), np.uint64)
    left = words << np.uint64(2 * (8 * eights - k))
    for i in range(eights):
        letters[:, i] = EIGHTS[(left >> np.uint64(16 * (eights - 1 - i))) & np.uint64(0xFFFF)]
    letters = np.ascontiguousarray(letters.view(np.uint8)[:, :k])
    return pa.StringArray.from_buffers(len(words), pa.py_buffer((np.arange(len(words) + 1) * k).astype(np.int32)), pa.py_buffer(letters))


def _in_parts(rows: DataFrame) -> DataFrame:
    """Runs of one group in one task, those that are counted before those that are looked up."""
    return rows.repartition(F.shiftright("part", 1)).sortWithinPartitions("part")


def _summed(words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words in order, and the sums of their weights."""
    if not len(words):
        return words, weights
    few = weights.sum() <= 2 * len(words)  # most weigh 1: numbers alone are sorted faster than with their weights
    if few:
        words = np.sort(np.repeat(words, weights))
    else:
        order = np.argsort(words)
        words, weights = words[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    return words[starts], np.diff(starts, append=len(words)) if few else np.add.reduceat(weights, starts)


def _counted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """Words and their counts with the runs that are looked up: words, counts, whether they are complete, bases, sizes, ids.

    Words are given once as complete, when the next group begins; before, they come with what is looked up in them.
    """
    none, zero = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    now, words, counts, held, n_held = None, none, zero, [], 0

    def add() -> None:
        nonlocal words, counts, held, n_held
        if n_held:
            bases, sizes, v = (np.concatenate(c) for c in zip(*held, strict=True))
            sizes = sizes.astype(np.int64)
            words, counts = _summed(np.concatenate([words, _unfolded(bases, sizes, k)]), np.concatenate([counts, np.repeat(v, sizes)]))
            held, n_held = [], 0

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in filter(len, batches):
            columns = [(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] // np.dtype(kind).itemsize, np.frombuffer(c.buffers()[2], kind, c.buffers()[2].size // np.dtype(kind).itemsize)) for c, kind in zip(batch.columns[1:], (np.uint64, np.uint8, np.int64), strict=True)]
            part = batch.column(0).to_numpy()
            firsts = np.flatnonzero(np.diff(part, prepend=-1))
            for low, high in zip(firsts, [*firsts[1:], len(part)], strict=True):
                yield int(part[low]), *(data[at[low] : at[high]].copy() for at, data in columns)

    for part, bases, sizes, v in runs(batches):
        if part >> 1 != now:
            add()
            yield words, counts, True, none, zero, zero
            now, words, counts = part >> 1, none, zero
        if part & 1:
            add()
            yield words, counts, False, bases, sizes.astype(np.int64), v
        else:
            held.append((bases, sizes, v))
            n_held += len(bases)
            if n_held >= max(BATCH, len(words)):
                add()
    add()
    yield words, counts, True, none, zero, zero


def counted_words(weighted: DataFrame, k: int, as_numbers: bool) -> DataFrame:
    """kmer (text or long), n of the words of rows seq, w; sequences have the letters A, C, G, T only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts, complete, *_ in _counted(batches, k):
            if complete and len(words):
                kmer = pa.array(words.view(np.int64)) if as_numbers else _texts(words, k)
                yield pa.RecordBatch.from_arrays([kmer, pa.array(counts)], names=["kmer", "n"])

    rows = _in_parts(_rows(weighted.select("seq", F.col("w").alias("v")), k, 0))
    return rows.mapInArrow(count, f"kmer {'long' if as_numbers else 'string'}, n long")


def rarest_counts(weighted: DataFrame, asked: DataFrame, k: int, mode: str) -> DataFrame:
    """id, low of rows asked (seq, id[, head]): the least count, over the rows seq, w, of some of the words that mode names; an id has several rows, or none without a word.

    Rows without an id have n_words and n_distinct, which add up to the numbers of all words counted.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts, complete, bases, sizes, ids in _counted(batches, k):
            asked = _unfolded(bases, sizes, k)
            low = np.where(sizes > 0, np.iinfo(np.int64).max, 0)
            if len(asked):
                at = np.minimum(np.searchsorted(words, asked), max(len(words) - 1, 0))
                n = np.where(words[at] == asked, counts[at], 0) if len(words) else np.zeros(len(asked), np.int64)
                low[sizes > 0] = np.minimum.reduceat(n, (np.cumsum(sizes) - sizes)[sizes > 0])
            zeros, none = np.zeros(len(ids), np.int64), pa.nulls(1, pa.int64())
            numbers = [pa.array(np.append(zeros, n)) for n in (counts.sum() * complete, len(words) * complete)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(ids), none]), pa.concat_arrays([pa.array(low), none]), *numbers], names=["id", "low", "n_words", "n_distinct"])

    head = "head" in asked.columns
    letters = F.regexp_replace("seq", "[^ACGT]", "N").alias("seq")  # a byte for each
    rows = _rows(weighted.select("seq", F.col("w").alias("v")), k, 0).union(_rows(asked.select(letters, "id", *["head"] * head), k, 1, mode, head))
    return _in_parts(rows).mapInArrow(look_up, "id long, low long, n_words long, n_distinct long")
