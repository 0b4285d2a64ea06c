"""Words of Arrow batches as arrays of 64-bit hashes, and sorted blocks of keys that travel as one value."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

#: Odd constants for mixing.
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that releases memory when its task ends."""

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of lower-cased (A-Z) words; a worker keeps those of up to ``most`` words."""

    def __init__(self, most: int = 400_000):
        self.most, self.codes, self.hashes = most, {}, np.empty(0, np.uint64)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, text after text, and the number of words of each text."""
        if len(self.codes) > self.most:
            self.codes, self.hashes = {}, np.empty(0, np.uint64)
        split = [t.lower().split() if t else [] for t in texts]
        new = list({w: None for words in split for w in words if w not in self.codes})
        if new:
            self.codes.update(zip(new, range(len(self.hashes), len(self.hashes) + len(new)), strict=True))
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.codes.__getitem__
        codes = np.fromiter((get(w) for words in split for w in words), np.int64, int(counts.sum()))
        return self.hashes[codes], counts


def slices(sizes: np.ndarray, most_bytes: int, most_rows: int = 16_000) -> list[tuple[int, int]]:
    """Row ranges of about most_bytes; one long text makes a range of its own."""
    out, low, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > low and (held + n > most_bytes or i - low >= most_rows):
            out.append((low, i))
            low, held = i, 0
        held += n
    return out + [(low, len(sizes))] * (len(sizes) > low)


def split_by_range(keys: np.ndarray, n_parts: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and where each of n_parts equal ranges of the key space begins in it."""
    order = np.argsort(keys, kind="stable")
    edges = np.array([(p << bits) // n_parts for p in range(n_parts)], np.uint64)
    return order, np.append(np.searchsorted(keys[order], edges), len(keys))


def encode(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences, other columns as they are, compressed."""
    parts = [np.uint32(len(keys)).tobytes(), np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()]
    parts += [np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def decode(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for kind in ("u8", *kinds):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out
