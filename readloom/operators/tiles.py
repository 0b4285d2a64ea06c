"""Texts as sequences, cut into reads as arrays of letters: no text is looked through letter by letter in Spark's expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: So many bytes of texts are worked on at a time; a longer text by itself.
BYTES = 4_000_000


def tiles(texts: DataFrame, letters: str, bases: str, size: int, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The columns of texts but the last, a text that is not null, with i and seq: its pieces of ``size`` bases and their numbers from 0.

    Each of the letters (ASCII) becomes the base at its place, all others go; a text without any has no piece. ``keep``
    tells of many pieces, by their bases one after the other (bytes), their starts and their lengths, which are wanted.
    """
    table, others = bytes.maketrans(letters.encode(), bases.encode()), bytes(set(range(256)) - set(letters.encode()))
    names = texts.columns[:-1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(names))
            _, places, data = text.buffers()
            if not len(text) or not data:
                continue
            places, data = np.frombuffer(places, np.int32)[text.offset : text.offset + len(text) + 1], memoryview(data)
            firsts = np.flatnonzero(np.diff((places[:-1] - places[0]) // BYTES, prepend=-1))
            for low, high in zip(firsts, [*firsts[1:], len(text)], strict=True):
                at = places[low : high + 1].tolist()
                found = [bytes(data[a:b]).translate(table, others) for a, b in zip(at[:-1], at[1:], strict=True)]
                ends = np.cumsum([0, *map(len, found)])
                parts = -(-np.diff(ends) // size)
                of = np.repeat(np.arange(len(parts)), parts)
                i = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                starts, found = np.append(ends[of] + i * size, ends[-1]), b"".join(found)
                seq = pa.StringArray.from_buffers(len(of), pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(found))
                if keep and len(of):
                    wanted = np.flatnonzero(keep(np.frombuffer(found, np.uint8), starts[:-1], np.diff(starts)))
                    of, i, seq = of[wanted], i[wanted], seq.take(pa.array(wanted))
                rows = pa.array(low + of)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(len(names))), pa.array(i, pa.int32()), seq], names=[*names, "i", "seq"])

    kinds = [f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names]
    return texts.mapInArrow(cut, ", ".join([*kinds, "i int", "seq string"]))
