"""Words in runs against plain counts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.operators import filtering, words


def _some(spark, wild=True):
    rnd = random.Random(5)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(rnd.randrange(1, 90))) for _ in range(150)]
    seqs += ["A" * n for n in range(1, 80, 6)] + ["ACACAC" * 12, "C" * 40 + "A" * 40, ""] + seqs[:60] * 2
    seqs += [s[:20] + "N" + s[21:] for s in seqs[:40]] + ["ACGTÄACGT" * 4] if wild else []
    return seqs, spark.createDataFrame([(i, f"s{i % 3}", s) for i, s in enumerate(seqs)], "read_id long, sample string, seq string")


@pytest.mark.parametrize("batch", [100_000, 7])
@pytest.mark.parametrize("k", [12, 16, 19, 32])
def test_counts_and_support_in_runs(spark, monkeypatch, k, batch):
    monkeypatch.setattr(words, "BATCH", batch)
    seqs, reads = _some(spark)
    clean = ["".join(c if c in "ACGT" else "A" for c in s) for s in seqs]
    model = Counter(s[i : i + k] for s in clean for i in range(len(s) - k + 1))
    assert {r.kmer: r.n for r in filtering.count_kmers(reads, k).collect()} == dict(model)
    unique = filtering.dereplicate(reads)
    for mode in ("aligned", "endpiece", "deep"):
        for head in (None, F.length("seq") - 9):
            got = {r.seq: r.min_kmer for r in filtering.read_support(unique, reads, k, mode, head).collect()}
            counts = spark.createDataFrame(list(model.items()), "kmer string, n long")
            assert got == {r.seq: r.min_kmer for r in filtering.kmer_support(unique, counts, k, mode, head).collect()}


def test_few_rows_are_shuffled(spark):
    """A read of 60 bases has 45 words of 16, but about a fifth as many runs."""
    rnd = random.Random(6)
    reads = spark.createDataFrame([("".join(rnd.choice("ACGT") for _ in range(60)), 1) for _ in range(2000)], "seq string, v long")
    assert words._rows(reads, 16, 0).count() < 2000 * 12


def test_words_are_counted_where_they_are_looked_up(spark):
    _, reads = _some(spark)
    seen = []
    filtering.read_support(filtering.dereplicate(reads), reads, 16, write=lambda rows: seen.append(rows) or rows).count()
    n = seen[0].filter("id IS NULL").agg(F.sum("n_words").alias("n_kmers"), F.sum("n_distinct").alias("n_distinct_kmers")).first()
    assert n == filtering.kmer_metrics(reads, 16).first()


def test_words_are_packed_and_spelt():
    rnd = random.Random(8)
    for k in (12, 13, 16, 17, 31, 32):
        texts = ["".join(rnd.choice("ACGT") for _ in range(k + 3)) for _ in range(5)]
        rolled = words._rolled(words._codes(pa.array(texts), k + 3), k)
        assert words._texts(rolled.ravel(), k).to_pylist() == [t[i : i + k] for t in texts for i in range(4)]


def test_what_is_carried_is_one_group(monkeypatch):
    """Words of a group are given out when the next group begins, however batches are cut."""
    monkeypatch.setattr(words, "BATCH", 4)
    row = lambda g: [[2 * g], [np.arange(4 * g, 4 * g + 4).tobytes()], [np.ones(4, np.uint8).tobytes()], [np.full(4, 1 + g % 2 * 5).tobytes()]]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(sum(c, []), k) for c, k in zip(zip(*map(row, gs), strict=True), kinds, strict=True)], names=["part", "bases", "sizes", "v"]) for gs in ((1,), (1, 2), (3,), (5, 6))]
    seen = [(w.tolist(), n.tolist(), done) for w, n, done, *_ in words._counted(batches, 16)]
    assert max(len(w) for w, *_ in seen) == 4
    assert sorted((w, n) for ws, ns, done in seen if done for w, n in zip(ws, ns, strict=True)) == [(4 * g + i, (1 + g % 2 * 5) * (1 + (g == 1))) for g in (1, 2, 3, 5, 6) for i in range(4)]


def test_runs_are_shuffled_in_groups(spark, monkeypatch):
    """Runs of some thousand reads are few rows, none of more than a bound."""
    monkeypatch.setattr(words, "MOST_RUNS", 50)
    rnd = random.Random(6)
    reads = spark.createDataFrame([("".join(rnd.choice("ACGT") for _ in range(60)), 1) for _ in range(6000)] + [("A" * 60, 1)] * 600, "seq string, v long").coalesce(1)
    rows = words._rows(reads, 16, 0).agg(F.count("*").alias("n"), F.sum(F.length("sizes")).alias("runs"), F.max(F.length("sizes")).alias("most")).first()
    assert rows.runs > 6000 * 8 and rows.n < rows.runs / 6 and rows.most == 50
