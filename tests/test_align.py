"""The similarity join against a comparison of all reads with all windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import sequences as s
from readloom.operators import align, filtering

SHARE = align.WILD_SHARE


def same(a, b):
    return a == b or a not in "ACGT" or b not in "ACGT"


def hamming(reads, refs, similarity, least=1):
    out = set()
    for x in {r for r in reads if len(r) >= least}:
        e, most = int((1 - similarity) * len(x) + 1e-9), int(SHARE * len(x) + 1e-9)
        for i, ref in enumerate(refs):
            for p in range(len(ref) - len(x) + 1):
                win = ref[p : p + len(x)]
                ed, wild = sum(not same(a, b) for a, b in zip(x, win, strict=True)), sum(a not in "ACGT" or b not in "ACGT" for a, b in zip(x, win, strict=True))
                if ed <= e and wild <= most:
                    out.add((x, i, p + 1, ed))
    return out


def edits_from(x, text):
    """Fewest edits of x against a beginning of text."""
    row = list(range(len(text) + 1))
    for n, a in enumerate(x, 1):
        new = [n]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (not same(a, b)), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def best_edits(reads, refs, similarity):
    """Of each read and reference the fewest edits, and the first place with so few."""
    out = {}
    for x in set(reads):
        e, most = int((1 - similarity) * len(x) + 1e-9), int(SHARE * len(x) + 1e-9)
        for i, ref in enumerate(refs):
            for p in range(len(ref)):
                wild = sum(c not in "ACGT" for c in ref[p : p + len(x)]) + sum(c not in "ACGT" for c in x)
                if wild <= most and (ed := edits_from(x, ref[p : p + len(x) + e])) <= e:
                    out[x, i] = min(out.get((x, i), (ed, p + 1)), (ed, p + 1))
    return out


def some(rnd, letters="ACGT", n_refs=4, size=120, n_reads=25, lengths=(20, 60), wild=0.0, runs=False, indels=False):
    refs = ["".join(rnd.choice(letters) for _ in range(size)) for _ in range(n_refs)]
    reads = []
    for _ in range(n_reads):
        ref, length = rnd.choice(refs), rnd.randint(*lengths)
        p = rnd.randrange(size - length + 1)
        x = list(ref[p : p + length])
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(x))
            x[i : i + 1] = rnd.choice([["A"], [], ["C", "G"]] if indels else [["A"], ["T"]])
        reads.append("".join(c if rnd.random() > wild / 4 else "N" for c in x))
    refs = ["".join(c if rnd.random() > wild else "N" for c in r) for r in refs]
    if runs:
        refs = [r[:30] + "NNNN" + r[34:70] + "NNN" + r[73:] for r in refs]
    return reads, refs


def frames(spark, reads, refs):
    return spark.createDataFrame([(x,) for x in set(reads)], "seq string"), spark.createDataFrame(list(enumerate(refs)), "ref_id long, seq string")


CASES = [dict(), dict(wild=0.04), dict(wild=0.03, runs=True), dict(letters="AAAAC"), dict(lengths=(1, 9), size=40)]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_hamming_hits_equal_brute_force(spark, case):
    """Plain, with unknown bases, with runs of them, of low complexity, and short reads."""
    reads, refs = some(random.Random(case), **CASES[case])
    got = {tuple(r) for r in align.hamming_hits(*frames(spark, reads, refs), 0.93).select("seq", "ref_id", "pos", "ed").collect()}
    want = hamming(reads, refs, 0.93)
    assert got == want and want
    if case < 3:
        assert any(ed for *_, ed in want)


@pytest.mark.parametrize("case", [0, 1, 2, 3])
def test_edit_hits_equal_brute_force_with_unknown_bases(spark, case):
    reads, refs = some(random.Random(case + 10), **(CASES[case] | dict(indels=True, n_reads=12, size=90, lengths=(20, 45))))
    rows = align.edit_hits(*frames(spark, reads, refs), 0.93).collect()
    got = {}
    for r in rows:
        got[r.seq, r.ref_id] = min(got.get((r.seq, r.ref_id), (r.ed, r.pos)), (r.ed, r.pos))
    assert got == best_edits(reads, refs, 0.93) and got


def test_repeats_are_dealt_over_keys(spark, monkeypatch):
    """Poly-A and tandem repeats: all placements, and no key with many more places or seeds than HOT."""
    monkeypatch.setattr(align, "HOT", 20)
    refs = ["A" * 150, "AC" * 80, "ACG" * 40 + "TTGACCA" * 6]
    reads = ["A" * n for n in range(30, 60)] + ["AC" * n for n in range(15, 30)] + ["ACG" * 12, "TTGACCA" * 5, "A" * 29 + "C" + "A" * 10]
    joined = []
    real = align._balanced_join

    def spy(*a):
        joined.append(real(*a))
        return joined[-1]

    monkeypatch.setattr(align, "_balanced_join", spy)
    got = {tuple(r) for r in align.hamming_hits(*frames(spark, reads, refs), 0.95).select("seq", "ref_id", "pos", "ed").collect()}
    assert got == hamming(reads, refs, 0.95)
    keys = ["q", "word", "of_seed", "of_place"]
    most = joined[0].groupBy(*keys).agg(F.count_distinct("ref_id", "at").alias("places"), F.count_distinct("seq", "off").alias("seeds")).agg(F.max("places"), F.max("seeds")).first()
    assert max(most) <= 3 * 20


@pytest.mark.parametrize("case", [0, 1])
def test_hits_of_large_references_equal_brute_force(spark, monkeypatch, case):
    """References that are shuffled, and a dominant one whose rows are dealt over keys."""
    monkeypatch.setattr(align, "SENT", 0)
    monkeypatch.setattr(align, "HOT", 5)
    reads, refs = some(random.Random(case + 20), n_refs=3, n_reads=20, lengths=(20, 40), **CASES[case])
    reads += [refs[1][p : p + 30] for p in range(0, 60, 3)]
    frame, table = frames(spark, reads, refs)
    want = hamming(reads, refs, 0.93)
    hits = align.hamming_hits(frame, table, 0.93)
    assert {tuple(r) for r in hits.select("seq", "ref_id", "pos", "ed").collect()} == want
    offsets = spark.createDataFrame([(i, 1000 * i) for i in range(3)], "ref_id long, start_off long")
    least = {}
    for x, i, p, ed in want:
        least[x] = min(least.get(x, (ed, 1000 * i + p)), (ed, 1000 * i + p))
    assert {r.seq: (r.ed, r.g_pos) for r in align.best_hit(hits, offsets).collect()} == least
    edits = {}
    for r in align.edit_hits(frame, table, 0.93).collect():
        edits[r.seq, r.ref_id] = min(edits.get((r.seq, r.ref_id), (r.ed, r.pos)), (r.ed, r.pos))
    assert edits == best_edits(reads, refs, 0.93)


def test_rows_of_a_common_reference_are_dealt(spark, monkeypatch):
    """No key has many more rows than the bound; nothing is lost or doubled, and references without rows or text are no matter."""
    monkeypatch.setattr(align, "HOT", 50)
    rows = spark.range(2000).select(F.col("id").alias("x"), F.when(F.col("id") % 3 < 2, 7).when(F.col("id") == 2, None).otherwise(F.col("id") % 11).alias("ref_id"))
    side = spark.createDataFrame([(i, f"ref{i}") for i in range(9)] + [(20, None)], "ref_id long, ref string")
    left, right = align.dealt(rows, side)
    assert left.count() == 2000 and left.groupBy("ref_id", "_deal").count().agg(F.max("count")).first()[0] <= 2 * 50
    assert right.groupBy("ref_id", "_deal").count().filter("count > 1").isEmpty()
    plain = {tuple(r) for r in rows.join(side, "ref_id").select("x", "ref_id", "ref").collect()}
    for sent in (0, 1 << 20):
        monkeypatch.setattr(align, "SENT", sent)
        got = align.on_references(rows, side, F.length("ref")).select("x", "ref_id", "ref").collect()
        assert len(got) == len(plain) and {tuple(r) for r in got} == plain
        empty = align.on_references(rows.limit(0), side, F.length("ref"))
        assert empty.isEmpty() and set(empty.columns) == {"x", "ref_id", "ref"}


def test_rarest_words():
    rnd = np.random.default_rng(2)
    codes = rnd.integers(0, 4, (40, 14)).astype(np.uint8)
    codes[rnd.random(codes.shape) < 0.05] = 4
    counts = np.zeros(align.BUCKETS, np.int64)
    counts[:64] = rnd.integers(0, 50, 64)
    for m in (1, 2, 3, 4):
        places, words, found = align.rarest_words(codes, 3, m, counts)
        for row, held, word, ok in zip(codes, places, words, found, strict=True):
            number = lambda p: int(row[p] * 16 + row[p + 1] * 4 + row[p + 2])  # noqa: B023, E731
            cost = [counts[number(p)] + 1 if (row[p : p + 3] < 4).all() else None for p in range(12)]

            def least(p, m):
                if not m:
                    return 0
                ways = [cost[q] + least(q + 3, m - 1) for q in range(p, 12) if cost[q] is not None]  # noqa: B023
                return min(ways, default=10**9)

            want = least(0, m)
            assert ok == (want < 10**9)
            if ok:
                assert sum(cost[p] for p in held) == want and (np.diff(held) >= 3).all() and [number(p) for p in held] == word.tolist()


def test_places_are_written_once_whatever_the_lengths(spark, monkeypatch):
    written = {}
    real = align.materialise

    def spy(df, name):
        out = real(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(align, "materialise", spy)
    rnd = random.Random(1)
    refs = ["".join(rnd.choice("ACGT") for _ in range(200)) for _ in range(3)]
    align.hamming_hits(*frames(spark, [refs[0][:n] for n in range(20, 100)], refs), 0.97).count()
    assert written["places"] == [600]


def test_packed_mismatches(spark):
    rnd = random.Random(4)
    rows = []
    for n in (0, 1, 31, 32, 33, 64, 100):
        a = "".join(rnd.choice("ACGTN") for _ in range(n))
        rows.append((a, "".join(c if rnd.random() < 0.7 else rnd.choice("ACGTN") for c in a)))
    frame = spark.createDataFrame(rows, "a string, b string")
    wild = F.zip_with(s.wild_bits(F.col("a")), s.wild_bits(F.col("b")), lambda x, y: x.bitwiseOR(y))
    for r in frame.select("a", "b", s.mismatches(s.packed(F.col("a")), s.packed(F.col("b")), wild).alias("n"), s.wild_letters(F.col("a")).alias("w")).collect():
        assert r.n == sum(not same(x, y) for x, y in zip(r.a, r.b, strict=True)) and r.w == r.a.count("N")


def test_words_as_numbers(spark):
    """Counts and support by packed words equal those by text, for words across longs, of 32 bases, and with other letters."""
    rnd = random.Random(9)
    seqs = ["".join(rnd.choice("ACGTTTTTN" if n % 4 == 0 else "ACGTTTTT") for _ in range(n)) for n in (0, 3, 31, 32, 33, 64, 65, 100, 40, 44)] + ["ACGT" * 10] * 3
    reads = spark.createDataFrame([(x,) for x in seqs], "seq string")
    for k in (1, 5, 31, 32):
        model = {}
        for x in (q.replace("N", "A") for q in seqs):
            for i in range(len(x) - k + 1):
                model[x[i : i + k]] = model.get(x[i : i + k], 0) + 1
        counts = filtering.count_kmers(reads, k)
        assert {r.kmer: r.n for r in counts.collect()} == model
        numbers = filtering.count_kmers(reads, k, as_numbers=True)
        for mode in ("aligned", "endpiece", "deep"):
            head = F.floor(F.length("seq") / 2).cast("int") if mode == "endpiece" else None
            got = [sorted(map(str, filtering.kmer_support(reads.distinct(), c, k, mode, head).collect())) for c in (counts, numbers)]
            assert got[0] == got[1] and "min_kmer=0" in "".join(got[0]) or k == 1


def test_seeds_are_as_long_as_reads_allow(spark):
    """In texts of low complexity words of 16 letters have many places, longer ones have few; nothing is lost."""
    rnd = random.Random(11)
    refs = ["".join(rnd.choice("AAAAC") for _ in range(2000)) for _ in range(5)]
    reads = [rnd.choice(refs)[p : p + 60] for p in rnd.sample(range(1900), 60)] + ["".join(rnd.choice("AAAAC") for _ in range(60)) for _ in range(60)]
    frame, table = frames(spark, reads, refs)
    assert align.candidates(frame, table, 0.97).count() < 10 * len(reads)
    assert {tuple(r) for r in align.hamming_hits(frame, table, 0.97).select("seq", "ref_id", "pos", "ed").collect()} == hamming(reads, refs, 0.97)


def test_words_that_no_reference_has_are_no_seeds():
    """A row goes before its seeds are chosen only if m words apart from each other are absent."""
    rnd = np.random.default_rng(3)
    codes = rnd.choice(5, (400, 23), p=[0.24, 0.24, 0.24, 0.24, 0.04]).astype(np.uint8)
    for q, share in ((1, 0.5), (2, 0.5), (4, 0.3), (8, 0.2)):
        counts = np.zeros(align.BUCKETS, np.int64)
        counts[: 4**q] = rnd.random(4**q) >= share
        for m in (1, 2, 3):
            if q * m <= 23:
                words, wild = align._words_at(codes, q)
                absent = (counts[words] == 0) & ~wild
                want = []
                for row in absent:
                    at = n = 0
                    while at < len(row):
                        at, n = (at + q, n + 1) if row[at] else (at + 1, n)
                    want.append(n >= m)
                assert align.unmatched(codes, q, m, counts).tolist() == want
                places, chosen, found = align.rarest_words(codes, q, m, counts)
                assert ((counts[chosen] == 0).all(axis=1) & found).tolist() == want


def test_seeds_of_other_reads_are_not_written(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    refs = spark.createDataFrame([(i, text(500)) for i in range(4)], "ref_id long, seq string")
    reads = spark.createDataFrame([(text(60), 1, 2) for _ in range(1000)], "seq string, e int, m int")
    words = align._words(align._places(refs), [28])
    assert align._seeds(reads, align._bucket_counts(words, [28])).count() < 100


@pytest.mark.parametrize("similarity", [1.0, 0.97, 0.93])
def test_no_read_with_a_hit_fails_the_seed_test(spark, similarity):
    """Reads of all lengths lie one after the other, as they are cut; those of another origin go."""
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    refs = [text(100) for _ in range(2)]
    refs[0] = refs[0][:40] + "N" + refs[0][41:60] + "N" + refs[0][61:]
    reads = [text(60) for _ in range(200)]
    for n in [1, 2, 5, 9, 17, 26, 33, 34, 41, 47, 55, 56, 59, 60, 60]:
        x = (ref := rnd.choice(refs))[(p := rnd.randrange(len(ref) - n)) : p + n]
        i = rnd.randrange(n)
        reads += [x, x[:i] + rnd.choice("ACGTN") + x[i + 1 :], x[:i] + x[i + 1 :] + "A", (x[:i] + "C" + x[i:])[:n]]
    starts = np.cumsum([0, *map(len, reads)])
    table = frames(spark, reads, refs)[1]
    kept = align.seed_test(table, similarity)(np.frombuffer("".join(reads).encode(), np.uint8), starts[:-1], np.diff(starts))
    near = {x for x, k in zip(reads, kept, strict=True) if k}
    assert {x for x, *_ in hamming(reads, refs, similarity)} | {x for x, _ in best_edits([x for x in reads[200:] if x not in near], refs, similarity)} <= near
    assert kept[:200].sum() < 20


def test_dense_unknown_bases_have_no_seed_test(spark):
    assert align.seed_test(frames(spark, [], ["ACGT" * 20 + "NNN" + "ACGT" * 20])[1], 0.97) is None
