"""Codebooks, codes and errors against a full search in plain whole numbers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code string"


def brute(rows, n_parts=8, n_entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = [[math.floor(Fraction(c) * 4096) for c in r[1]] for r in kept]
    edges = vc.cut(len(x[0]), n_parts)
    cuts = list(zip(edges, edges[1:], strict=False))
    books = [[v[a:b] for v in x[:n_entries]] for a, b in cuts]
    far = lambda p, q: sum((i - j) ** 2 for i, j in zip(p, q, strict=True))
    near = lambda part, book: min((far(part, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for (a, b), book in zip(cuts, books, strict=True):
            groups = {}
            for v in x:
                groups.setdefault(near(v[a:b], book)[1], []).append(v[a:b])
            for e, held in groups.items():
                book[e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out, by_label = [], {}
    for r, v in zip(kept, x, strict=True):
        found = [near(v[a:b], book) for (a, b), book in zip(cuts, books, strict=True)]
        error = sum(d for d, _ in found)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), error, r[2]))
    return sorted([(i, c, min(e, vc.MOST), min(by_label[k], vc.MOST), sha) for i, c, e, k in out], key=str)


def coded(spark, rows, **how):
    table = spark.createDataFrame([(*r, "v", "c") for r in rows], SCHEMA).repartition(3)
    vectors = vc.kept_vectors(table)
    books = vc.fit(vectors, **how)
    found = vc.label_errors(vc.encode(vectors, books))
    return sorted([(r.vec_id, r.code, r.error, r.label_error, books.sha256()) for r in found.collect()], key=str), vectors, books


def some(n, width, seed=1, size=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, size, (12, width))
    rows = [(i, (centres[rnd.integers(12)] + rnd.normal(0, size / 5, width)).tolist(), int(rnd.integers(3)) if i % 7 else None) for i in range(n)]
    return rows


def test_codes_equal_brute_force(spark, monkeypatch):
    """Nulls, non-finite components, other lengths, repeated rows and ids, null ids, ties."""
    rows = some(150, 16)
    rows += [(200, None, 1), (201, [*rows[0][1][:-1], None], 1), (202, [*rows[0][1][:-1], math.nan], 1), (203, [*rows[0][1][:-1], math.inf], 1), (204, [1.0, 2.0], 1)]
    rows += [rows[3]] * 40 + [(3, rows[5][1], 2), (None, rows[6][1], None), (None, rows[7][1], 1), (-1, [0.5] * 16, 0), (-2, [0.5] * 16, 0), (-3, [-0.5 / 4096] * 16, 1)]
    assert coded(spark, rows)[0] == brute(rows)
    monkeypatch.setattr(vc, "MAX_BROADCAST_LABELS", 1)
    assert coded(spark, rows)[0] == brute(rows)


@pytest.mark.parametrize(("n", "width", "size"), [(9, 16, 1.0), (60, 19, 1.0), (40, 5, 1.0), (50, 16, 1e9), (50, 16, 1e30), (40, 8, 1e303)])
def test_odd_sizes(spark, n, width, size):
    """Few vectors, lengths that are no multiple, short vectors, and components beyond 64 bits."""
    rows = some(n, width, 2, size)
    assert coded(spark, rows)[0] == brute(rows)


def test_decoded_vectors_have_the_errors(spark):
    rows = some(120, 16, 4)
    _, vectors, books = coded(spark, rows)
    back = vc.encode(vectors, books).select("vec_id", "error", vc.decode(F.col("code"), books).alias("x")).join(vectors, "vec_id").collect()
    for r in back:
        assert sum((math.floor(a * 4096) - round(b * 4096)) ** 2 for a, b in zip(r.v, r.x, strict=True)) == r.error


def test_partial_distances_are_those_of_a_full_search():
    rnd = np.random.default_rng(5)
    for width in (1, 3, 8):
        for _ in range(30):
            x, book = rnd.integers(-4, 5, (200, width)), rnd.integers(-4, 5, (rnd.integers(1, 17), width))
            full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            code, far = vc.nearest(x, book)
            assert (code == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    vectors = vc.kept_vectors(empty)
    assert vectors.count() == 0 and vc.fit(vectors) is None
    assert vc.kept_vectors(spark.createDataFrame([(1, None, 2, "", "")], SCHEMA)).count() == 0
    none = vc.kept_vectors(spark.createDataFrame([(1, [], 2, "", ""), (2, [], 2, "", "")], SCHEMA))
    assert [(r.code, r.error) for r in vc.encode(none, vc.fit(none)).collect()] == [("00" * 8, 0)] * 2
