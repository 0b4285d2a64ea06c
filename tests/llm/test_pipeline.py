"""The stages of the pipeline against brute force, each on its own input."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from readloom.llm import language

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _norm(text: str | None) -> str:
    return (text or "").translate(ASCII)


def _words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _stage(spark, name, rows, schema):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, schema), SF)
    if name != "pack":
        assert out.columns == schema.names
    return out.collect()


def _known_shares(rows):
    """For each id the share of its n-grams that are among the 6000 most frequent of some language; none without letters.

    A filter adds false hits, at most one in a few thousand, so no text may lie so near to the least share.
    """
    grams = lambda t: np.concatenate(list(language.ngrams(t)) or [np.empty(0, np.uint64)])
    count = defaultdict(Counter)
    for r in rows:
        if r.lang and r.text:
            count[r.lang].update(grams(r.text).tolist())
    order = lambda x: (-x[1], x[0] - (1 << 64) if x[0] >> 63 else x[0])
    known = np.array(sorted({h for c in count.values() for h, _ in sorted(c.items(), key=order)[:6000]}), np.uint64)
    out = {}
    for r in rows:
        g = grams(r.text)
        out[r.doc_id] = float(np.isin(g, known).mean()) if len(g) else None
        assert out[r.doc_id] is None or abs(out[r.doc_id] - corpus_pipeline.LEAST_HIT_SHARE) > 0.01
    return out


def _copies(rows):
    """Rows with the numbers of their copies: the inverse of the Poisson distribution of their source's mean at their own number."""
    sizes = Counter(r.source for r in rows)
    scale = len(rows) / sum(n**0.5 for n in sizes.values())
    for r in rows:
        mean = sizes[r.source] ** 0.5 * scale / sizes[r.source]
        u = int(hashlib.md5(f"17:1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        n, p = 0, math.exp(-mean)
        below = p
        while u >= below:
            n += 1
            p *= mean / n
            below += p
        yield r, n


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, rows = docs.schema, docs.collect()

    kept = _stage(spark, "language_id", rows, schema)
    shares = _known_shares(rows)
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows if shares[r.doc_id] is not None and shares[r.doc_id] >= corpus_pipeline.LEAST_HIT_SHARE)

    best = {}
    for r in kept:
        best[_norm(r.text)] = max(best.get(_norm(r.text), r.doc_id), r.doc_id)
    exact = _stage(spark, "exact_dedup", kept, schema)
    assert sorted(r.doc_id for r in exact) == sorted(best.values())

    sets = {}
    for r in exact:
        w = _words(_norm(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    near = _stage(spark, "near_dedup", exact, schema)
    assert sorted(r.doc_id for r in near) == [i for i in ids if find(i) == i]

    mixed = _stage(spark, "mix_sources", near, schema)
    assert sorted(map(str, mixed)) == sorted(str(r) for r, n in _copies(near) for _ in range(n))

    source = {r.doc_id: r.source for r in mixed}
    n_words, bins = defaultdict(int), defaultdict(list)
    for r in _stage(spark, "pack", mixed, schema):
        n_words[r.doc_id] += r.n_tokens
        bins[r.shard, r.bin].append(r)
    expected = defaultdict(int)
    for r in mixed:
        expected[r.doc_id] += len(_words(r.text))
    assert n_words == expected
    for held in bins.values():
        assert sum(r.n_tokens for r in held) <= 2048
        assert len({source[r.doc_id] for r in held}) == len(held)


def test_stages_on_odd_rows(spark):
    """Nulls, repeated ids, repeated rows, no rows, and columns named like the operators' own."""
    schema = spark.createDataFrame([], "doc_id long, text string, lang string, source string, kept string, rate string, node long, row string").schema
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(f"v{i}" for i in range(60))
    rows = [
        (3, near, "en", "a"), (5, near + " end", "en", "a"), (5, other, "en", None), (None, near + " tail", "fr", "a"), (None, other + " tail", "fr", "b"),
        (7, None, None, "a"), (8, "", "en", "a"), (9, "12 34", "en", "a"), (4, "x", "en", "b"), (4, "x", "en", "b"),
    ]
    rows = [(*r, "k", "r", 1, "row") for r in rows]
    assert all(_stage(spark, name, [], schema) == [] for name, _ in corpus_pipeline.STAGES)

    kept = [tuple(r) for r in _stage(spark, "exact_dedup", rows, schema)]
    assert sorted(kept, key=str) == sorted(rows[:5] + rows[6:9], key=str)
    texts = [(r.doc_id, r.text) for r in _stage(spark, "near_dedup", rows, schema)]
    assert sorted(texts, key=str) == sorted([(3, near), (5, other), (7, None), (8, ""), (9, "12 34"), (4, "x")], key=str)
    mixed = {tuple(r) for r in _stage(spark, "mix_sources", rows, schema)}
    assert mixed <= set(rows)
    packed = _stage(spark, "pack", rows, schema)
    assert len(packed) == len(rows)


def test_language_stage_rejects_what_no_language_has(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = ["Ez egy magyar nyelvű szöveg a városról és az emberekről, akik ott élnek", "qwrtz xkcdp vbnmlk zzxqj wqkrt pplmk", "это русский текст о погоде и людях", "½ 12 _", ""]
    planted = spark.createDataFrame([(10_000 + i, t, None, "x", len(t)) for i, t in enumerate(strange)], docs.schema)
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs.union(planted), SF).collect()}
    clean = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert clean <= got and not got & {10_000 + i for i in range(len(strange))}
