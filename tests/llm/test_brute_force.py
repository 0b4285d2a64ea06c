"""Operators without SQL against plain Python on small tables."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from readloom.llm import bitpack, chunk_dedup, language, packing, quality

SF = "/root/testdata/sf0.001"


def _documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- op3: constraints ------------------------------------------------------------------------------------------


def test_packing_constraints(spark):
    docs = _documents(spark).select("doc_id", "text", "source")
    docs = docs.union(docs.limit(20)).union(spark.createDataFrame([(-1, "same words", "s")] * 3000 + [(-2, "w " * 5000, None)], docs.schema))
    rows = packing.pack(docs, capacity=512, shard_items=100).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    cluster = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    bins, shards = {}, Counter(r.shard for r in rows)
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for held in bins.values():
        assert sum(r.n_tokens for r in held) <= 512
        assert len({source[r.doc_id] for r in held}) == len(held) == len({cluster[r.doc_id] for r in held})
        at = 0
        for r in sorted(held, key=lambda r: (r.bin_offset, r.n_tokens)):
            assert r.bin_offset == at
            at += r.n_tokens
    assert max(shards.values()) < 200  # 3000 equal rows and one long text are spread too
    words = Counter()
    for r in docs.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert +got == +words


# ---- op4 -------------------------------------------------------------------------------------------------------


def _least(hashes: list[int], a: int, b: int) -> list[int]:
    """Cuts in a stretch without a boundary, one byte after the other."""
    span, gap = chunk_dedup.SPAN, chunk_dedup.MIN_GAP
    at = [i for i in range(a + gap, b - gap) if hashes[i] == min(hashes[max(0, i - span + 1) : i + 1])]
    same = [hashes[i] == hashes[j] and j - i < span for i, j in zip(at, at[1:], strict=False)]
    steady = [x and (j == 0 or not same[j - 1] or at[j + 1] - at[j] == at[j] - at[j - 1]) for j, x in enumerate(same)]
    out, n, every = [], 0, 1
    for j, i in enumerate(at):
        n += 1
        if j == 0 or not steady[j - 1]:
            n, every = 0, math.ceil(span / (at[j + 1] - i)) if j < len(steady) and steady[j] else 1
        if n % every == 0:
            out.append(i + 1)
    return out


def _chunks(data: bytes) -> list[tuple[int, int]]:
    """Byte by byte: the hash of the last 16 bytes decides."""
    gear, h, found, last, hashes = [int(x) for x in chunk_dedup.GEAR], 0, [], None, []
    for i, c in enumerate(data):
        h = (2 * h + gear[c]) & 0xFFFF
        hashes.append(h)
        if h < 1 << (16 - chunk_dedup.CUT_BITS):
            if last is None or i + 1 - last > chunk_dedup.MIN_GAP:
                found.append(i + 1)
            last = i + 1
    found += [q for a, b in zip([0, *found], [*found, len(data)], strict=True) if b - a > chunk_dedup.LONG for q in _least(hashes, a, b)]
    forward = lambda p: next(q for q in range(p, len(data) + 1) if q == len(data) or data[q] & 0xC0 != 0x80)
    ends = sorted({forward(p) for p in found} | {len(data)})
    forced = [q for a, b in zip([0, *ends], ends, strict=False) if b - a > chunk_dedup.MAX_CHUNK for q in range(a + chunk_dedup.MAX_CHUNK, b, chunk_dedup.MAX_CHUNK)]
    ends = sorted(set(ends) | {forward(q) for q in forced})
    return list(zip([0, *ends], ends, strict=False))


def _spans(rows, within):
    cut = [(k, t.encode(), xxhash.xxh3_64_intdigest(t.encode())) for k, t in rows if k is not None and t]
    cut = [(k, d, h - (1 << 64) if h >> 63 else h, _chunks(d)) for k, d, h in cut]
    first, n = {}, Counter()
    for k, d, h, parts in cut:
        for a, b in parts:
            x = d[a:b]
            first[x], n[x] = min(first.get(x, (k, h)), (k, h)), n[x] + 1
    out = []
    for k, d, h, parts in cut:
        seen, runs = set(), []
        for i, (a, b) in enumerate(parts):
            x = d[a:b]
            if n[x] > 1 and (first[x] != (k, h) or x in seen):
                if not runs or runs[-1][-1] != i - 1:
                    runs.append([])
                runs[-1].append(i)
            seen.add(x)
        for run in runs:
            a, b = parts[run[0]][0], parts[run[-1]][1]
            owners = [first[d[slice(*parts[i])]] for i in run]
            foreign = [o[0] for o in owners if o != (k, h)]
            size = b - a if within else sum(parts[i][1] - parts[i][0] for i, o in zip(run, owners, strict=True) if o != (k, h))
            low, high = parts[max(run[0] - 1, 0)][0], parts[min(run[-1] + 1, len(parts) - 1)][1]
            low, high = low - chunk_dedup.SLACK, high + chunk_dedup.SLACK
            words = sum(m.start() < high and m.end() > low for m in re.finditer(rb"[^\x20\x09-\x0D]+", d))
            if size >= chunk_dedup.MIN_BYTES and (words >= chunk_dedup.MIN_WORDS or b - a >= chunk_dedup.LONG_BYTES):
                most = Counter(foreign or [k])
                out.append((k, min(o for o in most if most[o] == max(most.values())), a, b, len(run)))
    return sorted(out)


@pytest.mark.parametrize("hot", [10_000, 2])
def test_chunk_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(chunk_dedup, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in _documents(spark).collect()]
    long = max((t or "" for _, t in rows), key=len)
    rows += [(7, long + " tail"), (7, "head é " + long), (7, "head é " + long), (900, "x" * 3000), (901, "é" * 2000), (904, "who is the the " + "the " * 90 + "end"), (905, "a to " + "the " * 70), (906, "é ü " * 80), (907, "one é ü " + "é ü " * 70), (902, ""), (903, None), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for within in (False, True):
        got = chunk_dedup.repeated_spans(docs, within=within)
        assert sorted(tuple(r) for r in got.collect()) == _spans(rows, within)


def test_short_words_and_spans(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghijklm") for _ in range(n))
    texts, passages = {}, {}
    for p in range(40):
        passages[p] = " ".join(word(4) for _ in range(51))
        for side in (0, 1):
            texts[2 * p + side] = f"{' '.join(word(6) for _ in range(30))} {passages[p]} {' '.join(word(6) for _ in range(30))}"
    spans = {}
    for r in chunk_dedup.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    assert set(spans) == {k for k in texts if k % 2}
    left = chunk_dedup.remove_spans(texts[1], spans[1])
    assert len(left) < len(texts[1]) - 128 and texts[1].startswith(left[:100])
    assert chunk_dedup.remove_spans("abécd", [(1, 4), (2, 5)]) == "ad" and chunk_dedup.remove_spans(None, []) is None


# ---- op5 -------------------------------------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(*parts) -> int:
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True), seed)
    return _signed(seed)


def _quality(text, n_buckets):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    h = [_hash(w.encode()) for w in words]
    grams = [x % n_buckets for x in h] + [_hash(a, b) % n_buckets for a, b in zip(h, h[1:], strict=False)]
    base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))
    return base, len(words) < 10 or 100 * len(covered) > 20 * len(words), grams


def test_quality_equals_brute_force(spark):
    docs, labels = _documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    clash = docs.withColumnsRenamed({"lang": "score", "source": "kept", "n_chars": "grams"})
    odd = spark.createDataFrame([(9001, None, "a", "b", 1), (9002, "", "a", "b", 1), (9003, " \n\t\n", "a", "b", 1), (9004, "é ü x y #1 <b>\n\na\na\n a\n" + "one two three four five six " * 2, "a", "b", 1), (None, "null id " * 8, "a", "b", 1)], clash.schema)
    clash = clash.union(odd).union(odd.limit(4))
    rows = clash.collect()
    weights = quality.fit_ratio(clash, quality.trusted_ids(labels))
    trusted = {r.t_id for r in quality.trusted_ids(labels).collect()}
    size = len(weights)
    made = [(r.doc_id, *_quality(r.text, size)) for r in rows]
    raw, good = Counter(), Counter()
    for key, _, _, grams in made:
        raw.update(grams)
        good.update(grams if key in trusted else [])
    n_raw, n_good = sum(raw.values()) + size, sum(good.values()) + size
    want = [round(math.log((good[b] + 1) / n_good) - math.log((raw[b] + 1) / n_raw), 9) if raw[b] else 0.0 for b in range(size)]
    assert np.allclose(weights, want, atol=2e-9)
    got = quality.score_quality(clash, weights, threshold=-0.05).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (doc, base, failed, grams) in zip(sorted(got, key=key), sorted(made, key=key), strict=True):
        score = sum(weights[b] for b in grams) / len(grams) if grams else 0.0
        assert (r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (doc, *base, failed)
        assert abs(r.score - score) < 1e-9 and (abs(score + 0.05) < 1e-9 or r.kept == (not failed and score >= -0.05))


# ---- op6 -------------------------------------------------------------------------------------------------------


def test_language_filters_decide_like_exact_sets(spark):
    docs = _documents(spark)
    model, rows = language.fit(docs), docs.collect()
    grams = lambda t: np.concatenate(list(language.ngrams(t)) or [np.empty(0, np.uint64)])
    count = {}
    for r in rows:
        if r.lang and r.text:
            count.setdefault(r.lang, Counter()).update(grams(r.text).tolist())
    order = lambda x: (-x[1], x[0] - (1 << 64) if x[0] >> 63 else x[0])
    sets = {k: np.array([h for h, _ in sorted(c.items(), key=order)[:6000]], np.uint64) for k, c in sorted(count.items())}
    assert model.languages == list(sets)
    for r in rows:
        g = grams(r.text)
        hits = {k: int(np.isin(g, s).sum()) for k, s in sets.items()}
        lang, score, share = model.predict(r.text)
        corrected, n, known = model.counts(r.text)
        assert n == len(g) and known >= np.isin(g, np.concatenate(list(sets.values()))).sum()
        if len(g) and sum(hits.values()):
            top = sorted(hits.values())[-2:]
            assert lang == max(hits, key=hits.get) or top[0] >= 0.97 * top[1]
            assert all(abs(c - hits[k]) <= 5 + 0.03 * n for k, c in zip(sets, corrected, strict=True)) and 0 <= score <= 1 and 0 <= share <= 1


# ---- op9 -------------------------------------------------------------------------------------------------------


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    assert bitpack.splits_at_spaces(definition)
    parts = json.loads(definition)
    parts["normalizer"] = {"type": "NFC"}
    changed = json.dumps(parts)
    assert not bitpack.splits_at_spaces(changed)
    (tmp_path / "cased.json").write_text(changed, encoding="utf-8")
    t = Tokenizer.from_str(changed)
    rows = [(1, "The Cat  sat\nON it's 12"), (2, None), (3, ""), (4, "É" * 50)]
    path = bitpack.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), bitpack.new_path(spark, "t"), str(tmp_path / "cased.json"), 2, block_ids=8)
    got = bitpack.read_ids(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.ids for r in got] == [t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in rows]


def test_words_said_over_and_over(spark):
    """They are found wherever they begin, although they may hold no boundary."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    texts = {}
    for i in range(40):
        said = " ".join([word()[: rnd.randint(2, 6)] for _ in range(rnd.randint(1, 3))])
        for side in (0, 1):
            head, tail = (" ".join(word() for _ in range(rnd.randint(20, 40))) for _ in "ab")
            texts[2 * i + side] = f"{head} {' '.join([said] * rnd.randint(60, 90))} {tail}"
    got = chunk_dedup.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.owner_id == r.doc_id - 1} == {k for k in texts if k % 2}


def test_digests_are_blake2b():
    data = random.Random(1).randbytes(4000)
    ends, digests = chunk_dedup.chunk_digests(data)
    parts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert b"".join(parts) == data and digests.tobytes() == b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts)
