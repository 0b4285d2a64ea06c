"""Odd inputs (nulls, empty and very long texts, ties, repeated rows, no rows, clashing columns) and brute force."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import bitpack, chunk_dedup, exact_dedup, interpolation, jaccard, language, mixing, packing, quality, warc

SCHEMA = "doc_id long, text string, lang string, source string, kept string, row string, n long, h long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "a"), (4, "The cat sat on the mat. " * 20, "en", "a"),
    (5, "THE cat sat on the mat. " * 20, "en", "b"), (5, "THE cat sat on the mat. " * 20, "en", "b"), (None, "le chat est sur la table " * 9, "fr", "b"),
    (7, "le chat est sur la table " * 9, "fr", "b"), (8, LONG, "en", "a"), (9, LONG + " end", "en", "a"), (10, "é", "fr", "c"), (11, "12 34", None, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    got = exact_dedup.exact_dedup(docs)
    assert set(docs.columns) < set(got.columns) and got.count() == len(ROWS)
    assert got.filter("kept").count() == len({(t or "").encode().lower() for _, t, _, _ in ROWS})
    hot = docs.sparkSession.range(500).select("id", F.lit("same").alias("text"))
    rows = exact_dedup.exact_dedup(hot, id_col="id", min_hot=50, max_hot=10).collect()
    assert {(r.keep_id, r.group_size) for r in rows} == {(499, 500)} and [r.id for r in rows if r.kept] == [499]


def test_mixing(docs, empty):
    assert mixing.mix_sources(empty).count() == 0
    got = mixing.mix_sources(docs, weights={"a": 0.0, "b": 1.0}, size=4000)
    assert {r.source for r in got.select("source").distinct().collect()} == {"b"}
    many = docs.sparkSession.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    counts = [r["count"] for r in mixing.mix_sources(many, size=8000).groupBy("doc_id").count().collect()]
    assert abs(sum(counts) / 4000 - 2) < 0.1 and abs(np.var(counts + [0] * (4000 - len(counts))) - 2) < 0.25
    assert 1300 < mixing.mix_sources(many.limit(1), size=1400).count() + 100 < 1700


def test_mixing_many_sources(docs, monkeypatch):
    want = sorted(map(str, mixing.mix_sources(docs, size=40).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 2)
    assert sorted(map(str, mixing.mix_sources(docs, size=40).collect())) == want and len(want) > 20


def test_packing(docs, empty):
    assert packing.pack(empty).count() == 0
    rows = packing.pack(docs, capacity=100).collect()
    assert sum(r.n_tokens for r in rows) == sum(len((t or "").encode().split()) for _, t, _, _ in ROWS)
    used = {}
    for r in rows:
        used[r.shard, r.bin] = used.get((r.shard, r.bin), 0) + r.n_tokens
    assert max(used.values()) <= 100


def test_best_fit_is_the_tightest_compatible_bin():
    rnd = random.Random(2)
    n = sorted((rnd.randint(0, 60) for _ in range(300)), reverse=True)
    s, c = [rnd.randrange(6) for _ in n], [rnd.randrange(40) for _ in n]
    bins = []
    for got, size, a, b in zip(packing.best_fit(n, s, c, 100), n, s, c, strict=True):
        fits = [(room, i) for i, (room, ss, cc) in enumerate(bins) if room >= size and a not in ss and b not in cc]
        room, want = min(fits) if fits else (100, len(bins))
        if not fits:
            bins.append((100, set(), set()))
        assert got == (want, 100 - room)
        bins[want] = (room - size, bins[want][1] | {a}, bins[want][2] | {b})


def test_warc(spark):
    big = "x" * 2000
    rows = [(1, "u", big), (2, None, big), (3, "u\r\nv", "small"), (4, "w", "small"), (5, "w", None), (None, "w", big)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = warc.write_archive(pages, warc.new_path(spark, "t"))
    assert spark.read.parquet(f"{path}/blobs").count() == 3
    got = {r.id: r for r in warc.read_archive(spark, path).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {1: ("revisit", 2, 2000), 2: ("response", None, 2000), 3: ("response", None, 5), 4: ("response", None, 5), 5: ("response", None, 0), None: ("response", None, 2000)}
    head, _, rest = bytes(got[2].record).partition(b"\r\n\r\n")
    assert rest.partition(b"\r\n\r\n")[2] == big.encode() + b"\r\n\r\n" and b"Content-Length: %d" % (len(rest) - 4) in head
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0), warc.new_path(spark, "t"))).count() == 0


def test_warc_reads_whole_header_lines(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    big = "y" * 1000
    urls = ["http://x/?WARC-Refers-To: <urn:page:77>", "<urn:page:5>", "WARC-Type: revisit", "u\r\nWARC-Refers-To: <urn:page:8>\r\n", None]
    rows = [(i, u, f"p{i}") for i, u in enumerate(urls)] + [(100 + i, "u", big) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archive(pages, warc.new_path(spark, "t"))
    got = {r.id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(rows) and all(got[i].refers_to is None and got[i].record_type == "response" for i in range(len(urls)))
    assert {(r.record_type, r.refers_to) for k, r in got.items() if 100 <= k < 119} == {("revisit", 119)} and got[119].record_type == "response"
    assert all(bytes(r.payload) == (big if k >= 100 else f"p{k}").encode() for k, r in got.items())


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack_bits(ids, width)
    assert len(data) == -(-1001 * width // 8) and (bitpack.unpack_bits(data, width, 1001) == ids).all()
    assert (bitpack.unpack_bits(data, width, 77, 500) == ids[500:577]).all()


def test_token_ids(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(20, "a<|endoftext|>b  İ ́x ǅ a b", *"abcd", 1, 2)], SCHEMA)
    more = spark.createDataFrame([(21, "It's. NO,, x., É. don'T, A.b. é, l'a, 'S. 3. q,\xa0w.\x0b(b.)", *"abcd", 1, 2)], SCHEMA)
    rows = docs.filter("doc_id IS NOT NULL").union(extra).union(more)
    got = bitpack.read_ids(spark, bitpack.write_ids(rows, bitpack.new_path(spark, "t"), path, 2), with_ids=True).orderBy("start").collect()
    want = [t.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows.orderBy("doc_id", "text").collect()]
    assert [r.ids for r in got] == want and [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    assert bitpack.read_ids(spark, bitpack.write_ids(empty, bitpack.new_path(spark, "t"), path, 2)).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (8, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in quality.quality_rules(docs, labels).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and got[1].n_words == 0 and got[1].base_failed
    assert got[4].n_repeat_words == 120 and got[8].n_words == 30_000 and got[8].n_repeat_words == 30_000
    assert quality.quality_rules(empty, labels.limit(0)).count() == 0


def test_language(spark, docs, empty):
    none = language.predictor(spark, language.fit(empty))
    assert {r.p.lang_pred for r in docs.select(none("text").alias("p")).collect()} == {"und"}
    got = docs.select("doc_id", language.predictor(spark, language.fit(docs))("text").alias("p")).collect()
    said = {r.doc_id: r.p.lang_pred for r in got}
    assert said[1] == said[2] == said[3] == said[11] == "und" and said[4] == "en" and said[7] == "fr"
    odd = spark.createDataFrame([(t,) for t in ("²", "½ Ⅷ", "12_34 …", "\u0301", "a½", None)], "text string")
    assert [r.p.lang_pred == "und" for r in odd.select(language.predictor(spark, language.fit(docs))("text").alias("p")).collect()] == [True, True, True, True, False, True]
    filters = language.LanguageFilters([f"l{i:03}" for i in range(70)], [np.array([i], np.uint64) for i in range(70)], 0)
    assert filters.lanes == 2 and filters.predict("abc")[0] == "l000"


def test_chunk_dedup(spark, docs, empty):
    assert chunk_dedup.repeated_spans(empty).count() == 0
    assert chunk_dedup.repeated_spans(docs).count() > 0
    rnd = random.Random(4)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = words(60)
    texts = {i: f"{words(40)} {passage} {words(40)}" if i < 6 else words(140) for i in range(30)}
    got = chunk_dedup.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5} and {r.owner_id for r in got} == {0}
    assert all(texts[r.doc_id].encode()[r.start : r.end].decode() in texts[0] for r in got)
    data = (passage + "é" * 900).encode()
    ends = chunk_dedup.boundaries(data)
    assert ends[-1] == len(data) and np.diff(ends, prepend=0).max() <= chunk_dedup.MAX_CHUNK + 3
    assert data.decode() == "".join(data[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True))


def _components(rows, width, t):
    sets = []
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((key, frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and len(a & b) >= t * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), key), key)
    return {key: (len(s), low[find(i)]) for i, (key, s) in enumerate(sets)}


@pytest.mark.parametrize("in_task", [2, 4096])
def test_jaccard_components(spark, monkeypatch, in_task):
    monkeypatch.setattr(jaccard, "IN_TASK", in_task)
    if in_task == 2:  # every hub has several blocks
        monkeypatch.setattr(jaccard, "BLOCK_PAIRS", 2)
        monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 100)
    rnd = random.Random(6)
    rows = []
    for g in range(6):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([6, 30, 90, 300]))]
        for _ in range(8):
            x = list(base)
            for _ in range(rnd.randrange(1 + len(x) // 25)):
                x[rnd.randrange(len(x))] = f"v{rnd.randrange(9)}"
            rows.append((len(rows) * 7 % 101, " ".join(x)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE two")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(rows, 4, Fraction(85, 100))


def test_jaccard_odd_rows(docs, empty):
    assert jaccard.jaccard_components(empty).count() == 0
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (4, 5, 8, 9)} == {4: 4, 5: 4, 8: 8, 9: 8}


def test_signatures_never_miss():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = a.copy()
        b[: int(rng.integers(0, n // 10 + 1))] = rng.integers(0, 2**64, dtype=np.uint64)
        b = b[int(rng.integers(0, n // 12 + 1)) :]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.signatures(a, 17, 20), jaccard.signatures(b, 17, 20)))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(a) + len(b) - 2 * both


def test_interpolation(spark, docs, empty):
    assert interpolation.score_texts(empty).count() == 0
    rows = interpolation.score_texts(docs).collect()
    assert len(rows) == len(ROWS) and all(np.isfinite([r.score, r.base_score]).all() for r in rows)


def test_interpolation_is_a_distribution(spark):
    texts = [(i, " ".join(random.Random(i).choices("abc", k=6))) for i in range(60)]
    trained = spark.createDataFrame(texts, "doc_id long, text string")
    probes = [(1000 + i, w) for i, w in enumerate(["", "a", "b", "c", "zz"])]
    probes = [(k, w) for k, w in probes]
    folds = lambda key: zlib.crc32(str(key).encode()) % 5
    spare = iter(k for k in range(5000, 9000) if folds(k) == 1)
    probes = [(next(spare), w) for _, w in probes]
    got = {r.doc_id: r.score for r in interpolation.score_texts(trained.union(spark.createDataFrame(probes, "doc_id long, text string"))).collect()}
    # P(END | BOS) from the empty text; one-word texts give P(w | BOS) P(END | w), at most P(w | BOS)
    assert 0 < sum(10 ** got[k] for k, _ in probes) <= 1.001


def test_em_recovers_weights():
    rng = np.random.default_rng(0)
    cells = (5 << 16) | (rng.integers(0, 40, 4000) << 8) | rng.integers(0, 60, 4000)
    w = interpolation.learn_weights(cells, np.ones(4000), 1000)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and (w >= 0).all()


@pytest.mark.parametrize("batch_bytes", [4 << 20, 400])
def test_interpolation_gives_every_word_its_own_estimate(spark, docs, monkeypatch, batch_bytes):
    """In one batch a task, and in many, of which most have the common words and pairs; vectors are added up three at a time."""
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(vocab, [1 / (k + 1) for k in range(60)], k=rnd.randrange(30)))) for i in range(300)]
    fold = {k: zlib.crc32(str(k).encode()) % 5 for k, _ in rows}
    grams = {k: list(zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)) for k, t in rows}

    def counts(folds):
        one, two = {}, {}
        for k, g in grams.items():
            for v, w in g if fold[k] in folds else ():
                one[w], two[v, w] = one.get(w, 0) + 1, two.get((v, w), 0) + 1
        one["<s>"] = one.get("</s>", 0)
        return one, two, sum(n for w, n in one.items() if w != "<s>")

    def terms(v, w, one, two, n):
        c = one.get(v, 0)
        return interpolation._bucket(np.array([c]))[0], two.get((v, w), 0) / max(c, 1), one.get(w, 0) / n

    main, full = counts({0, 2, 3}), counts({0, 2, 3, 4})
    cells = []
    for k, g in grams.items():
        for v, w in g if fold[k] == 4 else ():
            b, p2, p1 = terms(v, w, *main)
            x, y = (min(int(interpolation._code(np.array([p]))[0]) * 8 // 2048, 255) for p in (p2, p1))
            cells.append(int(b) << 16 | x << 8 | y)
    types = len(full[0]) - 1
    weights = interpolation.learn_weights(*np.unique(cells, return_counts=True), types)
    want = {k: sum(np.log10(weights[b] @ (p2, p1, 1 / (types + 1))) for b, p2, p1 in (terms(v, w, *full) for v, w in g)) for k, g in grams.items()}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    named, find = [], interpolation.common_keys
    monkeypatch.setattr(interpolation, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(interpolation, "FAN_IN", 3)
    monkeypatch.setattr(interpolation, "OFTEN", 1)
    monkeypatch.setattr(interpolation, "common_keys", lambda b: named.append(find(b)) or named[-1])
    got = {r.doc_id: r for r in interpolation.score_texts(table).collect()}
    assert named[0].size > 20
    assert all(abs(got[k].score - want[k]) < 1e-6 * abs(want[k]) for k in want)
    assert all(got[k].n_tokens == len(g) and got[k].n_known == sum(w in full[0] for _, w in g) for k, g in grams.items())
    del full[0]["<s>"]
    n, v = sum(full[0].values()), len(full[0])
    base = {k: sum(math.log10((full[0].get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for _, w in g) for k, g in grams.items()}
    assert all(abs(got[k].base_score - base[k]) < 1e-9 * abs(base[k]) for k in base)
    assert {r.train_tokens for r in got.values()} == {n} and all(got[k].held_out == (fold[k] == 1) for k in fold)


def test_interpolation_ranges_see_a_pair_once_a_batch(spark, monkeypatch):
    hot = [(i, "same old line " * 700) for i in range(100)]
    table = spark.createDataFrame(hot + [(1000 + i, f"a{i} b{i} c{i % 7}") for i in range(300)], "doc_id long, text string").repartition(3)
    batches = interpolation.write_batches(interpolation._rows(table, "doc_id", "text", 5, 1, 4))
    blocks = [(r.kind, r.batch, interpolation.decode(r.payload, "u4", "u4")) for r in interpolation.count_blocks(batches, 5).collect()]
    keys = [(kind, batch, int(k)) for kind, batch, (found, _, _) in blocks for k in found]
    assert len(keys) == len(set(keys)) < 5000 and max(int(n.max()) for _, _, (_, n, _) in blocks) > 10_000

    asked, count = [], interpolation.count_blocks
    monkeypatch.setattr(interpolation, "count_blocks", lambda b, n, c: asked.append(n) or count(b, n, c))
    few = {r.doc_id: r.score for r in interpolation.score_texts(table).collect()}
    monkeypatch.setattr(interpolation, "RANGE_TOKENS", 10_000)
    many = {r.doc_id: r.score for r in interpolation.score_texts(table).collect()}
    assert asked[0] == 4 and asked[1] == 22 and few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 * abs(few[k]) for k in few)


def test_common_words_do_not_reach_the_ranges(spark, monkeypatch):
    """With ten times as many batches a range gets no more entries of the words that all have."""
    monkeypatch.setattr(interpolation, "BATCH_BYTES", 300)
    monkeypatch.setattr(interpolation, "OFTEN", 1)
    table = spark.createDataFrame([(i, f"the cat and the dog and the cow x{i}") for i in range(400)], "doc_id long, text string").repartition(4)
    batches = interpolation.write_batches(interpolation._rows(table, "doc_id", "text", 5, 1, 4))
    common = interpolation.common_keys(batches)
    assert len(common.keys[interpolation.WORDS]) == 6 and batches.count() > 30  # with the end
    blocks = interpolation.count_blocks(batches, 3, common).filter(F.col("kind") != interpolation.VECTOR).collect()
    held = {}
    for r in blocks:
        for k in interpolation.decode(r.payload, "u4", "u4")[0]:
            held[r.kind, int(k)] = held.get((r.kind, int(k)), 0) + 1
    assert max(held.values()) == 1


def test_contradictory_labels_are_bad(spark):
    rows = [(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 1), (4, None, 0), (5, 1, None), (5, 1, 0), (6, 0, 1), (None, 1, 0), (7, 1, 0), (7, None, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    good = {r.t_id for r in quality._good(labels, "doc_id").collect()}
    held = {r.t_id: r.good for r in quality.held_ids(labels).collect()}
    assert good == {1, 5} and {k for k, v in held.items() if not v} == {2, 6} and all(k in good for k, v in held.items() if v)


def test_quality_threshold_follows_the_labelled_rows(spark):
    rnd = random.Random(5)
    plain, odd = [f"w{i}" for i in range(40)], [f"spam{i}" for i in range(40)]
    text = lambda n: " ".join(rnd.choices(plain, k=100 - n) + rnd.choices(odd, k=n))
    rows = [(i, text(3 if i % 4 == 0 else 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    held = {r.t_id: r.good for r in quality.held_ids(labels).collect()}
    trusted = {r.t_id for r in quality.trusted_ids(labels).collect()}
    assert not trusted & held.keys() and len(trusted) + len(held) == 600 and 50 < sum(held.values()) < 150
    rows = quality.quality_rules(table, labels).collect()
    assert sum(r.kept for r in rows if r.id % 4 and r.id in held) > 0.95 * sum(held.values())
    assert sum(r.kept for r in rows if r.id % 4 == 0) < 0.05 * 150


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    ids = F.col("id").alias("doc_id")
    labels = spark.range(60_000).select(ids, (F.col("id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    held = {r.good: r["count"] for r in quality.held_ids(labels).groupBy("good").count().collect()}
    assert held[0] == 20_000 and held[1] + quality.trusted_ids(labels).count() == 40_000
    docs = spark.range(300).select(ids, F.concat(F.lit("a b w"), (F.col("id") % 7).cast("string")).alias("text"))
    sent = quality.fit_ratio(docs, quality.trusted_ids(labels))
    monkeypatch.setattr(quality, "SENT", 0)
    assert quality.fit_ratio(docs, quality.trusted_ids(labels)) == sent
