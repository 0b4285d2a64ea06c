"""Bigram language model by deleted interpolation.

The probability of word w after v is ``l2[b] c(v, w) / c(v) + l1[b] q(w) + l0[b] / (V + 1)`` with weights for each
bucket b of c(v), the number of times the context was seen: bucket 0 is a context never seen, bucket j > 0 holds
2^(j-1) <= c(v) < 2^j, the last one all larger. q is the maximum-likelihood unigram estimate over all words; words
never seen share the place of one more word in the last term. The weights are learned by
expectation-maximisation: counts come from training texts outside ``em_fold``, the events from those inside it.
The final counts come from all training texts. Each text is BOS w1 .. wn END; END is predicted like a word.

How it is spread: texts are cut into batches of a few MB, written as codes of the batch's own words. Words and pairs
that most batches have are named first, at most ``MAX_COMMON`` of them, from at most ``SAMPLED`` batches; their counts
are added up as vectors, ``FAN_IN`` of them at a time, and their totals, whose number is bounded, go to all tasks. For
the others each batch sends its distinct words and pairs, with their counts in it, in sorted compressed blocks to the
range that owns their hash. So no range gets an entry from nearly every batch; which keys are common decides their way,
never their counts. A range adds up and answers each block with the totals, and the batch, which then knows every count
it needs, works out its texts. The number of ranges grows with the number of tokens. EM sees a histogram of held-out events by (bucket, log p2, log p1) in steps of 1/8, so at most about a million
cells whatever the input.

Rules: a null text is empty, that is END alone; without training rows every token has probability 1 / (V + 1); rows
are never joined by id, so repeated and null ids do no harm; a null id falls into the fold of the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import discard, id_fold, materialise, partitions, spread
from readloom.llm.textbatch import WordHasher, decode, encode, mix, slices, tidy

BOS, END = np.uint64(0x1F0A2B3C4D5E6F71), np.uint64(0x2E1D0C3B4A596877)
N_BUCKETS = 20
MAIN, EM, TEST = 0, 1, 2
STEP, NEVER, COARSE = 2048, 65535, 8
#: Text bytes of a batch, and tokens for each range of hashes.
BATCH_BYTES, RANGE_TOKENS = 4 << 20, 1 << 20
#: Keys that travel as vectors, batches from which they are read off, the share of those that must have them, how often
#: at least in a batch, and vectors that one task adds up.
MAX_COMMON, SAMPLED, COMMON_SHARE, OFTEN, FAN_IN = 1 << 16, 16, 0.25, 3, 64


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c.astype(np.float64))[1], N_BUCKETS - 1).astype(np.uint8)


def _code(p: np.ndarray) -> np.ndarray:
    """Negative natural logarithms in steps of 1 / STEP; NEVER for 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-np.log(p) * STEP), NEVER - 1), NEVER).astype(np.uint16)


def _prob(code: np.ndarray, step: float = STEP, never: int = NEVER) -> np.ndarray:
    return np.where(code == never, 0.0, np.exp(-code.astype(np.float64) / step))


def _rows(docs: DataFrame, id_col: str, text_col: str, n_folds: int, test_fold: int, em_fold: int) -> DataFrame:
    fold = id_fold(F.col(id_col), n_folds)
    kind = F.when(fold == test_fold, TEST).when(fold == em_fold, EM).otherwise(MAIN)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), kind.cast("int").alias("kind"))


def _batches(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices with the hashes of their words and the number of words of each text."""
    hasher = WordHasher()
    for batch in batches:
        for low, high in slices(np.asarray(pc.binary_length(batch.column(1))), most_bytes):
            part = batch.slice(low, high - low)
            yield part, *hasher(part.column(1).to_pylist())


def write_batches(rows: DataFrame) -> DataFrame:
    """One row a batch: its texts, the sorted hashes of its words, and the text and word of each token."""
    most_bytes = BATCH_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        for part, words, counts in _batches(batches, most_bytes):
            n = len(counts)
            h = np.full(len(words) + n, END)
            is_word = np.ones(len(h), bool)
            is_word[np.cumsum(counts + 1) - 1] = False
            h[is_word] = words
            hashes, code = np.unique(h, return_inverse=True)
            place = np.repeat(np.arange(n, dtype=np.uint64), counts + 1)
            sink = pa.BufferOutputStream()
            texts = pa.table({"doc_id": part.column(0), "fold": part.column(2), "n_tokens": counts + 1})
            with pa.ipc.new_stream(sink, texts.schema) as w:
                w.write_table(texts)
            values = [batch_id, len(h), sink.getvalue().to_pybytes(), encode(hashes), encode(place, code.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, BATCHES.types, strict=True)], schema=BATCHES)
            batch_id += 1

    return materialise(rows.mapInArrow(tidy(cut), "batch long, n long, texts binary, words binary, tokens binary"), "batches")


BATCHES = pa.schema([("batch", pa.int64()), ("n", pa.int64()), ("texts", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])
WORDS, PAIRS, TEXTS, TOTALS, VECTOR = range(5)


class Batch:
    """A batch opened: its texts, and for each token the text, the word's code, the context's code and the pair's."""

    def __init__(self, texts: bytes, words: bytes, tokens: bytes):
        self.texts = pa.ipc.open_stream(texts).read_all()
        (self.hashes,) = decode(words)
        self.place, code = decode(tokens, "u4")
        self.code = code.astype(np.int64)
        first = np.ones(len(code), bool)
        first[1:] = self.place[1:] != self.place[:-1]
        # BOS is a context, never a word: as often as END
        self.before = np.where(first, np.searchsorted(self.hashes, END), np.roll(self.code, 1))
        v = np.where(first, BOS, self.hashes[self.before])
        self.pairs, self.pair = np.unique(mix(v + mix(self.hashes[self.code])), return_inverse=True)
        self.fold = self.texts["fold"].to_numpy()[self.place.astype(np.int64)]


class Common:
    """Sorted hashes of common words and pairs, and where the vector of counts has them."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.keys, self.size = {WORDS: words, PAIRS: pairs}, len(words) + len(pairs)
        self.first = {WORDS: 0, PAIRS: len(words)}

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are common, and the places of those in the vector."""
        own = self.keys[kind]
        if not len(own):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        there = own[at] == keys
        return there, at[there] + self.first[kind]


def common_keys(batches: DataFrame) -> Common:
    """Words and pairs that at least COMMON_SHARE of the sampled batches have OFTEN times, the most widespread first; none of fewer than four batches."""
    often = OFTEN
    ids = [r["batch"] for r in batches.select("batch").orderBy(F.xxhash64("batch"), "batch").limit(SAMPLED).collect()]
    n, sample = len(ids), batches.filter(F.col("batch").isin(ids))

    def names(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for i in range(len(row)):
                b = Batch(*(row.column(c)[i].as_py() for c in (2, 3, 4)))
                for kind, keys, at in ((WORDS, b.hashes, b.code), (PAIRS, b.pairs, b.pair)):
                    counts = np.bincount(at, minlength=len(keys))
                    keys = keys[np.argsort(-counts, kind="stable")[: min(MAX_COMMON, int((counts >= often).sum()))]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64))], names=["kind", "hash"])

    if n < 4:
        return Common(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    dealt = sample.repartition(min(n, partitions(batches.sparkSession)), "batch")
    held = dealt.mapInArrow(tidy(names), "kind int, hash long").groupBy("kind", "hash").count().filter(F.col("count") >= max(4, COMMON_SHARE * n))
    held = materialise(held, "held")
    found = held.orderBy(F.desc("count"), "kind", "hash").limit(MAX_COMMON).toArrow()
    discard(held)
    kind, keys = found["kind"].to_numpy(), found["hash"].to_numpy().view(np.uint64)
    return Common(np.sort(keys[kind == WORDS]), np.sort(keys[kind == PAIRS]))


def count_blocks(batches: DataFrame, n_parts: int, common: Common | None = None) -> DataFrame:
    """Each batch's distinct words and pairs with n (in its training texts) and n_em (in those for EM), for n_parts ranges.

    Those that are common make one more row of the batch, of kind VECTOR: their places in the vector and counts. Vectors
    are dealt evenly over the ranges, which add them up.
    """
    edges = np.array([(p << 64) // n_parts for p in range(n_parts)], np.uint64)
    common = common or Common(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    sent = batches.sparkSession.sparkContext.broadcast(common)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for i in range(len(row)):
                b = Batch(*(row.column(c)[i].as_py() for c in (2, 3, 4)))
                out, vector = [], []
                for kind, keys, at in ((WORDS, b.hashes, b.code), (PAIRS, b.pairs, b.pair)):
                    n, n_em = (np.bincount(at[x], minlength=len(keys)).astype(np.uint32) for x in (b.fold != TEST, b.fold == EM))
                    there, places = sent.value.find(kind, keys)
                    vector.append((places.astype(np.uint64), n[there], n_em[there]))
                    keys, n, n_em = keys[~there], n[~there], n_em[~there]
                    cuts = np.append(np.searchsorted(keys, edges), len(keys))
                    out += [(kind, p, encode(keys[x:y], n[x:y], n_em[x:y])) for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
                if sent.value.size:
                    out.append((VECTOR, int(mix(np.array([row.column(0)[i].as_py()], np.uint64))[0] % np.uint64(n_parts)), encode(*map(np.concatenate, zip(*vector, strict=True)))))
                if not out:
                    continue
                kinds, parts, payloads = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array([row.column(0)[i].as_py()] * len(out), pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "part", "batch", "payload"])

    return batches.mapInArrow(tidy(count), "kind int, part int, batch long, payload binary")


def _sum_vectors(payloads: list[bytes], kinds: str) -> bytes:
    opened = [decode(x, kinds, kinds) for x in payloads]
    places, at = np.unique(np.concatenate([x[0] for x in opened]), return_inverse=True)
    n, n_em = (np.bincount(at, np.concatenate([x[i] for x in opened]), len(places)).astype(np.uint64) for i in (1, 2))
    return encode(places, n, n_em)


def common_totals(vectors: DataFrame, n_vectors: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """n and n_em of the common keys: FAN_IN vectors (part, payload) are added up in a task, until one task's are left."""
    rows, groups = vectors.select(F.col("part").cast("long").alias("i"), "payload"), n_vectors
    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"i": table["i"][:1], "payload": pa.array([_sum_vectors(table["payload"].to_pylist(), "u8")], pa.binary())})

        rows = materialise(rows.groupBy(F.pmod("i", F.lit(groups)).alias("g")).applyInArrow(add, "i long, payload binary").withColumn("i", F.pmod("i", F.lit(groups))), "common")
    n, n_em = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    for row in rows.select("payload").toLocalIterator():  # at most FAN_IN of them
        places, a, b = decode(bytes(row["payload"]), "u8", "u8")
        n[places.astype(np.int64)] += a
        n_em[places.astype(np.int64)] += b
    return n, n_em


def add_up(table: pa.Table) -> pa.Table:
    """Answers each block of one range with the totals of its keys; a last row has the range's own totals. Vectors become their sum."""
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    if kind == VECTOR:
        return pa.table([pa.array([c], t) for c, t in zip((kind, part, -1, _sum_vectors(table["payload"].to_pylist(), "u4"), 0, 0, 0), COUNTS.types, strict=True)], schema=COUNTS)
    opened = [decode(x.as_py(), "u4", "u4") for x in table["payload"]]
    cuts = np.cumsum([0] + [len(x[0]) for x in opened])
    keys, n, n_em = (np.concatenate(c) for c in zip(*opened, strict=True))
    del opened
    unique, at = np.unique(keys, return_inverse=True)
    del keys
    n, n_em = (np.bincount(at, c, len(unique)).astype(np.uint64) for c in (n, n_em))
    out = []
    for batch, low, high in zip(table["batch"].to_pylist(), cuts, cuts[1:], strict=False):
        x = at[low:high]
        out.append((kind, part, batch, encode(np.zeros(len(x), np.uint64), n[x], n_em[x]), 0, 0, 0))
    if kind == WORDS:
        out.append((TOTALS, part, -1, None, int(n.sum()), int(n.sum() - n_em.sum()), int((n > 0).sum())))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), COUNTS.types, strict=True)], schema=COUNTS)


COUNTS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("batch", pa.int64()), ("payload", pa.binary()), ("n", pa.int64()), ("n_main", pa.int64()), ("types", pa.int64())])
RESOLVED = pa.schema([("texts", pa.binary()), ("tokens", pa.binary()), ("cells", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])


def resolve(n_main: int, common: Broadcast):
    """Function of a batch and the answers to its blocks: each token's counts of word and pair, and held-out events.

    common holds the common keys and their totals n and n_em.
    """

    def run(table: pa.Table) -> pa.Table:
        kinds, parts = table["kind"].to_numpy(), table["part"].to_numpy()
        i = int(np.flatnonzero(kinds == TEXTS)[0])
        texts = table["payload"][i].as_py()
        b = Batch(texts, table["words"][i].as_py(), table["tokens"][i].as_py())

        def totals(kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            named, *of_named = common.value
            there, places = named.find(kind, keys)
            at = np.flatnonzero(kinds == kind)
            found = [decode(table["payload"][int(j)].as_py(), "u8", "u8")[1:] for j in at[np.argsort(parts[at])]]
            out = tuple(np.zeros(len(keys), np.uint64) for _ in range(2))
            for i, x in enumerate(out):
                x[there] = of_named[i][places]
                if found:
                    x[~there] = np.concatenate([f[i] for f in found])
            return out

        (word, word_em), (pair, pair_em) = totals(WORDS, b.hashes), totals(PAIRS, b.pairs)
        held = b.fold == EM
        cells = n = np.zeros(0, np.int64)
        if held.any():
            of_word, of_pair = (word - word_em).astype(np.float64), (pair - pair_em).astype(np.float64)
            context = of_word[b.before[held]]
            p2, p1 = of_pair[b.pair[held]] / np.maximum(context, 1), of_word[b.code[held]] / max(n_main, 1)
            x, y = (np.minimum(_code(p).astype(np.int64) * COARSE // STEP, 255) for p in (p2, p1))
            cells, n = np.unique(_bucket(context).astype(np.int64) << 16 | x << 8 | y, return_counts=True)
        row = [texts, encode(b.place, word[b.code], pair[b.pair]), cells.tolist(), n.tolist()]
        return pa.table([pa.array([x], t) for x, t in zip(row, RESOLVED.types, strict=True)], schema=RESOLVED)

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """Weights [bucket, (l2, l1, l0)] by EM on events (bucket, p2, p1) with counts n."""
    bucket, a, b = cells >> 16, cells >> 8 & 255, cells & 255
    parts = np.stack([_prob(a, COARSE, 255), _prob(b, COARSE, 255), np.full(len(cells), 1 / (types + 1))], 1)
    weights = np.full((N_BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(rounds):
        shares = parts * weights[bucket]
        shares *= (n / np.maximum(shares.sum(1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, shares[:, j], N_BUCKETS) for j in range(3)], 1)
        # one event spread evenly keeps every weight positive in buckets with few events
        weights = (sums + 1 / 3) / (sums.sum(1, keepdims=True) + 1)
    seen = np.bincount(bucket, n, N_BUCKETS) > 0
    for i in range(1, N_BUCKETS):  # a bucket without events takes its neighbour's
        if not seen[i] and seen[:i].any():
            weights[i] = weights[i - 1]
    weights[0, 1:] += weights[0, 0] / 2
    weights[0, 0] = 0
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_folds: int = 5, test_fold: int = 1, em_fold: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    batches = write_batches(_rows(docs, id_col, text_col, n_folds, test_fold, em_fold))
    tokens = batches.agg(F.sum("n")).first()[0] or 0
    n_parts = max(partitions(spark), -(-tokens // RANGE_TOKENS))
    common = common_keys(batches)
    answers = count_blocks(batches, n_parts, common).groupBy("kind", "part").applyInArrow(add_up, "kind int, part int, batch long, payload binary, n long, n_main long, types long")
    counts = materialise(answers, "counts")
    own = common_totals(counts.filter(F.col("kind") == VECTOR), n_parts, common.size) if common.size else [np.zeros(0, np.uint64)] * 2
    n, n_main, types = (x or 0 for x in counts.filter(F.col("kind") == TOTALS).agg(F.sum("n"), F.sum("n_main"), F.sum("types")).first())
    words = [x[: len(common.keys[WORDS])] for x in own]
    n, n_main, types = n + int(words[0].sum()), n_main + int(words[0].sum() - words[1].sum()), types + int((words[0] > 0).sum())
    shared = spark.sparkContext.broadcast((common, *own))

    none = F.lit(None).cast("binary")
    texts = batches.select("batch", F.lit(TEXTS).alias("kind"), F.lit(0).alias("part"), F.col("texts").alias("payload"), "words", "tokens")
    both = counts.filter(~F.col("kind").isin(TOTALS, VECTOR)).select("batch", "kind", "part", "payload", none.alias("words"), none.alias("tokens")).union(texts)
    resolved = materialise(both.groupBy("batch").applyInArrow(resolve(n_main, shared), "texts binary, tokens binary, cells array<long>, n array<long>"), "resolved")
    discard(batches)
    discard(counts)
    cells = resolved.select(F.explode(F.arrays_zip("cells", "n")).alias("x")).groupBy(F.col("x.cells").alias("code")).agg(F.sum("x.n").alias("n"))
    events = cells.toPandas()
    weights = learn_weights(events["code"].to_numpy(np.int64), events["n"].to_numpy(np.float64), types)
    flat, smooth = 1 / (types + 1), np.log10(n + 0.5 * (types + 1))

    def weigh(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for opened, data in zip(row.column(0), row.column(1), strict=True):
                texts = pa.ipc.open_stream(opened.as_py()).read_all()
                place, word, pair = decode(data.as_py(), "u8", "u8")
                place, word, pair = place.astype(np.int64), word.astype(np.float64), pair.astype(np.float64)
                context = np.roll(word, 1)  # before a text's first word is the last one's END, as often as BOS
                l2, l1, l0 = weights[_bucket(context)].T
                p = l2 * pair / np.maximum(context, 1) + l1 * word / max(n, 1) + l0 * flat
                score, base = np.bincount(place, np.log10(p), len(texts)), np.bincount(place, np.log10(word + 0.5) - smooth, len(texts))
                known = np.bincount(place[word > 0], minlength=len(texts))
                test = pa.array(texts["fold"].to_numpy() == TEST)
                yield from pa.table([texts["doc_id"], test, texts["n_tokens"], pa.array(known), pa.array(np.full(len(texts), n, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).to_batches()

    return resolved.select("texts", "tokens").mapInArrow(tidy(weigh), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id"))
