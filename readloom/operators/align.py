"""Similarity join of unique reads with reference windows.

A read may differ from a window in at most e = floor((1 - s) L) places. Of e + 1 words of the read that do not overlap
one occurs unchanged in such a window (pigeonhole), so an equi-join on words finds every candidate; each is then compared
in full. Unlike a heuristic aligner this loses nothing. The best hit of a read is the one with the fewest differences, then
the lowest position.

Words. The references' places are written once, with the letters that follow; a seed of q letters joins on the first q
of them (packed in a long), where q is one of ``SEED_SIZES``, the largest of which e + 1 fit into the read. So what is
written does not grow with the number of read lengths.

Rarity. Which words of a read are its seeds is chosen by dynamic programming: of all ways to place e + 1 words without
overlap the one whose words are rarest in the references, by counts in ``BUCKETS`` buckets. A bucket with more than
``HOT`` places or seeds is dealt over so many keys that each has about ``HOT`` of either (repeats, a common primer).

Wild letters. A letter other than A, C, G, T, in the read or the window, costs nothing; in at most ``WILD_SHARE`` of the
read's letters either may be wild. Seeds have no wild letters. Reference words of up to ``SPELT`` wild letters are
spelt out; a window with more of them in a word is searched once more with floor(wild / (SPELT + 1)) seeds more, as each
of those it spoils takes that many wild letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.sequences import reverse_complement, wild_letters
from readloom.tables import materialise

#: Letters of a seed; with 0 a read of too few clean letters meets every place.
SEED_SIZES = (28, 24, 20, 16, 8, 4, 2, 1, 0)
#: So many counts for each size of seed go to all tasks (a prime below 2^20; up to ten letters each word has its own).
BUCKETS = 1_048_573
HOT = 4096
#: References of so many bytes go to all tasks; of larger ones at most so many have their rows dealt over keys.
SENT, MAX_HOT = 32 << 20, 100_000
#: What an id and an offset count for.
OFFSET_BYTES = 64
WILD_SHARE = 0.15
#: Letters of reads that are compared at a time.
LETTERS = 4_000_000
SPELT = 2
#: Letters as numbers 0 to 3, others as 4.
CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _allowed(length: Column, share: float) -> Column:
    return F.floor(F.lit(share) * length + 1e-9).cast("int")


def _places(refs: DataFrame) -> DataFrame:
    """ref_id, at, word: every place of the references and the letters of the largest seed from there, written once."""
    rows = refs.filter("seq <> ''").select("ref_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("at"))
    return materialise(rows.select("ref_id", "at", F.substring("seq", F.col("at") + 1, F.lit(SEED_SIZES[0])).alias("word")), "places")


def _words(places: DataFrame, sizes: list[int]) -> DataFrame:
    """q, word (packed), ref_id, at for each size; up to SPELT wild letters are spelt out."""
    rows = places.select("ref_id", "at", F.explode(F.array(*map(F.lit, sizes))).alias("q"), "word").withColumn("word", F.expr("left(word, q)"))
    rows = rows.filter(F.length("word") == F.col("q")).filter(wild_letters(F.col("word")) <= SPELT)
    for _ in range(SPELT):
        clean = F.length(F.regexp_extract("word", "^[ACGT]*", 0))
        rows = rows.withColumn("spelt", F.explode(F.when(clean < F.col("q"), F.array(*map(F.lit, "ACGT"))).otherwise(F.array(F.lit("")))))
        rows = rows.withColumn("word", F.when(F.col("spelt") == "", F.col("word")).otherwise(F.concat(F.expr("left(word, length(regexp_extract(word, '^[ACGT]*', 0)))"), "spelt", F.expr("substring(word, length(regexp_extract(word, '^[ACGT]*', 0)) + 2)"))))
    number = F.when(F.col("q") == 0, F.lit(0)).otherwise(F.conv(F.translate("word", "ACGT", "0123"), 4, 10).cast("long"))
    return rows.select("q", number.alias("word"), "ref_id", "at")


def _bucket() -> Column:
    return F.pmod("word", F.lit(BUCKETS)).cast("int").alias("bucket")


def _bucket_counts(words: DataFrame, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the number of reference words by bucket: at most sizes x BUCKETS rows reach the driver, as columns."""
    table = words.groupBy("q", _bucket()).count().toArrow()
    q, bucket, n = (table[c].to_numpy() for c in ("q", "bucket", "count"))
    counts = {size: np.zeros(BUCKETS, np.int64) for size in sizes}
    for size in sizes:
        counts[size][bucket[q == size]] = n[q == size]
    return counts


def unmatched(codes: np.ndarray, q: int, m: int, counts: np.ndarray) -> np.ndarray:
    """Whether a row has m words of q letters, none overlapping another or with a wild letter, that the references do not have: it then has no hit."""
    first = codes[:, : m * q]  # in most rows the first m words are such
    out = (counts[_packed(first, q) % BUCKETS] == 0).all(axis=1) & (first < 4).all(axis=1)
    rest = np.flatnonzero(~out)
    codes = codes[rest]
    words, wild = _words_at(codes, q)
    absent, at, rows = (counts[words % BUCKETS] == 0) & ~wild, np.zeros(len(codes), np.int64), np.arange(len(codes))
    spots = absent.shape[1]
    # the next such word from each place on; behind the last there is none, whatever is added
    following = np.full((len(codes), spots + q + 1), spots + 1)
    following[:, :spots] = np.minimum.accumulate(np.where(absent, np.arange(spots), spots + 1)[:, ::-1], axis=1)[:, ::-1]
    for _ in range(m):
        at = np.minimum(following[rows, np.minimum(at, spots)] + q, spots + q + 1)
    out[rest] = at <= spots - 1 + q
    return out


def without_seeds(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, m: np.ndarray, counts: dict[int, np.ndarray]) -> np.ndarray:
    """Which reads, whose letters (bytes) lie one after the other, are ``unmatched`` by words of the largest size of which m fit."""
    codes, out = CODES[letters], np.zeros(len(starts), bool)
    shape = lengths * (int(m.max(initial=0)) + 1) + m
    order = np.argsort(shape, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1):
        length, words = (int(lengths[rows[0]]), int(m[rows[0]])) if len(rows) else (0, 1)
        q = max((q for q in counts if q * words <= length), default=0)
        if not q:
            continue
        texts = np.lib.stride_tricks.sliding_window_view(codes, length)
        for low in range(0, len(rows), max(1, LETTERS // length)):
            part = rows[low : low + max(1, LETTERS // length)]
            out[part] = unmatched(texts[starts[part]], q, words, counts[q])
    return out


def seed_test(refs: DataFrame, similarity: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None:
    """A function of the letters (bytes), starts and lengths of many reads that tells which of them may have a hit.

    It takes along which buckets of each size are empty, and lets reads be dropped in the tasks where they are
    made, before they are shuffled. None if a reference has a word of more than ``SPELT`` wild letters: a window there
    need not have a seed.
    """
    places = _places(refs)
    if not places.filter(wild_letters(F.col("word")) > SPELT).isEmpty():
        return None
    sizes = [q for q in SEED_SIZES if q]
    sent = refs.sparkSession.sparkContext.broadcast({q: n > 0 for q, n in _bucket_counts(_words(places, sizes), sizes).items()})

    def may_hit(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = np.floor((1 - similarity) * lengths + 1e-9).astype(np.int64) + 1
        return ~without_seeds(letters, starts, lengths, m, sent.value)

    return may_hit


def _packed(codes: np.ndarray, q: int) -> np.ndarray:
    """The packed words of q letters of which each row is made up."""
    words, clean = codes.shape[1] // q, codes & 3
    if q % 4:
        return (clean.reshape(len(codes), words, q).astype(np.int64) << np.arange(2 * q - 2, -1, -2)).sum(axis=2)
    pairs = clean[:, ::2] << 2 | clean[:, 1::2]
    numbers = np.zeros((len(codes), words, 8), np.uint8)  # four letters a byte, the first the highest
    numbers[:, :, 8 - q // 4 :] = (pairs[:, ::2] << 4 | pairs[:, 1::2]).reshape(len(codes), words, q // 4)
    return numbers.view(">i8")[:, :, 0].astype(np.int64)


def _words_at(codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed word of q letters at each place, and whether it has a wild letter."""
    spots = codes.shape[1] - q + 1
    words, power, done, size = np.zeros((len(codes), spots), np.int64), (codes & 3).astype(np.int64), 0, 1
    while size <= q:  # words of 1, 2, 4, 8 ... letters; those that make up q are put together from the last to the first
        if q & size:
            words |= power[:, q - done - size : q - done - size + spots] << 2 * done
            done += size
        power, size = power[:, :-size] << 2 * size | power[:, size:], 2 * size
    so_far = np.cumsum(np.pad(codes > 3, ((0, 0), (1, 0))), axis=1)
    return words, so_far[:, q:] > so_far[:, :-q]


def _codes(texts: list[str]) -> np.ndarray:
    """Texts of one length as numbers 0 to 3, other letters as 4."""
    return CODES[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), -1)]


def rarest_words(codes: np.ndarray, q: int, m: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the places of the m words of q letters, none overlapping another or with a wild letter, whose counts add up to least.

    Also their packed words, and whether there are so many.
    """
    n, length = codes.shape
    words, wild = _words_at(codes, q)
    cost = np.where(wild, np.inf, counts[words % BUCKETS] + 1.0)
    least, taken = np.zeros((n, length + 1)), []
    for _ in range(m):  # least[:, j]: the sum for words inside the first j letters
        new, take = np.full((n, length + 1), np.inf), np.zeros((n, length + 1), bool)
        for j in range(q, length + 1):
            ending = least[:, j - q] + cost[:, j - q]
            take[:, j] = ending < new[:, j - 1]
            new[:, j] = np.minimum(new[:, j - 1], ending)
        least = new
        taken.append(take)
    found, rows = np.isfinite(least[:, length]), np.arange(n)
    places, end = np.zeros((n, m), np.int64), np.full(n, length)
    for t in reversed(range(m)):
        for _ in range(length):
            back = found & ~taken[t][rows, end] & (end > 0)
            if not back.any():
                break
            end = end - back
        end = np.where(found, end - q, 0)
        places[:, t] = end
    return places, words[rows[:, None], np.where(found[:, None], places, 0)], found


def _seeds(reads: DataFrame, counts: dict[int, np.ndarray]) -> DataFrame:
    """seq, e, off, q, word: the seeds of reads (seq, e, m) that the references may have; of a read without m clean words of any size one of no letters.

    A word whose bucket is empty is in no reference. Most reads of another origin have m of them, and so no seed at all.
    """
    sent = reads.sparkSession.sparkContext.broadcast(counts)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, places, data = batch.column(0).buffers()
            if not len(batch) or not data:
                continue
            ends = np.frombuffer(places, np.int32)[batch.column(0).offset : batch.column(0).offset + len(batch) + 1]
            none = without_seeds(np.frombuffer(data, np.uint8), ends[:-1], np.diff(ends), batch.column(2).to_numpy(), sent.value)
            batch = batch.take(pa.array(np.flatnonzero(~none)))
            seqs, ms, shapes = batch.column(0).to_pylist(), batch.column(2).to_pylist(), {}
            for i, (seq, m) in enumerate(zip(seqs, ms, strict=True)):
                shapes.setdefault((len(seq), m), []).append(i)
            for (length, m), rows in shapes.items():
                left = np.array(rows)
                for q in sorted(sent.value, reverse=True):
                    if not len(left) or q * m > length:
                        continue
                    if q:
                        codes = _codes([seqs[i] for i in left])
                        may = ~unmatched(codes, q, m, sent.value[q])
                        left = left[may]
                        if not len(left):
                            break
                        places, words, found = rarest_words(codes[may], q, m, sent.value[q])
                    else:
                        places = words = np.zeros((len(left), 1), np.int64)
                        found = np.ones(len(left), bool)
                    row, nth = np.nonzero(found[:, None] & (sent.value[q][words % BUCKETS] > 0))
                    if len(row):
                        of = pa.array(left[row])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(places[row, nth], pa.int32()), pa.array(np.full(len(of), q), pa.int32()), pa.array(words[row, nth], pa.int64())], names=["seq", "e", "off", "q", "word"])
                    left = left[~found]

    return reads.select("seq", "e", "m").mapInArrow(choose, "seq string, e int, off int, q int, word long")


def _balanced_join(seeds: DataFrame, words: DataFrame, counts: dict[int, np.ndarray]) -> DataFrame:
    """seeds joined with words on q and word. The places of a hot bucket are dealt over keys, and so are its seeds; each meets all of the other side's.

    The table of hot buckets has at most len(counts) x BUCKETS rows.
    """
    spark = seeds.sparkSession
    many = {q: max(HOT, 4 * int(c.sum()) // BUCKETS) for q, c in counts.items()}
    hot = [(q, int(b), int(-(-counts[q][b] // many[q]))) for q in counts for b in np.flatnonzero(counts[q] > many[q])]
    by_seed = seeds.groupBy("q", _bucket()).count().filter(F.col("count") > HOT).select("q", "bucket", F.ceil(F.col("count") / HOT).cast("int").alias("n_seed"))
    by_seed = materialise(by_seed, "hot-seeds")
    if not hot and by_seed.isEmpty():
        return seeds.join(words, ["q", "word"])
    by_place = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(zip(*hot, strict=True) if hot else [[], [], []], (pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["q", "bucket", "n_place"]))
    both = materialise(by_place.join(by_seed, ["q", "bucket"], "full").select("q", "bucket", F.coalesce("n_place", F.lit(1)).alias("n_place"), F.coalesce("n_seed", F.lit(1)).alias("n_seed")), "hot")
    dealt = lambda key, n: F.pmod(F.xxhash64(*key), F.coalesce(n, F.lit(1))).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    left = seeds.withColumn("bucket", _bucket()).join(F.broadcast(both), ["q", "bucket"], "left")
    left = left.withColumn("of_seed", dealt(["seq", "off"], F.col("n_seed"))).withColumn("of_place", all_of(F.col("n_place"))).drop("bucket", "n_seed", "n_place")
    right = words.withColumn("bucket", _bucket()).join(F.broadcast(both), ["q", "bucket"], "left")
    right = right.withColumn("of_place", dealt(["ref_id", "at"], F.col("n_place"))).withColumn("of_seed", all_of(F.col("n_seed"))).drop("bucket", "n_seed", "n_place")
    return left.join(right, ["q", "word", "of_seed", "of_place"])


def candidates(reads: DataFrame, refs: DataFrame, similarity: float, least_read: int = 1, wild_share: float = WILD_SHARE, written: bool = False) -> DataFrame:
    """seq, e, ref_id, start (0-based, where an ungapped placement would begin) for reads of ``least_read`` letters at least.

    A place that shares several seeds with a read comes once for each. Reads that come row by row from a ``written``
    table are not written again.
    """
    length = F.length("seq")
    reads = reads.filter(length >= max(1, least_read)).select("seq", _allowed(length, 1 - similarity).alias("e"), (wild_letters(F.col("seq")) > 0).alias("wild"))
    reads = reads if written else materialise(reads, "unique")
    # at most as many rows as the longest read has letters
    shapes = reads.groupBy(length.alias("length"), "e").agg(F.max("wild").alias("wild")).collect()
    places = _places(refs)
    found = _search(reads.withColumn("m", F.col("e") + 1), places, [(r["length"], r["e"] + 1, r["wild"]) for r in shapes])
    dense = places.filter(wild_letters(F.col("word")) > SPELT).select("ref_id").distinct()
    if shapes and not dense.isEmpty():
        more = lambda r: r["e"] + int(wild_share * r["length"] + 1e-9) // (SPELT + 1) + 1
        reach = max(r["length"] + r["e"] for r in shapes) + SEED_SIZES[0]
        around = Window.partitionBy("ref_id").orderBy("at").rangeBetween(-reach, reach)
        near = places.join(dense, "ref_id", "left_semi").withColumn("near", F.max(wild_letters(F.col("word")) > SPELT).over(around)).filter("near").drop("near")
        m = F.col("e") + F.floor(_allowed(length, wild_share) / (SPELT + 1)).cast("int") + 1
        found = found.union(_search(reads.withColumn("m", m), materialise(near, "near-wild"), [(r["length"], more(r), r["wild"]) for r in shapes]))
    return found


def _search(reads: DataFrame, places: DataFrame, shapes: list[tuple[int, int, bool]]) -> DataFrame:
    """seq, e, ref_id, start of all places that share a seed with a read; shapes are length, seeds and whether letters are wild."""
    sizes = set()
    for length, m, wild in shapes:
        fit = [q for q in SEED_SIZES if q * m <= length]
        sizes |= set(fit if wild else fit[:1])
    sizes = sorted(sizes or {0})
    words = _words(places, sizes)
    counts = _bucket_counts(words, sizes)
    seeds = materialise(_seeds(reads, counts), "seeds")
    return _balanced_join(seeds, words, counts).select("seq", "e", "ref_id", (F.col("at") - F.col("off")).alias("start"))


def dealt(rows: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows and side (one row for each ref_id), both with a key _deal: equal rows meet on ref_id and _deal.

    The rows of a reference with more than HOT of them are dealt over keys by a hash of all their columns, and each key
    has the reference's row. The list of such references has at most ``MAX_HOT`` rows, as the bound grows with the rows.
    """
    many = max(HOT, rows.count() // MAX_HOT)
    hot = rows.groupBy("ref_id").count().filter(F.col("count") > many).select("ref_id", F.ceil(F.col("count") / many).cast("int").alias("_n"))
    hot = F.broadcast(materialise(hot, "hot-references"))
    n = F.coalesce("_n", F.lit(1))
    left = rows.join(hot, "ref_id", "left").withColumn("_deal", F.pmod(F.xxhash64(*rows.columns), n).cast("int"))
    right = side.join(hot, "ref_id", "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.drop("_n"), right.drop("_n")


def on_references(rows: DataFrame, side: DataFrame, weight: Column) -> DataFrame:
    """rows (ref_id, ...) joined with side (one row for each ref_id; ``weight`` is a row's size in bytes) on ref_id.

    A side of up to ``SENT`` bytes, added up before, goes to all tasks. A larger one is shuffled, and the rows of common
    references are dealt over keys: most reads of a sample may lie on one species. Spark's own skew join would not split
    them where the next operator needs the rows by ref_id again.
    """
    if (side.agg(F.sum(weight)).first()[0] or 0) <= SENT:
        return rows.join(F.broadcast(side), "ref_id")
    left, right = dealt(materialise(rows, "on-references"), side)
    return left.join(right, ["ref_id", "_deal"]).drop("_deal")


def hamming_hits(reads: DataFrame, refs: DataFrame, similarity: float = 0.97, least_read: int = 1, wild_share: float = WILD_SHARE, written: bool = False) -> DataFrame:
    """seq, ref_id, pos (1-based), ed of all ungapped placements inside a reference."""
    rows = on_references(candidates(reads, refs, similarity, least_read, wild_share, written), refs.select("ref_id", F.col("seq").alias("ref")), F.length("ref"))
    rows = rows.filter((F.col("start") >= 0) & (F.col("start") + F.length("seq") <= F.length("ref")))
    rows = rows.select("seq", "e", "ref_id", "start", F.substring("ref", F.col("start") + 1, F.length("seq")).alias("win"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, windows, lengths = batch.column(0).to_pylist(), batch.column(4).to_pylist(), pc.utf8_length(batch.column(0)).to_numpy()
            edits, keep = np.zeros(len(seqs), np.int64), np.zeros(len(seqs), bool)
            for length in np.unique(lengths):
                same = np.flatnonzero(lengths == length)
                for low in range(0, len(same), max(1, LETTERS // int(length))):
                    part = same[low : low + max(1, LETTERS // int(length))]
                    read, window = _codes([seqs[i] for i in part]), _codes([windows[i] for i in part])
                    wild = (read > 3) | (window > 3)
                    edits[part] = ((read != window) & ~wild).sum(axis=1)
                    keep[part] = wild.sum(axis=1) <= int(wild_share * int(length) + 1e-9)
            keep = pa.array(np.flatnonzero(keep & (edits <= batch.column(1).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(2).take(keep), pc.add(batch.column(3).take(keep).cast(pa.int64()), 1), pa.array(edits).take(keep)], names=["seq", "ref_id", "pos", "ed"])

    kind = refs.schema["ref_id"].dataType.simpleString()
    return rows.mapInArrow(verify, f"seq string, ref_id {kind}, pos long, ed long").distinct()


def semi_global(reads: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Fewest edits of each read against parts of its window that begin at each place, for rows of letter codes (4 is wild).

    The columns of the edit table go as differences in bits (Myers 1999, Hyyro 2003): 64 rows a lane, lanes for longer
    reads one after the other, one step for all pairs at once. Read and window are turned, so that an end is a beginning.
    """
    n, length = reads.shape
    width, one, ones = windows.shape[1], np.uint64(1), np.uint64(2**64 - 1)
    turned, lanes = reads[:, ::-1], -(-length // 64)
    same = np.zeros((lanes, 5, n), np.uint64)
    for i in range(length):
        bit = one << np.uint64(i % 64)
        for c in range(4):
            same[i // 64, c] |= np.where((turned[:, i] == c) | (turned[:, i] == 4), bit, np.uint64(0))
    same[:, 4] = ones
    up, down = np.full((lanes, n), ones), np.zeros((lanes, n), np.uint64)
    score, out, every = np.full(n, length, np.int64), np.empty((n, width), np.int64), np.arange(n)
    for j in range(width):
        letter = windows[:, width - 1 - j]
        plus, minus = np.zeros(n, np.uint64), np.zeros(n, np.uint64)  # the difference that comes in from the lane above
        for b in range(lanes):
            eq, pv, mv = same[b, letter, every], up[b], down[b]
            xv = eq | mv
            eq = eq | minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            last = np.uint64(63 if b < lanes - 1 else (length - 1) % 64)
            out_plus, out_minus = (ph >> last) & one, (mh >> last) & one
            ph, mh = (ph << one) | plus, (mh << one) | minus
            up[b], down[b] = mh | ~(xv | ph), ph & xv
            plus, minus = out_plus, out_minus
        score += plus.astype(np.int64) - minus.astype(np.int64)
        out[:, width - 1 - j] = score
    return out


def _best_start(reads: list[str], windows: list[str], wild_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each read against a part of its window, and the first place where such a part begins.

    Places from where the read's length of letters has too many wild ones, with the read's own, do not count.
    """
    read, window = _codes(reads), _codes(windows)
    edits = semi_global(read, window)
    wild = window > 3
    if wild.any() or (read > 3).any():
        length, width = read.shape[1], window.shape[1]
        so_far = np.concatenate([np.zeros((len(wild), 1), np.int64), np.cumsum(wild, axis=1)], axis=1)
        ends = np.minimum(np.arange(width) + length, width)
        held = so_far[:, ends] - so_far[:, :-1] + (read > 3).sum(axis=1)[:, None]
        edits = np.where(held <= int(wild_share * length + 1e-9), edits, 1 << 30)
    place = edits.argmin(axis=1)
    return edits[np.arange(len(edits)), place], place


def edit_hits(reads: DataFrame, refs: DataFrame, similarity: float = 0.97, least_read: int = 1, wild_share: float = WILD_SHARE, written: bool = False) -> DataFrame:
    """Like hamming_hits with insertions and deletions: windows reach e bases further to both sides."""
    near = on_references(candidates(reads, refs, similarity, least_read, wild_share, written).distinct(), refs.select("ref_id", F.col("seq").alias("ref")), F.length("ref"))
    low = F.greatest(F.lit(0), F.col("start") - F.col("e"))
    near = near.select("seq", "e", "ref_id", low.alias("low"), F.substring("ref", low + 1, F.col("start") + F.length("seq") + F.col("e") - low).alias("win")).filter("win <> ''")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, windows, shapes = batch.column(0).to_pylist(), batch.column(4).to_pylist(), {}
            for i, (x, y) in enumerate(zip(seqs, windows, strict=True)):
                shapes.setdefault((len(x), len(y)), []).append(i)
            edits, place = np.zeros(len(seqs), np.int64), np.zeros(len(seqs), np.int64)
            for rows in shapes.values():
                for low in range(0, len(rows), 4096):
                    part = rows[low : low + 4096]
                    edits[part], place[part] = _best_start([seqs[i] for i in part], [windows[i] for i in part], wild_share)
            keep = np.flatnonzero(edits <= batch.column(1).to_numpy())
            pos = batch.column(3).to_numpy()[keep] + place[keep] + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(2).take(pa.array(keep)), pa.array(pos, pa.int64()), pa.array(edits[keep])], names=["seq", "ref_id", "pos", "ed"])

    kind = refs.schema["ref_id"].dataType.simpleString()
    return near.mapInArrow(verify, f"seq string, ref_id {kind}, pos long, ed long").distinct()


def best_hit(hits: DataFrame, offsets: DataFrame) -> DataFrame:
    """One hit per read: fewest differences, then lowest position in the references laid end to end (g_pos)."""
    placed = on_references(hits, offsets.select("ref_id", "start_off"), F.lit(OFFSET_BYTES)).withColumn("g_pos", F.col("start_off") + F.col("pos"))
    best = F.min(F.struct("ed", "g_pos", "ref_id", "pos")).alias("b")
    return placed.groupBy("seq").agg(best).select("seq", "b.ref_id", "b.pos", "b.ed", "b.g_pos")


def both_strands(hits_of, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """Hits of the reads and of their reverse complements, with strand + or -; the reads are computed once."""
    reads = materialise(reads.select("seq"), "both-strands")
    forward = hits_of(reads, refs).withColumn("strand", F.lit("+"))
    turned = reads.select(reverse_complement(F.col("seq")).alias("seq"))
    back = hits_of(turned, refs).withColumn("seq", reverse_complement(F.col("seq"))).withColumn("strand", F.lit("-"))
    return forward.union(back)


def best_pair(pairs: DataFrame) -> DataFrame:
    """Of each pair's placements the one with the fewest differences of both mates, then the lowest position."""
    best = F.min(F.struct((F.col("ed") + F.col("ed2")).alias("ed"), "g_pos", "ref_id", "pos", "pos2")).alias("b")
    return pairs.groupBy("pair_id").agg(best).select("pair_id", "b.*")


def concordant_pairs(first: DataFrame, second: DataFrame, max_insert: int = 1400) -> DataFrame:
    """Mates (pair_id, ref_id, pos, len) on one reference, in order, spanning at most max_insert bases."""
    other = second.select("pair_id", "ref_id", F.col("pos").alias("pos2"), F.col("len").alias("len2"), *([F.col("ed").alias("ed2")] if "ed" in second.columns else []))
    span = F.col("pos2") + F.col("len2") - F.col("pos")
    return first.join(other, ["pair_id", "ref_id"]).withColumn("span", span).filter((F.col("pos2") >= F.col("pos")) & (span <= max_insert))
