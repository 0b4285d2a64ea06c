"""Exact Jaccard self-join of word-shingle sets with PartEnum signatures, and the components of its links.

Sets whose sizes lie in one band [l, l / threshold] or in neighbouring bands can be similar, and then differ in at
most k elements. The feature domain (64-bit shingle hashes) is cut into n1 first-level ranges of ``N2`` second-level
ranges each, where n1 * (K2 + 1) > k, so at least one first-level range holds at most ``K2`` differences; a
signature is made for every way of leaving out K2 second-level ranges, hence one of them is shared. A set makes the
signatures of its own band and of the next one. Empty projections are left out where enough others must agree.

Equal sets are one class from the start. Signatures travel as sorted, compressed blocks, one per map batch and
range of signatures, so a signature met in one class only never becomes a row; of each ``SIG_BITS`` bits are kept,
which can only add candidates. The number of ranges grows with the bytes of text. Classes that share signatures are
compared in steps that lose no link: every member of a signature with its smallest one (whose sketch and text
travel once for each block of such members, so that a class that half of all others meet is no hot key); then, for signatures whose
members are still in different components, a task finds those members that size and a parity sketch, which bounds
the difference of two sets from below, leave within reach of another component. A signature of more than ``IN_TASK``
members, or ``IN_TASK_ELEMENTS`` elements of their sets, is replaced by the pairs of its blocks first: its members
outside its largest component are dealt into blocks, all members too, and each pair of such blocks is a group of its
own. The members left are few; their full sets meet in one task for each hub (the smallest member of a signature), so
a set that many signatures name travels once for each of its hubs, and the task yields only as many links as join the
components. Pairs inside one component need no comparison, as they cannot change a component.

Rules: null and empty texts have no shingles and link with nothing; a text with fewer words than ``width`` has one
shingle, its whole sequence; rows with a null id keep their class but never name a component. Classes are known by
64-bit hashes of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import discard, materialise, partitions, spread
from readloom.llm.components import connected_components
from readloom.llm.textbatch import WordHasher, decode, encode, mix, release, slices, split_by_range, tidy

N2, K2 = 3, 1
SUBSETS = list(combinations(range(N2), N2 - K2))
#: Classes named in a broadcast when texts of candidates are fetched; beyond, a join does it.
MAX_BROADCAST_IDS = 1_000_000
#: Members of a signature that one task compares with each other in memory, and the elements of all their sets.
IN_TASK, IN_TASK_ELEMENTS = 4096, 4 << 20
#: Pairs of one class, and elements of the sets paired with it, in a block that meets its sketch or text.
BLOCK_PAIRS, BLOCK_ELEMENTS = 512, 1 << 17
#: Bits of a signature, and text bytes for each range of signatures: a shingle makes about half a signature.
SIG_BITS, RANGE_BYTES = 52, 32 << 20


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    ends = np.cumsum(counts)
    rolled = hashes.copy()
    for j in range(1, width):
        rolled[: len(hashes) - j] = mix(rolled[: len(hashes) - j]) + hashes[j:]
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            yield np.unique(mix(rolled[end - n : end - width + 1]))
        elif n:
            yield np.array([xxhash.xxh3_64_intdigest(hashes[end - n : end].tobytes(), seed=n)], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def bands(num: int, den: int, up_to: int) -> list[tuple[int, int]]:
    """Bands [l, r] of set sizes, r = floor(l * den / num) for a threshold of num / den."""
    out, low = [], 1
    while not out or out[-1][1] < up_to:
        out.append((low, low * den // num))
        low = out[-1][1] + 1
    return out


def n_differences(num: int, den: int, largest: int) -> int:
    """Most elements in which two similar sets of at most this size differ: floor(2 (1 - t) / (1 + t) * size)."""
    return 2 * (den - num) * largest // (den + num)


@lru_cache(maxsize=4096)
def _plan(size: int, num: int, den: int) -> list[tuple]:
    """For the set's own band and the next one: (band, number of agreeing first-level ranges or 0, range edges, labels)."""
    levels = bands(num, den, size)
    own, out = len(levels) - 1, []
    for level, largest in ((own, levels[-1][1]), (own + 1, (levels[-1][1] + 1) * den // num)):
        k = n_differences(num, den, largest)
        n1 = k // (K2 + 1) + 1 + min(3, k // 16)
        edges = np.array([(j << 64) // (n1 * N2) for j in range(n1 * N2)], np.uint64)
        label = np.arange(n1 * len(SUBSETS), dtype=np.uint64).reshape(n1, len(SUBSETS)) + np.uint64(level << 32)
        out.append((level, n1 - k // (K2 + 1) if k else 0, edges, mix(label)))
    return out


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """PartEnum signatures of a sorted set of hashes."""
    out = []
    size = len(s)
    if not size:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    for level, agreeing, edges, label in _plan(size, num, den):
        if not agreeing:
            out.append(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=level)], np.uint64))
            continue
        at = np.searchsorted(s, edges)
        upper = np.append(at[1:], size)
        part = (sums[upper] - sums[at]).reshape(-1, N2)
        full = (upper > at).reshape(-1, N2)
        sigs = mix(np.stack([part[:, a] + part[:, b] for a, b in SUBSETS], axis=1) + label)
        some = np.stack([full[:, a] | full[:, b] for a, b in SUBSETS], axis=1)
        # Similar sets agree, but for K2 parts, in at least ``agreeing`` first-level ranges. A set with fewer ranges
        # that hold an empty projection shares one that is not empty, so its empty ones can go.
        out.append(sigs[some] if (~some).any(axis=1).sum() < agreeing else sigs.ravel())
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of about as many cells as elements; two sketches differ in no more bits than the sets in elements."""
    cells = max(64, 1 << max(len(s) - 1, 0).bit_length())
    return np.packbits(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements in which the sketched sets differ."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a)
    n = len(a)
    while n > len(b):
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    return (x ^ int.from_bytes(b)).bit_count()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))


def _sets(batches: Iterator[pa.RecordBatch], width: int, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hasher = WordHasher()
    for batch in batches:
        for low, high in slices(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)), 4 << 20):
            part = batch.slice(low, high - low)
            yield part, list(shingle_sets(*hasher(part.column(column).to_pylist()), width))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0


SIGNED = pa.int64()
BOTH = pa.schema([("part", pa.int32()), ("doc_id", SIGNED), ("node", SIGNED), ("n", SIGNED), ("text_hash", SIGNED), ("sketch", pa.binary()), ("payload", pa.binary())])


def classes_and_blocks(docs: DataFrame, width: int, num: int, den: int, n_parts: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: part null, of a document, with its class, set size and sketch; else a block of signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, done = [], 0, {}

        def blocks() -> pa.RecordBatch:
            sigs = np.concatenate([s for _, s in held])
            nodes = np.repeat(np.array([x for x, _ in held], np.uint64), [len(s) for _, s in held])
            sigs >>= np.uint64(64 - SIG_BITS)
            order, at = split_by_range(sigs, n_parts, SIG_BITS)
            sigs, nodes = sigs[order], nodes[order]
            ranges = [(p, low, high) for p, (low, high) in enumerate(zip(at, at[1:], strict=False)) if low < high]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in ranges], pa.int32()), *[pa.nulls(len(ranges), SIGNED)] * 4, pa.nulls(len(ranges), pa.binary()), pa.array([_block(sigs[low:high], nodes[low:high]) for _, low, high in ranges], pa.binary())], schema=BOTH)

        for batch, sets in _sets(batches, width):
            nodes = [_node(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(sets), pa.int32()), batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(list(map(len, sets)), SIGNED), batch.column(2), pa.array(list(map(sketch, sets)), pa.binary()), pa.nulls(len(sets), pa.binary())], schema=BOTH)
            for node, s in zip(nodes, sets, strict=True):
                if len(s) and node not in done:
                    done[node] = None
                    held.append((node, signatures(s, num, den)))
                    n_held += len(held[-1][1])
            if n_held > 1_000_000:
                yield blocks()
                held, n_held, done = [], 0, {}
        if held:
            yield blocks()

    return _rows(docs, id_col, text_col).mapInArrow(tidy(sign), "part int, doc_id long, node long, n long, text_hash long, sketch binary, payload binary")


def _block(sigs: np.ndarray, nodes: np.ndarray) -> bytes:
    """Signatures as differences; nodes as places in a table of the block's nodes."""
    table, place = np.unique(nodes, return_inverse=True)
    return np.uint32(len(table)).tobytes() + table.tobytes() + encode(sigs, place.astype(np.uint32))


def _open_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    sigs, place = decode(data[4 + 8 * n :], "u4")
    return sigs, np.frombuffer(data, np.uint64, n, 4)[place]


def _shared(table: pa.Table) -> pa.Table:
    """Members of signatures that more than one class has."""
    opened = [_open_block(x.as_py()) for x in table["payload"]]
    sigs, nodes = np.concatenate([s for s, _ in opened]), np.concatenate([n for _, n in opened])
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    first = np.append(True, (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1]))
    sigs, nodes = sigs[first], nodes[first]
    same = np.append(False, sigs[1:] == sigs[:-1])
    keep = same | np.append(same[1:], False)
    return pa.table({"sig": sigs[keep].view(np.int64), "node": nodes[keep].view(np.int64)})


def _in_blocks(pairs: DataFrame, weight: Column, most: int) -> DataFrame:
    """pairs (a, b, ...) with block: the pairs of one ``a`` are dealt into blocks of about ``most`` of the weight's sum."""
    loads = pairs.groupBy("a").agg(F.ceil(F.sum(weight) / most).cast("int").alias("n_blocks"))
    hot = materialise(loads.filter("n_blocks > 1"), "hubs")
    n_blocks = F.coalesce("n_blocks", F.lit(1))
    side = F.broadcast(hot) if hot.count() <= MAX_BROADCAST_IDS else hot
    return pairs.join(side, "a", "left").withColumn("block", F.pmod(F.xxhash64("b"), n_blocks).cast("int")).drop("n_blocks")


def _meet(pairs: DataFrame, of_a: DataFrame, of_b: DataFrame, n_buckets: int, function, schema: str) -> DataFrame:
    """function of tables of many hubs: pairs (a, block, ...) with of_b's columns, and (a, block) with of_a's columns.

    A hub's data travel once for each of its blocks, not for each of its pairs; all that meets is a block of a hub.
    """
    bucket = lambda *key: F.pmod(F.xxhash64(*key), F.lit(n_buckets)).alias("bucket")
    pairs = materialise(pairs, "blocks")
    left = pairs.join(of_b, "b").select(bucket("a", "block"), *pairs.columns, *[c for c in of_b.columns if c != "b"])
    hubs = pairs.select(F.col("a").alias("hub"), F.col("block").alias("hub_block")).distinct()
    right = hubs.join(of_a.withColumnRenamed("a", "hub"), "hub").select(bucket("hub", "hub_block"), "hub", "hub_block", *[c for c in of_a.columns if c != "a"])
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(function, schema)


def _hubs(table: pa.Table, column: str) -> dict[tuple[int, int], object]:
    return {(a, block): x for a, block, x in zip(table["hub"].to_pylist(), table["hub_block"].to_pylist(), table[column], strict=True)}


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """a, b and m (the size of b's set) of the pairs whose sizes and sketches do not rule a link out; no link is lost."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.struct("n", "sketch").alias(f"s{x}"))
    pairs = _in_blocks(pairs, F.lit(1), BLOCK_PAIRS)
    n_buckets = max(4 * partitions(pairs.sparkSession), pairs.count() // IN_TASK)

    def prune(left: pa.Table, right: pa.Table) -> pa.Table:
        hubs, keep, sizes = {k: x.as_py() for k, x in _hubs(right, "sa").items()}, [], []
        for a, block, b in zip(left["a"].to_pylist(), left["block"].to_pylist(), left["sb"].to_pylist(), strict=True):
            i, j, p, q = hubs[a, block]["n"], b["n"], hubs[a, block]["sketch"], b["sketch"]
            keep.append(num * max(i, j) <= den * min(i, j) and least_difference(p, q) * (den + num) <= (den - num) * (i + j))
            sizes.append(j)
        kept = left.select(["a", "b"]).append_column("m", pa.array(sizes, pa.int64()))
        return kept.filter(pa.array(keep, pa.bool_()))

    return _meet(pairs, side("a"), side("b"), n_buckets, prune, "a long, b long, m long")


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of some nodes; a short list of nodes is broadcast, so that the other texts do not travel."""
    nodes = materialise(nodes, "named")
    return texts.join(F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_IDS else nodes, "node", "left_semi")


def _linked(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose texts' sets are similar."""
    pairs = materialise(_possible(pairs, sketches, num, den), "possible")
    texts = _texts_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    elements = pairs.agg(F.sum("m")).first()[0] or 0
    n_buckets = max(4 * partitions(pairs.sparkSession), -(-elements // (IN_TASK_ELEMENTS // 8)))
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        hasher, kept = WordHasher(), []
        hubs = _hubs(right, "text_a")
        order = np.lexsort((left["block"].to_numpy(), left["a"].to_numpy()))
        left = left.take(pa.array(order))
        a, block, texts = left["a"].to_pylist(), left["block"].to_pylist(), left["text_b"]
        held, s = None, None
        sizes = np.asarray(pc.binary_length(texts.combine_chunks()))
        for low, high in slices(sizes, 4 << 20):
            for i, t in zip(range(low, high), shingle_sets(*hasher(texts.slice(low, high - low).to_pylist()), width), strict=True):
                if held != (a[i], block[i]):
                    held = (a[i], block[i])
                    (s,) = shingle_sets(*hasher([hubs[held].as_py()]), width)
                if num * max(len(s), len(t)) <= den * min(len(s), len(t)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if den * both >= num * (len(s) + len(t) - both):
                        kept.append(i)
        release()
        return left.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return _meet(_in_blocks(pairs, F.col("m"), BLOCK_ELEMENTS).drop("m"), side("a"), side("b"), n_buckets, verify, "a long, b long")


def _groups(table: pa.Table) -> Iterator[pa.Table]:
    """The table's rows of each signature or hub."""
    table = table.sort_by([("sig", "ascending"), ("n", "ascending"), ("node", "ascending")])
    sigs = table["sig"].to_numpy()
    cuts = np.append(np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1])), len(sigs)).tolist()
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield table.slice(low, high - low)


def _within_reach(table: pa.Table, num: int, den: int) -> pa.Table:
    """Members of signatures that have, in another component, a member whose size and sketch allow a link."""
    out = []
    for group in _groups(table):
        labels, n = group["label"].to_numpy(), group["n"].to_numpy()
        data = group["sketch"].to_pylist()
        width = min(map(len, data))  # longer sketches are folded: the bound gets looser, never wrong
        cells = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in data])
        near = np.zeros(len(n), bool)
        # Of two members in different components, one is outside the group's largest component.
        _, part = np.unique(labels, return_inverse=True)
        for i in np.flatnonzero(part != np.bincount(part).argmax()).tolist():
            low, high = np.searchsorted(n, -(-num * n[i] // den)), np.searchsorted(n, den * n[i] // num, side="right")
            rest = slice(low, high)
            differ = np.bitwise_count(cells[rest] ^ cells[i]).sum(axis=1, dtype=np.int64)
            close = (part[rest] != part[i]) & (differ * (den + num) <= (den - num) * (n[rest] + n[i]))
            near[rest] |= close
            near[i] |= close.any()
        if near.any():
            out.append(group.select(["sig", "node", "label", "n"]).filter(pa.array(near)))
    return pa.concat_tables(out) if out else table.select(["sig", "node", "label", "n"]).slice(0, 0)


def _spanning(group: pa.Table, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links that join the components of a signature's members as all their links would, found by an inverted index."""
    sets = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
    nodes, sizes = group["node"].to_pylist(), np.array(list(map(len, sets)))
    _, part = np.unique(group["label"].to_numpy(), return_inverse=True)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(element, kind="stable")]
    n_holders = np.bincount(element)
    first = np.cumsum(n_holders) - n_holders
    at = np.cumsum(sizes) - sizes
    # Of two members in different components, one is outside the component that is the largest now.
    for i in np.flatnonzero(part != np.bincount(part).argmax()).tolist():
        if (part == part[0]).all():
            return
        own = element[at[i] : at[i] + sizes[i]]
        length = n_holders[own]
        ends = np.cumsum(length)
        both = np.bincount(holder[np.repeat(first[own] - ends + length, length) + np.arange(ends[-1])], minlength=len(sets))
        linked = (den * both >= num * (sizes + sizes[i] - both)) & (part != part[i])
        others, where = np.unique(part[linked], return_index=True)
        for j in np.flatnonzero(linked)[where].tolist():
            yield min(nodes[i], nodes[j]), max(nodes[i], nodes[j])
        part[np.isin(part, others)] = part[i]


def _spanning_links(near: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between components among the members of each signature, by their full sets."""
    alike = near.groupBy("sig").agg(F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("elements"), F.min(F.xxhash64("node", F.lit(2))).alias("hub"))
    once = alike.groupBy("x", "y", "k", "elements", "hub").agg(F.min("sig").alias("sig"))
    # Signatures of one hub share most of their members. A hub that holds too much is split by its signatures.
    hubs = once.groupBy("hub").agg(F.ceil(F.sum("elements") / IN_TASK_ELEMENTS).alias("splits"))
    once = once.join(hubs, "hub").select("sig", F.xxhash64("hub", F.pmod(F.xxhash64("sig"), "splits")).alias("hub"))
    once = materialise(near.join(once, "sig").select(F.col("hub").alias("sig"), "node", "label", "n").distinct(), "once")
    n_buckets = _n_buckets(once)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    def span(table: pa.Table) -> pa.Table:
        out = {x for group in _groups(table) for x in _spanning(group, num, den)}
        return pa.table(list(map(pa.array, zip(*out, strict=True))) if out else [[], []], schema=pa.schema([("a", SIGNED), ("b", SIGNED)]))

    sets = _texts_of(texts, once.select("node").distinct()).select("node", "text").mapInArrow(tidy(hashes), "node long, hashes binary")
    return once.join(sets, "node").groupBy(F.pmod(F.xxhash64("sig"), F.lit(n_buckets))).applyInArrow(span, "a long, b long")


def _n_buckets(members: DataFrame) -> int:
    """Groups of signatures for tasks in which their members (sig, n) meet."""
    elements = members.agg(F.sum("n")).first()[0] or 0
    return max(4 * partitions(members.sparkSession), -(-elements // (IN_TASK_ELEMENTS // 4)))


def _paired_blocks(large: DataFrame) -> DataFrame:
    """Groups (sig, node, label, n) in place of signatures too large for a task (sig, node, label, n, main, n_blocks, n_outer).

    Every member outside the signature's component ``main`` meets every member in one of the new groups.
    """
    block = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    group = F.xxhash64("sig", "outer", "block").alias("sig")
    outer = large.filter("label <> main").withColumn("outer", block(1, F.col("n_outer"))).withColumn("block", numbers(F.col("n_blocks")))
    every = large.withColumn("block", block(2, F.col("n_blocks"))).withColumn("outer", numbers(F.col("n_outer")))
    return outer.select(group, "node", "label", "n").union(every.select(group, "node", "label", "n")).distinct()


def _links(members: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Enough links between classes to have all components."""
    # Near copies share many signatures; one for each set of members is enough.
    alike = members.groupBy("sig").agg(F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"), F.count(F.lit(1)).alias("k"), F.min("node").alias("a"))
    alike = alike.groupBy("x", "y", "k").agg(F.min(F.struct("sig", "a")).alias("s")).select("s.sig", "s.a")
    members = materialise(members.join(alike, "sig").join(sketches.select("node", "n"), "node").select("sig", "node", "n", "a"), "members")
    tested = materialise(members.filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = materialise(_linked(tested, sketches, texts, width, num, den), "linked")
    labels = connected_components(links)
    named = members.join(labels, "node", "left").select("sig", "node", "n", F.coalesce("label", "node").alias("label"))
    sizes = named.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("elements"))
    groups = sizes.groupBy("sig").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"), F.sum("elements").alias("elements"), F.max(F.struct("k", "elements", "label")).alias("main")).filter("parts > 1")
    blocks = lambda k, elements: F.greatest(F.ceil(2 * k / IN_TASK), F.ceil(2 * elements / IN_TASK_ELEMENTS), F.lit(1)).cast("int")
    k, elements, main = F.col("k"), F.col("elements"), F.col("main")
    groups = groups.select("sig", ((k > IN_TASK) | (elements > IN_TASK_ELEMENTS)).alias("large"), main["label"].alias("main"), blocks(k, elements).alias("n_blocks"), blocks(k - main["k"], elements - main["elements"]).alias("n_outer"))
    open_ = materialise(named.join(groups, "sig"), "open")
    met = open_.filter("NOT large").select("sig", "node", "label", "n")
    large = open_.filter("large")
    if not large.isEmpty():
        met = materialise(met.union(_paired_blocks(large)), "met")
    near = met.join(sketches.select("node", "sketch"), "node").select("sig", "node", "label", "n", "sketch")
    near = near.groupBy(F.pmod(F.xxhash64("sig"), F.lit(_n_buckets(met)))).applyInArrow(lambda t: _within_reach(t, num, den), "sig long, node long, label long, n long")
    return links.union(materialise(_spanning_links(materialise(near, "near"), texts, width, num, den), "linked"))


def jaccard_components(docs: DataFrame, width: int = 4, threshold: Fraction = Fraction(85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links; null if no id is known), component (a hash, null without shingles) and text_hash (Spark's xxhash64), one row per row of docs."""
    spark = docs.sparkSession
    num, den = threshold.numerator, threshold.denominator
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_parts = max(partitions(spark), -(-n_bytes // RANGE_BYTES))
    both = materialise(classes_and_blocks(docs, width, num, den, n_parts, id_col, text_col), "signatures")
    rows = materialise(both.filter("part IS NULL").select("doc_id", "node", "n", "text_hash"), "classes")
    sketches = both.filter("part IS NULL").select("node", "n", "sketch")
    blocks = both.filter("part IS NOT NULL").select("part", "payload")
    members = materialise(blocks.groupBy("part").applyInArrow(_shared, "sig long, node long"), "shared")
    classes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    candidates = materialise(members.select("node").distinct(), "nodes")
    if candidates.isEmpty():
        discard(both)
        labels = candidates.withColumn("label", F.col("node"))
    else:
        texts = _candidate_texts(docs, rows, candidates, width, id_col, text_col)
        sketches = materialise(sketches.join(candidates, "node").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
        discard(both)
        labels = connected_components(_links(members, sketches, texts, width, num, den))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    of_node = named.join(lowest, "label").select("node", "component_id", "label")
    return rows.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("label").alias("component"), "text_hash")


def _candidate_texts(docs: DataFrame, rows: DataFrame, candidates: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node, text of one document of each candidate class."""
    picked = materialise(rows.join(candidates, "node").groupBy("node").agg(F.min("doc_id").alias("pick"), F.count(F.col("doc_id")).alias("n_ids")), "picked")
    if picked.filter("n_ids = 0").isEmpty() and rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        small = picked.count() <= MAX_BROADCAST_IDS
        chosen = picked.select("node", F.col("pick").alias("doc_id"))
        return materialise(_rows(docs, id_col, text_col).join(F.broadcast(chosen) if small else chosen, "doc_id").select("node", "text"), "texts")
    # Ids are missing or repeat: texts are found by hashing them again.

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(s) for s in sets], np.uint64).view(np.int64)), batch.column(1)], names=["node", "text"])

    named = _rows(docs, id_col, text_col).mapInArrow(tidy(name), "node long, text binary").join(candidates, "node")
    return materialise(named.groupBy("node").agg(F.min("text").alias("text")), "texts")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")).select("doc_id", "n_shingles", "component_id")
