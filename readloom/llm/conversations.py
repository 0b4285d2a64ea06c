"""Conversation repair: the cheapest edits that make a conversation's roles follow ``(s?(ua)+)?``, by tight arcs.

A conversation's rows in order and four states of the pattern (nothing yet, system, user, assistant) span a graph: a
node is a state before a row, arcs keep (K), delete (D) or rerole (R) the row, or insert an empty turn (I) before it.
Forward and backward minimum costs mark the arcs that lie on a cheapest path, those for which forward cost, arc and
backward cost add up to the least total. A walk over the set of nodes that its letters so far can have reached takes
the least letter of any tight arc, and ends as soon as the pattern may end. A letter leads from a node to one node at
most, so equal letters give one repaired conversation.

Conversations of up to ``long_rows`` rows and ``long_bytes`` bytes are read as sorted rows of a task, one after the
other. Longer ones are cut into segments: a segment's effect is a table of costs from each state before it to each
state behind it, tables are joined along the conversation (both ways), and then each segment walks from every state
that a cheapest path can enter it by. So the rows of one conversation, if it held a third of all, are spread over all
tasks; equal rows of one turn travel as one row with a count. Two things of a long conversation stay in one piece: its
audit, one letter a row, and the digest of its repaired text, which is streamed through one task in order, as
SHA-256 is a chain.

Rules: rows go by turn, null turns first, then role, the first 64 characters of the text, the text's 64-bit hash and
the text. A null role or text is one space; a role's initial is its first character, and only s, u and a can be kept.
A row's fault is the first of: blank (no character but blanks and line ends), duplicate (role and text seen earlier in
the conversation), truncated (the last other character is no full stop, exclamation or question mark). Null
conversation ids are one conversation. A conversation without rows gives zeros, an empty audit and no turns; rows that
are marked ``gone`` only keep their conversation in the result. Costs beyond a long do not occur, as they are at most
4 a row; gaps are at most the largest long. Columns other than the four are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import discard, materialise
from readloom.llm.textbatch import tidy
from readloom.operators.ordered import ranges

BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of the edits.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: States: nothing yet, system, user, assistant. Which state follows by a turn that is inserted or reroled, and by one
#: that is kept; in which the pattern may end.
STATES, OVER = range(4), (0, 3)
ADDED = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = ("su", "ua", "au")
ROLES = {2: "user", 3: "assistant"}
FAR = 1 << 60
MOST = 2**63 - 1
LONG_ROWS, LONG_BYTES = 8192, 64 << 20
#: Up to so many long conversations, their ids are broadcast (counted before).
MAX_BROADCAST = 100_000


@lru_cache(None)
def arcs(initial: str, fault: int) -> tuple[tuple[str, int, int, int], ...]:
    """Letter, state before, state behind and cost of what can be done with a row."""
    found = [("D", p, p, DELETE) for p in STATES]
    if fault not in (BLANK, DUPLICATE):
        more = CUT_OFF * (fault == TRUNCATED)
        found += [("K", p, q, more) for p, q in KEPT.get(initial, {}).items()]
        found += [("R", p, q, REROLE + more) for p, q in ADDED.items()]
    return tuple(found)


def _inserted(costs: list[int]) -> list[int]:
    """Forward costs of a layer once turns may be inserted there."""
    user = min(costs[2], costs[0] + INSERT, costs[1] + INSERT, costs[3] + INSERT)
    return [costs[0], costs[1], user, min(costs[3], user + INSERT)]


def _back(costs: list[int]) -> list[int]:
    """Backward costs of a layer once turns may be inserted there."""
    user = min(costs[2], costs[3] + INSERT)
    return [min(costs[0], user + INSERT), min(costs[1], user + INSERT), user, min(costs[3], user + INSERT)]


END = _back([0 if q in OVER else FAR for q in STATES])


def forward(rows: list[tuple[str, int, int]], start: list[int]) -> list[list[int]]:
    """Least costs of the nodes before each row (initial, fault, copies), with insertions, and last behind all rows, without."""
    layers, costs = [], start
    for initial, fault, copies in rows:
        costs = _inserted(costs)
        layers.append(costs)
        new = [FAR] * 4
        for _, p, q, c in arcs(initial, fault):
            new[q] = min(new[q], costs[p] + c)
        costs = [min(FAR, c + DELETE * (copies - 1)) for c in new]
    return [*layers, costs]


def backward(rows: list[tuple[str, int, int]], end: list[int]) -> list[list[int]]:
    """Least costs from the nodes before each row to the end, given those of the layer behind the rows; that layer too."""
    layers = [end]
    for initial, fault, copies in reversed(rows):
        new = [FAR] * 4
        for _, p, q, c in arcs(initial, fault):
            new[p] = min(new[p], layers[-1][q] + c + DELETE * (copies - 1))
        layers.append(_back(new))
    return layers[::-1]


def walk(rows: list[tuple[str, int, int]], before: list[list[int]], behind: list[list[int]], start: int, total: int) -> tuple[list[str], int]:
    """From a node on a cheapest path before the rows: the letters at each row (insertions before it first), and the state behind them."""
    nodes, letters = {start}, []
    for i, (initial, fault, copies) in enumerate(rows):
        here = ""
        while not here.endswith(("D", "K", "R")):
            more = DELETE * (copies - 1)  # an arc of the row leads behind its copies, which are deleted
            tight = [(a, q) for a, p, q, c in arcs(initial, fault) if p in nodes and before[i][p] + c + more + behind[i + 1][q] == total]
            tight += [("I", q) for p, q in ADDED.items() if p in nodes and before[i][p] + INSERT + behind[i][q] == total]
            letter = min(tight)[0]
            nodes = {q for a, q in tight if a == letter}
            here += letter
        letters.append(here + "D" * (copies - 1))
    return letters, nodes.pop()


def closing(state: int) -> str:
    """The insertions with which a conversation ends."""
    letters = ""
    while state not in OVER:
        letters, state = letters + "I", ADDED[state]
    return letters


def repaired(letters: list[str], rows: list[tuple[str, str]], state: int, after: str = "") -> Iterator[tuple[int, str, str]]:
    """Number of the row, role and text of the turns that the letters of rows (role, text) leave, then of those inserted behind."""
    for i, (here, (role, text)) in enumerate(zip([*letters, after], [*rows, ("", "")], strict=True)):
        for letter in here:
            if letter == "K":
                state = KEPT[role[0]][state]
                yield i, role, text
            elif letter in "IR":
                state = ADDED[state]
                yield i, ROLES[state], text if letter == "R" else ""


@lru_cache(1 << 14)
def _cheapest(rows: tuple[tuple[str, int, int], ...]) -> tuple[int, tuple[str, ...], str]:
    before, behind = forward(list(rows), [0, FAR, FAR, FAR]), backward(list(rows), END)
    letters, state = walk(list(rows), before, behind, 0, behind[0][0])
    return behind[0][0], tuple(letters), closing(state)


def cheapest(rows: list[tuple[str, int, int]]) -> tuple[int, tuple[str, ...], str]:
    """Cost, letters at each row and closing letters; what short conversations have in common is worked out once."""
    return (_cheapest if len(rows) <= 64 else _cheapest.__wrapped__)(tuple(rows))


def _summary(turns: list[int | None], faults: list[int], initials: list[str]) -> dict[str, int]:
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return {"gaps": min(gaps, MOST), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": pairs}


TURNS = "array<struct<role: string, text: string>>"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` says, dropped rows marked ``gone``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("d"))
    rows = rows.withColumn("times", F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    gone = F.col("d") == 0
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with a key of the conversation that is never null, and the fault of a row by itself."""
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(*ENDS), FINE).otherwise(TRUNCATED)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return rows.select(key.alias("key"), "conv_id", "turn", "role", "text", "gone", fault.alias("fault"), F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("h"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """The rows of each conversation of sorted batches."""
    held: list[dict] = []
    for batch in batches:
        for key, rows in groupby(batch.to_pylist(), lambda r: r["key"]):
            rows = list(rows)
            if held and held[0]["key"] != key:
                yield held[0]["conv_id"], held
                held = []
            held += rows
    if held:
        yield held[0]["conv_id"], held


def _repair_short(rows: DataFrame) -> DataFrame:
    """conv_id, the counts, audit, turns: conversations that fit a task's memory, several of them."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    names = ["conv_id", *COUNTS, "audit", "turns"]

    @tidy
    def repair_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, id_type = [], 0, None

        def batch_of(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [id_type, *[pa.int64()] * len(COUNTS), pa.string(), kind], strict=True)], names=names)

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield batch

        for conv_id, all_rows in _conversations(typed(batches)):
            rows, seen, faults = [r for r in all_rows if not r["gone"]], set(), []
            for r in rows:
                said = (r["role"], r["text"])
                faults.append(DUPLICATE if r["fault"] != BLANK and said in seen else r["fault"])
                seen.add(said)
            initials = [r["role"][:1] for r in rows]
            cost, letters, after = cheapest([(i, f, 1) for i, f in zip(initials, faults, strict=True)])
            turns = [{"role": role, "text": text} for _, role, text in repaired(list(letters), [(r["role"], r["text"]) for r in rows], 0, after)]
            counts = _summary([r["turn"] for r in rows], faults, initials) | {"cost": cost}
            out.append([conv_id, *[counts[c] for c in COUNTS], "".join(letters) + after, turns])
            size += sum(len(t["text"]) for t in turns)
            if len(out) >= 2000 or size > 16 << 20:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(", ".join(f"{c} long" for c in COUNTS) + f", audit string, turns {TURNS}")])
    dealt = rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "head", "h", "text")
    return dealt.select("key", "conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(repair_all, schema)


# ---- long conversations ----------------------------------------------------------------------------------------

SEGMENT = ["key", "range", "chunk"]


def _segments(rows: DataFrame, weight: int) -> DataFrame:
    """key, range, chunk, at, initial, fault, copies, role, text of the rows of long conversations, written once.

    at numbers the rows of a range; a segment (key, range, chunk) has about ``weight`` bytes, 4096 of them for the row itself.
    """
    equal = rows.groupBy("key", "turn", "role", "text", "fault", "head", "h").agg(F.count(F.lit(1)).alias("copies"))
    equal = equal.withColumns({"late": F.col("turn").isNotNull().cast("int"), "at_turn": F.coalesce("turn", F.lit(0).cast(rows.schema["turn"].dataType)), "digest": F.sha2("text", 256)})
    first = equal.groupBy("key", "role", "digest").agg(F.min(F.struct("late", "at_turn")).alias("first"))
    rows = equal.join(first, ["key", "role", "digest"])
    again = (F.col("fault") != BLANK) & (F.struct("late", "at_turn") > F.col("first"))
    fault = F.when(again, DUPLICATE).otherwise(F.col("fault"))
    order = ["key", "late", "at_turn", "role", "head", "h"]
    rows = ranges(rows.withColumn("fault", fault).select(*order, "text", "fault", "copies"), *order)
    inside = Window.partitionBy("range").orderBy(*order, "text")
    so_far = F.sum(F.octet_length("text") + 4096).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"at": F.row_number().over(inside), "chunk": F.floor(so_far / weight)})
    gone = F.col("fault").isin(BLANK, DUPLICATE)
    return materialise(rows.select(*SEGMENT, "at", F.left("role", F.lit(1)).alias("initial"), "fault", "copies", "role", F.when(gone, "").otherwise(F.col("text")).alias("text")), "segments")


def _rows_of(table: pa.Table) -> list[tuple[str, int, int]]:
    return list(zip(*[table[c].to_pylist() for c in ("initial", "fault", "copies")], strict=True))


def _cost_table(table: pa.Table) -> pa.Table:
    """One row for a segment: costs from state to state, initials at its ends, its faults and illegal pairs."""
    rows = _rows_of(table.sort_by("at"))
    costs = [forward(rows, [0 if q == p else FAR for q in STATES])[-1] for p in STATES]
    first, last, pairs = rows[0][0], rows[-1][0], 0
    for i, (initial, _, copies) in enumerate(rows):
        pairs += copies - 1 + (i > 0 and rows[i - 1][0] + initial not in LEGAL)
    count = lambda fault: sum(c for _, f, c in rows if f == fault)
    again = count(DUPLICATE) + sum(c - 1 for _, f, c in rows if f in (FINE, TRUNCATED))
    cut = sum(f == TRUNCATED for _, f, _ in rows)
    head = {c: table[c][:1] for c in SEGMENT}
    return pa.table(head | {"costs": pa.array([sum(costs, [])], pa.list_(pa.int64())), "ends": [first + "\n" + last], "faults": pa.array([[count(BLANK), again, cut, pairs]], pa.list_(pa.int64()))})


def _join_costs(table: pa.Table) -> pa.Table:
    """For each segment of one conversation: forward costs before it, backward costs behind it, the conversation's cost and illegal pairs at borders."""
    table = table.sort_by([("range", "ascending"), ("chunk", "ascending")])
    steps = [np.array(c, object).reshape(4, 4) for c in table["costs"].to_pylist()]
    before, behind = [[0, FAR, FAR, FAR]], [END]
    for m in steps:
        before.append([min(FAR, *(before[-1][p] + m[p, q] for p in STATES)) for q in STATES])
    for m in reversed(steps):
        behind.append([min(FAR, *(m[p, q] + behind[-1][q] for q in STATES)) for p in STATES])
    behind = behind[::-1]
    ends = [e.split("\n") for e in table["ends"].to_pylist()]
    border = [0] + [int(a[1] + b[0] not in LEGAL) for a, b in zip(ends, ends[1:], strict=False)]
    longs = pa.list_(pa.int64())
    return pa.table({c: table[c] for c in SEGMENT} | {"before": pa.array(before[:-1], longs), "behind": pa.array(behind[1:], longs), "cost": [int(behind[0][0])] * len(steps), "faults": table["faults"], "border": border})


def _walk_segment(rows: pa.Table, costs: pa.Table) -> pa.Table:
    """For each state by which a cheapest path can enter the segment: the state behind it and the letters at each row."""
    head, rows = {c: rows[c][0].as_py() for c in SEGMENT}, _rows_of(rows.sort_by("at"))
    start, end, total = (costs[c][0].as_py() for c in ("before", "behind", "cost"))
    before, behind = forward(rows, start), backward(rows, end)
    found = [(p, *walk(rows, before, behind, p, total)) for p in STATES if start[p] + behind[0][p] == total]
    names = {"key": pa.string(), "range": pa.int32(), "chunk": pa.int64()}
    same = {c: pa.array([head[c]] * len(found), k) for c, k in names.items()}
    return pa.table(same | {"state": pa.array([p for p, _, _ in found], pa.int32()), "next": pa.array([q for _, _, q in found], pa.int32()), "letters": pa.array([x for _, x, _ in found], pa.list_(pa.string()))})


def _choose(table: pa.Table) -> pa.Table:
    """Of each segment of one conversation the state by which its walk enters, and the closing letters behind the last."""
    rows = sorted(table.select([*SEGMENT, "state", "next"]).to_pylist(), key=lambda r: (r["range"], r["chunk"]))
    state, out = 0, []
    for place, ways in groupby(rows, lambda r: (r["range"], r["chunk"])):
        out.append((*place, state))
        state = {w["state"]: w["next"] for w in ways}[state]
    key = rows[0]["key"]
    return pa.table({"key": [key] * len(out), "range": pa.array([r for r, _, _ in out], pa.int32()), "chunk": pa.array([c for _, c, _ in out], pa.int64()), "state": pa.array([s for _, _, s in out], pa.int32()), "after": [""] * (len(out) - 1) + [closing(state)]})


def _turns_of_segment(rows: pa.Table, chosen: pa.Table) -> pa.Table:
    """key, range, chunk, place, role, text of the repaired turns of a segment."""
    kept = rows.sort_by("at").select(["role", "text"]).to_pylist()
    way = chosen.to_pylist()[0]
    found = list(repaired(way["letters"], [(r["role"], r["text"]) for r in kept], way["state"], way["after"]))
    names = {"key": pa.string(), "range": pa.int32(), "chunk": pa.int64()}
    return pa.table({c: pa.array([way[c]] * len(found), k) for c, k in names.items()} | {"place": pa.array(range(len(found)), pa.int32()), "role": pa.array([r for _, r, _ in found], pa.string()), "text": pa.array([t for _, _, t in found], pa.string())})


@tidy
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and SHA-256 of each conversation's turns, as they come."""
    held, key = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([held.hexdigest()])], names=["key", "repaired_sha256"])
    for batch in batches:
        for k, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held is not None and k != key:
                yield done()
                held = None
            line = f"{role}:{text}".encode()
            if held is None:
                held, key = hashlib.sha256(line), k
            else:
                held.update(b"\n" + line)
    if held is not None:
        yield done()


def _repair_long(rows: DataFrame, weight: int) -> tuple[DataFrame, DataFrame]:
    """Of long conversations (rows that are not gone): key with counts, audit and repaired_sha256; and all repaired turns."""
    held = "key string, range int, chunk long"
    segments = _segments(rows, weight)
    plain = segments.select(*SEGMENT, "at", "initial", "fault", "copies")
    tables = plain.groupBy(*SEGMENT).applyInArrow(_cost_table, f"{held}, costs array<long>, ends string, faults array<long>")
    costs = materialise(tables.groupBy("key").applyInArrow(_join_costs, f"{held}, before array<long>, behind array<long>, cost long, faults array<long>, border long"), "costs")
    ways = materialise(plain.groupBy(*SEGMENT).cogroup(costs.groupBy(*SEGMENT)).applyInArrow(_walk_segment, f"{held}, state int, next int, letters array<string>"), "ways")
    chosen = ways.drop("letters").groupBy("key").applyInArrow(_choose, f"{held}, state int, after string")
    chosen = materialise(ways.join(chosen, [*SEGMENT, "state"]).select(*SEGMENT, "state", "letters", "after"), "chosen")
    pieces = F.array_sort(F.collect_list(F.struct("range", "chunk", F.concat(F.array_join("letters", ""), "after").alias("text"))))
    audits = chosen.groupBy("key").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("audit"))
    faults = [F.sum(F.col("faults")[i]).alias(c) for i, c in enumerate(["blank", "duplicate", "truncated", "inside"])]
    counts = costs.groupBy("key").agg(*faults, F.sum("border").alias("border"), F.first("cost").alias("cost"))
    turn = F.col("turn").cast("decimal(38,0)")
    spans = rows.groupBy("key", "turn").count().groupBy("key").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("turn"), F.lit(0)).alias("span"))
    gaps = F.least("span", F.lit(MOST).cast("decimal(38,0)")).cast("long")
    turns = segments.select(*SEGMENT, "at", "role", "text").groupBy(*SEGMENT).cogroup(chosen.groupBy(*SEGMENT)).applyInArrow(_turns_of_segment, f"{held}, place int, role string, text string")
    turns = materialise(turns, "turns")
    lines = turns.repartition("key").sortWithinPartitions(*SEGMENT, "place").select("key", "role", "text").mapInArrow(_digests, "key string, repaired_sha256 string")
    found = counts.join(audits, "key").join(spans, "key").join(lines, "key", "left")
    found = found.select("key", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("inside") + F.col("border")).alias("illegal"), "cost", "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    found = materialise(found, "long")
    for table in (segments, costs, ways, chosen):
        discard(table)
    return found, turns


def _split(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of short conversations, rows of long ones, and the long ones' ids (the last two None without any)."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.first("conv_id").alias("conv_id"))
    long = materialise(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("key", "conv_id"), "long-ids")
    n = long.count()
    if not n:
        return rows, None, None
    ids = F.broadcast(long.select("key")) if n <= MAX_BROADCAST else long.select("key")
    return rows.join(ids, "key", "left_anti"), rows.join(ids, "key", "left_semi"), long


def _digest_of(turns: Column) -> Column:
    line = F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return F.sha2(F.array_join(line, "\n").cast("binary"), 256)


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, segment_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """Repairs rows (conv_id, turn, role, text, gone), role and text not null.

    Returns one row per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), and the repaired turns, as lists of one conversation or, if it is long, of one segment:
    conv_id, range, chunk (its place in the conversation; null for a whole one), turns (role, text).
    """
    short, long, ids = _split(_keyed(rows), long_rows, long_bytes)
    done = materialise(_repair_short(short), "repaired")
    summary = done.select("conv_id", *COUNTS, "audit", _digest_of(F.col("turns")).alias("repaired_sha256"))
    turns = done.select("conv_id", F.lit(None).cast("int").alias("range"), F.lit(None).cast("long").alias("chunk"), "turns")
    if long is None:
        return summary, turns
    found, said = _repair_long(materialise(long.filter("NOT gone"), "long-rows"), segment_bytes)
    empty = {c: F.lit(0) for c in COUNTS} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    of_long = ids.join(found, "key", "left").select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in empty.items()])
    ordered = F.array_sort(F.collect_list(F.struct("place", "role", "text")))
    pieces = said.join(ids, "key").groupBy("conv_id", "range", "chunk").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return summary.unionByName(of_long), turns.unionByName(pieces)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(rows)[0].select("conv_id", *COUNTS, "audit", "repaired_sha256")


def _sql() -> str:
    """A search over all ways, row by row: of those that reach a state the cheapest is kept, then the least in letters."""
    way = lambda c, a, t: f"{{c: {c}, a: {a}, t: {t}}}"
    added = lambda x, role: way(f"{x}.c + {INSERT}", f"{x}.a || 'I'", f"{x}.t || chr(10) || '{role}:'")
    reroled = lambda x, role: way(f"{x}.c + {REROLE} + more", f"{x}.a || 'R'", f"{x}.t || chr(10) || '{role}:' || text")
    kept = lambda x: way(f"{x}.c + more", f"{x}.a || 'K'", f"{x}.t || chr(10) || role || ':' || text")
    deleted = lambda x: way(f"{x}.c + {DELETE}", f"{x}.a || 'D'", f"{x}.t")
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    only = lambda initial, x: f"CASE WHEN left(role, 1) = '{initial}' THEN {kept(x)} ELSE {deleted('far')} END"
    free = lambda x, *ways: f"CASE WHEN must THEN {deleted(x)} ELSE {least(deleted(x), *ways)} END"
    user = f"SELECT *, {way(10**9, repr('~'), repr(''))} AS far, {least('u', *[added(x, 'user') for x in 'nsa'])} AS u1 FROM rec"
    both = f"SELECT *, {least('a', added('u1', 'assistant'))} AS a1 FROM ({user})"
    states = [deleted("n") + " AS n", free("s", only("s", "n")) + " AS s", free("u1", *[f(x) for x in ("n", "s", "a1") for f in (lambda y: reroled(y, "user"), lambda y: only("u", y))]) + " AS u", free("a1", reroled("u1", "assistant"), only("a", "u1")) + " AS a"]
    far = way(10**9, "'~'", "''")
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    ends = ", ".join(f"'{c}'" for c in ENDS)
    return f"""
    WITH RECURSIVE crc16 AS (SELECT list(t ORDER BY k) AS tbl FROM (SELECT k, list_reduce([1, 2, 3, 4], lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k::BIGINT) AS t FROM range(16) r(k))),
    src AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '') AS h FROM conversations),
    drawn AS (SELECT cid, conv_id, turn, role, text, xor(list_reduce(list_transform(range(len(h)), lambda i: ('0x' || h[xor(i, 1) + 1])::BIGINT), lambda c, b: xor(c >> 4, tbl[(xor(c, b) & 15) + 1]), 4294967295), 4294967295) % 20 AS d FROM src, crc16),
    left_over AS (SELECT cid, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '{"".join(ENDS)}', '') ELSE text END AS text FROM drawn, range(2) r(i) WHERE d <> 0 AND (i = 0 OR d = 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, {blanks}) AS body FROM left_over),
    judged AS (SELECT *, CASE WHEN body = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 THEN {DUPLICATE} WHEN right(body, 1) NOT IN ({ends}) THEN {TRUNCATED} ELSE {FINE} END AS fault, lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY pos) || left(role, 1) AS pair FROM placed),
    rows AS MATERIALIZED (SELECT *, fault IN ({BLANK}, {DUPLICATE}) AS must, CASE WHEN fault = {TRUNCATED} THEN {CUT_OFF} ELSE 0 END AS more FROM judged),
    rec AS (SELECT DISTINCT cid, 0::BIGINT AS pos, {way(0, "''", "''")} AS n, {far} AS s, {far} AS u, {far} AS a FROM src
      UNION ALL SELECT cid, pos, {", ".join(states)} FROM (SELECT x.n, x.s, x.u1, x.a1, x.far, r.cid, r.pos, r.role, r.text, r.must, r.more FROM ({both}) x JOIN rows r ON r.cid = x.cid AND r.pos = x.pos + 1)),
    counts AS (SELECT cid, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY cid)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, w.c::BIGINT AS cost, w.a AS audit, sha256(substr(w.t, 2)) AS repaired_sha256
    FROM (SELECT DISTINCT cid, conv_id FROM src) LEFT JOIN counts USING (cid) JOIN (SELECT cid, pos, {least("n", "a1")} AS w FROM ({both})) e USING (cid) WHERE e.pos = coalesce(n_rows, 0)
    """


SQL = {"op11_conversations": _sql()}
