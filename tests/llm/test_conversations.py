"""Conversation repair against a search over all cheapest paths, whole and in segments."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from readloom.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    """Per conversation the rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        held, say = out.setdefault(conv, []), lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if d == 0:
            continue
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        held += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def least(rows):
    """Of all edits the cheapest, then the least in order, with the repaired lines: all ways are kept by state, least first."""
    add = {"": "u", "s": "u", "u": "a", "a": "u"}
    keep = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def best(ways):
        out = {}
        for q, way in ways:
            out[q] = min(out.get(q, way), way)
        return out

    def insert(ways):
        for _ in range(3):
            ways = best([*ways.items(), *((add[q], (c + 2, s + "I", (*t, names[add[q]] + ":"))) for q, (c, s, t) in ways.items())])
        return ways

    ways, seen, faults = {"": (0, "", ())}, set(), []
    for _, role, text in rows:
        body = text.strip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        new = []
        for q, (c, s, t) in insert(ways).items():
            new.append((q, (c + 3, s + "D", t)))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (q, role[:1]) in keep:
                    new.append((keep[q, role[:1]], (c + more, s + "K", (*t, f"{role}:{text}"))))
                new.append((add[q], (c + 2 + more, s + "R", (*t, f"{names[add[q]]}:{text}"))))
        ways = best(new)
    cost, audit, lines = min(w for q, w in insert(ways).items() if q in ("", "a"))
    return cost, audit, lines, [faults.count(x) for x in ("blank", "duplicate", "truncated")]


def expected(rows, damaged=True):
    out = []
    for conv, held in (damage(rows) if damaged else rows).items():
        held = sorted(held, key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in held if t is not None]
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        cost, audit, lines, faults = least(held)
        out.append((conv, min(max(turns) - min(turns) + 1 - len(set(turns)), cv.MOST) if turns else 0, *faults, pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed, n_convs=60):
    """Rows with faults of all kinds and few ties of turns within a conversation."""
    rnd, rows = random.Random(seed), []
    for conv in [None, *range(n_convs)]:
        turns = sorted(rnd.sample(range(40), rnd.randrange(1, 13)))
        for turn in turns:
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys", "u", "User"])
            rows.append((conv, turn, role, rnd.choice([None, "", " \t", "Hi.", "Hi.", "yes", "What? \n", "x" * 90 + rnd.choice(".a"), "Ünï!"])))
    rows += [(900, None, "user", "a."), (900, 3, "assistant", "b."), (901, None, None, None), (902, -(2**62), "user", "a."), (902, 2**62 + 5, "user", "b.")]
    return rows


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize(("long_rows", "segment"), [(8192, 1 << 25), (3, 4096), (0, 1 << 25)])
def test_repair_equals_brute_force(spark, monkeypatch, long_rows, segment):
    """Whole, and with long conversations in segments of one and of all rows of a range."""
    rows = some_rows(7, 60 if long_rows > 5 else 25)
    frame = cv.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    summary, turns = cv.repair(frame, long_rows, segment_bytes=segment)
    want = expected(rows)
    assert got(summary.select("conv_id", *cv.COUNTS, "audit", "repaired_sha256")) == want
    assert any("I" in w[7] for w in want) and any("R" in w[7] for w in want) and any("D" in w[7] for w in want)
    pieces = {}
    for r in turns.orderBy("range", "chunk").collect():
        pieces[r.conv_id] = pieces.get(r.conv_id, []) + [f"{t.role}:{t.text}" for t in r.turns]
    assert all(hashlib.sha256("\n".join(pieces.get(w[0], [])).encode()).hexdigest() == w[8] for w in want)


def test_one_long_conversation_of_equal_and_other_rows(spark):
    rnd = random.Random(3)
    held = [(t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b!", "c", f"n{t}."])) for t in range(400)] + [(7, "user", "same.")] * 300
    frame = spark.createDataFrame([(1, *r, False) for r in held] + [(2, 0, "user", "q?", False), (2, 1, "assistant", "", False), (3, 0, "user", "gone", True)], SCHEMA + ", gone boolean")
    summary = cv.repair(frame, long_rows=100, segment_bytes=50 * 4096)[0]
    rows = {1: sorted(held), 2: [(0, "user", "q?"), (1, "assistant", "")], 3: []}
    assert got(summary.select("conv_id", *cv.COUNTS, "audit", "repaired_sha256")) == expected(rows, damaged=False)


def test_conversations_on_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", gone string, key string")
    assert cv.repair(cv.damaged(empty))[0].count() == 0
    rows = some_rows(11, 5)
    more = spark.createDataFrame(rows, SCHEMA).withColumns({"gone": F.lit(True), "key": F.lit(1), "fault": F.lit("x"), "h": F.lit(None)})
    assert got(cv.repair(cv.damaged(more))[0].select("conv_id", *cv.COUNTS, "audit", "repaired_sha256")) == expected(rows)
    dropped = [(c, t, "user", "x") for c in range(40) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    alone = [r for r in dropped if sum(d[0] == r[0] for d in dropped) == 1]
    out = cv.repair(cv.damaged(spark.createDataFrame(alone, SCHEMA)))[0].collect()
    assert alone and {(r.audit, r.cost, r.gaps, r.repaired_sha256) for r in out} == {("", 0, 0, hashlib.sha256().hexdigest())}


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "word " * 200_000), (1, 1, "assistant", "word " * 200_000 + "."), (1, 2, "user", "word " * 200_000)]
    for long_bytes in (1 << 26, 1000):
        assert got(cv.repair(cv.damaged(spark.createDataFrame(rows, SCHEMA)), long_bytes=long_bytes)[0].select("conv_id", *cv.COUNTS, "audit", "repaired_sha256")) == expected(rows)
