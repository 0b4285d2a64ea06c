"""Rendezvous shards and slots against the formula, and what moves when shards come and go."""

import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from readloom.llm import sharding

SCHEMA = "doc_id long, text string, size string, slot string, row string, best string"
ROWS = [(1, "a"), (1, "a"), (1, "A"), (2, None), (3, ""), (None, "é"), (None, None), (4, "x" * 3_000_000), (-5, "a")]


def scores(key, weights, seed=sharding.SEED):
    draw = lambda i: (int(hashlib.md5(f"{seed}:{i}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    return [-w / math.log(draw(i)) if w else -1 for i, w in enumerate(weights)]


def test_shards_equal_the_formula(spark):
    docs = spark.createDataFrame([(i, t, "s", "t", "r", "b") for i, t in ROWS], SCHEMA)
    weights = [1.0, 0.0, 2.5, 1.0]
    rows = sharding.number_slots(sharding.assign_shards(docs, weights)).collect()
    assert len(rows) == len(ROWS) and set(docs.columns) <= set(rows[0].asDict())
    for r in rows:
        found = scores("" if r.doc_id is None else r.doc_id, [*weights, 1.0])
        assert r.shard == found[:4].index(max(found[:4])) != 1 and r.grown_shard == found.index(max(found)) and r.law == "key"
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    for held in by_shard.values():
        held.sort(key=lambda r: r.slot)
        assert [r.slot for r in held] == list(range(len(held)))
        keys = [(r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in held]
        assert keys == sorted(keys)


def test_few_records_move_and_weights_hold(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    of = lambda w, **k: {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(docs, w, **k).collect()}
    now, grown = of([1.0] * 16), of([1.0] * 17)
    assert all(now[i][1] == grown[i][0] for i in now) and {b for a, b in now.values() if a != b} == {16}
    assert 0.04 < sum(a != b for a, b in now.values()) / 6000 < 0.08
    less = of([1.0] * 15 + [0.0])
    assert all(less[i][0] == now[i][0] for i in now if now[i][0] != 15)
    shares = Counter(a for a, _ in of([1.0, 3.0]).values())
    assert abs(shares[1] / 6000 - 0.75) < 0.03
    assert all(a == b for a, b in of([1.0, 1.0], new_weight=0.0).values())
    assert {a for a, _ in of([0.0, 0.0]).values()} == {None}


def test_slots_in_many_ranges_and_one_hot_key(spark, monkeypatch):
    rows = [(5, "same")] * 700 + [(i, f"t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.number_slots(sharding.assign_shards(docs, [1.0, 1.0])).collect()
    for shard in (0, 1):
        held = sorted((r.slot, r.doc_id) for r in got if r.shard == shard)
        assert [s for s, _ in held] == list(range(len(held))) and [i for _, i in held] == sorted(i for _, i in held)
    written = []
    real = sharding.ranges
    monkeypatch.setattr(sharding, "ranges", lambda *a, **k: written.append(real(*a, **k)) or written[-1])
    sharding.number_slots(sharding.assign_shards(docs, [1.0])).collect()
    most = written[0].groupBy("range").count().agg(F.max("count")).first()[0]
    assert most < 250  # of 1000 rows, 700 of one key
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.number_slots(sharding.assign_shards(empty)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    numbered = sharding.number_slots(sharding.assign_shards(docs, [1.0, 1.0]))
    sharding.write_shards(numbered, str(tmp_path / "shards"), rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, back.select("shard", "slot", "doc_id", "text").collect())) == sorted(map(tuple, numbered.select("shard", "slot", "doc_id", "text").collect()))
    assert {r.n for r in back.groupBy(F.input_file_name()).agg((F.max("slot") - F.min("slot") + 1 - F.count("*")).alias("n")).collect()} == {0}
