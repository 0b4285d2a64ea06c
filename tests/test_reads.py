"""Reads of long texts."""

import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.operators import align, otu, tiles
from readloom.plans import catalogue


def test_long_texts_are_cut_in_one_pass(spark, tmp_path):
    """A place in a text of a million letters is not looked for from its beginning for each piece."""
    text = "".join(random.Random(7).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3_000_000))
    spark.createDataFrame([(1, "x", text), (2, "x", None), (3, "y", "...")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    rows = catalogue._reads(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("letters"), F.max("read_id").alias("last")).first()
    letters = sum(c != " " for c in text)
    assert (rows.n, rows.letters, rows.last) == (-(-letters // 60), letters, (1 << 26) + -(-letters // 60) - 1)
    assert time.time() - began < 20


def test_odd_texts_are_cut_like_expressions(spark, tmp_path, monkeypatch):
    """Arrays give what the expressions on whole texts give, over borders of what is worked on at a time too."""
    monkeypatch.setattr(tiles, "BYTES", 100)
    texts = ["İstanbul K ÄÖß Straße" * 9, None, "", "Zz" * 30, "z" * 61, "é" * 50, "x\ny\0z" * 40, "ΑΣ ςA" * 30]
    spark.createDataFrame([(i if i else None, "x" if i % 3 else None, t) for i, t in enumerate(texts * 3)], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for bases in (catalogue.CLEAN, catalogue.WITH_N):
        want = []
        for r in catalogue._whole(spark, str(tmp_path), bases).collect():
            want += [(r.doc_id and r.doc_id * catalogue.TILES + i // 60, r.sample, r.seq[i : i + 60]) for i in range(0, len(r.seq), 60)]
        got = [tuple(r) for r in catalogue._reads(spark, str(tmp_path), bases).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_reads_of_texts_are_not_made_by_expressions(spark, tmp_path):
    spark.createDataFrame([(1, "x", "abc")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue._reads(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp" not in plan and "translate" not in plan


def test_counts_meet_few_hits_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "x", "the quick brown fox jumps over the lazy dog " * 4)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog " * 6)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts, best = catalogue._counts_and_best(spark, str(tmp_path))
    plan = otu.otu_table(counts, best)._jdf.queryExecution().executedPlan().toString()
    assert best.count() > 0 and "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_reads_without_a_seed_are_not_shuffled(spark, tmp_path):
    """The hits of the reads that are left are those of all reads, in places and in edits."""
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    items = [text(400) for _ in range(5)]
    docs = [text(3000) for _ in range(30)] + [x[p : p + 200] for x in items for p in range(0, 120, 7)] + [x[:30] + x[31:90] + text(40) for x in items] + [None, "", "é"]
    spark.createDataFrame([(i, "x", t) for i, t in enumerate(docs)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole, near = catalogue._unique(spark, str(tmp_path)), catalogue._unique_near(spark, str(tmp_path))
    rows = lambda df: sorted(map(str, df.collect()))
    assert near.count() < whole.count() / 3
    best = rows(catalogue._best(spark, str(tmp_path)))
    assert best and best == rows(catalogue._best_of(whole, spark, str(tmp_path)))
    edits = lambda reads: rows(align.best_hit(align.edit_hits(reads, catalogue._refs(spark, str(tmp_path)), 0.97), catalogue._offsets(spark, str(tmp_path))))
    found = rows(catalogue.q22(spark, str(tmp_path)))
    assert len(found) > len(best) and found == edits(whole)


def test_otu_map_is_read_back_by_records(spark, tmp_path, monkeypatch):
    """A line was cut up anew for each of its reads, and reads without a seed were written. A read without an id comes last, as in SQL."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    items = [text(400) for _ in range(4)]
    docs = [text(3000) for _ in range(30)] + [x[p : p + 200] for x in items[:3] for p in range(0, 120, 7)] + [items[0]] * 20 + [None, ""]
    spark.createDataFrame([(i if i % 37 else None, "x", t) for i, t in enumerate(docs)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    reads, best = catalogue._reads_and_best(spark, str(tmp_path))
    order = Window.partitionBy("otu_id").orderBy(F.asc_nulls_last("read_id"))
    want = reads.join(best, "seq").select(F.col("ref_id").alias("otu_id"), "read_id").withColumn("place", F.row_number().over(order) - 1)
    want = sorted(map(str, want.select("otu_id", F.col("place").cast("long"), "read_id").collect()))
    real, written = catalogue.materialise, {}
    monkeypatch.setattr(catalogue, "materialise", lambda df, name: written.setdefault(name, real(df, name)))
    found = catalogue.q56(spark, str(tmp_path))
    assert sorted(map(str, found.collect())) == want and any("read_id=None" in x for x in want)
    assert found.columns == ["otu_id", "place", "read_id"] and {kind for _, kind in found.dtypes} == {"bigint"}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert written["reads"].count() < reads.count() / 3
