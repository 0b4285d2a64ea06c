"""Files with faults, files of ordered lines, windows over borders, and runs that begin at an alignment."""

import json
import random

import pytest
from pyspark.sql import functions as F

from readloom import config, run, tables
from readloom.operators import database, ordered, otu
from readloom.sources import database_files, fasta, files

BAD = {"ACGT\n>h\nAC\n": "begin with", ">h\n>i\nAC\n": "one line", ">h\nAC\nGT\n": "one line", ">h\nAC\n\n\n": "one line", ">h\nAC\n>i": "one line"}


@pytest.mark.parametrize("text", BAD)
def test_strict_reads_refuse(spark, tmp_path, text):
    (tmp_path / "x.fna").write_text(text)
    with pytest.raises(Exception, match=BAD[text]):
        fasta.read_reads(spark, str(tmp_path / "x.fna")).collect()


def test_strict_reads_keep_empty_sequences(spark, tmp_path):
    (tmp_path / "x.fna").write_text(">a_1 y\r\nacgt\r\n>b_1\n\n>c_1\nAC")
    assert [tuple(r) for r in fasta.read_reads(spark, str(tmp_path / "x.fna")).collect()] == [("a_1", "a", "ACGT"), ("b_1", "b", ""), ("c_1", "c", "AC")]
    (tmp_path / "none.fna").write_text("")
    assert fasta.read_reads(spark, str(tmp_path / "none.fna")).collect() == []


def check(text):
    """Line by line, each judged by the one before."""
    out, title = [], False
    for n, line in enumerate(text.split("\n")[:-1], 1):
        if line.startswith(">"):
            out += [(n, "title after title")] * title
            title = True
            continue
        if any(c not in "ACGTNacgtn" for c in line):
            out.append((n, "letter"))
        elif not title:
            out.append((n, "sequence after sequence"))
        title = False
    return out


def test_bad_lines_in_many_ranges(spark, tmp_path, monkeypatch):
    rnd = random.Random(6)
    text = "".join(rnd.choice([">h\n", ">h\n", "ACGT\n", "ACGN\n", "A C\n", "AC\r\n", "\n", "acx\n"]) for _ in range(400))
    (tmp_path / "x.fna").write_bytes(text.encode())
    real = ordered.ranges
    monkeypatch.setattr(fasta, "ranges", lambda df, *k, n=None: real(df, *k, n=50))
    got = fasta.bad_lines(spark, str(tmp_path / "x.fna")).orderBy("line").collect()
    assert [tuple(r) for r in got] == check(text) and len({r.reason for r in got}) == 3


def test_checked_input_is_mended_for_both_mates(spark, tmp_path):
    rnd = random.Random(2)
    a = "".join(rnd.choice("ACGT") for _ in range(300))
    turned = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    database_files.write_database(spark.createDataFrame([(0, "A", a)], "ref_ord long, ref_id string, seq string"), str(tmp_path / "db"), "g", compress=False)
    (tmp_path / "r1.fna").write_text(f">s1_1\n{a[10:50]}\n{a[50:80]}\n>s1_2\n{a[10:80]}\n")
    (tmp_path / "r2.fna").write_bytes(f">x\n{turned(a[150:210])}\r\n>y\n{turned(a[150:210])}\n".encode())
    c = config.Config(str(tmp_path / "r1.fna"), str(tmp_path / "out"), str(tmp_path / "db"), name="g", reads2=str(tmp_path / "r2.fna"), check=True)
    assert [tuple(r) for r in run.run(spark, c)["table"].collect()] == [("A", "s1", 2)]
    log = json.loads((tmp_path / "out/metrics.json").read_text())
    assert [x.split(": ")[1].split(";")[0] for x in log["remarks"]] == ["sequence after sequence in line 3", "letter in line 2"]
    assert (tmp_path / "out/formatted_input_fasta.fna").read_text() == f">s1_1\n{a[10:80]}\n>s1_2\n{a[10:80]}\n"
    both = config.Config(**(vars(c) | {"out": str(tmp_path / "out2"), "pe_count": "lines"}))
    assert [tuple(r) for r in run.run(spark, both)["table"].collect()] == [("A", "s1", 4)]


def test_offsets_keep_quotes_and_tabs(spark, tmp_path):
    ids = ['"q', "a\tb", "x'y\"z", "\\n"]
    refs = spark.createDataFrame([(i, x, "ACGT" * (i + 1)) for i, x in enumerate(ids)], "ref_ord long, ref_id string, seq string")
    database_files.write_database(refs, str(tmp_path), "g", compress=False)
    got = database_files.open_database(spark, str(tmp_path), "g").offsets.orderBy("start_off").collect()
    assert [tuple(r) for r in got] == list(zip(ids, [0, 4, 12, 24], strict=True))
    (tmp_path / "bad.db").write_text("a\tx\n")
    with pytest.raises(Exception, match="no offset"):
        fasta.read_offsets(spark, str(tmp_path / "bad.db")).collect()


def test_lines_as_streams(spark, tmp_path):
    """One key has most of the rows: its line spans ranges and part files, and no row is larger than a value."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("b", i, f"v{i}") for i in range(3000)] + [("a", 0, "one"), ("c", 2, "z"), ("c", 1, "y"), ("c", 1, "y")]
    frame = spark.createDataFrame(rows, "k string, o long, value string").repartition(4)
    files.write_streams(frame, str(tmp_path / "parts"), ["k"], ["o"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [p for p in sorted((tmp_path / "parts").glob("part-*")) if p.stat().st_size]
    assert len(parts) > 2 and max(p.stat().st_size for p in parts) < 0.7 * sum(p.stat().st_size for p in parts)
    files.join_files(spark, str(tmp_path / "parts"), str(tmp_path / "x.txt"), end="\n")
    assert (tmp_path / "x.txt").read_text() == "one\t\n" + "".join(f"v{i}\t" for i in range(3000)) + "\ny\ty\tz\t\n"
    assert not (tmp_path / "parts").exists()


@pytest.mark.parametrize("lines", [[], [("a", [])], [("b", [f"v{i}" for i in range(3000)])], [("a", ["one"]), ("b", [f"v{i}" for i in range(3000)]), ("c", ["y", "", "y"]), ("d", []), ("e", ["z"])]])
def test_streams_are_read_by_records(spark, tmp_path, monkeypatch, lines):
    """A line spans many splits and ranges, and so do short lines beside it; no line is a value in any task."""
    (tmp_path / "x.txt").write_text("\n".join("".join(f"{x}\t" for x in [name, *values]) for name, values in lines) + "\n")
    real = ordered.ranges
    monkeypatch.setattr(files, "ranges", lambda df, *k: real(df, *k, n=50))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    rows = files.read_stream_file(spark, str(tmp_path / "x.txt"))
    got = rows.collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == sorted((name, i, x) for name, values in lines for i, x in enumerate(values))
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_one_file_and_one_line(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(500)], "i long, value string").repartition(4)
    files.write_file(rows, str(tmp_path / "x.txt"), "i")
    assert (tmp_path / "x.txt").read_text() == "".join(f"v{i}\n" for i in range(500))
    files.write_one_line(rows, str(tmp_path / "y.txt"), ">h", "i")
    assert (tmp_path / "y.txt").read_text() == ">h\n" + "".join(f"v{i}" for i in range(500)) + "\n"


def test_windows_over_borders(spark):
    rnd = random.Random(8)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 1, 3, 30]))) for _ in range(40)]
    for spacer in (0, 2):
        refs = database.concat_offsets(spark.createDataFrame(list(zip(range(40), map(str, range(40)), seqs, strict=True)), "ref_ord long, ref_id string, seq string"), spacer)
        text = "".join("N" * spacer + x + "N" * spacer for x in seqs)
        places = [(rnd.randrange(1, len(text) + 1), rnd.randrange(1, 60)) for _ in range(200)] + [(1, 0)]
        got = database.windows(spark.createDataFrame(places, "pos long, len long"), refs).collect()
        assert sorted(map(tuple, got)) == sorted((p, n, text[p - 1 : p - 1 + n]) for p, n in places)


def test_many_positions_in_one_reference(spark, monkeypatch):
    """All positions in one reference, most of them equal: the largest range holds a small share."""
    rows = [(5000, i) for i in range(1500)] + [(i, i) for i in range(200, 700)]
    offsets = spark.createDataFrame([("a", 0, 100), ("b", 100, 9000), ("none", 9000, 9000), ("c", 9000, 9100)], "ref_id string, start_off long, next_off long")
    made, real = [], ordered.ranges
    monkeypatch.setattr(database, "ranges", lambda df, *k, n=None: made.append(real(df, *k, n=40)) or made[-1])
    got = database.locate(spark.createDataFrame(rows, "pos long, v long"), offsets).collect()
    assert len(got) == 2000 and {(r.ref_id, r.next_off) for r in got} == {("b", 9000)}
    assert made[0].groupBy("range").count().agg(F.max("count")).first()[0] < 300
    none = database.locate(spark.createDataFrame([(-1,), (0,), (9050,), (10**6,)], "pos long"), offsets).collect()
    assert sorted((r.pos, r.ref_id) for r in none) == [(0, "a"), (9050, "c"), (10**6, "c")]


def test_compacted_alignment(spark):
    refs = database.concat_offsets(spark.createDataFrame([(0, "a", "ACGTACG"), (1, "b", "TTACGTT")], "ref_ord long, ref_id string, seq string"))
    # ACGTACGTTACGTT: ACGT at 1, 5 (over the border) and 10; its extension ACGTT at 5 and 10
    lines = [(1, "all", 5, "AAAA"), (2, "all", 1, "AAAA"), (3, "all", 10, "CCCCC"), (4, "*", 0, "ACGT"), (5, "all", 10, "GGGG")]
    got = otu.compact_alignment(spark.createDataFrame(lines, "rix long, rname string, pos long, seq string"), refs)
    assert {r.rix: r.pos for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1}


def test_biom_without_taxonomy(spark):
    table = spark.createDataFrame([("A", "s", 2)], "otu_id string, sample string, n long")
    samples, order = spark.createDataFrame([("s", 0)], "sample string, ix long"), spark.createDataFrame([("A", 0)], "otu_id string, ref_ord long")
    assert json.loads(fasta.biom_rows(table, None, samples, order).first().entry) == {"id": "A", "metadata": None}


def test_counts_file(spark, tmp_path):
    samples = spark.createDataFrame([("s a", 0), ("t", 1)], "sample string, ix long")
    counts = spark.createDataFrame([(0, "t", 3), (1, "s a", 1), (1, "t", 2)], "rix long, sample string, n long")
    fasta.write_counts(counts, samples, str(tmp_path / "c.db"))
    assert (tmp_path / "c.db").read_text() == "2\ns a\nt\n1:3:\n0:1:1:2:\n"
    names, cells = fasta.read_counts(spark, str(tmp_path / "c.db"))
    assert sorted(map(tuple, names.collect())) == [("s a", 0), ("t", 1)] and sorted(map(tuple, cells.collect())) == [(0, 1, 3), (1, 0, 1), (1, 1, 2)]


def test_rejected_reads_with_a_name_in_common_are_logged(spark, tmp_path):
    a = "ACGGTCATTACGGATCCGATTACAGGTTCAGA" * 3
    database_files.write_database(spark.createDataFrame([(0, "A", a)], "ref_ord long, ref_id string, seq string"), str(tmp_path / "db"), "g", compress=False)
    (tmp_path / "r.fna").write_text(f">s_1\n{a[:60]}\n>s_1\nACNT\n>s_2\n{a[:50]}\n")
    c = config.Config(str(tmp_path / "r.fna"), str(tmp_path / "out"), str(tmp_path / "db"), name="g", logs=True)
    results = run.run(spark, c)
    assert (tmp_path / "out/filtered.txt").read_text() == "s_1\tAMBIGUOUS\n"
    log = json.loads((tmp_path / "out/metrics.json").read_text())
    assert log["counters"] == {"n_reads": 3, "n_ambiguous": 1, "ambiguous_bases": 1, "n_samples": 1, "n_distinct": 2, "n_sequences": 1, "n_committed": 2, "n_rejected": 0, "n_chimeras": 0, "n_assigned": 1, "n_expanded": 2}
    assert set(log["seconds"]) == {"filter", "align", "compact and look up", "table", "logs"}
    assert results["members"].count() == 2  # what is returned is kept
    top = tables.shared_dir(spark).removeprefix("file://")
    assert not list(__import__("pathlib").Path(top, "readloom").glob("work-*"))


def test_empty_run(spark, tmp_path):
    database_files.write_database(spark.createDataFrame([(0, "A", "ACGT" * 9)], "ref_ord long, ref_id string, seq string"), str(tmp_path / "db"), "g", compress=False)
    (tmp_path / "r.fna").write_text("")
    c = config.Config(str(tmp_path / "r.fna"), str(tmp_path / "out"), str(tmp_path / "db"), name="g", logs=True)
    assert run.run(spark, c)["table"].count() == 0
    assert json.loads((tmp_path / "out/otutable.biom").read_text())["shape"] == [0, 0]


def test_compatible_options():
    levels = {"1.005": (1, 4), "2.005": (2, 4), "3.010": (3, 9), "0.005": (0, 5), "2.1": (2, 100), "1.01": (1, 10)}
    assert {k: config.parse_denoise(k, True) for k in levels} == levels
    with pytest.raises(ValueError):
        config.Config(reads="", out="o", database="d", alignment="x").validate()
