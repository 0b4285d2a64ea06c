import json
import random

import pytest
from pyspark.sql import functions as F

from readloom import config, run
from readloom.functions import sequences as s
from readloom.operators import align, database, filtering, ordered, otu
from readloom.sources import database_files, fasta, lzw
from readloom.tables import materialise


def _run_model(seqs):
    """Sorted neighbours: a sequence joins the next one while it is its prefix."""
    order, out = sorted(set(seqs)), {}
    for i in range(len(order) - 1, -1, -1):
        after = order[i + 1] if i + 1 < len(order) else None
        out[order[i]] = out[after] if after and after.startswith(order[i]) else order[i]
    return out


def test_prefix_runs_equal_the_sorted_model(spark):
    rnd = random.Random(3)
    seqs = ["".join(rnd.choice("AAC") for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    got = filtering.prefix_representatives(spark.createDataFrame([(x,) for x in set(seqs)], "seq string"))
    assert {r.seq: r.rep for r in got.collect()} == _run_model(seqs)


def test_q5_ambiguous_reads_count_as_a(spark):
    reads = spark.createDataFrame([(1, "s", "ACNT")], "read_id long, sample string, seq string")
    assert {r.kmer: r.n for r in filtering.count_kmers(reads, 3).collect()} == {"ACA": 1, "CAT": 1}
    clean, bad = filtering.reject_ambiguous(reads)
    assert clean.count() == 0 and bad.first().reason == "AMBIGUOUS"


def test_denoise_rules(spark):
    rows = spark.createDataFrame([("A", 1, 5), ("C", 1, 1), ("G", 2, 1), ("T", 1, None)], "seq string, copies long, min_kmer long")
    kept = lambda x, y: sorted(r.seq for r in filtering.denoise(rows, x, y).collect())
    assert kept(1, 3) == ["A", "G", "T"] and kept(2, None) == ["G"] and kept(None, 2) == ["A", "T"] and kept(None, None) == ["A", "C", "G", "T"]
    with pytest.raises(ValueError):
        filtering.denoise(rows, -1, None)


def test_support_words_of_mates(spark):
    row = spark.range(1).select(s.support_words(F.lit("AAACCCGGGT"), 3, "endpiece").alias("e"), s.support_words(F.lit("AAACCCGGGT"), 3, head=F.lit(4)).alias("p"), s.kmers(F.lit("AC"), 3).alias("k")).first()
    assert row.e == ["AAA", "CCC", "GGG", "GGT"] and row.p == ["AAA", "GGG"] and row.k == []


def test_offsets_look_up_and_flush_end(spark):
    refs = spark.createDataFrame([(0, 10, "ACGT"), (1, 11, ""), (2, 12, "GGG")], "ref_ord long, ref_id long, seq string")
    off = database.concat_offsets(refs, blocks=2)
    assert [(r.ref_id, r.start_off, r.end_off) for r in off.orderBy("ref_ord").collect()] == [(10, 0, 4), (11, 4, 4), (12, 4, 7)]
    found = database.locate(spark.createDataFrame([(0,), (3,), (4,), (7,), (900000,)], "pos long"), off)
    assert {r.pos: r.ref_id for r in found.collect()} == {0: 10, 3: 10, 4: 12, 7: 12, 900000: 12}
    hit = spark.createDataFrame([(1, 4, 4)], "pos long, len long, next_off long")
    assert database.chimera_flag(hit).first().is_chimera and not database.chimera_flag(hit, flush_end="accept").first().is_chimera


def test_edit_hits_equal_brute_force(spark):
    rnd = random.Random(5)
    refs = ["".join(rnd.choice("ACGT") for _ in range(120)) for _ in range(3)]
    reads = []
    for _ in range(12):
        r, p = rnd.randrange(3), rnd.randrange(50)
        x = list(refs[r][p : p + 60])
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(x))
            x[i : i + 1] = rnd.choice([["A"], [], ["C", "G"]])
        reads.append("".join(x))
    frame = spark.createDataFrame([(x,) for x in set(reads)], "seq string")
    got = align.edit_hits(frame, spark.createDataFrame(list(enumerate(refs)), "ref_id long, seq string"), 0.95)
    got = {(r.seq, r.ref_id): r.ed for r in got.groupBy("seq", "ref_id").agg(F.min("ed").alias("ed")).collect()}
    want = {}
    for x in set(reads):
        for i, ref in enumerate(refs):
            e = int(0.05 * len(x) + 1e-9)
            row = [0] * (len(ref) + 1)
            for n, base in enumerate(x, 1):
                new = [n]
                for j, other in enumerate(ref, 1):
                    new.append(min(row[j - 1] + (base != other), row[j] + 1, new[j - 1] + 1))
                row = new
            if min(row) <= e:
                want[x, i] = min(row)
    assert got == want


def test_compaction_takes_the_first_position(spark):
    hits = spark.createDataFrame([("AC", 9), ("ACG", 3), ("ACG", 5), ("AG", 1)], "win string, pos long")
    assert {(r.win, r.pos): r.new_pos for r in otu.compact_positions(hits).collect()} == {("AC", 9): 9, ("ACG", 3): 9, ("ACG", 5): 9, ("AG", 1): 1}


def test_fasta_and_sam(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">s1_1 x\nacgt\n>s2_2\nAC\r\nGT\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "a.fna")).collect()
    assert [(r.header, r.seq, r.n_lines) for r in rows] == [("s1_1 x", "acgt", 1), ("s2_2", "ACGT", 2)]
    assert [r.reason for r in fasta.validate_fasta(spark, str(tmp_path / "a.fna")).collect()] == ["sequence lines"]
    (tmp_path / "b.sam").write_text("0\t0\tr\t7\t1\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\n1\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    sam = fasta.read_sam(spark, str(tmp_path / "b.sam")).orderBy("rix").collect()
    assert (sam[0].pos, sam[0].tags, sam[1].rname) == (7, "NM:i:0", "*")


def test_lzw_round_trip():
    data = bytes(random.Random(1).choices(b"ACGT\n", k=300_000)) + b"A" * 5000
    assert lzw.decompress(lzw.compress(data)) == data and lzw.compress(b"") == b""


def test_headers_without_sequence(spark):
    rows = spark.createDataFrame([(0, "a", ""), (1, "b", "AC"), (2, "c", "GG")], "ord long, header string, seq string")
    assert [(r.header, r.seq) for r in database.drop_empty_headers(rows).orderBy("ord").collect()] == [("a", "AC"), ("c", "GG")]


def test_prefix_runs_and_compaction_in_many_ranges(spark, monkeypatch):
    """A shared primer, empty text, and ranges so small that runs cross their bounds."""
    rnd = random.Random(9)
    seqs = {""} | {"ACGTACGTACGT" + "".join(rnd.choice("AAC") for _ in range(rnd.randint(0, 9))) for _ in range(500)}
    made = ordered.ranges

    def small(df, *keys, n=None):
        return made(df, *keys, n=60)

    monkeypatch.setattr(filtering, "ranges", small)
    monkeypatch.setattr(otu, "ranges", small)
    frame = spark.createDataFrame([(x,) for x in seqs], "seq string")
    sizes = [r["count"] for r in small(frame, "seq").groupBy("range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < len(seqs) / 8
    assert {r.seq: r.rep for r in filtering.prefix_representatives(frame).collect()} == _run_model(seqs)

    hits = sorted({(rnd.choice(sorted(seqs)), rnd.randrange(30)) for _ in range(900)})
    want, at, before = {}, None, None
    for win, pos in hits:
        if before is None or not win.startswith(before):
            at = pos
        want[win, pos], before = at, win
    got = otu.compact_positions(spark.createDataFrame(hits, "win string, pos long"))
    assert {(r.win, r.pos): r.new_pos for r in got.collect()} == want


def test_ordered_on_no_rows_and_ties(spark):
    none = spark.createDataFrame([], "k long, v long")
    assert ordered.number(none, "i", "k").collect() == []
    rows = spark.createDataFrame([(k * 1000, v) for k in range(50) for v in range(4)], "k long, v long")
    got = ordered.running_sum(rows, F.col("v"), "before", "k", "v", n=20).orderBy("k", "v").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.v


def test_denoise_levels():
    levels = {"1": (1, None), "2.1": (2, 100), "0.005": (0, 5), "1.005": (1, 5), "1.01": (1, 10), "": (None, 2), "0": (0, None)}
    assert {k: config.parse_denoise(k) for k in levels} == levels and config.parse_denoise(None) == (None, None)
    for bad in ("-1", "x", "1.2345", "1.x"):
        with pytest.raises(ValueError):
            config.parse_denoise(bad)


def test_options():
    c = config.from_arguments(["--reads", "a.fna,b.fna", "--out", "o", "--database", "d", "--trim", "150", "--no-compact", "--similarity", "0.9"])
    assert (c.reads, c.reads2, c.trim, c.trim2, c.compact, c.similarity) == ("a.fna", "b.fna", 150, 150, False, 0.9)
    for wrong in ({"trim2": 5}, {"similarity": 2.0}, {"support": "other"}, {"reads": ""}):
        with pytest.raises(ValueError):
            config.Config(**({"reads": "a", "out": "o", "database": "d"} | wrong)).validate()


def _lines(path):
    if path.is_file():
        return path.read_text().splitlines()
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_golden_run(spark, tmp_path):
    """Two samples, four references: duplicates, prefixes, lower case, N, an empty read, hits at and over a reference's end, no taxonomy, adjacent headers."""
    rnd = random.Random(12)
    bases = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    a, b, c, d = (bases(200) for _ in range(4))
    (tmp_path / "refs.fna").write_text(f">A\n{a[:90]}\n{a[90:]}\n>B\n>lost\n{b}\n>C\n{c}\n>D\n{d}\n")
    refs = database_files.read_references(spark, str(tmp_path / "refs.fna"))
    assert [(r.ref_id, r.seq) for r in refs.orderBy("ref_ord").collect()] == [("A", a), ("B", b), ("C", c), ("D", d)]
    tax = spark.createDataFrame([("A", "k__x; p__y"), ("B", "k__x; p__z"), ("D", "k__w")], "otu_id string, taxonomy string")
    folder = database_files.write_database(refs, str(tmp_path / "db"), "g", tax)
    assert sorted(p.name for p in (tmp_path / "db/g").iterdir() if p.name[0] != ".") == ["g.db", "g.fa", "g.refs", "g.taxonomy", "g.tcf"] and folder.endswith("db/g")
    assert _lines(tmp_path / "db/g/g.fa") == [">g", a + b + c + d] and _lines(tmp_path / "db/g/g.db") == ["A\t0", "B\t200", "C\t400", "D\t600"]
    one = a[20:120][:50] + ("A" if a[70] != "A" else "C") + a[71:120]
    reads = [("s1_1", a[20:120]), ("s2_1", a[20:120]), ("s1_2", a[20:100]), ("s1_3", one.lower()), ("s2_2", b[:60] + "N" + b[61:100]), ("s2_3", ""), ("s1_4", c[100:]), ("s2_4", c[90:190]), ("s2_5", bases(100)), ("s3_1", bases(90)), ("s2_6", b[5:105])]
    (tmp_path / "reads.fna").write_text("".join(f">{k} extra\n{v}\n" for k, v in reads))
    c1 = config.Config(str(tmp_path / "reads.fna"), str(tmp_path / "out"), str(tmp_path / "db"), name="g", legacy=True, logs=True)
    run.run(spark, c1)
    # the hit flush with the end of C counts as one over it
    assert _lines(tmp_path / "out/otutable.txt") == ["#OTU ID\ts1\ts2\ts3\ttaxonomy", "A\t3\t1\t0\tk__x; p__y", "B\t0\t1\t0\tk__x; p__z", "C\t0\t1\t0\tUNSUPPORTED_MAPPING"]
    assert sorted(_lines(tmp_path / "out/fail.txt")) == ["s1_4", "s2_5", "s3_1"]
    assert sorted(_lines(tmp_path / "out/filtered.txt")) == ["s2_2\tAMBIGUOUS", "s2_3\tAMBIGUOUS"]
    assert _lines(tmp_path / "out/filt.db")[:4] == ["3", "s1", "s2", "s3"] and "A\ts1_1\ts1_2\ts1_3\ts2_1\t" in _lines(tmp_path / "out/otumap.txt")
    assert [x.split("\t")[0] for x in _lines(tmp_path / "out/otumap.txt")] == ["A", "B", "C"]
    c2 = config.Config(str(tmp_path / "reads.fna"), str(tmp_path / "out2"), str(tmp_path / "db"), name="g", flush_end="accept", denoise="2", rc=False, ambiguous="convert")
    table = {(r.otu_id, r.sample): r.n for r in run.run(spark, c2)["table"].collect()}
    # the empty read, kept here, is a prefix of the first sequence in order (s1_3), which so gets a second copy
    assert table == {("A", "s1"): 3, ("A", "s2"): 2}
    found = json.loads((tmp_path / "out2/otutable.biom").read_text())
    assert found["shape"] == [1, 3] and found["data"] == [[0, 0, 3], [0, 1, 2]] and found["rows"][0] == {"id": "A", "metadata": {"taxonomy": ["k__x", "p__y"]}}


def test_paired_run(spark, tmp_path):
    rnd = random.Random(13)
    a = "".join(rnd.choice("ACGT") for _ in range(300))
    turned = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    refs = spark.createDataFrame([(0, "A", a), (1, "B", "ACGT" * 50)], "ref_ord long, ref_id string, seq string")
    database_files.write_database(refs, str(tmp_path / "db"), "g", compress=False)
    pairs = [("s1_1", a[10:80], turned(a[150:210])), ("s1_2", a[10:80], turned(a[150:210])), ("s2_1", a[150:210], turned(a[10:80])), ("s2_2", "ACGT" * 15, turned(a[10:80]))]
    (tmp_path / "r1.fna").write_text("".join(f">{k}\n{x}\n" for k, x, _ in pairs))
    (tmp_path / "r2.fna").write_text("".join(f">other\n{y}\n" for _, _, y in pairs))
    c = config.Config(str(tmp_path / "r1.fna"), str(tmp_path / "out"), str(tmp_path / "db"), name="g", reads2=str(tmp_path / "r2.fna"), denoise="1.001", k=8, logs=True)
    got = run.run(spark, c)
    assert [tuple(r) for r in got["table"].collect()] == [("A", "s1", 2)] and sorted(_lines(tmp_path / "out/fail.txt")) == ["s2_1", "s2_2"]
    assert "\n".join(_lines(tmp_path / "out/2_filt.fa")).count(">") == 3
    short = config.Config(str(tmp_path / "r1.fna"), str(tmp_path / "out3"), str(tmp_path / "db"), name="g", reads2=str(tmp_path / "r2.fna"), max_insert=150)
    assert run.run(spark, short)["table"].count() == 0
    (tmp_path / "r3.fna").write_text(">x\nACGT\n")
    with pytest.raises(Exception, match="no mate"):
        fasta.read_pairs(spark, str(tmp_path / "r1.fna"), str(tmp_path / "r3.fna")).collect()


def test_compressed_files(spark, tmp_path):
    (tmp_path / "x.tcf").write_bytes(lzw.compress(b">one\nACGT\nAC\n>two\nGGG\n"))
    assert sorted((r.header, r.seq) for r in lzw.read_compressed_files(spark, str(tmp_path / "x.tcf")).collect()) == [("one", "ACGTAC"), ("two", "GGG")]
    assert lzw.read_compressed(lzw.compress_references(spark.createDataFrame([], "ref_ord long, ref_id long, seq string"))).collect() == []


def test_prefix_runs_number_and_sum_representatives(spark, monkeypatch):
    """Runs over many ranges, with primers that all reads share, as a model in plain Python has them."""
    rnd = random.Random(11)
    seqs = ["ACGT" * 3 + "".join(rnd.choice("AC") for _ in range(rnd.randint(0, 9))) for _ in range(500)] + ["A" * n for n in range(60)] + ["T" * n for n in range(1, 90)]
    n = {x: rnd.randint(1, 5) for x in seqs}
    rep = _run_model(seqs)
    numbers = {r: i for i, r in enumerate(sorted(set(rep.values())))}
    want = {x: (n[x], numbers[rep[x]], sum(n[y] for y in n if rep[y] == x) if rep[x] == x else None) for x in n}
    for splits in (1, 3, 40, 300):
        monkeypatch.setattr(ordered, "MAX_RANGES", splits)
        frame = materialise(spark.createDataFrame(list(n.items()), "seq string, n long"), "found")
        monkeypatch.setattr(ordered, "partitions", lambda spark: 100)
        assert not ordered.ranges(frame, "seq").schema["range"].nullable
        assert {r.seq: (r.n, r.run, r.copies) for r in filtering.prefix_runs(frame).collect()} == want
    empty = materialise(spark.createDataFrame([], "seq string, n long"), "found")
    assert filtering.prefix_runs(empty).count() == 0


def test_a_run_groups_sequences_by_their_order(spark, tmp_path, monkeypatch):
    """Single reads: sequences are compacted, counted and numbered in one shuffle by range; each rule of denoising gives what groups of representatives give."""
    rnd = random.Random(12)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(40)) for _ in range(6)]
    reads = [s[: rnd.choice([20, 30, 40])] for s in seqs * 12] + ["ACGTACGTAC"]
    frame = spark.createDataFrame([(i, f"r{i}", "s", x, "") for i, x in enumerate(reads)], "read_no long, read_id string, sample string, seq string, seq2 string")
    rep = _run_model(reads)
    copies = {r: sum(rep[x] == r for x in reads) for r in rep.values()}
    stages = []
    monkeypatch.setattr(run, "materialise", lambda df, name: stages.append(name) or materialise(df, name))
    for denoise in ("1", "2", "1.002"):
        stages.clear()
        c = config.Config(reads="x", out=str(tmp_path), database="x", denoise=denoise, k=16)
        kept, named = run.unique_reads(frame, c, run.RunLog())
        least, support = config.parse_denoise(denoise)
        numbers = {r: i for i, r in enumerate(sorted(r for r in copies if copies[r] >= least))}
        if support:  # a sequence of one read alone has words of one read alone
            numbers = {r: i for i, r in enumerate(sorted(r for r in numbers if copies[r] > 1 or len(r) < 16))}
        assert {r.seq: (r.copies, r.rix) for r in kept.collect()} == {r: (copies[r], i) for r, i in numbers.items()}
        assert {(r.seq, r.seq2): r.rix for r in named.collect()} == {(x, ""): numbers[rep[x]] for x in set(reads) if rep[x] in numbers}
        assert "stands" not in stages and (denoise != "1" or stages == ["found", "runs", "kept"])
