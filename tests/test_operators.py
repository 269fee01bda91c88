"""DataFrame operators, column functions, sources, SQL, streams and the command line."""

import gzip
import io
import random
import sys

import pytest
from pyspark.sql import functions as F

from nearspark import SearchOptions, cli
from nearspark.functions import columns as C
from nearspark.functions.alphabets import alphabet
from nearspark.functions.pretty import render
from nearspark.functions.sql import register
from nearspark.kernel.engine import find
from nearspark.local import Searcher, mutate, path, plant, random_sequence
from nearspark.operators import records as R
from nearspark.operators import search as S
from nearspark.operators.crispr import check_guides, crispr
from nearspark.plans.seeds import pieces, seed_filter
from nearspark.sources import fastx
from nearspark.streaming.search import search_stream, start

MATCH = ["text_start", "text_end", "pattern_start", "pattern_end", "cost", "strand", "cigar"]
DNA = SearchOptions(alphabet="dna", k=2, rc=True)


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(5)
    patterns = [random_sequence(rng, n).decode() for n in (12, 12, 20, 70)]
    texts = [plant(rng, random_sequence(rng, rng.choice([0, 30, 300, 1200])) or b"A", [mutate(rng, p.encode(), 2) for p in rng.sample(patterns, 2)])[0].decode() for _ in range(40)]
    return patterns, [*texts, "", texts[0]]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, seq string")


def expected(patterns, texts, options):
    return sorted((i, p, *row[1:]) for i, t in enumerate(texts) for p, pattern in enumerate(patterns) for row in find(pattern.encode(), t.encode(), options))


@pytest.mark.parametrize("options", [DNA, DNA.with_(mode="all"), DNA.with_(best_only=True), DNA.with_(rc_mode="pattern"), SearchOptions(alphabet="iupac", k=2, rc=True, alpha=0.5, max_n_frac=0.2)])
def test_search_equals_single_searches(spark, sample, options):
    patterns, texts = sample
    found = S.search(frame(spark, texts), patterns, options, text_col="seq", keep=["id"]).select("id", "pattern_idx", *MATCH).collect()
    assert sorted(map(tuple, found)) == expected(patterns, texts, options)


@pytest.mark.parametrize("options", [DNA, DNA.with_(mode="all"), DNA.with_(best_only=True), DNA.with_(rc_mode="pattern", k=4), SearchOptions(alphabet="iupac", k=3, rc=True, alpha=0.5)])
def test_long_texts_in_chunks(spark, sample, options):
    patterns, texts = sample
    texts = [*texts[:12], "A" * 500, "".join(texts)[:3000]]
    patterns = [*patterns[:2], "AAAAAAAA"]
    found = S.search_long(frame(spark, texts), patterns, options, text_col="seq", keep=["id"], chunk=64).select("id", "pattern_idx", *MATCH).collect()
    assert sorted(map(tuple, found)) == expected(patterns, texts, options)
    with pytest.raises(ValueError):
        S.search_long(frame(spark, texts), patterns, DNA.with_(max_n_frac=0.1), text_col="seq")


def test_untraced_and_modes(spark, sample):
    patterns, texts = sample
    table = frame(spark, texts)
    plain = S.search(table, patterns, DNA.with_(trace=False), text_col="seq", keep=["id"])
    assert plain.where("strand = '+' and (text_start is not null or cigar is not null)").count() == 0
    assert plain.where("strand = '-' and (text_end is not null or text_start is null)").count() == 0
    one = S.search_many(table, patterns, DNA, partitions=3, search_mode="batch_texts", text_col="seq", keep=["id"])
    assert one.exceptAll(S.search(table, patterns, DNA, text_col="seq", keep=["id"], prefilter=False)).isEmpty()
    every = S.search_all_alignments(table, patterns[:1], DNA.with_(k=1), text_col="seq", keep=["id"])
    assert R.grouped(every, "id").where("size(alignments) = 0").isEmpty()
    with pytest.raises(ValueError):
        S.search(table, ["AC", ""], DNA, text_col="seq")
    with pytest.raises(ValueError):
        S.search_many(table, patterns, DNA, search_mode="other", text_col="seq")


def test_patterns_from_a_table_in_blocks(spark, sample, monkeypatch):
    patterns, texts = sample
    rows = spark.createDataFrame([(i, f"n{i}", p) for i, p in enumerate(patterns)], "pattern_idx int, pattern_id string, pattern string")
    monkeypatch.setattr(S, "pattern_blocks", lambda p, most=25, f=S.pattern_blocks: f(p, most))
    assert len(list(S.pattern_blocks(rows))) > 1
    found = S.search(frame(spark, texts), rows, DNA, text_col="seq", keep=["id"])
    assert sorted(map(tuple, found.select("id", "pattern_idx", *MATCH).collect())) == expected(patterns, texts, DNA)
    assert R.with_patterns(found.drop("pattern_id"), rows).count() == found.count()


def test_clashing_names_and_empty_tables(spark):
    table = spark.createDataFrame([(1, "ACGT", "x")], "cost int, seq string, strand string")
    assert S.search(table, ["ACG"], SearchOptions(k=0), text_col="seq").columns[0] == "seq"
    assert S.search(table.limit(0), ["ACG"], SearchOptions(k=0), text_col="seq").isEmpty()
    assert S.search(table, [], SearchOptions(k=0), text_col="seq").isEmpty()


def test_end_predicate(spark, sample):
    patterns, texts = sample
    follows = F.col("search_text").substr(F.col("search_end") + 1, F.lit(1)) == F.lit(b"G")
    found = S.search_where(frame(spark, texts), patterns, DNA, follows, text_col="seq", keep=["id"])
    want = []
    for row in expected(patterns, texts, DNA):
        text = texts[row[0]]
        place = row[3] if row[7] == "+" else row[2] - 1
        if 0 <= place < len(text) and text[place] == "G":
            want.append(row)
    assert sorted(map(tuple, found.select("id", "pattern_idx", *MATCH).collect())) == want
    best = S.search_where(frame(spark, texts), patterns, DNA.with_(best_only=True), F.lit(True), text_col="seq", keep=["id"])
    assert sorted(map(tuple, best.select("id", "pattern_idx", *MATCH).collect())) == expected(patterns, texts, DNA.with_(best_only=True))


def test_records_and_counts(spark, sample):
    patterns, texts = sample
    table = frame(spark, texts)
    found = S.search(table, patterns, DNA, text_col="seq", keep=["id"])
    have = {r.id for r in found.select("id").distinct().collect()}
    assert {r.id for r in R.filter_records(table, patterns, DNA, text_col="seq").collect()} == have
    assert {r.id for r in R.filter_records(table, patterns, DNA, invert=True, text_col="seq").collect()} == {*range(len(texts) + 1)} - have
    assert {r.id for r in R.semi_join(table, found, "id").collect()} == have
    assert R.anti_join(table, found, "id").count() == len(texts) + 1 - len(have)
    counts = {r.cost: r.matches for r in R.histogram(found, 2).collect()}
    assert set(counts) == {0, 1, 2} and sum(counts.values()) == found.count() == R.summary(found, "id").first().matches
    assert R.best(found, "id").count() == len({(r[0], r[1], r[7]) for r in expected(patterns, texts, DNA)})
    assert R.ordered(found, "id").count() == found.count()
    pairs = R.all_vs_all(spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "TTACGTACGTACTT"), ("c", "GGGGGGGGGG")], "id string, seq string"), SearchOptions(alphabet="dna"))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 1)]


def test_ranges_and_windows(spark):
    table = spark.createDataFrame([(1, "XXXABCXXXABXC"), (2, "")], "id long, seq string")
    ranges = S.search_ranges(table, ["ABC"], SearchOptions(k=1), text_col="seq", keep=["id"])
    assert [tuple(r)[4:] for r in ranges.orderBy("first_end").select("id", *S.RANGE.names).collect()] == [(5, 7, 0), (11, 13, 1)]
    costs = spark.createDataFrame([(1, i, c) for i, c in enumerate([3, 1, 1, 2, 0, 0])], "t int, end int, cost int")
    assert sorted((r.end, r.cost) for r in R.rightmost_minima(costs, 1, ["t"]).collect()) == [(2, 1), (5, 0)]
    assert sorted((r.first_end, r.last_end) for r in R.islands(costs, 1, ["t"]).collect()) == [(1, 2), (4, 5)]
    deltas = spark.createDataFrame([(1, i, d) for i, d in enumerate([1, -1, -1, 1])], "t int, end int, delta int")
    assert [(r.cost, r.least) for r in R.running_cost(deltas, ["t"], start=2).orderBy("end").collect()] == [(3, 3), (2, 2), (1, 1), (2, 1)]


def test_seeds(spark):
    assert pieces(b"ABCDEFGH", 2) == [b"AB", b"CDE", b"FGH"]
    assert seed_filter(F.col("seq"), [b"ACGT"], SearchOptions(alphabet="iupac", k=0)) is None
    table = spark.createDataFrame([("xxhellxx",), ("none",), ("HELLOWORLD",)], "seq string")
    kept = table.where(seed_filter(F.col("seq"), [b"helloworld"], SearchOptions(alphabet="ascii_ci", k=1)))
    assert {r.seq for r in kept.collect()} == {"HELLOWORLD"}


GUIDE_TEXTS = [("exact", "TAGCATCAGCTACGAGG"), ("pam_mutated", "TAGCATCAGCTACGACG"), ("n_frac", "TNNNATCAGCTACGAGG")]


@pytest.mark.parametrize("edits, share, counts", [(True, 1.0, (2, 1, 2)), (False, 1.0, (1, 0, 1)), (False, 3 / 17 + 0.01, (1, 0, 1)), (False, 3 / 17 - 0.01, (1, 0, 0))])
def test_crispr(spark, edits, share, counts):
    table = spark.createDataFrame(GUIDE_TEXTS, "text_id string, seq string")
    found = crispr(table, ["TAGCATCAGCTACGNGG"], 1, share, allow_pam_edits=edits, keep=["text_id"])
    have = {r.text_id: r["count"] for r in found.groupBy("text_id").count().collect()}
    assert tuple(have.get(t, 0) for t, _ in GUIDE_TEXTS) == counts


def test_guides():
    assert check_guides(["AAAGG", b"CCAGG"]) == b"AGG"
    for bad in ([], ["AAAGG", "AAATG"], ["A"]):
        with pytest.raises(ValueError):
            check_guides(bad)


def test_column_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.reverse_complement(F.lit("ACGTRYN"))) == "NRYACGT" == alphabet("iupac").reverse_complement(b"ACGTRYN").decode()
    assert one(C.complement(F.lit("acgt"), "dna")) == "tgca" and one(C.reverse_text(F.lit("abc"))) == "cba"
    for text, good in (("ACTUGNRYSWKMBDHVX", True), ("", True), ("ACGZ", False), ("ACG\n", False), ("@CGT", False), ("E", False)):
        assert one(C.valid_seq(F.lit(text))) is good is alphabet("iupac").valid(text.encode())
    assert one(C.valid_seq(F.lit("ACGTactg"), "dna")) and not one(C.valid_seq(F.lit("ACGN"), "dna"))
    for a, b, letters, good in (("A", "N", "iupac", True), ("C", "Y", "iupac", True), ("X", "N", "iupac", False), ("A", "N", "dna", False), ("C", "c", "dna", True), ("l", "L", "ascii", False), ("l", "L", "ascii_ci", True)):
        assert one(C.is_match(F.lit(a), F.lit(b), letters)) is good is alphabet(letters).matches(a.encode(), b.encode())
    assert one(C.is_match_slice(F.lit("ANG"), F.lit("ACG"))) and one(C.is_match_slice(F.lit("A"), F.lit("AC"))) is None
    assert one(C.n_fraction(F.lit("ANnC"))) == 0.5 and one(C.n_fraction(F.lit(""))) == 0
    assert one(C.n_endpoint(F.lit("NNNNAAAA"), F.lit(4), 4, 1, 0.5)) is False
    assert one(C.reverse_cigar(F.lit("2=1X3D"))) == "3D1X2=" and one(C.format_cigar(F.lit("2=1X3D"), F.lit("-"), sam=True)) == "3D1X2="
    assert one(C.match_region(F.lit("CAAGTC"), F.lit(1), F.lit(5), F.lit("-"))) == "ACTT" and one(C.match_region(F.lit("CAAGTC"), F.lit(1), F.lit(5), F.lit("-"), sam=True)) == "AAGT"
    assert one(C.net_insertions(F.lit("2=1I1X"))) == 1 and one(C.net_insertions(F.lit("2=1D1="))) == 0
    assert one(C.overhang_steps(F.lit(10), F.lit(2), 0.5)) == 5 and one(C.overhang_steps(F.lit(10), F.lit(2), 0.5, 3)) == 3
    assert one(C.overshoot_cost(F.lit(1), F.lit(13), F.lit(10), 0.5)) == 2
    assert one(C.pam_match(F.lit("ACAGG"), F.lit(5), "NGG")) and not one(C.pam_match(F.lit("GG"), F.lit(2), "NGG"))
    assert one(C.strand_number(F.lit("-"))) == 1 and one(C.fractional_k(F.lit("ABCDE"), 0.3)) == 2
    assert one(C.prefix_value(F.lit(0b1011).cast("long"), F.lit(0b0100).cast("long"), 3)) == 1
    assert spark.range(1).select(F.lit(2).alias("cost")).select(C.match_text("cost")).first()[0] == '{"cost":2}'


def test_paths(spark, sample):
    patterns, texts = sample
    found = S.search(frame(spark, texts), patterns[:2], DNA, text_col="seq", keep=["id"]).withColumn("path", C.alignment_path()).collect()
    local = {(m.text_idx, m.pattern_idx, m.strand, m.text_start, m.text_end): path(m) for m in Searcher("dna").search_many(patterns[:2], texts, 2)}
    assert found and all([tuple(p) for p in r.path] == local[r.id, r.pattern_idx, r.strand, r.text_start, r.text_end] for r in found)


def test_pretty():
    m = {"text_start": 3, "text_end": 7, "pattern_start": 0, "pattern_end": 4, "cost": 1, "strand": "+", "cigar": "3=1X"}
    line = render(b"ATCG", b"CCCATCACCC", m, "p", context=5, colour=False)
    assert "ATCACCC" in line and line.startswith("p (+)  1 |") and line.rstrip().endswith("@ 3-7")
    assert render(b"ATCG", b"CCCATCACCC", m, style="compact", context=2, colour=False) == "+  1 | CCATCACC"
    assert "\x1b[32mA" in render(b"ATCG", b"CCCATCACCC", m, style="line")
    assert "CCCATCACCC" in render(b"ATCG", b"x\nCCCATCACCC\ny", {**m, "text_start": 5, "text_end": 9}, style="line", colour=False)


def test_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x>y\nACGT\nAC\n>two\r\nGG\r\n\n>three\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@r1\nACGT\n+\n@@@@\n@r2 z\nGG\n+\nII\n")
    rows = {r.text_id: (r.seq, r.quality) for r in fastx.read_fastx(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fastq.gz")]).collect()}
    assert rows == {"one x>y": ("ACGTAC", None), "two": ("GG", None), "three": ("", None), "r1": ("ACGT", "@@@@"), "r2 z": ("GG", "II")}
    (tmp_path / "p.txt").write_text("ACG\n\nTT\n")
    assert fastx.read_patterns(spark, str(tmp_path / "p.txt")) == [("1", "ACG"), ("3", "TT")] and fastx.read_guides(spark, str(tmp_path / "p.txt")) == ["ACG", "TT"]
    assert fastx.read_pattern_fasta(spark, str(tmp_path / "a.fa")).count() == 3
    fastx.write_records(fastx.read_fastx(spark, [str(tmp_path / "b.fastq.gz")]), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))) == "@r1\nACGT\n+\n@@@@\n@r2 z\nGG\n+\nII\n"
    (tmp_path / "bad.fq").write_text("@r1\nACGT\n")
    with pytest.raises(Exception, match="FASTQ"):
        fastx.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


@pytest.mark.parametrize("split", [37, 64, 250, 1 << 20])
def test_split_fastq(spark, tmp_path, split):
    rng = random.Random(split)
    records = []
    for i in range(120):
        n = rng.choice([0, 1, 1, 2, 9, 40])
        records.append((f"{rng.choice(['', '@', '+'])}r{i}", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@@+I", k=n))))
    for name, end in (("a.fastq", "\n"), ("b.fq", "\r\n")):
        (tmp_path / name).write_bytes("".join(f"@{a}{end}{b}{end}+{end}{c}{end}" for a, b, c in records).encode())
    with gzip.open(tmp_path / "c.fastq.gz", "wt") as f:
        f.write("".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in records))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in before:
        spark.conf.set(c, split)
    try:
        rows = fastx.read_fastq(spark, str(tmp_path)).collect()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    found = {}
    for r in rows:
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.text_id, r.seq, r.quality))
    assert {name: sorted(x) for name, x in found.items()} == dict.fromkeys(("a.fastq", "b.fq", "c.fastq.gz"), sorted(records))


def test_match_table(spark, tmp_path):
    table = spark.createDataFrame([("t", "CCCATCACCC")], "text_id string, seq string")
    found = S.search(table, [("p", "ATCG")], SearchOptions(alphabet="dna", k=1, rc=True), text_col="seq")
    plain = [tuple(r) for r in fastx.match_table(found, "dna").orderBy("strand").collect()]
    assert plain == [("p", "t", 1, "+", 3, 7, "ATCA", "3=1X"), ("p", "t", 1, "-", 1, 5, "ATGG", "2=1X1=")]
    sam = [tuple(r) for r in fastx.match_table(found, "dna", sam=True).orderBy("strand").collect()]
    assert sam[1][6:] == ("CCAT", "1=1X2=")
    fastx.write_tsv(fastx.match_table(found, "dna"), str(tmp_path / "tsv"))
    assert any(p.read_text().startswith("\t".join(fastx.TSV) + "\n") for p in (tmp_path / "tsv").glob("part*"))


def test_sql(spark):
    register(spark)
    rows = spark.sql("SELECT m.* FROM VALUES ('CCCATCACCC') t(seq) LATERAL VIEW inline(fuzzy_search(seq, 'ATCG', 1, 'dna')) m").collect()
    assert [tuple(r) for r in rows] == [(3, 7, 0, 4, 1, "+", "3=1X"), (1, 5, 0, 4, 1, "-", "2=1X1=")]
    assert spark.sql("SELECT size(fuzzy_search_all('XXXABCXXX', 'ABC', 1, 'ascii')), size(fuzzy_best('ABCABC', 'ABC', 0, 'ascii')), fuzzy_search(NULL, 'A', 0, 'ascii')").first()[:] == (3, 1, None)
    assert spark.sql("SELECT revcomp('AACG'), complement('AACG'), valid_seq('ACGZ'), n_frac('ANAN'), cigar_reverse('2=1X')").first()[:] == ("CGTT", "TTGC", False, 0.5, "1X2=")


def test_stream(spark, sample, tmp_path):
    patterns, texts = sample
    table = frame(spark, texts)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start(search_stream(stream, patterns, DNA, text_col="seq", keep=["id"]), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).select("id", "pattern_idx", *MATCH).collect()
    assert sorted(map(tuple, found)) == expected(patterns, texts, DNA)
    with pytest.raises(ValueError):
        search_stream(table, patterns, DNA)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "t.fa").write_text(">a\nCCCATCGCCC\n>b\nGGGGGGGG\n")
    (tmp_path / "t.txt").write_text("one\nsay hello there\n")
    (tmp_path / "g.txt").write_text("TAGCATCAGCTACGNGG\n")
    (tmp_path / "c.fa").write_text(">exact\nTAGCATCAGCTACGAGG\n")
    fa = str(tmp_path / "t.fa")
    say = lambda *argv: (cli.run(spark, argv), capsys.readouterr())[1]
    assert say("search", "-p", "ATCG", "-k", "0", "--no-rc", fa).out == "\t".join(fastx.TSV) + "\npattern\ta\t0\t+\t3\t7\tATCG\t4=\n"
    assert say("filter", "-p", "ATCG", "-k", "0", fa).out == ">a\nCCCATCGCCC\n"
    assert say("filter", "-p", "ATCG", "-k", "0", "-v", fa).out == ">b\nGGGGGGGG\n"
    shown = say("grep", "-p", "ATCG", "-k", "0", "--no-rc", "--search", str(tmp_path / "o1"), "--filter", str(tmp_path / "o2"), fa).err
    assert "t.fa>a" in shown and "0: 1" in shown and (tmp_path / "o1").exists() and (tmp_path / "o2").exists()
    assert "| say " in say("agrep", "helo", "-k", "1", str(tmp_path / "t.txt")).out
    assert "exact\t0\t+\t0\t17" in say("crispr", "-g", str(tmp_path / "g.txt"), "-k", "1", "--max-n-frac", "0.1", str(tmp_path / "c.fa")).out
    assert "MB/s" in say("test").out
    for path in ("-", ""):
        monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(b">s\nTTATCGTT\n")))
        assert say("filter", "-p", "ATCG", "-k", "0", path).out == ">s\nTTATCGTT\n"
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(b"@s\nTTATCGTT\n+\nIIIIIIII\n")))
    assert say("filter", "-p", "ATCG", "-k", "0", "-").out == "@s\nTTATCGTT\n+\nIIIIIIII\n"
