"""Operators that compare records, against brute force on small tables."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearspark.llm import components, covertree, minhash, mixing, queries, shared, suffix_dedup, warc
from nearspark.llm.components import bipartite_classes, connected_components

WORDS = [f"w{i:03d}" for i in range(400)]


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


@pytest.mark.parametrize("in_a_partition", [10, 100_000])
def test_components(spark, monkeypatch, in_a_partition):
    monkeypatch.setattr(components, "EDGES", in_a_partition)
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}
    for a, b in edges:
        if a is not None:
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert found == {x: find(parent, x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()
    link = np.zeros((4, 3), bool)
    link[1, 0] = link[2, 0] = link[2, 2] = True
    assert bipartite_classes(link).tolist() == [4, 1, 1, 4, 1, 4, 1]


def near_texts():
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.choice([12, 60, 200]))
        texts.append(" ".join(base))
        for _ in range(6):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append("  ".join(copy).upper())
    # a chain: each text is near the next one only, and many stand about one
    base = rng.choices(WORDS, k=150)
    for i in range(10):
        base = base[: 6 * i] + rng.choices(WORDS, k=6) + base[6 * i + 6 :]
        texts.append(" ".join(base))
    hub = rng.choices(WORDS, k=150)
    for i in range(60):
        copy = hub[:]
        for p in rng.sample(range(150), 4):
            copy[p] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    return [*texts, texts[3], texts[3], None, "", " \n ", None, "one two", "ONE two", "one"]


def plain_groups(rows, words):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(parent, i)] = min(d, least.get(find(parent, i), d))
    return [(d, len(s), least[find(parent, i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("block", [8, 256])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_texts()
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    rows = [(i, texts[i]) for i in order]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sketch string").repartition(3)
    found = minhash.find_duplicates(table, words=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(plain_groups(rows, 4))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    if block == 256:
        kept = minhash.deduplicate(table.union(table.where("doc_id < 5")), words=4)
        assert kept.columns == table.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.kept)
        assert minhash.find_duplicates(table.limit(0)).isEmpty()


def test_rows_of_one_id_are_kept_each_by_its_class(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey")
    rows = [(None, one), (7, one), (None, two), (5, three), (5, two + " x"), (3, two + " x"), (5, three), (None, three), (9, None), (9, "")]
    kept = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(7, one), (0, two), (5, three), (3, two + " x"), (9, "")])


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    one = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    two = np.concatenate([one[:900], rng.integers(0, 2**64, 100, dtype=np.uint64)])
    sets = [np.sort(x) for x in (one, two, one[:1], one[:7])]
    first = np.cumsum([0, *map(len, sets)])
    bins = minhash.sketch(first, np.concatenate(sets), 288)
    assert (bins != minhash._EMPTY).all()
    assert abs((bins[0] == bins[1]).mean() - 900 / 1100) < 0.1


@pytest.mark.parametrize("block", [16, 512])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(4)
    rows, made = [], []
    for i in range(150):
        base = rng.normal(size=8)
        if i % 3 and made:
            base = made[rng.integers(len(made))] + rng.normal(scale=0.12, size=8) * rng.choice([0, 1, 2])
        made.append(base)
        rows.append((i, (base * rng.uniform(0.1, 9)).astype(np.float32).tolist(), int(i % 2)))
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] + [1.0] * 7, 0), (203, rows[5][1], None), (204, [None] + [1.0] * 7, 0), (205, [float("inf")] * 8, 1), (206, [], 0), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0), (5, rows[5][1], rows[5][2])]
    valid = [(k, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)), lab) for k, (_, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    parent, links = list(range(len(rows))), Counter()
    for x, a, la in valid:
        for y, b, lb in valid:
            if x < y and la == lb and len(a) == len(b) and a @ b >= 0.93:
                links[x] += 1
                links[y] += 1
                p, q = find(parent, x), find(parent, y)
                parent[max(p, q)] = min(p, q)
    least = defaultdict(lambda: 10**9)
    for k, r in enumerate(rows):
        least[find(parent, k)] = min(least[find(parent, k)], r[0])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = covertree.find_duplicates(table, block=block, sample=40).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == sorted((r[0], links[k], least[find(parent, k)], r[0] == least[find(parent, k)]) for k, r in enumerate(rows))
    if block == 16:
        assert covertree.find_duplicates(table.limit(0)).isEmpty()


def dense(one, two, links):
    found = np.zeros((len(one.points), len(two.points)), int)
    np.add.at(found, (links.one, links.two), 1)
    for a, b, c, d in links.wholes:
        found[a:b, c:d] += 1 if one is not two or a != c else np.triu(np.ones((b - a, d - c), int), 1)
    assert found.max(initial=0) <= 1  # each pair once
    back = np.zeros(found.shape, bool)
    back[np.ix_(one.order, two.order)] = found > 0
    return back


def test_cover_tree_prunes_and_includes():
    rng = np.random.default_rng(5)
    for spread, per, many in ((0.05, 60, 4), (0.4, 5, 40), (0.02, 50, 40), (0.3, 1, 300)):
        points = np.concatenate([rng.normal(c, spread / 2, (per, 12)) for c in rng.normal(size=(many, 12))])
        points /= np.linalg.norm(points, axis=1)[:, None]
        tree, other = covertree.build(points, 0.05), covertree.build(points[:100], 0.3)
        sizes = [len(c) for c in tree.centres]
        assert all(p <= q for p, q in zip(sizes, sizes[1:], strict=False)) and len(tree.points) == len(points)
        for centres, radii, bounds in zip(tree.centres, tree.radii, tree.bounds, strict=True):
            for k in range(len(centres)):
                assert bounds[k] <= centres[k] < bounds[k + 1]
                assert np.linalg.norm(tree.points[bounds[k] : bounds[k + 1]] - tree.points[centres[k]], axis=1).max() <= radii[k] + 1e-9
        for cosine in (0.5, 0.93, 0.999):
            true = points @ points.T >= cosine
            links = covertree.linked(tree, tree, cosine)
            assert (dense(tree, tree, links) | dense(tree, tree, links).T == true & ~np.eye(len(points), dtype=bool)).all()
            assert (dense(tree, other, covertree.linked(tree, other, cosine)) == true[:, :100]).all()
            total, label, _ = covertree.summed(tree, tree, links, np.ones(len(points), int), np.ones(len(points), int))
            assert (total[np.argsort(tree.order)] == true.sum(axis=1) - 1).all()
            assert all(np.array_equal(label[i] == label[j], True) for i, j in zip(links.one, links.two, strict=True))


def test_dual_traversal_computes_few_distances():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, 0.02, (50, 32)) for c in rng.normal(size=(40, 32))])
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = covertree.build(points, 0.05)
    assert covertree.linked(tree, tree, 0.93).distances < 0.1 * len(points) ** 2 / 2


def plain_repeats(texts, length):
    starts = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        starts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def plain_passages(texts, n):
    holders = defaultdict(set)
    words = [re.findall(r"[^ \t-\r]+", t or "") for t in texts]
    for row, w in enumerate(words):
        for i in range(len(w) - n + 1):
            holders[tuple(w[i : i + n])].add(row)
    out = []
    for w in words:
        inside = set()
        for i in range(len(w) - n + 1):
            if len(holders[tuple(w[i : i + n])]) > 1:
                inside.update(range(i, i + n))
        out.append(len(inside))
    return out


def test_repeats(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choices([*WORDS, "naïve", "東京"], k=n))
    shared = [prose(n) for n in (10, 12, 30, 80)]
    texts = [" ".join(rng.sample([prose(rng.randrange(40)) for _ in range(3)] + rng.sample(shared, 2), 5)) for _ in range(40)]
    whole = prose(60)
    texts += [whole, whole, prose(20) * 3, "ab" * 200, "a" * 300, "", None, shared[0], texts[0][:70], None]
    texts += [" ".join(WORDS[:5] * 9), " ".join(WORDS[3:40] * 2), " ".join(WORDS[20:40])]  # runs repeated in a text, and across texts
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(1, texts[1], "x", "y", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, N_Spans string, key string, open string").repartition(3)
    found = suffix_dedup.remove_repeats(table, length=50, texts=True, passage=12).collect()
    assert set(found[0].asDict()) == {"doc_id", "text", "key", "open", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "n_passage_words"}
    want = [(*w, n) for w, n in zip(plain_repeats([r[1] for r in rows], 50), plain_passages([r[1] for r in rows], 12), strict=True)]
    assert 5 < sum(w[-1] > 0 for w in want) < len(want) - 5
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in found) == sorted((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert suffix_dedup.remove_repeats(table.limit(0)).isEmpty()


def test_repeats_of_many_batches(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    whole, other = prose(60), prose(60)
    # repeated rows, and rows that hold the same passages between other words: each alone in its batch
    rows = [(1, whole), (1, whole), (2, other), (1, whole), (2, other), (3, prose(9) + " " + whole[40:200] + " " + prose(9)), (4, other[10:150] + " " + whole[100:260]), (5, prose(40))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = suffix_dedup.remove_repeats(table, length=50, passage=12).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = [(r[0], *w, n) for r, w, n in zip(rows, plain_repeats([r[1] for r in rows], 50), plain_passages([r[1] for r in rows], 12), strict=True)]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in found) == sorted(want)


def test_passages_that_also_repeat_within_a_row(spark):
    """A passage in two rows, one of which holds a part of it again: the other row holds that part too."""
    rng = random.Random(10)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [words(60) for _ in range(12)]
    texts = [" ".join([*p, *words(9), *p[i : i + 25], *words(9)]) for i, p in enumerate(shared)] + [" ".join(p) for p in shared]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.n_passage_words for r in suffix_dedup.remove_repeats(table, length=50, passage=12).collect()}
    assert found == dict(enumerate(plain_passages(texts, 12))) == dict(enumerate([85] * 12 + [60] * 12))


def test_sent_entries_are_small():
    """Entries are most of what op8 puts on disk: two fingerprints of 8 bytes, and little beside them."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS, k=400)) for _ in range(300)]
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts)], names=["key", "text"])
    sent = pa.Table.from_batches(suffix_dedup._suffixes(400, 300, 51, 40)([batch]))
    n = sum(len(a) // 8 for a in sent.column("a").to_pylist())
    assert n > 20 * len(texts)
    assert sum(len(v or b"") for c in sent.column_names[1:] for v in sent.column(c).to_pylist()) < 24 * n
    # every text's keys are there once, and every place is read back
    assert [k for k in sent.column("keys").to_pylist() if k] == [b"".join(keys)]
    seen = [suffix_dedup._arrays(sent, row) for row in range(sent.num_rows)]
    doc, low, high = (np.concatenate([x[c] for x in seen]).astype(np.int64) for c in ("doc", "low", "high"))
    bytes_ = low < suffix_dedup._WORD
    covered = Counter()
    for d, a, b in zip(doc[bytes_].tolist(), low[bytes_].tolist(), high[bytes_].tolist(), strict=True):
        covered[d] += b - a + 1
    assert covered == {d: len(t) - 400 + 1 for d, t in enumerate(texts)}


def test_log_index_levels():
    rng = np.random.default_rng(7)
    index, a, b = suffix_dedup.LogIndex(), [], []
    for n in (5, 1, 40, 3, 3, 3, 90, 2):
        x, y = rng.integers(0, 60, n, dtype=np.uint64), rng.integers(0, 4, n, dtype=np.uint64)
        index.insert(x, y, np.arange(n) + sum(map(len, a)), np.zeros(n, bool))
        a.append(x)
        b.append(y)
        sizes = [len(level) for level in index.levels]
        assert all(p > 2 * q for p, q in zip(sizes, sizes[1:], strict=False))
    a, b = np.concatenate(a), np.concatenate(b)
    for e in index.entries():
        others = (a == e["a"]) & (np.arange(len(a)) != e["id"])
        assert (e["same"] > 0) == (others & (b == e["b"])).any() and (e["near"] > 0) == (others & (b != e["b"])).any()


def test_warc(spark, tmp_path):
    pages = [(5, "http://a/\r\nX: y", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (3, "http://b", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (9, None, None), (4, "http://c", ""), (7, "http://d", "x"), (3, "http://b", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (None, "http://e", "x"), (None, "http://f", "alone")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = warc.make_records(table)
    warc.write_archive(records, str(tmp_path / "archive"))
    read = warc.read_archive(spark, str(tmp_path / "archive"))
    assert read.count() == len(pages)
    parsed = warc.parse_records(read, keep=["payload_bytes"], ids="long").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    least = {"": 4, "x": 7, pages[0][2]: 3, "alone": None}
    want = [(p, len((h or "").encode()), sha(h), "response" if p == least[h or ""] else "revisit", None if p == least[h or ""] else least[h or ""]) for p, _, h in pages]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in parsed), key=key) == sorted(want, key=key)
    assert {r.payload.decode() for r in parsed if r.record_type == "response"} == set(least) and all(r.payload is None for r in parsed if r.record_type == "revisit")
    # each distinct payload is what the archive holds, and the files give the same records
    warc.write_files(records, str(tmp_path / "files"), per_file=2)
    files = warc.read_files(spark, str(tmp_path / "files"))
    assert files.exceptAll(warc.parse_records(read)).isEmpty() and warc.parse_records(read).exceptAll(files).isEmpty()
    assert warc.make_records(table, least_revisit=10).where("record_type = 'revisit'").select("page_id").collect() == [(5,)]
    assert warc.make_records(table.limit(0)).isEmpty()
    for broken in (b"no record", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


def test_ids_of_records_that_are_no_integers(spark, tmp_path):
    table = spark.createDataFrame([("a>", "u", "x"), ("b\nc", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    warc.write_archive(warc.make_records(table), str(tmp_path / "a"))
    read = warc.read_archive(spark, str(tmp_path / "a"))
    found = {(r.page_id, r.refers_to) for r in warc.parse_records(read).collect()}
    assert found == {("a>", None), ("b%0Ac", "a>"), (None, None)}
    with pytest.raises(Exception, match="not an integer"):
        warc.parse_records(read, ids="long").collect()


def test_changed_payload_is_found(spark, tmp_path):
    warc.write_archive(warc.make_records(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")), str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a"))
    rows.withColumn("payload", F.when(F.col("kind") == "payload", F.lit(b"b"))).write.partitionBy("kind").parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def shares(spark, leaves, budget, weights, **more):
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, available long")
    return {(r.domain, r.lang, r.source): r.allotted for r in mixing.allot(table, budget, weights, **more).collect()}


def test_budget(spark):
    leaves = [("a", "x", "1", 100), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 50)]
    # b cannot take its half, nor 1 its quarter: 1's shortage goes to its sibling first
    assert shares(spark, leaves, 1000, {}, max_epochs=1) == {("a", "x", "1"): 100, ("a", "x", "2"): 375, ("a", "y", "3"): 475, ("b", "x", "4"): 50}
    assert shares(spark, leaves, 10**6, {}, max_epochs=2) == {k[:3]: 2 * k[3] for k in leaves}
    assert shares(spark, leaves, 400, {("a",): 3.0, ("a", "y"): 0.0}, max_epochs=3) == {("a", "x", "1"): 150, ("a", "x", "2"): 150, ("a", "y", "3"): 0, ("b", "x", "4"): 100}
    with pytest.raises(ValueError):
        shares(spark, leaves, 10, {("a",): -1.0})


@pytest.mark.parametrize("budget", [300, 0.5, 5.0])
def test_mix(spark, monkeypatch, budget):
    monkeypatch.setattr(mixing, "RANGE", 3)
    monkeypatch.setattr(mixing, "FAN", 2)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 9)), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2"]), i) for i in range(120)]
    rows += [(3, *rows[3][1:]), (None, "a b c", "en", "s1", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    got = mixing.mix(table, budget, {("*", "en"): 2.0}).collect()
    leaf = lambda r: (r[2] or "(null)", r[3])
    size = lambda r: len(r[1].split())
    available = Counter()
    for r in rows:
        available[leaf(r)] += size(r)
    given = shares(spark, [("all", *k, v) for k, v in available.items() if v], budget, {("*", "en"): 2.0})
    want = Counter()
    for k, v in available.items():
        whole, room = divmod(given["all", *k], v)
        mine = [r for r in rows if leaf(r) == k and size(r)]
        order = defaultdict(list)
        for r in mine:
            name = "" if r[0] is None else str(r[0])
            order[hashlib.md5(f"mix|{whole}|{name}".encode()).hexdigest(), r[0] or -1].append(r)
            for e in range(whole):
                want[r[0], r[2], r[3], e] += 1
        total = 0
        for at in sorted(order):
            total += sum(map(size, order[at]))
            if total > room:
                break
            for r in order[at]:
                want[r[0], r[2], r[3], whole] += 1
    assert Counter((r.doc_id, r.lang, r.source, r.epoch) for r in got) == want
    assert mixing.mix(table.limit(0), budget).isEmpty()


def test_pipeline(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontaminate", "pii", "mixing"]
    now, sizes = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(now.count())
        if i < 4:
            assert now.columns == docs.columns
    before = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "2")).collect()}
    assert sizes[0] > sizes[1] > 0 and sizes[1] >= sizes[2] == sizes[3]
    groups = {d: c for d, _, c in plain_groups([(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "0")).collect()], 5)}
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "1")).collect()} == {d for d, c in groups.items() if d == c}
    assert set(before) == {r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).collect()} and {r.doc_id for r in now.collect()} <= set(before)
    assert duckdb and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_writes_its_stages(spark, monkeypatch):
    read = []

    def stage(number):
        def run(_, docs, sf_dir):
            read.append(sorted(docs.inputFiles()))
            return docs.where(f"doc_id % 7 <> {number}")

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"stage{i}", stage(i)) for i in range(5)])
    sf = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, sf)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in documents.where("doc_id % 7 > 4").collect())
    assert read[0] == sorted(documents.inputFiles())
    folder = shared.checkpoint_dir(spark).removeprefix("file:").lstrip("/")
    for i in range(1, 5):
        assert read[i] and all(folder in f and f"/stage{i - 1}-" in f for f in read[i])


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("benchmark", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{table}.parquet')")
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(found.columns)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, wanted))


def test_empty_batches():
    assert minhash.shingles(pa.array([], pa.string()), 4)[1].size == 0
