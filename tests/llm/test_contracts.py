"""The registered queries against plain programming from their contracts, and awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearspark.llm import bpe, covertree, decontaminate, minhash, mixing, pii, quality, secrets, shared, suffix_dedup, warc
from nearspark.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark, name, *columns, sf=SF):
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf).collect())


def test_decontaminate(spark, documents):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(r.item_id))
    sizes, want = sorted({len(w) for w in windows}), []
    for doc, text in documents:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        want.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    assert any(w[5] for w in want) and not all(w[5] for w in want)
    assert rows_of(spark, "op1_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want)


def test_count_tokens(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in documents]
    want = sorted((d, len((t or "").encode()), n, n > 1024) for (d, t), n in zip(documents, counts, strict=True))
    assert rows_of(spark, "op3_count_tokens", "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_near_duplicates(spark, documents):
    sets, holders = {}, defaultdict(list)
    for doc, text in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[doc] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3) if w else 0)}
        for x in sets[doc]:
            holders[x].append(doc)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    both = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[:i])
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert any(root(d) != d for d in sets)
    assert rows_of(spark, "op4_near_duplicates", "doc_id", "n_shingles", "component_id", "kept") == sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


def test_secrets(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables hold none
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assign = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    want = []
    for doc, text in documents:
        t, found = text or "", []
        found += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(f[2] for f in found)
        want.append((doc, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)))))
    assert sum(sum(w[1:4]) for w in want) > 0
    assert rows_of(spark, "op5_find_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", sf=sf) == sorted(want)


def test_random_strings_in_a_table(spark):
    import random

    rng = random.Random(5)
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").where("lang = 'en' and length(text) < 3000").collect()]
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHJKLMNPQRSTUVWXYZ", "abcXYZdefUVWghiRSTjklOPQmno0123456789+/")
    planted, rows = {}, []
    for i in range(120):
        key = "".join(rng.choices(alphabets[i % 3], k=rng.randrange(24, 60)))
        before = rng.choice(prose)[:400] + " "
        planted[i] = (len(before), len(before) + len(key))
        rows.append((i, f"{before}{key} {rng.choice(prose)[:400]}"))
    names = ["getUserAccountSettingsFromDatabase", "com/understanding-machine-learning-2024", "MAX_NUMBER_OF_OPEN_CONNECTIONS", "0123456789012345678901234567890", "d41d8cd98f00b204e9800998ecf8427E".upper(), "123e4567-e89b-12d3-a456-426614174000"]
    rows += [(1000 + i, f"see {names[i % len(names)]} here") for i in range(60)]
    found = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "random"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.tiktoken")).collect()}
    assert sum(planted[i] in found[i] for i in planted) >= 118
    assert not any(found[1000 + i] for i in range(60))


def test_near_vectors(spark):
    import numpy as np

    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    points = {r.vec_id: np.array(r.embedding, float) for r in vectors}
    label = {r.vec_id: r.label for r in vectors}
    ids = sorted(points)
    at = {v: i for i, v in enumerate(ids)}
    unit = np.stack([points[v] / np.linalg.norm(points[v]) for v in ids])
    cosines = unit @ unit.T
    link = {v: [o for o in ids if o != v and label[v] is not None and label[o] == label[v] and cosines[at[v], at[o]] >= 0.93] for v in ids}
    least, todo = {}, []
    for v in ids:
        if v not in least:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in least:
                    least[x] = v
                    todo += link[x]
    assert rows_of(spark, "op7_near_vectors", "vec_id", "n_links", "component_id", "kept") == [(v, len(link[v]), least[v], least[v] == v) for v in ids]


def test_remove_repeats(spark, documents):
    data = [(d, (t or "").encode()) for d, t in documents]
    starts = Counter(hash(b[i : i + 400]) for _, b in data for i in range(len(b) - 399))
    want = []
    for doc, b in data:
        spans = []
        for i in range(len(b) - 399):
            if starts[hash(b[i : i + 400])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 400
                else:
                    spans.append([i, i + 400])
        kept, end = [], 0
        for x, y in spans:
            kept.append(b[end:x])
            end = y
        kept = b"".join([*kept, b[end:]])
        want.append((doc, len(b), len(b) - len(kept), len(spans), sha(kept)))
    assert any(w[2] for w in want)
    assert rows_of(spark, "op8_remove_repeats", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


def test_score_quality(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op9_score_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [(r.score, r.predicted, label[r.doc_id]) for r in found if r.held_out and label.get(r.doc_id) is not None]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert len(held) > 50 and sum(a > b for a in good for b in bad) > 0.95 * len(good) * len(bad)
    assert sum(p == y for _, p, y in held) > 0.9 * len(held)


def luhn(s):
    digits = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_find_pii(spark, documents):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(s)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    want = []
    for doc, text in documents:
        found = [(k, m.start(), m.end()) for k, (pattern, good) in kinds.items() for m in re.finditer(pattern, text or "") if good(m[0])]
        n = Counter(f[0] for f in found)
        want.append((doc, *[n[k] for k in kinds], sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))))
    assert all(sum(w[i] for w in want) for i in (1, 2, 3, 4))
    assert rows_of(spark, "op10_find_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want)


ITEMS = "item_id string, text string"
#: Of each operator on a table: what it gives, and whether it gives a row for each row.
OPERATORS = {
    "find_contamination": (lambda t: decontaminate.find_contamination(t, t.sparkSession.createDataFrame([("q", "some words here")], ITEMS)), True),
    "count_tokens": (lambda t: bpe.count_tokens(t, vocabulary("byte_bpe_50k.json")), True),
    "find_duplicates": (lambda t: minhash.find_duplicates(t), True),
    "deduplicate": (lambda t: minhash.deduplicate(t), False),
    "find_secrets": (lambda t: secrets.find_secrets(t, vocabulary("byte_bpe_50k.tiktoken")), True),
    "mix": (lambda t: mixing.mix(t, 1.0), False),
    "remove_repeats": (lambda t: suffix_dedup.remove_repeats(t), True),
    "score_quality": (lambda t: quality.score_quality(t, quality.fit_quality(t, t.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))), True),
    "find_pii": (lambda t: pii.find_pii(t), True),
    "redact_pii": (lambda t: pii.redact_pii(t), True),
    "make_records": (lambda t: warc.make_records(t, "doc_id", "source", "text"), True),
}
CLASHES = "N_WORDS n_hit ITEMS Matches __text__ n_bytes N_Tokens set_id N_SHINGLES component_id Kept __rows__ n keep_0 KEEP_1 extra_0 secrets Epoch domain stop covered OPEN more key N_Removed kept_sha256 score PREDICTED __id__ __y__ pii redacted __null__ c0 C1 so_far least sha256 payload id `a.b` null"


@pytest.fixture(scope="module")
def awkward(spark):
    long = "some words here and there " * 200_000
    rows = [(1, "some words here", "en", "s1"), (1, "some words here", "en", "s1"), (None, None, None, None), (None, "", "en", None), (2, " \n ", None, "s2"), (3, long, "en", "s1"), (2, "other words", "fr", "s1"), (None, "other words", "fr", "s1"), (None, "other words", "fr", "s1")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = CLASHES.replace("`", "").split()
    return table.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, awkward, name):
    operator, each = OPERATORS[name]
    found = operator(awkward)
    rows = found.collect()
    assert (len(rows) == 9) if each else (0 < len(rows) <= (27 if name == "mix" else 9))
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    if name == "deduplicate":
        assert found.columns == awkward.columns and len(rows) == 5  # of equal rows one stays, of "other words" that with an id
    empty = operator(awkward.limit(0))
    assert empty.columns == found.columns and empty.isEmpty()


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [1.0, 0.01], "a"), (2, [1.0, 0.0], None), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [math.nan, 1.0], "a"), (6, [None, 1.0], "a"), (7, [], "a"), (8, [1.0], "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").select("*", *[F.lit(1).alias(c) for c in ("N_Links", "key", "unit", "place", "kept", "id", "cell")])
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.find_duplicates(table).collect()), key=str)
    alone = [(i, 0, i, True) for i in range(2, 9)]
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), *alone], key=str)
    assert covertree.find_duplicates(table.limit(0)).isEmpty()
    named = table.withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    assert {r.component_id for r in covertree.find_duplicates(named).collect()} == {f"v{i}" for i in range(1, 9)}


def test_stages_on_awkward_rows(spark, tmp_path):
    rows = [(1, "some words here", "en", "s1", 15), (1, "some words here", "en", "s1", 15), (None, None, None, None, None), (2, "", "en", "x", 0), (None, "other words", "fr", "s2", 11), (3, "a long text " * 100_000, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("q", "other words")], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns[: len(docs.columns)] == docs.columns and found.count() <= 12, name
        assert stage(spark, docs.limit(0), str(tmp_path)).isEmpty(), name


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = property(lambda self: type("C", (), {"get": staticmethod(lambda *a: None)}))
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)})), "getCheckpointDir": staticmethod(lambda: None)})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.checkpoint_dir(Session())
