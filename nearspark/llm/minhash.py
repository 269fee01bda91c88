"""Near-duplicate documents by fast similarity sketching, banding and exact checks.

A sketch has ``bands * rows`` coordinates.  In round ``i`` every shingle is
placed in one bin by a hash, and a bin keeps the least (round, hash) that it
has seen; after as many rounds as there are coordinates, round ``n + j`` places
all shingles in bin ``j``, so every coordinate fills.  Rounds end when all bins
of a text are filled, which takes a few for texts of usual length.

Equal shingle sets are joined first.  Of the sets that share a band, each is
compared with the least one; the links found give classes.  Where a band still
holds several classes, members of all but its largest class are compared with
every member of another class, so that no link between classes is missed.
Every candidate is decided on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from nearspark.llm import text as tx
from nearspark.llm.batches import map_texts
from nearspark.llm.components import bipartite_classes, connected_components
from nearspark.llm.shared import cut, plain_names, shuffle_partitions

SHINGLE = 5
SIMILARITY = 0.8
#: Two sets of similarity 0.8 share none of 48 bands of 6 with probability 5e-7.
#: A coordinate is kept as one byte, so others agree by chance once in 256 times,
#: which makes candidates, never links.
BANDS, ROWS = 48, 6
#: Shards of band keys: so many for each shuffle partition, and more where a shard
#: would stand for more than ``SHARD_SETS`` sets (1.2 kB each).
SHARDS, SHARD_SETS = 4, 50_000
_FILLED_BY = np.random.default_rng(11).integers(1, 2**64, 4096, dtype=np.uint64)
_EMPTY = np.uint64(2**64 - 1)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (first, hashes), sorted within a text."""
    data, offsets = tx.utf8(texts)
    found = tx.words(tx.lowered(data), offsets, tx.NON_BLANK)
    counts = found.counts
    owner = found.owner()
    grams = tx.gram_hashes(found.hashes, words)
    inside = np.flatnonzero(owner[: len(grams)] == owner[words - 1 :]) if len(grams) else np.zeros(0, np.int64)
    docs, hashes = [owner[inside]], [grams[inside]]
    for n in range(1, words):  # texts of fewer words are one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            at = found.first[short]
            docs.append(short)
            hashes.append(tx.mix(tx.gram_hashes(found.hashes[at[:, None] + np.arange(n)].ravel(), n)[::n] + np.uint64(n)))
    docs, hashes = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    docs, hashes = docs[new], hashes[new]
    return np.searchsorted(docs, np.arange(len(offsets))), hashes


def sketch(first: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """A row of ``size`` filled coordinates for each set; sets without elements stay empty."""
    n = len(first) - 1
    bins = np.full((n, size), _EMPTY, np.uint64)
    flat = bins.ravel()
    open_ = np.flatnonzero(np.diff(first))
    doc = np.repeat(np.arange(n), np.diff(first))
    for i in range(2 * size):
        if not len(open_):
            break
        h = tx.mix(hashes ^ _FILLED_BY[i])
        place = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if i < size else i - size
        np.minimum.at(flat, doc * size + place, np.uint64(i) << np.uint64(48) | h & np.uint64((1 << 48) - 1))
        filled = (bins[open_] != _EMPTY).all(axis=1)
        if filled.any():
            open_ = open_[~filled]
            left = np.isin(doc, open_)
            doc, hashes = doc[left], hashes[left]
    return bins


_SKETCH = [T.StructField("set_id", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sketch", T.BinaryType())]


def _sketches(words: int, size: int):
    def make():
        def run(texts: pa.Array) -> list:
            first, hashes = shingles(texts, words)
            counts = np.diff(first)
            one, two = tx.mix(hashes), tx.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            sums = np.zeros((2, len(hashes) + 1), np.uint64)
            np.cumsum(one, out=sums[0, 1:])
            np.cumsum(two, out=sums[1, 1:])
            ids = np.ascontiguousarray((sums[:, first[1:]] - sums[:, first[:-1]]).T).astype(">u8")
            coords = tx.mix(sketch(first, hashes, size)).astype("u1")
            some = counts > 0
            return [[ids[i].tobytes() if some[i] else None for i in range(len(counts))], pa.array(counts), [coords[i].tobytes() if some[i] else None for i in range(len(counts))]]

        return run

    return make


def band_keys(coords: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands) hashes of the bands of (sets, bands * rows) coordinates."""
    parts = coords.reshape(len(coords), bands, -1).astype(np.uint64)
    total = np.zeros(parts.shape[:2], np.uint64)
    for r in range(parts.shape[2]):
        total = tx.mix(total + parts[:, :, r] + np.uint64(1))
    return tx.mix(total + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_ID = np.dtype([("h", ">u8"), ("l", ">u8")])
_DEALT = T.StructType([T.StructField("shard", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("keys", "ids", "left", "right")]])
_PAIR = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each key the least id; and pairs of every other id with it."""
    order = np.lexsort((ids["l"], ids["h"], keys))
    keys, ids = keys[order], ids[order]
    lead = np.ones(len(keys), bool)
    lead[1:] = keys[1:] != keys[:-1]
    least = np.maximum.accumulate(np.where(lead, np.arange(len(keys)), 0))
    other = np.flatnonzero(~lead & (ids != ids[least]))
    return keys[lead], ids[lead], ids[other], ids[least[other]]


def _deal(bands: int, shards: int):
    """(node, sketch) to shards of band keys, those of a batch stars already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), _ID)
            coords = np.frombuffer(b"".join(batch.column(1).to_pylist()), "u1").reshape(len(ids), -1)
            keys = band_keys(coords, bands).ravel()
            keys, least, left, right = _stars(keys, np.repeat(ids, bands))
            shard, pair_shard = (keys % np.uint64(shards)).astype(np.int64), (left["l"].astype(np.uint64) % np.uint64(shards)).astype(np.int64)
            order, pair_order = np.argsort(shard, kind="stable"), np.argsort(pair_shard, kind="stable")
            ends, pair_ends = np.searchsorted(shard[order], np.arange(shards + 1)), np.searchsorted(pair_shard[pair_order], np.arange(shards + 1))
            rows = [[], [], [], [], []]
            for s in range(shards):
                part, pairs = order[ends[s] : ends[s + 1]], pair_order[pair_ends[s] : pair_ends[s + 1]]
                if len(part) or len(pairs):
                    for column, value in zip(rows, (s, keys[part].tobytes(), least[part].tobytes(), left[pairs].tobytes(), right[pairs].tobytes()), strict=True):
                        column.append(value)
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=_DEALT.names)

    return run


def _gather(table: pa.Table) -> pa.Table:
    """A shard's candidate pairs, each once."""
    blob = lambda c: b"".join(table.column(c).to_pylist())
    _, _, left, right = _stars(np.frombuffer(blob("keys"), "<u8"), np.frombuffer(blob("ids"), _ID))
    left, right = np.concatenate([left, np.frombuffer(blob("left"), _ID)]), np.concatenate([right, np.frombuffer(blob("right"), _ID)])
    order = np.lexsort((right["l"], right["h"], left["l"], left["h"]))
    left, right = left[order], right[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    return pa.Table.from_arrays([_cells(left[new]), _cells(right[new])], names=["a", "b"])


def _confirm(words: int, similarity: float):
    """(a, b, text_a, text_b) to the pairs (a, b) whose sets are similar enough."""
    hundredths = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            sizes = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3)))
            for x, y in _ranges(sizes.to_numpy(zero_copy_only=False)):
                fa, ha = shingles(batch.column(2).slice(x, y - x), words)
                fb, hb = shingles(batch.column(3).slice(x, y - x), words)
                for i in range(y - x):
                    one, two = ha[fa[i] : fa[i + 1]], hb[fb[i] : fb[i + 1]]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= hundredths * (len(one) + len(two) - both) > 0:
                        good.append(x + i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return run


def _ranges(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _bands_of(bands: int):
    fields = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("class", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coords = np.frombuffer(b"".join(batch.column(2).to_pylist()), "u1").reshape(batch.num_rows, -1)
                keys = band_keys(coords, bands).view(np.int64).ravel()
                ends = pa.array(np.arange(batch.num_rows + 1) * bands, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(keys))], names=fields.names)

    return run, fields


def find_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row.

    A text's set is that of its distinct shingles of ``words`` blank-separated
    words, A-Z in lower case; a text of fewer words is one shingle; null, empty
    and blank texts have none and are linked with nothing.  Rows are linked if
    the sets' intersection is at least ``similarity`` of their union.
    component_id is the least id reachable over links, kept tells whether it
    is the row's own.  Repeated rows get equal results; a null id is reachable
    but never the least unless all are null; an empty table gives an empty one.
    A very long text is hashed whole by one task.  Other columns are not read.
    """
    found = _decided(documents, id_col, text_col, words, similarity, bands, rows)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: a digest of id and text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("\x00", F.col(f"`{id_col}`").cast("string"), text).cast("binary")))


def _decided(documents: DataFrame, id_col: str, text_col: str, words: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, key, n_shingles, component_id, kept) for each row."""
    spark = documents.sparkSession
    text: Column = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = _key(id_col, text_col)
    source = documents.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), text.alias("text"))
    made = cut(map_texts(source, "text", _SKETCH, _sketches(words, bands * rows), ["id", "key"]))
    # a set goes by the key of one of its rows, so that texts are fetched without a detour
    sets = made.where("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("least_id"), F.min("key").alias("node"), F.max("sketch").alias("sketch"))
    sets = cut(sets)
    shards = max(SHARDS * shuffle_partitions(spark), -(-sets.count() // SHARD_SETS))

    pairs = sets.select("node", "sketch").mapInArrow(_deal(bands, shards), _DEALT).groupBy("shard").applyInArrow(_gather, _PAIR)
    pairs = cut(pairs.distinct())
    texts = source.select("key", "text")
    one = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    links = cut(both.mapInArrow(_confirm(words, similarity), _PAIR).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    roots = connected_components(links)
    touching = _touching(sets, pairs, roots, bands, similarity, shards)
    if touching.count():
        more = cut(_links_between(touching, texts, words, similarity, shards))
        if more.count():
            roots = connected_components(links.union(more))

    # written, so that joins read them from plain exchanges, which Spark can split, or broadcast them by their size
    classes = cut(sets.join(roots, "node", "left").select("set_id", "least_id", F.coalesce("root", "node").alias("class")))
    least = cut(classes.groupBy("class").agg(F.min("least_id").alias("component_id")))
    member = classes.join(least, "class").select("set_id", "component_id")
    with_set, without = made.where("n_shingles > 0"), made.where("n_shingles = 0")
    out = with_set.join(member, "set_id").select("id", "key", "n_shingles", "component_id").union(without.select("id", "key", "n_shingles", "id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


#: Sets of a block; a task compares two blocks.
BLOCK = 256
#: Candidates whose sketches agree in a share below the similarity less this are
#: not linked: five standard deviations of a share of 288 coordinates.
MARGIN = 0.12
_LINK = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])


def _in_blocks(members: DataFrame, group: str, columns: list[str], shards: int) -> DataFrame:
    """Members (group, node, class, columns) dealt to tasks of two blocks of their group.

    All but the members of a group's largest class (side 0) meet all its
    members (side 1); groups of one class are left out.
    """
    counts = members.groupBy(group, "class").agg(F.count("*").alias("n"))
    mixed = counts.groupBy(group).agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("main")).where("classes > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = mixed.select(group, F.col("main.class").alias("main"), blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("main.n")).alias("minor_blocks"))
    inside = members.join(sizes, group)
    block = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    one = inside.where(F.col("class") != F.col("main")).select(group, block("minor_blocks").alias("i"), every("blocks").alias("j"), F.lit(0).alias("side"), "node", "class", *columns)
    two = inside.select(group, every("minor_blocks").alias("i"), block("blocks").alias("j"), F.lit(1).alias("side"), "node", "class", *columns)
    dealt = one.unionByName(two).withColumn("task", F.xxhash64(group, "i", "j")).withColumn("shard", F.pmod("task", F.lit(shards)))
    return dealt.select("shard", "task", "side", "node", "class", *columns)


def _by_task(compare):
    """A shard's tasks; ``compare`` gives which rows of side 0 are linked to which of side 1."""

    def run(table: pa.Table) -> pa.Table:
        task, side = table.column("task").to_numpy(), table.column("side").to_numpy()
        ids = np.frombuffer(b"".join(table.column("node").to_pylist()), _ID)
        _, kind = np.unique(np.array(table.column("class").to_pylist(), object), return_inverse=True)
        payload = table.column(table.num_columns - 1).combine_chunks()
        order = np.lexsort((side, task))
        left, right = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            one, two = rows[side[rows] == 0], rows[side[rows] == 1]
            apart = kind[one][:, None] != kind[two][None, :]
            if not apart.any():
                continue
            label = bipartite_classes(compare(payload, one, two) & apart)
            members = np.concatenate([one, two])
            linked = np.flatnonzero(label < len(one))
            left.append(members[linked])
            right.append(one[label[linked]])
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.Table.from_arrays([_cells(ids[left]), _cells(ids[right])], names=["u", "v"])

    return run


def _touching(sets: DataFrame, pairs: DataFrame, roots: DataFrame, bands: int, similarity: float, shards: int) -> DataFrame:
    """(node, class, cluster) of sets that share a band and a near sketch with a set of another class.

    A cluster holds whatever such candidates, or classes, connect.  Only a
    forest that connects them leaves the tasks, not every pair.
    """
    run, fields = _bands_of(bands)
    seen = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    now = cut(sets.select("node", "sketch").join(seen, "node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class"), "sketch"))
    entries = now.mapInArrow(run, fields).select("node", "class", F.explode("bands").alias("band"))
    shared = entries.groupBy("band", "class").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("classes"), F.sum("n").alias("n"))
    # the two sets of a band that holds no others were compared before
    entries = cut(entries.join(shared.where("classes > 1 and n > 2").select("band"), "band").join(now.select("node", "sketch"), "node"))
    forest = cut(_in_blocks(entries, "band", ["sketch"], shards).groupBy("shard").applyInArrow(_by_task(_near(similarity - MARGIN)), _LINK).distinct())
    touched = forest.select(F.col("u").alias("node")).union(forest.select("v")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class"))
    touched = cut(touched)
    clusters = connected_components(forest.union(touched.select("node", "class")))
    return cut(touched.join(clusters.select("node", F.col("root").alias("cluster")), "node"))


def _near(least: float):
    """Which sketches agree in a share of ``least`` at least."""

    def compare(payload: pa.Array, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        rows = lambda at: np.frombuffer(b"".join(payload.take(pa.array(at)).to_pylist()), "u1").reshape(len(at), -1)
        left, right = rows(one), rows(two)
        return np.stack([(right == x).sum(axis=1) >= least * right.shape[1] for x in left])

    return compare


def _links_between(touching: DataFrame, texts: DataFrame, words: int, similarity: float, shards: int) -> DataFrame:
    """Links (u, v) that join classes of a cluster: full sets are compared, block by block."""
    fetched = touching.join(texts.withColumnRenamed("key", "node"), "node").select("cluster", "node", "class", "text")
    dealt = _in_blocks(fetched, "cluster", ["text"], shards)
    return dealt.groupBy("shard").applyInArrow(_by_task(_linked(words, similarity)), _LINK).distinct()


def _linked(words: int, similarity: float):
    """Which texts' shingle sets are similar enough."""
    hundredths = round(100 * similarity)

    def compare(payload: pa.Array, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        first, hashes = shingles(payload.take(pa.array(np.concatenate([one, two]))), words)
        sizes = np.diff(first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        known, place = np.unique(hashes, return_inverse=True)
        both = np.zeros((len(one), len(two)))
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        for a in range(0, len(known), 1 << 13):  # a slice of the shingles as a 0-1 matrix of texts
            low, high = np.searchsorted(place, (a, a + (1 << 13)))
            has = np.zeros((len(sizes), min(1 << 13, len(known) - a)), np.float32)
            has[owner[low:high], place[low:high] - a] = 1
            both += has[: len(one)] @ has[len(one) :].T
        union = sizes[: len(one)][:, None] + sizes[len(one) :][None, :] - both
        return (100 * both >= hundredths * union) & (both > 0)

    return compare


def _cells(ids: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(ids.astype(_ID).tobytes())]).cast(pa.binary())


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of one row of each class of near-duplicates: that of the least id.

    Rows that repeat its id and text (null: empty) stay once.  Rows with a null id are kept
    only if nothing with an id is in their class.  Rows of one id with
    different texts are kept or not each by its own class.  Null, empty and
    blank texts are in no class and stay; an empty table gives an empty one; no
    column's name clashes.
    """
    found = _decided(documents, id_col, text_col, **options).where("kept")
    kept = cut(found.groupBy("id", "key").agg(F.count("*").alias("n")).toDF("kept_id", "kept_key", "n"))
    carried, fields = plain_names(documents, None, [])
    names = [f"keep_{i}" for i in range(len(fields))]
    keyed = documents.select(F.col(f"`{id_col}`").alias("id"), _key(id_col, text_col).alias("key"), *carried)
    rows = keyed.join(kept, (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id")))
    several = rows.where("n > 1").dropDuplicates(["id", "key"])
    # both parts read one exchange of the documents; where no row is repeated, the second is empty
    return rows.where("n = 1").select(*names).union(several.select(*names)).toDF(*[f.name for f in fields])
