"""Text quality by a factorisation machine.

A text is a sparse vector: hashed words (log frequencies, unit length) and
standardised statistics of its structure and metadata.  The score is

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

through a logistic function; the last form makes the pairwise interactions
linear in the number of features.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from nearspark.llm import text as tx
from nearspark.llm.batches import map_texts

BUCKET_BITS = 15
FACTORS = 8
#: Labelled texts that a model is fitted on at most, the first by a hash of their ids.
SAMPLE = 6000
EPOCHS = 8
SEED = 7
THRESHOLD = 0.3

_UPPER, _LOWER = tx._byte_set((0x41, 0x5A)), tx._byte_set((0x61, 0x7A))
_DIGIT, _SPACE = tx._byte_set((0x30, 0x39)), tx._byte_set((0x20, 0x20), (0x09, 0x0D))
_HIGH, _STOP = tx._byte_set((0x80, 0xFF)), tx._byte_set((0x2E, 0x2E), (0x2C, 0x2C))
_MARK = tx._byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) & ~_STOP
_LINE = tx._byte_set((0x0A, 0x0A))
_CLASSES = (_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _STOP, _MARK, _LINE)
N_STATS = len(_CLASSES) + 9


@dataclass
class Features:
    """Sparse rows: entries ``first[r]`` to ``first[r + 1]`` are row ``r``; ``stats`` is dense."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def featurise(texts: pa.Array, *metadata: pa.Array, bits: int = BUCKET_BITS) -> Features:
    """Hashed word features and raw structure statistics of each text, then its metadata."""
    data, offsets = tx.utf8(texts)
    n = len(offsets) - 1
    found = tx.words(tx.lowered(data), offsets, tx.NON_BLANK)
    buckets = (found.hashes >> np.uint64(64 - bits)).astype(np.int64)
    keys, freq = np.unique(found.owner() << bits | buckets, return_counts=True)
    row = keys >> bits
    value = np.log1p(freq)
    norm = np.sqrt(np.bincount(row, value**2, n))
    value = value / norm[row]
    first = np.searchsorted(row, np.arange(n + 1))

    size = np.diff(offsets)
    per = np.maximum(size, 1)
    stats = np.zeros((n, N_STATS))
    sums = np.zeros(len(data) + 1, np.int64)
    for i, table in enumerate(_CLASSES):
        np.cumsum(table[data], out=sums[1:])
        stats[:, i] = (sums[offsets[1:]] - sums[offsets[:-1]]) / per
    at = len(_CLASSES)
    counts = found.counts
    n_words = np.maximum(counts, 1)
    distinct = np.diff(first)
    lengths = found.ends - found.starts
    owner = found.owner()
    stats[:, at] = np.log1p(size)
    stats[:, at + 1] = np.log1p(counts)
    stats[:, at + 2] = distinct / n_words
    top = np.zeros(n)
    np.maximum.at(top, row, freq)
    stats[:, at + 3] = top / n_words
    stats[:, at + 4] = np.bincount(owner, lengths, n) / n_words
    same = np.zeros(len(owner))
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
    stats[:, at + 5] = np.bincount(owner, same, n) / n_words
    marked = np.zeros(len(owner))
    if len(owner):
        marked[:] = _MARK[data[found.ends - 1]]
    stats[:, at + 6] = np.bincount(owner, marked, n) / n_words
    if len(owner) > 3:
        grams = tx.gram_hashes(found.hashes, 3)
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        _, kept = np.unique(grams[inside] ^ tx.mix(owner[inside].astype(np.uint64)), return_index=True)
        kinds = np.bincount(owner[inside[kept]], minlength=n)
        stats[:, at + 7] = 1 - kinds / np.maximum(np.bincount(owner[inside], minlength=n), 1)
    stats[:, at + 8] = np.bincount(owner, lengths > 20, n) / n_words
    if metadata:
        stats = np.concatenate([stats, np.stack([np.asarray(m, np.float64) for m in metadata], axis=1)], axis=1)
    return Features(first, (keys & ((1 << bits) - 1)).astype(np.int32), value.astype(np.float32), stats.astype(np.float32))


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the entries of each row."""
    sums = np.zeros((len(first) - 1, values.shape[1]))
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        sums[filled] = np.add.reduceat(values, first[filled], axis=0)
    return sums


@dataclass
class Machine:
    """A fitted model; its size depends on ``bits``, ``FACTORS`` and the statistics only."""

    bits: int
    bias: float
    weights: np.ndarray  # hashed words, then statistics
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def score(self, x: Features) -> np.ndarray:
        """Probability of label 1 for each row."""
        buckets = 1 << self.bits
        linear = np.full(len(x.first) - 1, self.bias)
        dense = self.dense(x.stats)
        linear += dense @ self.weights[buckets:]
        sums, squares = dense @ self.factors[buckets:], dense**2 @ self.factors[buckets:] ** 2
        row = np.repeat(np.arange(len(linear)), np.diff(x.first))
        linear += np.bincount(row, self.weights[x.index] * x.value, len(linear))
        part = self.factors[x.index] * x.value[:, None]
        sums += _by_row(part, x.first)
        squares += _by_row(part**2, x.first)
        return 1 / (1 + np.exp(-np.clip(linear + 0.5 * (sums**2 - squares).sum(axis=1), -30, 30)))


def fit(x: Features, y: np.ndarray, bits: int = BUCKET_BITS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.05, decay: float = 1e-4, batch: int = 64) -> Machine:
    """Minimises the mean logistic loss by AdaGrad over mini-batches."""
    rng = np.random.default_rng(seed)
    buckets, n, n_stats = 1 << bits, len(y), x.stats.shape[1]
    mean, scale = (x.stats.mean(axis=0), x.stats.std(axis=0) + 1e-6) if n else (np.zeros(n_stats), np.ones(n_stats))
    v = rng.normal(0, 0.01, (buckets + n_stats, factors))
    machine = Machine(bits, 0.0, np.zeros(buckets + n_stats), v, mean, scale)
    if n == 0 or y.min() == y.max():
        machine.bias = 3.0 * (2 * float(y[0]) - 1) if n else 0.0
        machine.factors[:] = 0
        return machine
    rate_of = float(y.mean())
    machine.bias = float(np.log(rate_of / (1 - rate_of)))
    dense = machine.dense(x.stats)
    stat_ids = np.arange(buckets, buckets + n_stats)
    seen_w, seen_v = np.full(len(v), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            spans = [np.arange(x.first[r], x.first[r + 1]) for r in rows]
            entries = np.concatenate(spans)
            ids = np.concatenate([x.index[entries], np.tile(stat_ids, len(rows))])
            vals = np.concatenate([x.value[entries], dense[rows].ravel()]).astype(np.float64)
            owner = np.concatenate([np.repeat(np.arange(len(rows)), [len(s) for s in spans]), np.repeat(np.arange(len(rows)), n_stats)])
            vx = v[ids] * vals[:, None]
            sums = np.stack([np.bincount(owner, vx[:, f], len(rows)) for f in range(factors)], axis=1)
            z = machine.bias + np.bincount(owner, machine.weights[ids] * vals, len(rows)) + 0.5 * (sums**2).sum(axis=1) - 0.5 * np.bincount(owner, (vx**2).sum(axis=1), len(rows))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            used, back = np.unique(ids, return_inverse=True)
            gw = np.bincount(back, g[owner] * vals, len(used)) + decay * machine.weights[used]
            gv_all = (g[owner] * vals)[:, None] * (sums[owner] - vx)
            gv = np.stack([np.bincount(back, gv_all[:, f], len(used)) for f in range(factors)], axis=1) + decay * v[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            machine.weights[used] -= rate * gw / np.sqrt(seen_w[used])
            v[used] -= 0.3 * rate * gv / np.sqrt(seen_v[used])
            machine.bias -= 0.1 * rate * g.sum()
    return machine


def held_out(id_column: Column) -> Column:
    """Whether a row is kept out of fitting: the crc32 of its id's text is divisible by 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _metadata(columns: Sequence[str]) -> list[Column]:
    """Numbers as the model takes them: signed logarithms, 0 for null and not finite."""
    plain = [F.col(f"`{c}`").cast("double") for c in columns]
    finite = [F.when(F.abs(c) < float("inf"), c).otherwise(0.0) for c in plain]
    return [F.coalesce(F.signum(c) * F.log1p(F.abs(c)), F.lit(0.0)) for c in finite]


def fit_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: Sequence[str] = (), sample: int = SAMPLE, bits: int = BUCKET_BITS) -> Machine:
    """A model of ``label_col`` (0 or 1), fitted on labelled rows that are not held out.

    At most ``sample`` labelled ids are used, the first by a hash of the id, so
    one task receives a bounded number of sparse rows; the driver receives the
    model.  An id with several
    labels counts with the majority of them (ties: 1); null labels and ids are
    left out, and so are labels without a document.  Of documents that share
    an id, each is a row.  Without labelled rows the model scores all 0.5.
    ``metadata`` names numeric columns of the documents that are features too;
    null counts as 0.  Texts are read whole; other columns are not read.
    """
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id__"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("__y__"))
        .orderBy(F.xxhash64("__id__"), "__id__")
        .limit(sample)
    )
    beside = [c.alias(f"beside_{i}") for i, c in enumerate(_metadata(metadata))]
    rows = documents.select(F.col(f"`{id_col}`").alias("__id__"), F.col(f"`{text_col}`").alias("__t__"), *beside).join(F.broadcast(ids), "__id__")
    n_stats = N_STATS + len(metadata)
    fields = [
        T.StructField("i", T.ArrayType(T.IntegerType())),
        T.StructField("v", T.ArrayType(T.FloatType())),
        T.StructField("s", T.ArrayType(T.FloatType())),
    ]

    def make():
        def run(texts: pa.Array, *beside: pa.Array) -> list:
            x = featurise(texts, *beside, bits=bits)
            ends = pa.array(x.first, pa.int32())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x.stats) + 1) * n_stats, pa.int32()), pa.array(x.stats.ravel()))
            return [pa.ListArray.from_arrays(ends, pa.array(x.index)), pa.ListArray.from_arrays(ends, pa.array(x.value)), stats]

        return run

    found = map_texts(rows, "__t__", fields, make, ["__id__", "__y__"], extra=[F.col(f"beside_{i}") for i in range(len(beside))])
    fitted = found.repartition(1).mapInArrow(_fitted(n_stats, bits), "machine binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else fit(_no_rows(n_stats), np.zeros(0), bits)


def _no_rows(n_stats: int) -> Features:
    return Features(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, n_stats), np.float32))


def _fitted(n_stats: int, bits: int):
    """The rows of the sample to one row, the pickled model; it is fitted on an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not sum(b.num_rows for b in found):
            return
        got = pa.Table.from_batches(found).combine_chunks().sort_by("__id__").combine_chunks()
        index, value, stats = (got[c].combine_chunks() for c in ("i", "v", "s"))
        first = np.concatenate([[0], np.cumsum(np.asarray(index.value_lengths()))])
        x = Features(first, np.asarray(index.flatten()), np.asarray(value.flatten()), np.asarray(stats.flatten()).reshape(-1, n_stats))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, got["__y__"].to_numpy(), bits))], pa.binary())], names=["machine"])

    return run


def score_quality(documents: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD, metadata: Sequence[str] = (), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with score (0 to 1) and predicted (0 or 1).

    Null and empty texts are scored from their (empty) statistics.  Repeated
    rows get equal scores; texts are scored whole; an empty table gives an
    empty one.  Columns named like the results, in whatever case, are replaced.
    ``metadata`` names the columns that the model was fitted with.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def make():
        def run(texts: pa.Array, *beside: pa.Array) -> list:
            score = shared.value.score(featurise(texts, *beside, bits=shared.value.bits))
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return run

    return map_texts(documents, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, keep, extra=_metadata(metadata))
