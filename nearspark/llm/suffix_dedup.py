"""Removal of long byte strings that occur more than once.

Suffixes start at anchors: positions whose ``GRAM``-byte prefix has the least
hash among all that start in some window of ``length`` bytes.  Equal windows
have equal anchors, so every repeated window is found among suffixes that
share their anchor's prefix, and about one position in fifty is indexed.

The suffixes are dealt by the hash of that prefix into shards.  A shard keeps
a logarithmic family of suffix arrays: a batch arrives as a suffix array
(suffixes ordered by 128-bit fingerprints of the text around their anchor), is
merge-scanned against the levels that exist, and levels of equal size are
merged.  The scan marks

* suffixes whose whole surroundings occur again: all their windows are repeated,
* suffixes that share the anchor's prefix with different surroundings: they
  stay open.

The same family holds suffixes of words: their windows are ``passage`` words
long, and they count only what other documents hold too.

The windows of open suffixes, and of one witness (of words: two, from different
rows) for each kind of surroundings that they were compared with, go through a second family, in which a suffix is
ordered by the fingerprint of its first ``length`` bytes.  Both phases deal
fingerprints, never groups.  Every entry is sent, equal ones too; the receiving
shard merges those of a batch before they are indexed, so a passage that is
frequent costs the one shard an entry in memory for each occurrence.

An entry is sent as its two fingerprints and three packed numbers: the row of its
text in the batch, and its first and last start.  The keys of a batch's texts
travel once, with one of its shards, and meet the replies where these are gathered.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from nearspark.llm import text as tx
from nearspark.llm.batches import slices
from nearspark.llm.shared import cut, plain_names, shuffle_partitions

LENGTH = 400
GRAM_SHARE = 0.75
#: Words of a passage that is counted when another document holds it too.
PASSAGE = 51
#: Shards: so many for each shuffle partition, so that the sizes of partitions even
#: out, and more where a shard would stand for more than ``SHARD_BYTES`` of text.
SHARDS, SHARD_BYTES = 4, 64 << 20
_PLACE_BITS = 31
#: Added to the places of words, which share blobs with the places of bytes.
_WORD = 1 << 31


class LogIndex:
    """Sorted arrays of (first, second) fingerprints whose sizes grow geometrically.

    ``same`` counts entries with both fingerprints equal (as 1 or 2), ``near``
    marks entries that share only the first one with some other.
    """

    def __init__(self):
        self.levels: list[np.ndarray] = []

    TYPE = np.dtype([("a", "u8"), ("b", "u8"), ("id", "i8"), ("same", "u1"), ("near", "u1")])

    def insert(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        """``many``: whether an entry stands for several of its batch."""
        level = np.zeros(len(a), self.TYPE)
        order = np.lexsort((b, a))
        level["a"], level["b"], level["id"], level["same"] = a[order], b[order], ids[order], many[order]
        self._within(level)
        for other in self.levels:
            self._scan(level, other)
            self._scan(other, level)
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = self._merge(self.levels.pop(), level)
        self.levels.append(level)

    @staticmethod
    def _within(level: np.ndarray) -> None:
        a, b = level["a"], level["b"]
        if len(a) < 2:
            return
        shared = a[1:] == a[:-1]
        equal = shared & (b[1:] == b[:-1])
        for at, flags in (("same", equal), ("near", shared & ~equal)):
            level[at][1:] |= flags
            level[at][:-1] |= flags
        # an entry is near also if others of its first fingerprint, further off, differ
        starts = np.flatnonzero(np.append(True, ~shared))
        group = np.add.reduceat(level["near"].astype(np.int64), starts) > 0
        level["near"] |= np.repeat(group, np.diff(np.append(starts, len(a)))).astype(np.uint8)

    @staticmethod
    def _scan(level: np.ndarray, other: np.ndarray) -> None:
        """Marks entries of ``level`` by what ``other`` holds."""
        low, high = np.searchsorted(other["a"], level["a"], "left"), np.searchsorted(other["a"], level["a"], "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return
        low, high, b = low[hit], high[hit], level["b"][hit]
        at = low.copy()  # first entry of the range that is not below b, found by bisection
        left, right = low.copy(), high.copy()
        while (open_ := left < right).any():
            mid = (left + right) // 2
            below = open_ & (other["b"][np.minimum(mid, len(other) - 1)] < b)
            left = np.where(below, mid + 1, left)
            right = np.where(open_ & ~below, mid, right)
        at = left
        equal = (at < high) & (other["b"][np.minimum(at, len(other) - 1)] == b)
        only_equal = equal & (other["b"][low] == b) & (other["b"][high - 1] == b)
        level["same"][hit] |= equal
        level["near"][hit] |= ~only_equal

    @staticmethod
    def _merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        both = np.concatenate([one, two])
        return both[np.lexsort((both["b"], both["a"]))]

    def entries(self) -> np.ndarray:
        """All entries, in order."""
        if not self.levels:
            return np.zeros(0, self.TYPE)
        level = self.levels[0]
        for other in self.levels[1:]:
            level = self._merge(level, other)
        return level


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.int64).max, np.int64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _anchors(sums: np.ndarray, sums_two: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Of all windows of symbols within texts, grouped by their anchor: gram hash, surroundings' hash, text, first and last start."""
    empty = np.zeros(0, np.int64)
    n = len(sums) - 1
    if n < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    at = np.arange(n - gram + 1)
    hashes = tx.range_hashes(sums, at, at + gram)
    keys = (hashes >> np.uint64(64 - 32)).astype(np.int64) << _PLACE_BITS | at
    best = _sliding_min(keys, length - gram + 1) & ((1 << _PLACE_BITS) - 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
    starts = np.flatnonzero(np.arange(len(best)) + length <= offsets[1:][doc])
    anchor = best[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    if not len(first):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    low, high = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    return hashes[anchor[first]], tx.range_hashes(sums_two, low, high + length, 1), doc[low], low - offsets[doc[low]], high - offsets[doc[low]]


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, deflated one plane of bytes after the other."""
    return zlib.compress(x.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), "u1").reshape(4, -1).T).view("<u4").ravel()


def _places(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[str, bytes]:
    """Columns that say where entries lie: rows as differences, ranges by start and span."""
    return {"doc": _packed(np.diff(doc.astype(np.int64), prepend=0)), "low": _packed(low), "span": _packed(high - low)}


class _Writer:
    """Entries of one batch of texts, dealt into shards; one of these gets the keys of the texts.

    The shard follows from the first fingerprint, or from the second one.
    """

    SCHEMA = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("batch", T.BinaryType())] + [T.StructField(c, T.BinaryType()) for c in ("keys", "doc", "a", "b", "low", "span")]
    )

    def __init__(self, shards: int, by_first: bool):
        self.shards, self.by_first = shards, by_first

    def write(self, keys: np.ndarray, a, b, doc, low, high) -> pa.RecordBatch:
        shard = ((a if self.by_first else b) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        name = hashlib.md5(keys.tobytes()).digest()
        rows = []
        for s in range(self.shards):
            part = order[ends[s] : ends[s + 1]]
            if len(part):
                prints = {c: x[part].astype("<u8").tobytes() for c, x in (("a", a), ("b", b))}
                rows.append({"shard": s, "batch": name, "keys": None} | prints | _places(doc[part], low[part], high[part]))
        # a row that follows from the name, so that keys of many batches spread over the shards
        rows[int.from_bytes(name[:4], "big") % len(rows)]["keys"] = keys.tobytes()
        kinds = {"shard": pa.int32()} | dict.fromkeys(self.SCHEMA.names[1:], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], names=list(kinds))


def _collect(parts: list[tuple], n_cols: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(n_cols)]


def _suffixes(length: int, gram: int, passage: int, shards: int):
    """Documents (key, text) to their dealt anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(shards, by_first=True)
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
            texts, parts = pc.fill_null(batch.column(1), ""), []
            for x, y in slices(texts):
                data, offsets = tx.utf8(texts.slice(x, y - x))
                a, b, doc, low, high = _anchors(tx.prefix_hashes(data), tx.prefix_hashes(data, 1), offsets, length, gram)
                parts.append((a, b, doc + x, low, high))
                found = tx.words(data, offsets, tx.NON_BLANK)
                a, b, doc, low, high = _anchors(tx.prefix_sums(found.hashes), tx.prefix_sums(found.hashes, 1), found.first, passage, passage // 2 + 1)
                parts.append((a, b, doc + x, low + _WORD, high + _WORD))
            if sum(len(p[0]) for p in parts):
                yield writer.write(keys, *_collect(parts, 5))

    return run


_REPLY = T.StructType([T.StructField(c, T.BinaryType()) for c in ("batch", "keys", "doc", "low", "span", "open")])
_RANGES = T.StructType([T.StructField(c, T.BinaryType()) for c in ("key", "covered", "open")])


def _arrays(table: pa.Table, row: int) -> dict[str, np.ndarray]:
    """The columns of a row; ``keys`` are empty where they travel with another."""
    kinds = {"keys": "V16", "a": "<u8", "b": "<u8", "open": "u1"}
    x = {c: np.frombuffer(table.column(c)[row].as_buffer() or b"", kinds[c]) for c in table.column_names if c in kinds}
    doc, low, span = (_unpacked(table.column(c)[row].as_buffer()) for c in ("doc", "low", "span"))
    return x | {"doc": np.cumsum(doc, dtype="<u4"), "low": low, "high": low + span}


def _indexed(table: pa.Table) -> tuple[np.ndarray, list[dict[str, np.ndarray]], np.ndarray]:
    """Entries of a shard after all its batches were inserted, the batches, and where each begins."""
    index, batches, begins, total = LogIndex(), [], [], 0
    for row in range(table.num_rows):
        x = _arrays(table, row)
        order = np.lexsort((x["b"], x["a"]))
        a, b = x["a"][order], x["b"][order]
        lead = np.ones(len(a), bool)
        lead[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        kept = order[lead]
        back = np.empty(len(a), np.int64)
        back[order] = np.cumsum(lead) - 1
        copies = np.bincount(back)
        docs = int(x["doc"].max()) + 1
        pairs = np.unique(back * docs + x["doc"]) // docs
        many = np.where(x["low"][kept] >= _WORD, np.bincount(pairs, minlength=len(copies)), copies) > 1
        index.insert(x["a"][kept], x["b"][kept], kept + total, many)
        x["kept"], x["back"], x["batch"] = kept, back, table.column("batch")[row].as_py()
        batches.append(x)
        begins.append(total)
        total += len(x["a"])
    return index.entries(), batches, np.array(begins)


def _reply(x: dict, chosen: np.ndarray, open_: np.ndarray) -> tuple:
    places = _places(x["doc"][chosen], x["low"][chosen], x["high"][chosen])
    return (x["batch"], x["keys"].tobytes(), *places.values(), open_.astype("u1").tobytes())


def _flags(entries: np.ndarray, batches: list[dict], begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each batch, of every entry: same, near, witness.

    A witness stands for all entries of equal fingerprints that are near others:
    it is the first of them by batch, row and place.  Words take a second one, the
    first of another row: what is open may lie in the row of the first.
    """
    order = np.argsort(entries["id"])
    ids, same, near = entries["id"][order], entries["same"][order] > 0, entries["near"][order] > 0
    out, wanted = [], []
    for x, begin in zip(batches, begins.tolist(), strict=True):
        at = np.searchsorted(ids, x["kept"] + begin)
        s, n = same[at][x["back"]], near[at][x["back"]]
        out.append((s, n, np.zeros(len(s), bool)))
        wanted.append(np.flatnonzero(s & n))
    if any(len(w) for w in wanted):
        batch = np.repeat(np.arange(len(batches)), [len(w) for w in wanted])
        place = np.concatenate(wanted)
        a, b, doc, low = (np.concatenate([x[c][w] for x, w in zip(batches, wanted, strict=True)]) for c in ("a", "b", "doc", "low"))
        _, rank = np.unique([x["batch"] for x in batches], return_inverse=True)
        order = np.lexsort((low, doc, rank[batch], b, a))
        a, b, doc, low, batch, place = (v[order] for v in (a, b, doc, low, batch, place))
        chosen = np.ones(len(a), bool)
        chosen[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.maximum.accumulate(np.where(chosen, np.arange(len(a)), 0))
        other = (doc != doc[first]) | (rank[batch] != rank[batch[first]])
        chosen[1:] |= other[1:] & ~other[:-1] & (low[1:] >= _WORD)
        for i, p in zip(batch[chosen].tolist(), place[chosen].tolist(), strict=True):
            out[i][2][p] = True
    return out


def _resolve(table: pa.Table) -> pa.Table:
    """A shard of anchors: which have all windows repeated, which stay open."""
    entries, batches, begins = _indexed(table)
    rows = []
    for x, (same, near, witness) in zip(batches, _flags(entries, batches, begins), strict=True):
        chosen = np.flatnonzero(same | near)
        if len(chosen) or len(x["keys"]):
            open_ = (~same & near) | witness
            rows.append(_reply(x, chosen, (same[chosen] * 1) | (open_[chosen] * 2)))
    return _table(rows, _REPLY)


def _repeated(table: pa.Table) -> pa.Table:
    """A shard of windows: those that occur again."""
    entries, batches, begins = _indexed(table)
    rows = []
    for x, (same, _, _) in zip(batches, _flags(entries, batches, begins), strict=True):
        chosen = np.flatnonzero(same)
        if len(chosen) or len(x["keys"]):
            rows.append(_reply(x, chosen, np.ones(len(chosen))))
    return _table(rows, _REPLY)


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, pa.binary()) for c in columns], names=schema.names)


def _union(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges of starts that cover the given ones; touching ranges join."""
    order = np.argsort(low, kind="stable")
    low, high = low[order].astype(np.int64), high[order].astype(np.int64)
    reach = np.maximum.accumulate(high)
    ends = np.ones(len(low), bool)  # whether a range of the union ends here
    ends[:-1] = low[1:] > reach[:-1] + 1
    starts = np.ones(len(low), bool)
    starts[1:] = ends[:-1]
    return low[starts], reach[ends]


def _by_document(table: pa.Table) -> pa.Table:
    """The replies to one batch, gathered for each of its documents."""
    parts = [_arrays(table, row) for row in range(table.num_rows)]
    doc, low, high, flag = (np.concatenate([x[c] for x in parts]) for c in ("doc", "low", "high", "open"))
    if not len(doc):
        return _table([], _RANGES)
    keys = next((x["keys"] for x in parts if len(x["keys"])), None)
    if keys is None:
        raise RuntimeError("a batch of texts came without its keys: its task ran again over rows in another order")
    _, kept, back = np.unique(keys.view(np.dtype([("h", ">u8"), ("l", ">u8")]))["h"], return_index=True, return_inverse=True)
    names, doc = keys[kept], back[doc]
    order = np.argsort(doc, kind="stable")
    ends = np.searchsorted(doc[order], np.arange(len(names) + 1))
    rows = []
    for i in range(len(names)):
        part = order[ends[i] : ends[i + 1]]
        if not len(part):
            continue
        blobs = []
        for bit in (1, 2):
            mine = part[(flag[part] & bit) > 0]
            a, b = _union(low[mine], high[mine]) if bit == 1 else (low[mine], high[mine])
            blobs.append(np.stack([a, b], axis=1).astype("<u4").tobytes() if len(mine) else b"")
        rows.append((names[i].tobytes(), *blobs))
    return _table(rows, _RANGES)


def _open_windows(length: int, passage: int, shards: int):
    """Documents (key, text, open) to their dealt windows."""

    def windows(symbols: tuple[np.ndarray, np.ndarray], ranges: np.ndarray, size: int) -> tuple:
        counts = ranges[:, 1] - ranges[:, 0] + 1
        at = np.repeat(ranges[:, 0] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return tx.range_hashes(symbols[0], at, at + size), tx.range_hashes(symbols[1], at, at + size, 1), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(shards, by_first=False)
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
            parts, texts = [], batch.column(1)
            for i, blob in enumerate(batch.column(2).to_pylist()):
                ranges = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
                data, offsets = tx.utf8(texts.slice(i, 1))
                of_words = ranges[:, 0] >= _WORD
                if not of_words.all():
                    a, b, at = windows((tx.prefix_hashes(data), tx.prefix_hashes(data, 1)), ranges[~of_words], length)
                    parts.append((a, b, np.full(len(at), i), at, at))
                if of_words.any():
                    found = tx.words(data, offsets, tx.NON_BLANK).hashes
                    a, b, at = windows((tx.prefix_sums(found), tx.prefix_sums(found, 1)), ranges[of_words] - _WORD, passage)
                    parts.append((a, b, np.full(len(at), i), at + _WORD, at + _WORD))
                if sum(len(p[0]) for p in parts) > 1 << 19:
                    yield writer.write(keys, *_collect(parts, 5))
                    parts = []
            if parts:
                yield writer.write(keys, *_collect(parts, 5))

    return run


_RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("n_passage_words", T.LongType())]


def _finish(length: int, passage: int, schema: T.StructType, n_kept: int, texts_too: bool):
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = [[], [], [], [], []]
            kept_texts = []
            for text, *blobs in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                ranges = np.concatenate([np.frombuffer(b or b"", "<u4").reshape(-1, 2).astype(np.int64) for b in blobs])
                of_words = ranges[:, 0] >= _WORD
                low, high = _union(ranges[~of_words, 0], ranges[~of_words, 1] + length - 1)
                kept, end = [], 0
                for a, b in zip(low.tolist(), high.tolist(), strict=True):
                    kept.append(data[end:a])
                    end = b + 1
                kept.append(data[end:])
                left = b"".join(kept)
                first, last = _union(ranges[of_words, 0], ranges[of_words, 1] + passage - 1)
                made = (len(data), len(data) - len(left), len(low), hashlib.sha256(left).hexdigest(), int((last - first + 1).sum()))
                for column, value in zip(rows, made, strict=True):
                    column.append(value)
                kept_texts.append(None if text is None else left.decode("utf-8", "ignore"))
            made = rows + ([kept_texts] if texts_too else [])
            yield pa.RecordBatch.from_arrays(batch.columns[3 : 3 + n_kept] + [pa.array(v, out.field(n_kept + i).type) for i, v in enumerate(made)], schema=out)

    return run


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: list[str] | None = None, texts: bool = False, passage: int = PASSAGE
) -> DataFrame:
    """``keep`` columns (default: all) with n_bytes, n_removed, n_spans, kept_sha256, n_passage_words.

    A byte of a text (UTF-8; null: empty) is removed if a ``length``-byte string
    that covers it starts anywhere else too, in this or another document;
    strings never cross documents.  n_spans counts maximal removed runs,
    kept_sha256 is of the remaining bytes.  n_passage_words counts the words
    (between blanks, of the whole text) that lie in a run of ``passage`` words
    that another row holds too; it removes nothing.  ``texts=True`` adds
    kept_text: the remaining bytes, less those of characters that were cut.
    Repeated rows are occurrences of each other.  Texts shorter than ``length``
    lose nothing.  A very long text is one task's work, within 2 GiB.  An empty
    table gives an empty one.  Kept columns named like the results, in
    whatever case, are replaced; other names do not clash.

    Strings count as equal when two 64-bit fingerprints of independent families
    agree: of the anchor's prefix and the surroundings, or of the whole string.
    """
    if length < 8 or passage < 2:
        raise ValueError("length must be at least 8 bytes and passage at least 2 words")
    spark = documents.sparkSession
    gram = max(4, int(length * GRAM_SHARE))
    made = _RESULT + ([T.StructField("kept_text", T.StringType())] if texts else [])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # never null, so that no join puts a filter below the exchange that they share
    key: Column = F.coalesce(F.unhex(F.md5(F.concat_ws("\x00", F.col(f"`{id_col}`").cast("string"), text).cast("binary"))), F.lit(b""))
    carried, fields = plain_names(documents, keep, made)
    source = documents.select(key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"), *carried)
    names = [f"keep_{i}" for i in range(len(fields))]
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS * shuffle_partitions(spark), -(-size // SHARD_BYTES))

    suffixes = source.where(F.octet_length("text") >= min(length, 2 * passage - 1)).select("key", "text").mapInArrow(_suffixes(length, gram, passage, shards), _Writer.SCHEMA)
    found = suffixes.groupBy("shard").applyInArrow(_resolve, _REPLY).groupBy("batch").applyInArrow(_by_document, _RANGES)
    # repeated rows of several batches are covered alike, but a witness is open in its own only
    found = cut(found.groupBy("key").agg(F.max("covered").alias("covered"), F.listagg("open").alias("open")))

    # both joins below read this one exchange: the same columns reach them
    rows = source.repartition("key")
    opened = rows.join(found.where(F.octet_length("open") > 0).select("key", "open"), "key").select("key", "text", "open", *names)
    windows = opened.mapInArrow(_open_windows(length, passage, shards), _Writer.SCHEMA)
    again = windows.groupBy("shard").applyInArrow(_repeated, _REPLY).groupBy("batch").applyInArrow(_by_document, _RANGES)
    again = again.select("key", F.col("covered").alias("more")).groupBy("key").agg(F.max("more").alias("more"))

    marked = found.where(F.octet_length("covered") > 0).select("key", "covered").join(again, "key", "full")
    joined = rows.join(marked, "key", "left").select("text", "covered", "more", *names)
    schema = T.StructType(fields + made)
    return joined.mapInArrow(_finish(length, passage, schema, len(fields), texts), schema)
