"""Benchmark decontamination with suffix arrays over shards of training words.

Every shard (an Arrow batch of documents) gets a suffix array of its word
positions, cut to the length of a window.  Each suffix of each benchmark item
is looked up in it by binary search; the range found gives the locations of
verbatim matches, and matches on one diagonal join to the longest ones.
Positions whose first words begin no benchmark suffix cannot be in a range and
are left out of the array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from nearspark.llm import text as tx
from nearspark.llm.batches import slices
from nearspark.llm.shared import cut, plain_names

WINDOW = 13
#: Benchmark text that is held in memory at once; more is taken in blocks, each a pass.
BLOCK_BYTES = 2 << 20
#: Passes over the documents between writes to the shared folder.
PASSES = 8
_BITS = 22


@dataclass
class Items:
    """A block of items as it is broadcast: the hashes of their words, each once."""

    ids: list
    first: np.ndarray  # words first[i] to first[i + 1] are those of item i
    hashes: np.ndarray


@dataclass
class Suffixes:
    """Every suffix of a block of items, cut to the length of a window."""

    items: list  # item id of each item
    owner: np.ndarray  # item of each window
    position: np.ndarray  # of the window's first word in its item
    lengths: np.ndarray  # words of each window
    rows: np.ndarray  # (windows, WINDOW) hashes, zeros after the window
    lead: int  # words that every window has
    filter: np.ndarray  # bit table of the hashes of the first ``lead`` words


def _keys(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of hashes as byte strings that sort like the rows."""
    return np.ascontiguousarray(rows[:, :width].astype(">u8")).view(f"S{8 * width}").ravel()


def items_of(items: list[tuple[object, str]]) -> Items:
    data, offsets = tx.utf8(pa.array([t or "" for _, t in items], pa.string()))
    found = tx.words(tx.lowered(data), offsets, tx.ALNUM)
    return Items([i for i, _ in items], found.first, found.hashes)


def windows_of(block: Items, window: int = WINDOW) -> Suffixes:
    """The suffixes that begin a window; an item of fewer words is one window."""
    counts = np.diff(block.first)
    size = np.minimum(counts, window)
    many = np.where(counts > 0, counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    position = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    lengths = size[owner]
    padded = np.concatenate([block.hashes, np.zeros(window, np.uint64)])
    rows = padded[(block.first[owner] + position)[:, None] + np.arange(window)]
    rows[np.arange(window) >= lengths[:, None]] = 0
    lead = int(min(lengths.min(), 3)) if len(owner) else 1
    table = np.zeros(1 << _BITS, bool)
    if len(owner):
        first = np.ascontiguousarray(rows[:, :lead])
        table[_bits(tx.gram_hashes(first.ravel(), lead)[::lead])] = True
    return Suffixes(block.ids, owner, position, lengths, rows, lead, table)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def search(texts: pa.Array, tests: Suffixes, window: int = WINDOW) -> list[tuple[int, np.ndarray, np.ndarray, list]]:
    """For each text: n_words, hit word ranges (starts, ends), matches.

    A match is (item index, item word, document word, words): the longest
    verbatim one on its diagonal.
    """
    counts, where_doc, where_word, rows = [], [], [], []
    base = 0
    for a, b in slices(texts):
        data, offsets = tx.utf8(texts.slice(a, b - a))
        found = tx.words(tx.lowered(data), offsets, tx.ALNUM)
        counts.append(found.counts)
        n = len(found.hashes)
        if n >= tests.lead and len(tests.owner):
            grams = tx.gram_hashes(found.hashes, tests.lead)
            at = np.flatnonzero(tests.filter[_bits(grams)])
            doc = np.searchsorted(found.first, at, side="right") - 1
            padded = np.concatenate([found.hashes, np.zeros(window, np.uint64)])
            near = at[:, None] + np.arange(window)
            part = padded[near]
            part[near >= found.first[doc + 1][:, None]] = 0
            where_doc.append(doc + base)
            where_word.append(at - found.first[doc])
            rows.append(part)
        base += b - a
    n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    out = [[int(n), [], [], []] for n in n_words]
    if not rows:
        return out
    docs, places, suffixes = np.concatenate(where_doc), np.concatenate(where_word), np.concatenate(rows)
    order = np.argsort(_keys(suffixes, window), kind="stable")  # the shard's suffix array
    docs, places, suffixes = docs[order], places[order], suffixes[order]
    hits = []
    for size in np.unique(tests.lengths).tolist():
        these = np.flatnonzero(tests.lengths == size)
        keys, wanted = _keys(suffixes, size), _keys(tests.rows[these], size)
        low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        many = high - low
        if not many.any():
            continue
        test = np.repeat(these, many)
        suffix = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        hits.append((docs[suffix], places[suffix], test, np.full(len(test), size)))
    if not hits:
        return out
    doc, place, test, size = (np.concatenate(x) for x in zip(*hits, strict=True))
    item, item_word = tests.owner[test], tests.position[test]
    order = np.lexsort((place, place - item_word, item, doc))
    doc, place, item, item_word, size = (x[order] for x in (doc, place, item, item_word, size))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - item_word[1:] != place[:-1] - item_word[:-1]) | (place[1:] != place[:-1] + 1)
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(doc)) - 1
    for f, g in zip(firsts.tolist(), lasts.tolist(), strict=True):
        start, end = int(place[f]), int(place[g] + size[g])
        row = out[doc[f]]
        row[1].append(start)
        row[2].append(end)
        row[3].append((int(item[f]), int(item_word[f]), start, end - start))
    return out


def covered(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, through one partition at a time."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


_MATCH = T.StructType([T.StructField("item_id", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("item_word", "doc_word", "n_words")]])
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(_MATCH)),
]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (default: all) with n_words, n_hit, items, matches.

    n_hit counts document words within an occurrence of any window; items are
    the distinct ids (as strings, sorted) of items with an occurring window;
    matches are the longest verbatim matches with their places.  Items with a
    null id or text, or without words, are left out; items that share an id
    count as one.  A null or empty document has 0 words and no hits.  Repeated
    rows are judged each, whole however long their texts are; an empty table
    gives an empty one, and without items nothing is hit.  Columns named like
    the results, in whatever case, are replaced; other names do not clash.

    The benchmark is read in blocks of ``block_bytes`` of text.  A block is
    broadcast as the hashes of its words, 8 bytes each and so at most 8 times
    ``block_bytes`` / 2, whatever its words are; workers make its windows.  Each
    block is one pass over the documents; after every ``PASSES`` of them the
    rows are written to the shared folder, so that no task runs more workers.
    """
    spark: SparkSession = documents.sparkSession
    carried, kept_fields = plain_names(documents, keep, RESULT)
    plain = [T.StructField(f"keep_{i}", f.dataType) for i, f in enumerate(kept_fields)]
    ranges = T.ArrayType(T.ArrayType(T.IntegerType()))
    rows = documents.select(F.col(f"`{text_col}`").cast("string").alias("text"), *carried)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    i, block, last = 0, next(blocks, []), False
    while not last:
        following = next(blocks, None)
        last = following is None
        tests = spark.sparkContext.broadcast(items_of(block))
        so_far = T.StructField("so_far", T.StructType([T.StructField("ranges", ranges), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(_MATCH))]))
        schema = T.StructType([*kept_fields, *RESULT] if last else [T.StructField("text", T.StringType()), *plain, so_far])
        rows = rows.mapInArrow(_pass(tests, window, i > 0, last, len(plain), schema), schema)
        if not last and i % PASSES == PASSES - 1:
            rows = cut(rows)
        i, block = i + 1, following
    return rows


def _pass(tests, window: int, again: bool, last: bool, n_kept: int, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows_of(tests.value, window)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            before = batch.column(batch.num_columns - 1).to_pylist() if again else [None] * batch.num_rows
            n_words, n_hit, items, matches, carry = [], [], [], [], []
            for (n, starts, ends, found), old in zip(search(texts, known, window), before, strict=True):
                old = old or {"ranges": [], "items": [], "matches": []}
                union = covered(starts + [r[0] for r in old["ranges"]], ends + [r[1] for r in old["ranges"]])
                ids = sorted({known.items[m[0]] for m in found} | set(old["items"]))
                places = old["matches"] + [{"item_id": known.items[i], "item_word": p, "doc_word": d, "n_words": k} for i, p, d, k in found]
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in union))
                items.append(ids)
                matches.append(places)
                carry.append({"ranges": [list(r) for r in union], "items": ids, "matches": places})
            kept = batch.columns[1 : 1 + n_kept]
            made = [n_words, n_hit, items, matches] if last else [carry]
            first = [] if last else [batch.column(0)]
            shift = len(first) + n_kept
            arrays = [*first, *kept, *[pa.array(x, type=out_schema.field(shift + i).type) for i, x in enumerate(made)]]
            yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    return run


def contaminated(one_in: int = 20) -> Column:
    """Whether a word is hit, and at least one in ``one_in`` words are."""
    return (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))
