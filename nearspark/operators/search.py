"""Fuzzy search of patterns in a DataFrame of texts.

Patterns are few and go to every executor; texts stay where they are, so a
search is a scan and one Arrow pass without a shuffle.  A pattern table beyond
``BLOCK_BYTES`` is taken in blocks, each a broadcast of bounded size and a
pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearspark.kernel.engine import FIELDS, SLICE_BYTES, Engine, as_texts
from nearspark.kernel.trace import trace
from nearspark.plans.options import SearchOptions
from nearspark.plans.seeds import seed_filter

#: Bytes of patterns that are broadcast at once.
BLOCK_BYTES = 1 << 20

Patterns = DataFrame | Sequence[str | bytes | tuple[str, str | bytes]]

MATCH = T.StructType(
    [T.StructField("pattern_idx", T.IntegerType()), T.StructField("pattern_id", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("text_start", "text_end", "pattern_start", "pattern_end", "cost")]
    + [T.StructField("strand", T.StringType()), T.StructField("cigar", T.StringType())]
)
#: The order of matches: CIGARs do not take part in it.
MATCH_ORDER = ("pattern_idx", "text_start", "text_end", "pattern_start", "pattern_end", "cost", "strand")


def _bytes(value: str | bytes | bytearray) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value)


def pattern_blocks(patterns: Patterns, most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """(number of the first, [(id, pattern)]) in blocks of bounded size.

    A DataFrame has the columns pattern and, if it likes, pattern_id and
    pattern_idx (it is read in the order of the latter); without ids they are
    numbers from 1 on.  Null and empty patterns are an error.
    """

    def rows() -> Iterator[tuple[str | None, str | bytes]]:
        if isinstance(patterns, DataFrame):
            chosen = patterns.orderBy("pattern_idx") if "pattern_idx" in patterns.columns else patterns
            name = F.col("pattern_id").cast("string") if "pattern_id" in patterns.columns else F.lit(None).cast("string")
            yield from chosen.select(name, "pattern").toLocalIterator()
        else:
            yield from (p if isinstance(p, tuple) else (None, p) for p in patterns)

    first, block, size = 0, [], 0
    for i, (name, value) in enumerate(rows()):
        if not value:
            raise ValueError("a pattern is null or empty")
        if block and size + len(value) > most:
            yield first, block
            first, block, size = i, [], 0
        block.append((str(i + 1) if name is None else name, _bytes(value)))
        size += len(value)
    if block:
        yield first, block


def _kept(texts: DataFrame, text_col: str, keep: Sequence[str] | None, made: Sequence[str]) -> list[str]:
    return [c for c in (texts.columns if keep is None else keep) if c not in made]


def _input(texts: DataFrame, text_col: str, kept: Sequence[str]) -> DataFrame:
    column = F.col(f"`{text_col}`")
    if not isinstance(texts.schema[text_col].dataType, T.StringType | T.BinaryType):
        column = column.cast("string")
    return texts.select(column.alias("__text__"), *[F.col(f"`{c}`") for c in kept])


def _ints(values: np.ndarray, absent: bool = True) -> pa.Array:
    values = np.asarray(values, np.int64)
    return pa.array(values, pa.int32(), mask=values < 0) if absent else pa.array(values, pa.int32())


def search(texts: DataFrame, patterns: Patterns, options: SearchOptions, text_col: str = "text", keep: Sequence[str] | None = None, prefilter: bool = True) -> DataFrame:
    """``keep`` columns (default: all) of a text, and a match, for every match.

    Positions are byte offsets into the forward text, ends exclusive; starts
    are null when not traced (for reverse complements the end is).  Null and
    empty texts have no matches; equal texts have equal ones.  Columns named
    like those of a match are left out.
    """
    kept = _kept(texts, text_col, keep, MATCH.names)
    schema = T.StructType([texts.schema[c] for c in kept] + list(MATCH))
    parts = None
    for first, block in pattern_blocks(patterns):
        for _, p in block:
            options.check_pattern(p)
        chosen = texts
        seeds = seed_filter(F.col(f"`{text_col}`"), [p for _, p in block], options) if prefilter else None
        if seeds is not None:
            chosen = texts.where(seeds)
        part = _input(chosen, text_col, kept).mapInArrow(_searching(texts.sparkSession.sparkContext.broadcast((first, block)), options, schema, len(kept)), schema)
        parts = part if parts is None else parts.unionByName(part)
    return texts.sparkSession.createDataFrame([], schema) if parts is None else parts


def _searching(block, options: SearchOptions, schema: T.StructType, n_kept: int):
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, patterns = block.value
        engine = Engine([p for _, p in patterns], options)
        names = np.array([n for n, _ in patterns], object)
        for batch in batches:
            for found in engine.search(batch.column(0)):
                rows = pa.array(found["row"], pa.int64())
                made = [
                    _ints(found["pattern_idx"] + first),
                    pa.array(names[found["pattern_idx"]], pa.string()),
                    *[_ints(found[c]) for c in FIELDS[2:6]],
                    _ints(found["cost"]),
                    pa.array(found["strand"], pa.string()),
                    pa.array(found["cigar"], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([c.take(rows) for c in batch.columns[1 : 1 + n_kept]] + made, schema=out)

    return run


def search_all(texts: DataFrame, patterns: Patterns, options: SearchOptions, **more) -> DataFrame:
    """Matches at every end within ``k`` edits."""
    return search(texts, patterns, options.with_(mode="all"), **more)


def search_best(texts: DataFrame, patterns: Patterns, options: SearchOptions, **more) -> DataFrame:
    """The best match of each pattern, text and strand: least cost, then largest end."""
    return search(texts, patterns, options.with_(best_only=True), **more)


def search_all_alignments(texts: DataFrame, patterns: Patterns, options: SearchOptions, **more) -> DataFrame:
    """Every alignment at every end; ``anchor`` is what those of a group share.

    That is text_end on the forward strand and text_start on the other.
    """
    found = search(texts, patterns, options.with_(mode="alignments"), **more)
    return found.withColumn("anchor", F.when(F.col("strand") == "+", F.col("text_end")).otherwise(F.col("text_start")))


def search_encoded(texts: DataFrame, patterns: Patterns, options: SearchOptions, every: bool = False, **more) -> DataFrame:
    """As ``search`` or ``search_all``, reverse complements of patterns being searched in the forward text."""
    return search(texts, patterns, options.with_(rc_mode="pattern", mode="all" if every else options.mode), **more)


def search_many(texts: DataFrame, patterns: Patterns, options: SearchOptions, partitions: int | None = None, search_mode: str = "auto", **more) -> DataFrame:
    """All patterns in all texts.

    ``search_mode`` names how a single machine would batch the work; results
    do not depend on it.  ``partitions`` deals the texts out anew.
    """
    if search_mode not in ("auto", "single", "batch_patterns", "batch_texts", "batch_patterns_short"):
        raise ValueError(f"unknown search mode {search_mode!r}")
    return search(texts.repartition(partitions) if partitions else texts, patterns, options, **more)


_ENDS = T.ArrayType(T.StructType([T.StructField("search_end", T.IntegerType()), T.StructField("cost", T.IntegerType())]))


def _ends_schema(texts: DataFrame, kept: Sequence[str]) -> T.StructType:
    return T.StructType(
        [texts.schema[c] for c in kept]
        + [T.StructField("pattern_idx", T.IntegerType()), T.StructField("pattern_id", T.StringType()), T.StructField("strand", T.StringType())]
        + [T.StructField("search_pattern", T.BinaryType()), T.StructField("search_text", T.BinaryType()), T.StructField("search_ends", _ENDS), T.StructField("text_row", T.LongType())]
    )


def search_where(texts: DataFrame, patterns: Patterns, options: SearchOptions, predicate: Column, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Matches at those ends that satisfy a predicate.

    The predicate sees, of ends selected by ``options.mode``, the columns
    search_pattern, search_text (bytes as searched: complement and reversed
    text on the strand ``-``), search_end, cost, strand and the kept columns.
    It is applied before alignments are found, and before the best is chosen.
    """
    if options.mode == "alignments":
        raise ValueError("a predicate on ends is for the modes minima and all")
    kept = _kept(texts, text_col, keep, [*MATCH.names, "search_pattern", "search_text", "search_end", "search_ends", "text_row"])
    schema = _ends_schema(texts, kept)
    parts = None
    for first, block in pattern_blocks(patterns):
        shared = texts.sparkSession.sparkContext.broadcast((first, block))
        part = _input(texts, text_col, kept).mapInArrow(_ending(shared, options, schema, len(kept)), schema)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("there are no patterns")
    alike = [c for c in schema.names if c != "search_ends"]
    ends = parts.select(*[F.col(f"`{c}`") for c in alike], F.inline("search_ends")).where(predicate)
    # of a text only the window that an alignment to its end can reach is handed on
    size = F.octet_length("search_text")
    first = F.greatest(F.least("search_end", size) - F.octet_length("search_pattern") - options.k, F.lit(0))
    window = F.substring("search_text", first + 1, F.octet_length("search_pattern") + options.k)
    ends = ends.select(*[F.col(f"`{c}`") for c in kept], "pattern_idx", "pattern_id", "strand", "search_pattern", window.alias("__window__"), first.alias("__first__"), size.alias("__size__"), "search_end", "cost", "text_row")
    if options.best_only:
        order = Window.partitionBy("text_row", "pattern_idx", "strand").orderBy("cost", F.desc("search_end"))
        ends = ends.withColumn("__n__", F.row_number().over(order)).where("__n__ = 1").drop("__n__")
    out = T.StructType([texts.schema[c] for c in kept] + list(MATCH))
    return ends.mapInArrow(_tracing(options, out, len(kept)), out)


def _ending(block, options: SearchOptions, schema: T.StructType, n_kept: int):
    """Each text once for each pattern and strand with ends, as it is searched."""
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, patterns = block.value
        engine = Engine([p for _, p in patterns], options.with_(trace=False, best_only=False))
        by_text = options.rc_mode == "text"
        task, seen = (TaskContext.get().partitionId() << 33), 0
        for batch in batches:
            plain = batch.column(0).cast(pa.large_binary())
            sizes = pc.fill_null(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
            for found in engine.search(batch.column(0)):
                if not len(found["row"]):
                    continue
                # a part of the matches is of one pattern and strand
                p, forward = int(found["pattern_idx"][0]), found["strand"][0] == "+"
                name, pattern = patterns[p]
                needle = pattern if forward else options.letters.complement(pattern) if by_text else options.letters.reverse_complement(pattern)
                order = np.argsort(found["row"], kind="stable")
                row, cost = found["row"][order], found["cost"][order]
                end = found["text_end"][order] if forward or not by_text else sizes[row] - found["text_start"][order]
                end = end + len(pattern) - found["pattern_end"][order]
                begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                stops = np.append(begins[1:], len(row))
                held = np.cumsum(sizes[row[begins]])
                for some in np.split(np.arange(len(begins)), np.flatnonzero(np.diff(held // SLICE_BYTES)) + 1):
                    rows = row[begins[some]]
                    texts = [t.as_py() for t in plain.take(pa.array(rows, pa.int64()))]
                    low, high = begins[some[0]], stops[some[-1]]
                    items = pa.StructArray.from_arrays([_ints(end[low:high]), _ints(cost[low:high])], fields=list(out.field("search_ends").type.value_type))
                    offsets = pa.array(np.append(begins[some], high) - low, pa.int32())
                    made = [
                        pa.array(np.full(len(rows), p + first), pa.int32()),
                        pa.array([name] * len(rows), pa.string()),
                        pa.array([found["strand"][0]] * len(rows), pa.string()),
                        pa.array([needle] * len(rows), pa.binary()),
                        pa.array(texts if forward or not by_text else [t[::-1] for t in texts], pa.binary()),
                        pa.ListArray.from_arrays(offsets, items, type=out.field("search_ends").type),
                        pa.array(rows + task + seen, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(rows, pa.int64())) for c in batch.columns[1 : 1 + n_kept]] + made, schema=out)
            seen += batch.num_rows

    return run


def _tracing(options: SearchOptions, schema: T.StructType, n_kept: int):
    out = to_arrow_schema(schema)
    names = ("pattern_idx", "pattern_id", "strand", "needle", "window", "first", "size", "end", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(n_kept + i) for i, c in enumerate(names)}
            first, size, end = (get[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "size", "end"))
            windows = as_texts(get["window"])
            begins = windows.offsets[:-1]
            beyond = np.maximum(end - size, 0)
            needles = get["needle"].dictionary_encode()
            which = needles.indices.to_numpy(zero_copy_only=False)
            lengths = np.array([len(x) for x in needles.dictionary.to_pylist()], np.int64)[which]
            start, stop, p1, p2 = np.full(len(end), -1), end - beyond, np.full(len(end), -1), lengths - beyond
            cigar, keep = np.full(len(end), None, object), np.ones(len(end), bool)
            if options.trace:
                for i, needle in enumerate(needles.dictionary.to_pylist()):
                    at = np.flatnonzero(which == i)
                    # where the texts would begin, of which the windows are all that is looked at
                    start[at], stop[at], p1[at], p2[at], _, cigar[at] = trace(np.frombuffer(needle, np.uint8), windows.data, begins[at] - first[at], size[at], end[at], options)
                limit = options.max_n_frac
                if limit is not None and limit < 1:
                    sums = np.concatenate([[0], np.cumsum((windows.data | 32) == 110)])
                    low, high = begins + np.minimum(start - first, windows.lengths), begins + stop - first
                    share = (sums[high] - sums[low]).astype(np.float32) / np.maximum(stop - start, 1).astype(np.float32)
                    keep = (share <= np.float32(limit)) | (stop <= start)
            if options.rc_mode == "text":
                back = np.asarray(get["strand"].to_pylist(), object) == "-"
                start, stop = np.where(back, size - stop, start), np.where(back, np.where(start >= 0, size - start, -1), stop)
            made = [get["pattern_idx"], get["pattern_id"], *[_ints(x) for x in (start, stop, p1, p2)], get["cost"], get["strand"], pa.array(cigar, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *made], schema=out).filter(pa.array(keep))

    return run


RANGE = T.StructType(
    [T.StructField("pattern_idx", T.IntegerType()), T.StructField("pattern_id", T.StringType()), T.StructField("strand", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("first_end", "last_end", "cost")]
)


def search_ranges(texts: DataFrame, patterns: Patterns, options: SearchOptions, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Maximal runs of ends within ``k`` edits, with their least cost.

    With ``rc`` also those of the patterns' reverse complements in the forward text.
    """
    kept = _kept(texts, text_col, keep, RANGE.names)
    schema = T.StructType([texts.schema[c] for c in kept] + list(RANGE))
    out = to_arrow_schema(schema)
    n_kept = len(kept)

    def ranging(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, named = block.value
            engine = Engine([p for _, p in named], options)
            names = np.array([n for n, _ in named], object)
            for batch in batches:
                for found in engine.ranges(batch.column(0)):
                    made = [_ints(found["pattern_idx"] + first), pa.array(names[found["pattern_idx"]], pa.string()), pa.array(found["strand"], pa.string()), *[_ints(found[c]) for c in ("first_end", "last_end", "cost")]]
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(found["row"], pa.int64())) for c in batch.columns[1 : 1 + n_kept]] + made, schema=out)

        return run

    parts = None
    for first, block in pattern_blocks(patterns):
        part = _input(texts, text_col, kept).mapInArrow(ranging(texts.sparkSession.sparkContext.broadcast((first, block))), schema)
        parts = part if parts is None else parts.unionByName(part)
    return texts.sparkSession.createDataFrame([], schema) if parts is None else parts


def search_long(texts: DataFrame, patterns: Patterns, options: SearchOptions, text_col: str = "text", keep: Sequence[str] | None = None, chunk: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """As ``search``, for texts so long that one should be the work of many tasks.

    Texts are cut into chunks of ``chunk`` bytes with as much text to either
    side as an alignment can reach, and dealt out anew; a chunk reports the
    ends (on the strand ``-`` the starts) that lie in it.  Minima, and the
    best match, are then chosen among a text's ends by windows, which see
    ends within ``k`` edits only.  In these two cases limits on N and PAMs,
    which come after the choice, are not supported.
    """
    chosen = options.mode == "minima" or options.best_only
    if chosen and (options.pam is not None or (options.max_n_frac is not None and options.max_n_frac < 1)):
        raise ValueError("limits on N and PAMs need the mode all, without best_only")
    blocks = list(pattern_blocks(patterns))
    longest = max((len(p) for _, block in blocks for _, p in block), default=0)
    reach = longest + options.k
    made = [*MATCH.names, "text_row", "chunk_no", "chunk_start", "chunk_size", "text_size", "piece"]
    kept = _kept(texts, text_col, keep, made)
    data = F.col(f"`{text_col}`").cast("binary")
    rows = texts.select(data.alias("piece"), *[F.col(f"`{c}`") for c in kept]).where(F.octet_length("piece") > 0).withColumn("text_row", F.monotonically_increasing_id()).withColumn("text_size", F.octet_length("piece"))
    numbers = F.explode(F.sequence(F.lit(0), F.ceil(F.col("text_size") / chunk).cast("int") - 1))
    rows = rows.withColumn("chunk_no", numbers).withColumn("chunk_start", F.greatest(F.lit(0), F.col("chunk_no") * chunk - reach))
    size = F.least(F.col("text_size"), (F.col("chunk_no") + 1) * chunk + reach) - F.col("chunk_start")
    rows = rows.withColumn("piece", F.col("piece").substr(F.col("chunk_start") + 1, size)).withColumn("chunk_size", F.octet_length("piece"))
    rows = rows.repartition(partitions) if partitions else rows.repartition("text_row", "chunk_no")
    wide = options.with_(mode="all" if options.mode == "minima" else options.mode, best_only=False)
    found = search(rows, [p for _, block in blocks for p in block], wide, text_col="piece", keep=[*kept, "text_row", "chunk_no", "chunk_start", "chunk_size", "text_size"], prefilter=False)
    place = lambda c: (F.col(c) + F.col("chunk_start")).cast("int")
    found = found.withColumns({"text_start": place("text_start"), "text_end": place("text_end")})
    low, high = F.col("chunk_no") * chunk, (F.col("chunk_no") + 1) * chunk
    by_end = (F.col("strand") == "+") | F.lit(options.rc_mode == "pattern")
    ends_here = (F.col("text_end") <= high) & ((F.col("text_end") > low) | (low == 0))
    last = high >= F.col("text_size")
    starts_here = (F.col("text_start") >= low) & ((F.col("text_start") < high) | last)
    found = found.where(F.when(by_end, ends_here).otherwise(starts_here))
    if chosen:
        lengths = F.element_at(F.array(*[F.lit(len(p)) for _, block in blocks for _, p in block]), F.col("pattern_idx") + 1)
        end = F.when(by_end, F.col("text_end")).otherwise(F.col("text_size") - F.col("text_start")) + lengths - F.col("pattern_end")
        found = found.withColumn("search_end", end)
        order = Window.partitionBy("text_row", "pattern_idx", "strand").orderBy("search_end")
        if options.mode == "minima":
            after = F.lag("search_end").over(order) == F.col("search_end") - 1
            step = F.when(after, F.signum(F.col("cost") - F.lag("cost").over(order))).otherwise(F.lit(-1.0))
            rises = F.when(F.lead("search_end").over(order) == F.col("search_end") + 1, F.lead("cost").over(order) > F.col("cost")).otherwise(True)
            found = found.withColumns({"__step__": F.when(step != 0, step), "__rises__": rises})
            found = found.withColumn("__way__", F.last("__step__", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__rises__ and __way__ < 0")
        if options.best_only:
            best = Window.partitionBy("text_row", "pattern_idx", "strand").orderBy("cost", F.desc("search_end"))
            found = found.withColumn("__n__", F.row_number().over(best)).where("__n__ = 1")
    return found.select(*[F.col(f"`{c}`") for c in kept], *MATCH.names)
