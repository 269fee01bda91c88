"""Running a per-text function over Arrow batches of a DataFrame.

The function sees slices of bounded size, so the memory of a Python worker
depends on ``max_bytes`` and the longest single text, not on the batch size
that the session is set to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearspark.llm.shared import plain_names

#: Bytes of text handed to a per-slice function at once (one text at least).
SLICE_BYTES = 1 << 20


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > max_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., list]],
    keep: Sequence[str] | None = None,
    max_bytes: int = SLICE_BYTES,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Columns ``keep`` (default: all) followed by ``fields``.

    ``make`` is called once for each task and returns a function from a string
    array without nulls to one Arrow array (or list) for each field.  A null
    text is handed over as the empty text.  The function also gets the arrays
    of the columns ``extra``, which are not kept.  A kept column whose name is
    that of a field, in whatever case, is replaced by the field; other names
    do not clash.
    """
    carried, kept = plain_names(df, keep, fields)
    schema = T.StructType(kept + list(fields))
    out = to_arrow_schema(schema)
    beside = [c.alias(f"extra_{i}") for i, c in enumerate(extra)]
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("text"), *beside, *carried)
    n_extra = len(beside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for a, b in slices(texts, max_bytes):
                cols = fn(texts.slice(a, b - a), *[c.slice(a, b - a) for c in batch.columns[1 : 1 + n_extra]])
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=out.field(len(kept) + i).type) for i, x in enumerate(cols)]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[1 + n_extra :]] + made, schema=out)

    return rows.mapInArrow(run, schema)
