"""Search over streams: every micro-batch is searched like a table.

No state is kept, so results are appended as texts arrive and do not depend on
how the stream is cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearspark.operators.search import Patterns, search
from nearspark.plans.options import SearchOptions


def search_stream(texts: DataFrame, patterns: Patterns, options: SearchOptions, **more) -> DataFrame:
    """Matches of a streaming DataFrame of texts, as a streaming DataFrame."""
    if not texts.isStreaming:
        raise ValueError("the texts are not a stream")
    return search(texts, patterns, options, **more)


def start(matches: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends matches to Parquet files; each text is searched once, also after a restart."""
    return matches.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
