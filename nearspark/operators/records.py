"""What is done with matches: records with or without one, counts, orders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from nearspark.kernel.engine import Engine
from nearspark.operators.search import MATCH_ORDER, Patterns, _input, pattern_blocks
from nearspark.plans.options import SearchOptions
from nearspark.plans.seeds import seed_filter


def filter_records(texts: DataFrame, patterns: Patterns, options: SearchOptions, invert: bool = False, text_col: str = "text") -> DataFrame:
    """Rows whose text holds a match of any pattern, each once; ``invert``: the others.

    One pass without a join.  Null and empty texts hold no match.
    """
    blocks = list(pattern_blocks(patterns))
    wanted = options if options.max_n_frac is not None and options.max_n_frac < 1 else options.with_(trace=False)
    rows, flag = texts, "__matched__"
    if not invert and len(blocks) == 1:
        seeds = seed_filter(F.col(f"`{text_col}`"), [p for _, p in blocks[0][1]], options)
        rows = rows if seeds is None else rows.where(seeds)
    marked = rows.withColumn(flag, F.lit(False))
    for first, block in blocks:
        schema = T.StructType([*marked.schema])
        marked = _input(marked, text_col, marked.columns).mapInArrow(_marking(texts.sparkSession.sparkContext.broadcast((first, block)), wanted), schema)
    return marked.where(~F.col(flag) if invert else F.col(flag)).drop(flag)


def _marking(block, options: SearchOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine([p for _, p in block.value[1]], options)
        for batch in batches:
            hit = np.array(batch.columns[-1].to_pylist(), bool)
            for found in engine.search(batch.column(0)):
                hit[found["row"]] = True
            yield pa.RecordBatch.from_arrays([*batch.columns[1:-1], pa.array(hit, pa.bool_())], names=batch.schema.names[1:])

    return run


def semi_join(texts: DataFrame, matches: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Texts that have a row among matches found before."""
    return texts.join(matches, key, "left_semi")


def anti_join(texts: DataFrame, matches: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Texts that have none."""
    return texts.join(matches, key, "left_anti")


def histogram(matches: DataFrame, k: int) -> DataFrame:
    """(cost, matches) for each cost from 0 to ``k``, those without matches too."""
    counts = matches.groupBy("cost").agg(F.count("*").alias("matches"))
    every = matches.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("cost"))
    return every.join(counts, "cost", "left").select("cost", F.coalesce("matches", F.lit(0)).alias("matches"))


def summary(matches: DataFrame, key: str) -> DataFrame:
    """One row: matches, texts with one, distinct ends."""
    return matches.agg(
        F.count("*").alias("matches"),
        F.count_distinct(key).alias("texts"),
        F.count_distinct(key, "pattern_idx", "strand", F.coalesce("text_end", "text_start")).alias("ends"),
    )


def best(matches: DataFrame, *by: str) -> DataFrame:
    """Of matches of each ``by`` (and pattern and strand) the cheapest, then the last."""
    order = Window.partitionBy(*by, "pattern_idx", "strand").orderBy("cost", F.desc("text_end"), "text_start", "cigar")
    return matches.withColumn("__n__", F.row_number().over(order)).where("__n__ = 1").drop("__n__")


def grouped(alignments: DataFrame, *by: str) -> DataFrame:
    """Alignments gathered by ``by``, pattern, strand and anchor, in the order of their cost and CIGAR."""
    item = F.struct("cost", "text_start", "text_end", "cigar")
    return alignments.groupBy(*by, "pattern_idx", "strand", "anchor").agg(F.sort_array(F.collect_list(item)).alias("alignments"))


def ordered(matches: DataFrame, *by: str) -> DataFrame:
    """By ``by``, then the order of matches."""
    return matches.orderBy(*by, *MATCH_ORDER)


def with_patterns(matches: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches with the columns of their pattern, found by pattern_idx."""
    return matches.join(patterns, "pattern_idx")


def pattern_summary(patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """One row: n_queries, how many patterns there are, and max_pattern_length, the bytes of the longest; 0 without any."""
    return patterns.agg(F.count(pattern_col).alias("n_queries"), F.coalesce(F.max(F.octet_length(pattern_col)), F.lit(0)).alias("max_pattern_length"))


def all_vs_all(sequences: DataFrame, options: SearchOptions, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """(id, other_id, matches): how often each sequence occurs in each other one."""
    patterns = sequences.select(F.col(id_col).cast("string").alias("pattern_id"), F.col(seq_col).alias("pattern")).where(F.length("pattern") > 0)
    from nearspark.operators.search import search

    found = search(sequences.select(F.col(id_col).cast("string").alias("id"), F.col(seq_col).alias("seq")), patterns, options.with_(trace=False, rc_mode="pattern"), text_col="seq", keep=["id"])
    return found.where(F.col("id") != F.col("pattern_id")).groupBy("pattern_id", "id").agg(F.count("*").alias("matches")).select(F.col("pattern_id").alias("id"), F.col("id").alias("other_id"), "matches")


def rightmost_minima(costs: DataFrame, k: int, by: Sequence[str], end: str = "end", cost: str = "cost") -> DataFrame:
    """Of a table of costs of ends the rows that end a local minimum within ``k``."""
    order = Window.partitionBy(*by).orderBy(end)
    step = F.signum(F.col(cost) - F.lag(cost).over(order))
    marked = costs.withColumn("__step__", F.when(step == 0, None).otherwise(step)).withColumn("__next__", F.lead(cost).over(order))
    way = F.coalesce(F.last("__step__", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1.0))
    chosen = marked.withColumn("__way__", way).where((F.col(cost) <= k) & (F.col("__way__") < 0) & (F.col("__next__").isNull() | (F.col("__next__") > F.col(cost))))
    return chosen.drop("__step__", "__next__", "__way__")


def islands(costs: DataFrame, k: int, by: Sequence[str], end: str = "end", cost: str = "cost") -> DataFrame:
    """(by, first_end, last_end, cost): maximal runs of consecutive ends within ``k``."""
    order = Window.partitionBy(*by).orderBy(end)
    inside = costs.where(F.col(cost) <= k).withColumn("__run__", F.col(end) - F.row_number().over(order))
    return inside.groupBy(*by, "__run__").agg(F.min(end).alias("first_end"), F.max(end).alias("last_end"), F.min(cost).alias("cost")).drop("__run__")


def running_cost(deltas: DataFrame, by: Sequence[str], end: str = "end", delta: str = "delta", start: int = 0) -> DataFrame:
    """Costs from their differences, and the least cost so far."""
    order = Window.partitionBy(*by).orderBy(end).rowsBetween(Window.unboundedPreceding, 0)
    total: Column = F.sum(delta).over(order) + F.lit(start)
    return deltas.withColumn("cost", total).withColumn("least", F.min("cost").over(order))
