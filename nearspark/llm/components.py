"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from nearspark.llm.shared import cut, work_dir

#: Edges of a partition, about.
EDGES = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the least node of its component.

    Rounds of contraction.  Each partition replaces its edges by links of every
    node to the least node that its edges connect it with; then every node
    points to the least among itself and its neighbours in all partitions,
    links are carried over to the nodes pointed to, loops and repeats go, until
    no link is left.  The pointers of all rounds are followed.  Where the order
    of nodes is random, as that of hashes, a round leaves a constant share of
    the nodes at most, so the number of rounds grows with the logarithm of the
    largest component's size.  A node's least neighbour is found before the
    shuffle too, and links meet pointers in equi-joins whose skewed partitions
    Spark splits, so a node with very many neighbours is no single task.

    Each round is written to the shared folder as a table, so that the next is
    planned by its true size; the tables are emptied at the end.  Loops,
    repeated and reversed edges and edges with a null end are allowed and add
    nothing; without edges the result is empty.
    """
    spark = edges.sparkSession
    folder, schema = work_dir(spark, "components"), edges.select("u", "v").schema
    written = []

    def table(df: DataFrame, parts: int) -> DataFrame:
        path = f"{folder}/{len(written)}"
        df.coalesce(parts).write.parquet(path)
        written.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def contracted(df: DataFrame, parts: int) -> DataFrame:
        simple = df.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        return table(simple.coalesce(parts).mapInArrow(_forest, schema), parts)

    now = cut(edges.select("u", "v"))
    count = now.count()
    now, roots = contracted(now, -(-count // EDGES) or 1), None
    while count := now.count():
        parts = -(-count // EDGES)
        least = now.union(now.select("v", "u")).groupBy("u").agg(F.min("v").alias("v"))
        to = table(least.select("u", F.least("u", "v").alias("to")), parts)
        roots = to.toDF("node", "root") if roots is None else _followed(roots, to)
        now = now.join(to, "u").select(F.col("to").alias("a"), F.col("v").alias("u")).join(to, "u").select(F.col("a").alias("u"), F.col("to").alias("v"))
        now = contracted(now, parts)
    found = cut(now.toDF("node", "root") if roots is None else roots)
    for path in written:
        spark.range(0).write.mode("overwrite").parquet(path)
    return found


def _followed(roots: DataFrame, to: DataFrame) -> DataFrame:
    """Roots replaced by what they point to; those that point nowhere stay."""
    return roots.join(to, roots["root"] == to["u"], "left").select("node", F.coalesce("to", "root").alias("root"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges (u, v) to links of each node with the least one of its component."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    found = pa.Table.from_batches(parts)
    n = found.num_rows
    ends = pa.chunked_array([*found.column(0).chunks, *found.column(1).chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    names = ends.dictionary.take(order)
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    ends = rank[ends.indices.to_numpy()]
    label = labels(len(names), ends[:n], ends[n:])
    others = np.flatnonzero(label != np.arange(len(label)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(others)), names.take(pa.array(label[others]))], names=["u", "v"])


def labels(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of the nodes 0 to n - 1 the least node that edges (one, two) connect each with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, label[one], low)
        np.minimum.at(new, label[two], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def bipartite_classes(link: np.ndarray) -> np.ndarray:
    """Component of each row and then of each column of a bipartite graph.

    It is the number of a row; what has no link gets the number of rows.
    """
    rows = len(link)
    label = np.where(link.any(axis=1), np.arange(rows), rows)
    while True:
        other = np.where(link, label[:, None], rows).min(axis=0, initial=rows)
        new = np.minimum(label, np.where(link, other[None, :], rows).min(axis=1, initial=rows))
        if (new == label).all():
            return np.concatenate([label, other])
        label = new
