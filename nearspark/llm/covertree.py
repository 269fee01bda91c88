"""Near-duplicate vectors by cover trees and dual traversal.

Vectors are scaled to unit length, where cosine >= c means a distance of at
most sqrt(2 - 2c).  A cover tree has nested levels of centres with radii that
halve from level to level: a level's centres are those of the level above and,
of the points that lie further than its radius from all of them, as many as
cover the rest.  Two trees are descended together.  A pair of nodes is dropped
when the distance of its centres exceeds the threshold by more than both
covering radii, or taken whole when even the furthest pair lies within it;
distances are computed only for children of pairs that stay open, at last for
points.

At the top stands one shallow tree for each label, from a bounded sample: its
nodes are cells, every vector goes to the nearest one, and pairs of cells are
dropped by the same bound before any of their vectors meet.  Large cells are
split into blocks.  The tree of each block is built once and kept as a row; a
task descends two of them.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from nearspark.llm.components import connected_components, labels
from nearspark.llm.shared import cut

COSINE = 0.93
#: Vectors of a block, about; a task holds the trees of two blocks.
BLOCK = 2048
#: Vectors from which the cells of all labels are made, at most.
SAMPLE = 4096
#: Pairs of nodes whose distances are computed at once.
PAIRS = 1 << 17
_SLACK = 1e-7


@dataclass
class CoverTree:
    """Points in the order of the tree, so that a node's points and its children are ranges.

    Level ``i`` has centres (as points), ``radii[i]`` that cover the points, and
    ``bounds[i][k]`` to ``bounds[i][k + 1]``, the points of node ``k``;
    ``children[i]`` bounds its nodes on the level below, the last of which is
    the points themselves.
    """

    points: np.ndarray
    order: np.ndarray  # the number of each point in the array that the tree was built from
    centres: list[np.ndarray]
    radii: list[np.ndarray]
    bounds: list[np.ndarray]
    children: list[np.ndarray]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _cover(points: np.ndarray, centres: np.ndarray, radius: float, chunk: int = 256) -> np.ndarray:
    """``centres`` and as many other points as it takes that each lies within ``radius`` of one."""
    mask = np.ones(len(points), bool)
    mask[centres] = False
    rest, chosen = np.flatnonzero(mask), list(centres)
    for at in range(0, len(rest), chunk):
        here = rest[at : at + chunk]
        free = here[~(_distances(points[here], points[chosen]) <= radius).any(axis=1)] if chosen else here
        near = _distances(points[free], points[free]) <= radius
        open_ = np.ones(len(free), bool)
        for k in range(len(free)):
            if open_[k]:
                chosen.append(free[k])
                open_ &= ~near[k]
    return np.array(chosen, np.int64)


def build(points: np.ndarray, least_radius: float) -> CoverTree:
    """Levels of radius 2, 1, 1/2 ... until one is at most ``least_radius`` or every point is a centre."""
    n = len(points)
    radius, levels = 2.0, [_cover(points, np.zeros(1, np.int64), 2.0)]
    while radius > least_radius and len(levels[-1]) < n:
        radius /= 2
        levels.append(_cover(points, levels[-1], radius))
    # of each level the node of every centre of the level below, and at last of every point
    below = [*levels[1:], np.arange(n)]
    up = []
    for level, lower in zip(levels, below, strict=True):
        parent = np.concatenate([_distances(points[lower[at : at + 1024]], points[level]).argmin(axis=1) for at in range(0, len(lower), 1024)])
        at = np.full(n, -1)
        at[level] = np.arange(len(level))
        parent[at[lower] >= 0] = at[lower][at[lower] >= 0]  # a centre stays its own
        up.append(parent)
    nodes = [up[-1]]
    for parent in reversed(up[:-1]):
        nodes.insert(0, parent[nodes[0]])
    order = np.lexsort(nodes[::-1])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    tree = CoverTree(points[order], order, [], [], [], [])
    starts = []
    for level, node in zip(levels, nodes, strict=True):
        node = node[order]
        lead = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        which = node[lead]
        bounds = np.append(lead, n)
        far = np.linalg.norm(tree.points - points[level[node]], axis=1)
        tree.centres.append(place[level[which]])
        tree.radii.append(np.maximum.reduceat(far, lead))
        tree.bounds.append(bounds)
        starts.append(lead)
    for bounds, lower in zip(tree.bounds, [*starts[1:], np.arange(n)], strict=True):
        tree.children.append(np.searchsorted(lower, bounds))
    return tree


@dataclass
class Links:
    """What a traversal found, by the places of points in the two trees."""

    one: np.ndarray  # linked points, pair by pair
    two: np.ndarray
    wholes: list  # (first, end, first, end): ranges of points of which each is linked to each
    distances: int  # that were computed


def _expand(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs from the ranges a x b of each row: one large product at a time, or many small ones."""
    size = (high_a - low_a) * (high_b - low_b)
    for k in np.flatnonzero(size >= 1 << 12).tolist():
        step = max(1, PAIRS // int(high_b[k] - low_b[k]))
        for at in range(low_a[k], high_a[k], step):
            yield np.arange(at, min(at + step, high_a[k])), np.arange(low_b[k], high_b[k]), True
    small = np.flatnonzero(size < 1 << 12)
    ends = np.cumsum(size[small])
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        rows = small[np.searchsorted(ends, first, "right") : np.searchsorted(ends, first + PAIRS, "right")]
        if not len(rows):
            continue
        width = (high_b - low_b)[rows]
        inner = np.arange(size[rows].sum()) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
        width = np.repeat(width, size[rows])
        yield np.repeat(low_a[rows], size[rows]) + inner // width, np.repeat(low_b[rows], size[rows]) + inner % width, False


def linked(one: CoverTree, two: CoverTree, cosine: float) -> Links:
    """Pairs of points with a cosine of at least ``cosine``; within one tree, each pair once and none of a point with itself."""
    same = one is two
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))
    found_one, found_two, wholes, computed = [], [], [], 0
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(one.centres[0])), np.arange(len(two.centres[0])), indexing="ij"))
    if same:
        a, b = a[a <= b], b[a <= b]
    apart = np.linalg.norm(one.points[one.centres[0][a]] - two.points[two.centres[0][b]], axis=1)
    depth = max(len(one.centres), len(two.centres))
    for i in range(depth):
        p, q = min(i, len(one.centres) - 1), min(i, len(two.centres) - 1)
        spread = one.radii[p][a] + two.radii[q][b]
        open_ = apart - spread <= reach + _SLACK
        inside = open_ & (apart + spread <= reach - _SLACK)
        wholes += np.stack([one.bounds[p][a[inside]], one.bounds[p][a[inside] + 1], two.bounds[q][b[inside]], two.bounds[q][b[inside] + 1]], axis=1).tolist()
        a, b, apart = a[open_ & ~inside], b[open_ & ~inside], apart[open_ & ~inside]
        last = i == depth - 1
        # a tree that has no further level waits, unless both have none: then the points follow
        down_a, down_b = last or p == i and i < len(one.centres) - 1, last or q == i and i < len(two.centres) - 1
        range_a = (one.children[p][a], one.children[p][a + 1]) if down_a else (a, a + 1)
        range_b = (two.children[q][b], two.children[q][b + 1]) if down_b else (b, b + 1)
        next_a = np.arange(len(one.points)) if last else one.centres[min(i + 1, len(one.centres) - 1)]
        next_b = np.arange(len(two.points)) if last else two.centres[min(i + 1, len(two.centres) - 1)]
        kept: list[tuple] = []
        for x, y, product in _expand(*range_a, *range_b):
            if product:
                dots = (one.points[next_a[x]] @ two.points[next_b[y]].T).ravel()
                x, y = np.repeat(x, len(y)), np.tile(y, len(x))
            else:
                if same:
                    chosen = x <= y
                    x, y = x[chosen], y[chosen]
                dots = np.einsum("ij,ij->i", one.points[next_a[x]], two.points[next_b[y]])
            computed += len(x)
            if last:
                good = dots >= cosine
                if same:
                    good &= x < y
                found_one.append(x[good])
                found_two.append(y[good])
            else:
                distance = np.sqrt(np.maximum(2 - 2 * dots, 0))
                good = distance - one.radii[min(i + 1, len(one.radii) - 1)][x] - two.radii[min(i + 1, len(two.radii) - 1)][y] <= reach + _SLACK
                if same:
                    good &= x <= y
                kept.append((x[good], y[good], distance[good]))
        if not last:
            a, b, apart = (np.concatenate(c) if kept else np.zeros(0, np.int64) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 3
    empty = np.zeros(0, np.int64)
    return Links(np.concatenate(found_one) if found_one else empty, np.concatenate(found_two) if found_two else empty, wholes, computed)


def summed(one: CoverTree, two: CoverTree, links: Links, n_one: np.ndarray, n_two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the points of both trees (one tree: of its points) the links, weighted by n, and an own one of each class."""
    same = one is two
    size = len(one.points) if same else len(one.points) + len(two.points)
    shift = 0 if same else len(one.points)
    total = np.zeros(size, np.int64)
    np.add.at(total, links.one, n_two[links.two])
    np.add.at(total, links.two + shift, n_one[links.one])
    edges = [(links.one, links.two + shift)]
    sums_one, sums_two = np.append(0, np.cumsum(n_one)), np.append(0, np.cumsum(n_two))
    for a, b, c, d in links.wholes:
        if same and a == c:
            total[a:b] += sums_one[b] - sums_one[a] - n_one[a:b]
        else:
            total[a:b] += sums_two[d] - sums_two[c]
            total[c + shift : d + shift] += sums_one[b] - sums_one[a]
        edges += [(np.arange(a, b), np.full(b - a, c + shift)), (np.full(d - c, a), np.arange(c, d) + shift)]
    label = labels(size, *(np.concatenate(e) for e in zip(*edges, strict=True)))
    return total, label, np.flatnonzero((label != np.arange(size)) | (total > 0))


def _spread(points: np.ndarray, wanted: int) -> np.ndarray:
    """Farthest-first: as many points that lie far apart."""
    near, order = np.linalg.norm(points - points[0], axis=1), [0]
    while len(order) < wanted:
        order.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(points - points[order[-1]], axis=1))
    return points[order]


def _rows(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), T.StructField("key", T.BinaryType()), T.StructField("place", T.StringType()), T.StructField("unit", T.BinaryType())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector, label) to unit vectors in double precision; unusable ones get no key."""
    for batch in batches:
        rows: list[list] = [[], [], []]
        for vector, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            key = place = unit = None
            if label is not None and vector.is_valid and not vector.values.null_count and len(vector.values):
                raw = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(raw).max()
                if np.isfinite(raw).all() and top > 0:
                    raw = raw / top
                    unit = (raw / np.sqrt(raw @ raw)).tobytes()
                    place = f"{len(raw)}:{label}"
                    key = hashlib.md5(place.encode() + b"\x00" + unit).digest()
            for column, value in zip(rows, (key, place, unit), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.binary())], names=["id", "key", "place", "unit"])


def _cells(sample: list[tuple[str, bytes]], sizes: dict[str, int], block: int) -> dict[str, np.ndarray]:
    """Centres of the cells of each place: about one for each ``block`` of its vectors."""
    by_place: dict[str, list[bytes]] = {}
    for place, unit in sample:
        by_place.setdefault(place, []).append(unit)
    cells = {}
    for place, units in by_place.items():
        points = np.stack([np.frombuffer(u, np.float64) for u in units])
        cells[place] = _spread(points, min(len(points), -(-sizes.get(place, 0) // block) or 1))
    return cells


def _route(cells):
    """Vectors with their cell and their distance from its centre."""
    fields = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("place", T.StringType()), T.StructField("unit", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("off", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.array(batch.column(1).to_pylist(), object)
            units = batch.column(2).to_pylist()
            cell, off = np.zeros(len(places), np.int32), np.full(len(places), 2.0)
            for place in set(places.tolist()):
                centres = cells.value.get(place)
                if centres is None:
                    continue
                rows = np.flatnonzero(places == place)
                points = np.stack([np.frombuffer(units[r], np.float64) for r in rows])
                cell[rows] = _distances(points, centres).argmin(axis=1)
                off[rows] = np.linalg.norm(points - centres[cell[rows]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(off)], names=fields.names)

    return run, fields


def _meeting(cells, cosine: float):
    """Pairs of cells (place, one, two, radius_one, radius_two) to those whose vectors may be linked."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, one, two = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            spread = batch.column(3).to_numpy() + batch.column(4).to_numpy()
            good = one == two
            for place in set(places.tolist()) & cells.value.keys():
                rows = np.flatnonzero(places == place)
                centres = cells.value[place]
                good[rows] |= np.linalg.norm(centres[one[rows]] - centres[two[rows]], axis=1) - spread[rows] <= reach + _SLACK
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:3]], names=["place", "one", "two"])

    return run


_TREE = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("tree", T.BinaryType())])


def _built(cosine: float):
    """The vectors of a block to one row: their tree, keys and numbers in its order."""
    least = np.sqrt(max(0.0, 2 - 2 * cosine)) / 8

    def run(table: pa.Table) -> pa.Table:
        tree = build(np.stack([np.frombuffer(u, np.float64) for u in table.column("unit").to_pylist()]), least)
        keys = np.array(table.column("key").to_pylist(), object)[tree.order]
        n = table.column("n").to_numpy()[tree.order]
        return pa.Table.from_arrays([table.column("block_id")[:1], pa.array([pickle.dumps((tree, keys.tolist(), n))], pa.binary())], names=_TREE.names)

    return run


_FOUND = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("other", T.BinaryType())])


def _compare(cosine: float):
    """The trees of one or two blocks to the links of each vector, and to one of its class."""

    def run(table: pa.Table) -> pa.Table:
        trees = [pickle.loads(blob) for blob in table.column("tree").to_pylist()]
        (one, keys_one, n_one), (two, keys_two, n_two) = trees[0], trees[-1]
        total, label, chosen = summed(one, two, linked(one, two, cosine), n_one, n_two)
        keys = keys_one if one is two else keys_one + keys_two
        return pa.Table.from_arrays([pa.array([keys[i] for i in chosen], pa.binary()), pa.array(total[chosen]), pa.array([keys[i] for i in label[chosen]], pa.binary())], names=_FOUND.names)

    return run


def find_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row.

    Rows are linked if their labels are equal and not null, their vectors have
    the same dimension, and the cosine in double precision is at least
    ``cosine``.  Null, empty and zero vectors and those with null or non-finite
    components are linked with nothing.  n_links counts other rows, repeated
    ones too; component_id is the least id reachable, kept tells whether it is
    the row's own.  Ids may be of any type that has an order, and stay of it.
    Null ids are reachable, but never the least unless all are null.  An empty
    table gives an empty one; other columns are not read, whatever their names.
    ``cosine`` must be above 0.

    The cells are made from ``sample`` vectors at most, the first by a hash of
    the vector; every vector is compared.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.col(f"`{label_col}`").cast("string").alias("label"))
    made = cut(source.mapInArrow(_units, _rows(source.schema["id"].dataType)))
    distinct = cut(made.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("least_id"), F.first("place").alias("place"), F.first("unit").alias("unit"), F.count("*").alias("n")))

    chosen = distinct.select("place", "unit", F.xxhash64("key").alias("h")).orderBy("h").limit(sample).select("place", "unit").collect()
    some = spark.createDataFrame([(p,) for p in sorted({r[0] for r in chosen})], "place string")
    sizes = {r[0]: r[1] for r in distinct.join(F.broadcast(some), "place").groupBy("place").count().collect()}
    cells = spark.sparkContext.broadcast(_cells([tuple(r) for r in chosen], sizes, block))
    run, fields = _route(cells)
    routed = cut(distinct.select("key", "place", "unit", "n").mapInArrow(run, fields))

    sized = cut(routed.groupBy("place", "cell").agg(F.count("*").alias("size"), F.max("off").alias("radius")).withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int")))
    one = sized.select("place", F.col("cell").alias("one"), F.col("radius").alias("radius_one"), F.col("blocks").alias("n_one"))
    two = sized.select("place", F.col("cell").alias("two"), F.col("radius").alias("radius_two"), F.col("blocks").alias("n_two"))
    met = one.join(two, "place").where("one <= two").select("place", "one", "two", "radius_one", "radius_two")
    met = met.mapInArrow(_meeting(cells, cosine), "place string, one int, two int")
    number = lambda cell, part: F.xxhash64("place", cell, part)
    tasks = met.join(one.drop("radius_one"), ["place", "one"]).join(two.drop("radius_two"), ["place", "two"])
    tasks = tasks.select("place", "one", "two", F.explode(F.sequence(F.lit(0), F.col("n_one") - 1)).alias("part_one"), "n_two")
    tasks = tasks.select("place", "one", "two", "part_one", F.explode(F.sequence(F.when(F.col("one") == F.col("two"), F.col("part_one")).otherwise(0), F.col("n_two") - 1)).alias("part_two"))
    tasks = tasks.select(F.xxhash64("place", "one", "two", "part_one", "part_two").alias("task"), F.array_distinct(F.array(number("one", "part_one"), number("two", "part_two"))).alias("blocks"))

    placed = routed.join(sized.select("place", "cell", "blocks"), ["place", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    trees = cut(placed.select(number("cell", "part").alias("block_id"), "key", "unit", "n").groupBy("block_id").applyInArrow(_built(cosine), _TREE))
    dealt = trees.join(tasks.select("task", F.explode("blocks").alias("block_id")), "block_id").select("task", "tree")
    found = cut(dealt.groupBy("task").applyInArrow(_compare(cosine), _FOUND))

    roots = connected_components(found.select(F.col("key").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = cut(distinct.select("key", "least_id", "n").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    least = cut(classes.groupBy("root").agg(F.min("least_id").alias("component_id")))
    result = classes.join(least, "root").join(links, "key", "left").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = made.select("id", "key").join(result, "key", "left")
    component = F.when(F.col("key").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
