"""Mixing sources to target weights, with DataFrame functions only.

Weights belong to the nodes of a tree domain - language - source.  A token
budget goes down the tree: among siblings it is shared by weight, but no node
gets more than the tokens below it times ``max_epochs``; what a node cannot
take goes to its siblings, by weight, and reaches the parent's siblings only
when all of them are full.  A leaf then takes whole epochs of its documents
and of the last epoch the prefix, in a seeded order, that fits its tokens.

The prefix is found as a cut in the order, not by sorting a leaf: sums over
ranges of hashes, then over the ranges of the one where the budget ends, then
over the documents of the last.  Each of these holds a bounded number of rows
to order, however many documents a leaf has.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from nearspark.llm.shared import cut, plain_names

LEVELS = ("domain", "lang", "source")
SEED = "mix"
MAX_EPOCHS = 3
#: Leaves whose table is broadcast at most (a row is under 200 bytes).
BROADCAST_LEAVES = 50_000
#: Documents of a range of hashes, and ranges of a larger range, about.
RANGE, FAN = 512, 1024
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text_col: str = "text") -> Column:
    """Blank-separated words."""
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: int, weights: Mapping[tuple[str, ...], float], default: float) -> Column:
    value = F.lit(None).cast("double")
    for path, weight in weights.items():
        if len(path) == level + 1:
            if weight < 0:
                raise ValueError(f"weight of {path} is negative")
            here = F.lit(True)
            for name, part in zip(LEVELS, path, strict=False):
                here = here & (F.lit(True) if part == "*" else F.col(name) == part)
            value = F.coalesce(value, F.when(here, F.lit(float(weight))))
    return F.coalesce(value, F.lit(float(default)))


def allot(leaves: DataFrame, budget: int | float, weights: Mapping[tuple[str, ...], float], max_epochs: int = MAX_EPOCHS, default: float = 1.0) -> DataFrame:
    """``leaves`` (domain, lang, source, available) with allotted: each one's tokens.

    ``weights`` maps a path from the top, such as ``("web", "en")``, to its
    weight among its siblings; ``"*"`` stands for any name, earlier entries go
    first, and what no entry names has the weight ``default``.
    """
    tree = leaves.withColumn("capacity", (F.col("available") * max_epochs).cast("double"))
    got = None
    for level in range(len(LEVELS)):
        path, parent = list(LEVELS[: level + 1]), list(LEVELS[:level])
        siblings = Window.partitionBy(*parent)
        nodes = tree.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available")).withColumn("weight", _weight(level, weights, default))
        if got is None:
            wanted = F.lit(float(budget)) if isinstance(budget, int) else F.floor(F.sum("available").over(siblings) * F.lit(budget)).cast("double")
            nodes = nodes.withColumn("given", F.least(wanted, F.sum("capacity").over(siblings)))
        else:
            nodes = nodes.join(got, parent)
        order = siblings.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))), LEVELS[level])
        before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", (F.col("weight") > 0) & (F.col("capacity") * rest <= F.col("weight") * (F.col("given") - before)))
        taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(siblings)
        open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(siblings)
        share = F.when(F.col("full"), F.col("capacity")).when(open_weight > 0, F.col("weight") * (F.col("given") - taken) / open_weight).otherwise(0.0)
        got = nodes.withColumn("share", share).select(*path, F.col("share").alias("given"))
    return tree.join(got, list(LEVELS)).withColumn("allotted", F.floor("given").cast("long")).drop("capacity", "given")


def _order_key(epoch: Column, doc: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))


def _cut_in(rows: DataFrame, group: list[str], part: str) -> DataFrame:
    """Of (group, part, tokens, room) the part in which the room ends, with the room left for it."""
    order = Window.partitionBy(*group).orderBy(part)
    sums = rows.withColumn("until", F.sum("tokens").over(order)).withColumn("before", F.col("until") - F.col("tokens"))
    return sums.where((F.col("before") <= F.col("room")) & (F.col("until") > F.col("room"))).select(*group, part, (F.col("room") - F.col("before")).alias("room"))


def mix(
    documents: DataFrame,
    budget: int | float,
    weights: Mapping[tuple[str, ...], float] | None = None,
    domain: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    tokens: Column | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (default: all) with domain, n_tokens and epoch, a row for each copy taken.

    ``budget`` is a number of tokens, or as a float a share of all tokens.
    Null names count as the name ``(null)``.  Documents without tokens are
    never taken.  Rows of equal id and leaf are taken together or not at all;
    ties in the order are decided by the id.  An empty table gives an empty
    one.  Columns named like the results, in whatever case, are replaced.
    Texts are counted whole, however long.  No leaf gets more
    than its share; the documents that would exceed it are left out, so the
    sum falls short of the budget by less than one document for each leaf.
    """
    made = [T.StructField(c, T.StringType()) for c in ("domain", "n_tokens", "epoch")]
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(null)"))
    carried, kept = plain_names(documents, keep, made)
    marked = documents.select(
        *carried,
        F.col(f"`{id_col}`").alias("id"),
        name(domain if domain is not None else F.lit("all")).alias("domain"),
        name(F.col(f"`{lang_col}`")).alias("lang"),
        name(F.col(f"`{source_col}`")).alias("source"),
        (tokens if tokens is not None else token_count(text_col)).cast("long").alias("tokens"),
    ).where("tokens > 0")
    narrow = cut(marked.select("id", *LEVELS, "tokens"))

    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    shares = allot(leaves, budget, weights or {}, max_epochs)
    shares = shares.select(*LEVELS, "available", "documents", F.expr("allotted div available").alias("whole"), F.expr("allotted % available").alias("room"))
    shares = cut(shares)
    # one result either way: a hint where the size is known to be bounded, else Spark's own choice
    few = shares.count() <= BROADCAST_LEAVES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    key = _order_key(F.col("whole"), F.col("id"), seed)
    ranged = narrow.join(small(shares.where("room > 0")), list(LEVELS)).withColumn("key", key)
    count = F.greatest(F.lit(1), F.ceil(F.col("documents") / RANGE))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = ranged.withColumn("part", F.shiftright(place * count, 32)).withColumn("large", F.floor(F.col("part") / FAN))
    leaf = list(LEVELS)
    larges = ranged.groupBy(*leaf, "large", "room").agg(F.sum("tokens").alias("tokens"))
    ends = _cut_in(larges, leaf, "large")
    parts = ranged.drop("room").join(small(ends), [*leaf, "large"]).groupBy(*leaf, "part", "room").agg(F.sum("tokens").alias("tokens"))
    ends = _cut_in(parts, leaf, "part")
    last = ranged.drop("room").join(small(ends), [*leaf, "part"]).groupBy(*leaf, "key", "id", "room").agg(F.sum("tokens").alias("tokens"))
    order = F.struct("key", "id").alias("at")
    ends = _cut_in(last.select(*leaf, order, "room", "tokens"), leaf, "at").select(*leaf, F.col("at").alias("stop"))
    # room that ends in no document: all documents fit, which only a room of all tokens would be
    cuts = cut(shares.join(ends, leaf, "left").select(*leaf, "whole", "stop"))

    taken = marked.join(small(cuts), leaf)
    within = F.col("stop").isNotNull() & (F.struct(_order_key(F.col("whole"), F.col("id"), seed).alias("key"), F.col("id").alias("id")) < F.col("stop"))
    copies = F.col("whole") + F.when(within, 1).otherwise(0)
    taken = taken.withColumn("copies", copies.cast("int")).where("copies > 0")
    return taken.select(*[F.col(f"keep_{i}").alias(f.name) for i, f in enumerate(kept)], "domain", F.col("tokens").alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
