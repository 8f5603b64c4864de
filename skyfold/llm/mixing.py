"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the last level of a tree (domain, language, source). Weights are propagated from the root; a node's budget is filled among
its children in proportion to their weights, and what a child can't fill (its tokens times ``max_epochs``) goes to its siblings first. Only what all
children together lack goes up to the parent's siblings. Each leaf then reads its documents in seeded epochs, a new order each, up to
its budget: whole epochs, and the prefix of one more.

Which documents lie in a prefix is a cutoff of their seeded hash, found from token counts alone. Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import cut

#: Runs of a leaf's hash order whose token sums are added up first; the last run alone is sorted.
RUN_BITS = 12
#: Leaves that are sent to all tasks (at about 100 bytes each); more are joined through a shuffle.
SENT_LEAVES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int, epoch: int | Column) -> Column:
    """A document's place in an epoch, from 0 up."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch if isinstance(epoch, Column) else F.lit(epoch), F.col("__id"), F.col("__crc")), 1)


def _keys(docs: DataFrame, levels: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"__l{i}") for i, c in enumerate(levels)]


def _rates(nodes: DataFrame, group: list[str]) -> DataFrame:
    """``group`` and __rate, the tokens for each unit of weight at which the group's shares, none above its room, add up to its budget; infinite where all rooms together are no more.

    ``nodes``: group, __b (budget, one for each group), __w (weight) and __c (room). A group's nodes are never sorted in one task: sums by steps of room over weight show the step in which the rate lies,
    sums by the different values in that step the rate itself.
    """
    ratio = F.col("__c") / F.col("__w")
    step = F.when(ratio > 0, F.floor(F.log2(ratio) * 16)).otherwise(F.lit(-(1 << 30))).cast("long")
    live = nodes.filter("__w > 0").select(*group, "__b", "__w", "__c", ratio.alias("__t"), step.alias("__k"))
    sums = live.groupBy(*group, "__k").agg(F.sum("__c").alias("c"), F.sum("__w").alias("w"), F.min("__t").alias("t"), F.max("__b").alias("b"))
    order = Window.partitionBy(*group).orderBy("__k")
    sums = sums.withColumn("used", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("later", F.coalesce(F.sum("w").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    # the last step whose least ratio the rate reaches, with all below it full
    reached = F.when(F.col("used") + F.col("t") * (F.col("w") + F.col("later")) <= F.col("b"), F.struct("__k", "used", "later"))
    edge = sums.groupBy(*group).agg(F.max(reached).alias("e"), F.sum("w").alias("all"), F.max("b").alias("b"))
    at = edge.filter("e IS NOT NULL").select(*group, F.col("e.__k").alias("__k"), F.col("e.used").alias("used"), F.col("e.later").alias("later"))
    each = live.join(at, [*group, "__k"]).groupBy(*group, "__t").agg(F.sum("__c").alias("c"), F.sum("__w").alias("w"), F.max("__b").alias("b"), F.max("used").alias("used"), F.max("later").alias("later"))
    order = Window.partitionBy(*group).orderBy("__t")
    each = each.withColumn("before", F.col("used") + F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)) + F.col("later"))
    full = F.col("__t") * F.col("open") <= F.col("b") - F.col("before")
    inside = each.groupBy(*group).agg(F.max("used").alias("used"), F.sum(F.when(full, F.col("c")).otherwise(0.0)).alias("c"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w"), F.max("later").alias("later"))
    inside = inside.select(*group, (F.col("used") + F.col("c")).alias("inner"), (F.col("w") + F.col("later")).alias("open"))
    rate = F.when(F.col("open").isNull(), F.col("b") / F.col("all")).when(F.col("open") > 0, (F.col("b") - F.col("inner")) / F.col("open")).otherwise(F.lit(float("inf")))
    return edge.select(*group, "b", "all").join(inside, group, "left").select(*group, F.greatest(rate, F.lit(0.0)).alias("__rate"))


def budgets(leaves: DataFrame, n_levels: int, weights: Mapping[tuple[str, ...], float], total: float | None, share: float, max_epochs: int, power: float) -> DataFrame:
    """``leaves`` (__l0.., tokens) with a column budget.

    ``weights``: weight of a node among its siblings by its path from the root; a node without one weighs its tokens to the ``power``.
    """
    names = [f"__l{i}" for i in range(n_levels)]
    df = cut(leaves.withColumn("__room0", (F.col("tokens") * F.lit(max_epochs)).cast("double")).withColumn("__all", F.lit(0)))
    everything = df.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    df = df.withColumn("__budget", F.lit(float(total if total is not None else share * everything)))
    for level in range(n_levels):
        path = names[: level + 1]
        group = ["__all", *path[:-1]]
        nodes = df.groupBy("__all", *path).agg(F.sum("tokens").alias("__t"), F.sum("__room0").alias("__c"), F.max("__budget").alias("__b"))
        given = F.lit(None).cast("double")
        for key, w in weights.items():
            if len(key) == level + 1:
                same = F.lit(True)
                for name, part in zip(path, key):
                    same = same & ((F.col(name) == part) if part != "*" else F.lit(True))
                given = F.coalesce(given, F.when(same, F.lit(float(w))))
        default = F.pow(F.col("__t").cast("double"), F.lit(power))
        # nodes without a weight divide, by size, what one average given weight leaves them
        nodes = nodes.withColumn("__g", given)
        means = nodes.groupBy(*group).agg(F.avg("__g").alias("__each"), F.avg(F.when(F.col("__g").isNull(), default)).alias("__base"))
        weight = F.coalesce(F.col("__g"), F.try_divide(default, F.col("__base")) * F.coalesce(F.col("__each"), F.lit(1.0)), F.lit(0.0))
        nodes = cut(nodes.join(means, group).withColumn("__w", F.greatest(weight, F.lit(0.0))).select("__all", *path, "__b", "__w", "__c"))
        due = F.when(F.col("__w") > 0, F.least(F.col("__c"), F.col("__w") * F.col("__rate"))).otherwise(0.0)
        given_out = nodes.join(_rates(nodes, group), group, "left").select("__all", *path, F.coalesce(due, F.lit(0.0)).alias("__next"))
        df = df.join(given_out, ["__all", *path]).drop("__budget").withColumnRenamed("__next", "__budget")
    return df.withColumn("budget", F.floor(F.round("__budget", 3)).cast("long")).drop("__budget", "__room0", "__all")


def leaf_plan(docs: DataFrame, levels: tuple[str, ...], weights: Mapping[tuple[str, ...], float], total: float | None = None, share: float = 1.0, max_epochs: int = 4, power: float = 0.5, seed: int = 42) -> DataFrame:
    """For each leaf: tokens, budget, whole epochs, and the hash below which a document is in one epoch more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    meta = cut(docs.select(*_keys(docs, levels), F.col("doc_id").cast("long").alias("__id"), F.crc32(text.cast("binary")).alias("__crc"), token_count(text).alias("n")))
    names = [f"__l{i}" for i in range(len(levels))]
    leaves = cut(meta.groupBy(*names).agg(F.sum("n").alias("tokens")))
    leaves = cut(budgets(leaves, len(levels), weights, total, share, max_epochs, power).withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.try_divide("budget", "tokens"))).otherwise(0).cast("int")).withColumn("left", (F.col("budget") - F.col("whole") * F.col("tokens")).cast("long")))
    placed = _with_leaf(meta, leaves, names).withColumn("h", _hash(seed, F.col("whole"))).withColumn("run", F.shiftright("h", 63 - RUN_BITS))
    sums = placed.groupBy(*names, "run").agg(F.sum("n").alias("s"), F.max("left").alias("left"))
    upto = sums.withColumn("end", F.sum("s").over(Window.partitionBy(*names).orderBy("run")))
    # the run in which the leaf's prefix ends; a leaf without one reads the whole epoch or none of it
    edge = cut(upto.filter((F.col("end") > F.col("left")) & (F.col("end") - F.col("s") <= F.col("left"))).groupBy(*names).agg(F.min("run").alias("run"), F.min(F.struct("run", F.expr("end - s"))).getField("col2").alias("start")))
    edge_run = edge.withColumnRenamed("run", "edge_run")
    inside = placed.join(edge_run, names).filter("run = edge_run").groupBy(*names, "h").agg(F.sum("n").alias("n"), F.max("left").alias("left"), F.max("start").alias("start"))
    inside = inside.withColumn("end", F.col("start") + F.sum("n").over(Window.partitionBy(*names).orderBy("h")))
    below = inside.filter("end > left").groupBy(*names).agg(F.min("h").alias("cutoff"))
    return leaves.join(below, names, "left").withColumn("cutoff", F.coalesce("cutoff", F.when(F.col("left") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(0)).cast("long")))


def _with_leaf(df: DataFrame, leaves: DataFrame, names: list[str]) -> DataFrame:
    small = leaves.count() <= SENT_LEAVES
    return df.join(F.broadcast(leaves) if small else leaves, names)


def mix(docs: DataFrame, levels: tuple[str, ...] = ("lang", "source"), weights: Mapping[tuple[str, ...], float] | None = None, total: float | None = None, share: float = 1.0, max_epochs: int = 4, power: float = 0.5, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that the mixture reads, once for each epoch, with the columns epoch (from 0) and n_tokens added under names that ``docs`` doesn't use.

    ``levels``: columns of ``docs`` from the root down. ``weights``: a node's weight among its siblings by its path, ``*`` for any name at that level;
    nodes without one weigh their tokens to the ``power``. ``total``: tokens to read, else ``share`` of all tokens. A leaf is read ``max_epochs`` times at most.

    A null level value is the node "". A null text has no tokens; such rows, like any of a leaf's, come in where their hash falls in a prefix. Rows that share doc_id and text
    stand at the same place of an epoch and are read or left together. A prefix never passes its budget. An empty table gives an empty result.
    """
    names = [f"__l{i}" for i in range(len(levels))]
    plan = leaf_plan(docs, levels, weights or {}, total, share, max_epochs, power, seed)
    own = docs.columns
    epoch, tokens = (_free(n, own) for n in ("epoch", "n_tokens"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("*", *_keys(docs, levels), F.col("doc_id").cast("long").alias("__id"), F.crc32(text.cast("binary")).alias("__crc"))
    placed = _with_leaf(keyed, plan.select(*names, "whole", "cutoff"), names)
    last = F.when(_hash(seed, F.col("whole")) < F.col("cutoff"), F.col("whole")).otherwise(F.col("whole") - 1)
    read = placed.withColumn(epoch, F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
    return read.withColumn(tokens, token_count(F.col("text"))).select(*[F.col(f"`{c}`") for c in own], epoch, tokens)


def _free(name: str, used: list[str]) -> str:
    while name in used:
        name += "_"
    return name
