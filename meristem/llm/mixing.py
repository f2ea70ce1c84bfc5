"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The tree's levels are domain, language and source. A node's budget is dealt to its children by weight;
a child gets no more than its subtree holds (tokens times epochs), and what it can't take goes to its
siblings by weight. A node never gets more than its whole subtree can hold, so a shortage rises to an
ancestor only once all siblings are full. A leaf then takes whole epochs and a token prefix of the
last one, in an order that a seed and the epoch fix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import cut

LEVELS = ("domain", "lang", "source")
_PER_BUCKET = 20_000


def word_tokens(text: Column) -> Column:
    """Words between white space, as a token count that needs no Python."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes(parent..., name, weight, capacity, parent_budget) to the same with budget.

    With children in order of capacity per weight, those before a place are full and the rest share
    what is left by weight; the share per weight is right where it first fits the next child.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(rest)
    group = Window.partitionBy(*parent)
    fits = F.when(level * F.col("weight") <= F.col("capacity"), level)
    return (
        nodes.withColumn("_level", fits)
        .withColumn("_level", F.max("_level").over(group))
        .withColumn("budget", F.least(F.col("capacity").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.col("capacity").cast("double"))))
        .drop("_level")
    )


def budgets(leaves: DataFrame, total: int, epochs: int, weights: DataFrame | None = None) -> DataFrame:
    """leaves(domain, lang, source, n_docs, tokens) to the same with budget (whole tokens).

    weights(level, name, weight) gives target weights by level and node name; nodes without one weigh 1
    among their siblings. A subtree whose weight is 0 (or less, or NaN) takes nothing and counts as empty.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * F.lit(epochs))
    for level in LEVELS:
        if weights is None:
            leaves = leaves.withColumn(f"_w_{level}", F.lit(1.0))
        else:
            own = weights.where(F.col("level") == level).groupBy(F.col("name").alias("_name")).agg(F.max(F.col("weight").cast("double")).alias(f"_w_{level}"))
            leaves = leaves.join(own, F.col(level).eqNullSafe(F.col("_name")), "left").drop("_name").withColumn(f"_w_{level}", F.coalesce(f"_w_{level}", F.lit(1.0)))
            empty = F.isnan(f"_w_{level}") | (F.col(f"_w_{level}") <= 0)
            leaves = leaves.withColumn("capacity", F.when(empty, 0).otherwise(F.col("capacity"))).withColumn(f"_w_{level}", F.when(empty, 1.0).otherwise(F.col(f"_w_{level}")))
    budget = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first(f"_w_{level}").alias("weight")).where("capacity > 0")
        parent = list(LEVELS[:depth])
        if budget is None:
            nodes = nodes.withColumn("parent_budget", F.lit(float(total)))
        else:
            above = budget.select(*[F.col(c).alias(f"_{c}") for c in parent], F.col("budget").alias("parent_budget"))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parent]
            nodes = nodes.join(above, same).drop(*[f"_{c}" for c in parent])
        budget = water_fill(nodes, parent, level).drop("parent_budget", "weight", "capacity")
    return budget.withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long"))


def mix_sources(
    docs: DataFrame,
    domain: Column,
    total: int | None = None,
    share: float = 0.5,
    epochs: int = 2,
    seed: int = 42,
    weights: DataFrame | None = None,
    tokens: Column | None = None,
    carry: Column | None = None,
) -> DataFrame:
    """One row per document (doc_id, text, lang, source; others are not read): doc_id, domain, lang, source, n_tokens, full_epochs, last_tokens, taken.

    full_epochs: whole copies taken; last_tokens: tokens of the copy in the last, partial epoch (the
    document at the budget's end gives a prefix); taken: all tokens taken. The budget is total tokens,
    or share of epochs passes over the table. carry is kept as a first column "carried", whole rows for
    instance, and only rows of the buckets in which budgets end move with it.

    Null languages and sources are leaves of their own; a text without tokens takes nothing. Words are
    counted over whole texts, however long, by Spark's own functions. Repeated
    rows count each and have their own results; of rows with one and the same id the shorter go first,
    and among equal ones the order is open. An empty table gives no rows.
    """
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    whole_rows = docs.select(*([carry.alias("carried")] if carry is not None else []), F.col("doc_id"), domain.cast("string").alias("domain"), F.col("lang"), F.col("source"), tokens.cast("long").alias("n_tokens"))
    rows = cut(whole_rows.drop("carried"))
    leaves = cut(rows.groupBy(*LEVELS).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")))
    whole = leaves.agg(F.sum("tokens").alias("t"), F.max("n_docs").alias("n")).first()
    if total is None:
        total = int((whole["t"] or 0) * epochs * share)
    plan = budgets(leaves, total, epochs, weights)
    plan = leaves.join(plan.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "budget"), _same(), "left").select(
        *LEVELS,
        F.coalesce(F.expr("cast(least(coalesce(budget, 0), tokens * {0}) as bigint) div nullif(tokens, 0)".format(epochs)), F.lit(0)).cast("long").alias("full_epochs"),
        F.coalesce(F.expr("cast(least(coalesce(budget, 0), tokens * {0}) as bigint) % nullif(tokens, 0)".format(epochs)), F.lit(0)).cast("long").alias("last_budget"),
    )
    plan = cut(plan)
    small = _small(plan)

    # An epoch's order: md5 of seed, epoch and id. Its first hex digits deal a leaf into buckets of bounded size.
    digits = max(1, math.ceil(math.log(max(1, (whole["n"] or 0) / _PER_BUCKET), 16)))

    def ordered(of: DataFrame, by_leaf: DataFrame) -> DataFrame:
        named = by_leaf.withColumnsRenamed({c: f"_{c}" for c in LEVELS})
        return (
            of.join(F.broadcast(named) if small else named, _same())
            .drop(*[f"_{c}" for c in LEVELS])
            .withColumn("_at", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.col("doc_id").cast("string"))))
            .withColumn("_bucket", F.substring("_at", 1, digits))
        )

    sums = ordered(rows, plan).groupBy(*LEVELS, "last_budget", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("_upto", upto).where("_upto > last_budget").groupBy(*LEVELS).agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("before"))).alias("_end"))
    plan = cut(plan.join(ends.withColumnsRenamed({c: f"_{c}" for c in LEVELS}), _same(), "left").select(*plan.columns, "_end"))

    # Only the bucket in which the budget ends needs a running sum; those before are whole, those after left out.
    placed = ordered(rows if carry is None else whole_rows, plan)
    within = Window.partitionBy(*LEVELS, "_bucket").orderBy("_at", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ending = F.coalesce(F.col("_bucket") == F.col("_end._bucket"), F.lit(False))
    earlier = F.col("_end.before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    partial = placed.where(ending).withColumn("last_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("last_budget") - earlier)))
    others = placed.where(~ending).withColumn("last_tokens", F.when(F.col("_bucket") < F.col("_end._bucket"), F.col("n_tokens")).otherwise(F.lit(0)))
    taken = (F.col("full_epochs") * F.col("n_tokens") + F.col("last_tokens")).alias("taken")
    return partial.unionByName(others).select(*whole_rows.columns, "full_epochs", F.col("last_tokens").cast("long"), taken)


def _small(leaves: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of leaves has so few rows that a copy in every task is cheap."""
    return leaves.limit(most + 1).count() <= most


def _same() -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LEVELS]
