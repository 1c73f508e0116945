"""Mixing sources to target weights over a tree of domain, language and source.

The tree's nodes get budgets from the top: a node's budget is shared among its children by their weights, but no
child gets more than its subtree can give (its tokens times the number of epochs allowed). What a short child
leaves goes to its siblings by their weights; only what a whole subtree cannot take goes to the siblings of its
parent, because the parent's own capacity was already counted one level up. Each leaf then takes whole epochs and
the token-prefix of one more, every epoch in its own seeded order.

Rows are never gathered by leaf: a leaf's tokens are summed by the first three hexadecimal digits of the order
key, the bucket where the prefix ends is found on these sums, and only that bucket's rows (a 4096th of the leaf)
are put in order. The result is a cut in the order, which every row can test for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored, words

LEVELS = ("domain", "lang", "source")


def order_key(seed: int, epoch, doc_id):
    """Place of a document in an epoch's order: hexadecimal text, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Budgets of children (capacity, weight, parent_budget), by weight within each parent and up to capacity.

    In the order of capacity per weight the children that are filled up are a prefix: child i is one exactly if
    what the earlier ones leave, divided by the weights not yet served, is at least its capacity per weight.
    """
    children = children.withColumn("per", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")))
    rest = [c for c in children.columns if c in LEVELS]
    order = Window.partitionBy(*parent).orderBy(F.col("per").asc_nulls_last(), *rest)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    children = children.withColumn("taken", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity"))).over(before), F.lit(0.0)))
    children = children.withColumn("served", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    whole = Window.partitionBy(*parent)
    children = children.withColumn("level", (F.col("parent_budget") - F.col("taken")) / (F.sum("weight").over(whole) - F.col("served")))
    children = children.withColumn("full", (F.col("weight") > 0) & (F.col("level") >= F.col("per")))
    # The first child that is not filled up sets the level of all that are not.
    level = F.max(F.when(~F.col("full") & (F.col("weight") > 0), F.struct((-F.col("served")).alias("s"), F.col("level").alias("level")))).over(whole)["level"]
    children = children.withColumn("common", level)
    budget = F.when(F.col("weight") <= 0, 0.0).when(F.col("full"), F.col("capacity")).otherwise(F.col("common") * F.col("weight"))
    return children.withColumn("budget", budget).drop("per", "taken", "served", "level", "full", "common", "parent_budget", "weight")


def with_leaf(docs: DataFrame, domain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with leaf columns m_domain, m_lang, m_source (missing ones become "(none)") and m_tokens, its words."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    return docs.withColumns({"m_domain": none(domain), "m_lang": none(F.col("lang")), "m_source": none(F.col("source")), "m_tokens": F.size(words(F.col(text))).cast("long"), "m_id": F.col(doc_id).cast("long")})


def plan(leafed: DataFrame, weights: dict, share: float, epochs: int, seed: int) -> DataFrame:
    """One row for each leaf: tokens, budget, whole epochs, and where the last one's prefix ends.

    leafed: rows of with_leaf. weights: for each level a column over domain, lang, source, at least 0 and relative
    to the siblings. share: tokens wanted, as a share of all tokens.
    """
    light = leafed.select(*(F.col(f"m_{c}").alias(c) for c in LEVELS), F.col("m_tokens").alias("tokens"), F.col("m_id").alias("doc_id"))
    leaves = stored(light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    budget = None
    for k, level in enumerate(LEVELS):
        keys, parent = list(LEVELS[: k + 1]), list(LEVELS[:k])
        nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * F.lit(float(epochs))).alias("capacity")).withColumn("weight", weights[level].cast("double"))
        if budget is None:
            wanted = F.sum("capacity").over(Window.partitionBy()) / F.lit(float(epochs)) * F.lit(float(share))
            nodes = nodes.withColumn("parent_budget", wanted)  # few rows: the domains
        else:
            nodes = nodes.join(budget.select(*parent, F.col("budget").alias("parent_budget")), parent)
        budget = share_out(nodes, parent)
    leaves = stored(leaves.join(budget.select(*LEVELS, "budget"), list(LEVELS)))
    whole = F.least(F.lit(epochs), F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)) + 1e-9)).cast("int")
    leaves = leaves.withColumn("epochs", whole)
    leaves = stored(leaves.withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("budget") - F.col("epochs") * F.col("tokens") + 1e-6)).cast("long")))

    # Sums by the first digits of the key, in the order of the epoch that is cut.
    open_ = leaves.where(F.col("epochs") < epochs).select(*LEVELS, "rest", (F.col("epochs") + 1).alias("epoch"))
    keyed = light.join(open_, list(LEVELS)).withColumn("key", order_key(seed, F.col("epoch"), F.col("doc_id")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    end = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    sums = sums.withColumn("end", end).where(F.col("end") > F.col("rest"))
    cut = stored(sums.groupBy(*LEVELS).agg(F.min("bucket").alias("bucket"), F.min_by(F.col("end") - F.col("tokens"), "bucket").alias("before")))
    edge = keyed.join(cut, [*LEVELS, "bucket"])
    run = F.sum("tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("key", F.col("doc_id").asc_nulls_first())) + F.col("before")
    edge = edge.withColumn("run", run).where(F.col("run") <= F.col("rest"))
    last = edge.groupBy(*LEVELS).agg(F.max("key").alias("last"))
    # Up to which key a leaf takes rows: the last that fits, else all of the buckets before; no cut takes them all.
    cut = cut.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "bucket").alias("cut"))
    return stored(leaves.join(cut, list(LEVELS), "left").select(*LEVELS, "docs", "tokens", "budget", "epochs", "rest", "cut"))


def mixed(leafed: DataFrame, planned: DataFrame, epochs: int, seed: int) -> DataFrame:
    """Rows of with_leaf once for each epoch in which plan takes them, with m_epoch (from 1)."""
    leaf = planned.select(*(F.col(c).alias(f"m_{c}") for c in LEVELS), F.col("epochs").alias("m_full"), F.col("cut").alias("m_cut"))
    rows = leafed.join(leaf, [f"m_{c}" for c in LEVELS])
    key = order_key(seed, F.col("m_full") + 1, F.col("m_id"))
    more = (F.col("m_full") < epochs) & (F.col("m_cut").isNull() | (key <= F.col("m_cut")))
    rows = rows.withColumn("m_times", F.col("m_full") + F.when(more, 1).otherwise(0)).where("m_times > 0")
    return rows.withColumn("m_epoch", F.explode(F.sequence(F.lit(1), F.col("m_times")))).drop("m_full", "m_cut", "m_times")


def mix(docs: DataFrame, domain, weights: dict, share: float, epochs: int = 3, seed: int = 1) -> DataFrame:
    """docs once for each epoch in which it is taken, with domain and epoch in m_domain and m_epoch.

    docs has doc_id, text, lang and source. A null domain, language or source is a node "(none)"; a null text has
    no tokens. Children without a positive weight get nothing. Rows with one doc_id stand at one place of the
    order and are taken together. Prefixes never exceed a leaf's budget; a budget above all capacity takes every
    row in every epoch. An empty table gives an empty result.
    """
    leafed = with_leaf(docs, domain)
    return mixed(leafed, plan(leafed, weights, share, epochs, seed), epochs, seed)
