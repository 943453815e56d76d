"""Mixing sources to target weights: hierarchical token budgets, then a token-prefix of seeded epochs from each leaf.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._spark import fresh, materialize, small

#: Slices of the order of a leaf's documents; only the slice in which the budget ends is sorted.
_SLICES = 3  # hexadecimal digits of the order key


def count_words(text: Column) -> Column:
    """Tokens as white-space separated words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def order_key(id_col: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(""))))


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int | None = None, epochs: int = 2) -> DataFrame:
    """``levels..., tokens, allotted``: tokens of the budget for each leaf (``levels..., tokens`` in ``leaves``).

    ``weights`` has for each level the weights of its values (1 where none is given, 0 for none of it). From the root
    down, a node's budget goes to its children in proportion to their weights, but to none more than its descendants
    can give in ``epochs`` passes: what a child cannot take goes to its siblings, and only what no sibling can take is
    left with their parent's siblings, as the parent's own limit counts its descendants only. Whole tokens: rounding
    leaves less than one token for each child unspent. ``budget`` None: as many tokens as the leaves have.
    Levels may have any names but ``tokens`` and ``allotted``; other columns of ``leaves`` are left out. Null values of
    a level are a value like others; null tokens count as none.
    """
    if {x.lower() for x in levels} & {"tokens", "allotted"}:
        raise ValueError("a level can't be named tokens or allotted")
    keys = [f"level{i}" for i in range(len(levels))]  # inside, only names of this function's own
    nodes = leaves.select(*[F.col(f"`{x}`").alias(k) for k, x in zip(keys, levels, strict=True)], F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))
    cap = F.col("tokens") * epochs
    for key, level in zip(keys, levels, strict=True):
        for value, w in weights.get(level, {}).items():
            if w == 0:
                cap = F.when(F.col(key) == value, F.lit(0)).otherwise(cap)
    nodes = nodes.withColumn("cap", cap.cast("long"))
    whole = nodes.agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap")).first()
    nodes = nodes.withColumn("given", F.lit(min(budget if budget is not None else whole["tokens"] or 0, whole["cap"] or 0)).cast("long"))
    for depth, (key, level) in enumerate(zip(keys, levels, strict=True), 1):
        weight = F.lit(1)
        for value, w in weights.get(level, {}).items():
            weight = F.when(F.col(key) == value, w).otherwise(weight)
        above, here = keys[: depth - 1], keys[:depth]
        children = nodes.groupBy(*here).agg(F.sum("cap").alias("most"), F.first("given").alias("parent")).withColumn("weight", F.when(F.col("most") > 0, weight).otherwise(0).cast("long"))
        beside = Window.partitionBy(*[F.col(x) for x in above] or [F.lit(0)])
        # Siblings in the order in which they run out; those before a node are full if the node itself is.
        order = beside.orderBy(F.when(F.col("weight") > 0, F.col("most") / F.col("weight")).otherwise(F.lit(float("inf"))), key)
        children = children.withColumn("full_before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        children = children.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        children = children.withColumn("full", (F.col("weight") > 0) & (F.col("most") * F.col("weight_left") <= F.col("weight") * (F.col("parent") - F.col("full_before"))))
        taken = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(beside)
        weight_open = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(beside)
        children = children.withColumn("taken", taken).withColumn("weight_open", weight_open)
        share = F.when(F.col("full"), F.col("most")).when(F.col("weight") == 0, 0).otherwise(F.expr("((parent - taken) * weight) div weight_open"))
        children = children.select(*[F.col(k).alias(f"its_{k}") for k in here], share.cast("long").alias("share"))
        same = [F.col(k).eqNullSafe(F.col(f"its_{k}")) for k in here]
        nodes = nodes.join(children, same).select(*keys, "tokens", "cap", F.col("share").alias("given"))
    return nodes.select(*[F.col(k).alias(x) for k, x in zip(keys, levels, strict=True)], "tokens", F.col("given").alias("allotted"))


def mix_sources(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], budget: int | None = None, epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` chosen for the mixture, with ``_epoch``, ``_tokens`` and the columns ``_<level>`` beside them.

    ``levels`` names the tree's levels from the root down, each with the column that gives a row's value; null values
    are ``unknown``. A leaf that may spend as much as its documents hold once or more gives all of them in so many
    epochs; what remains of its budget takes the longest prefix of its documents that fits, in the seeded order of
    that epoch. A row is repeated once for each epoch. Rows that repeat an id are ordered beside each other.
    Null texts hold no tokens. An empty table gives an empty result. Columns of ``docs`` named like the new ones are
    replaced by them (so the operator can run on its own output); all others may have any name.

    Sums by leaf and by slice of the order decide where a leaf's prefix ends, so documents are neither sorted nor
    moved, but for the one slice (1 / 4096) in which it ends.
    """
    p = fresh(docs.columns)
    names = [f"{p}{i}" for i in range(len(levels))]
    tokens, full, rest, key, part, end, before, times, upto = (f"{p}{x}" for x in ("tokens", "full", "rest", "key", "slice", "end", "before", "times", "upto"))
    added = {f"_{x}".lower() for x in levels} | {"_tokens", "_epoch"}
    own = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select("*", *[F.coalesce(value.cast("string"), F.lit("unknown")).alias(name) for name, value in zip(names, levels.values(), strict=True)], count_words(F.col(text_col)).alias(tokens))
    leaves = materialize(rows.groupBy(*names).agg(F.sum(tokens).alias("tokens")), "leaves")
    plan = budgets(leaves, names, {name: weights.get(level, {}) for name, level in zip(names, levels, strict=True)}, budget, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("allotted div tokens")).otherwise(0).cast("long")
    plan = plan.withColumn(full, whole).withColumn(rest, F.col("allotted") - F.col(full) * F.col("tokens")).select(*names, full, rest)
    plan = materialize(plan, "budgets")
    keyed = rows.join(small(plan), names).withColumn(key, order_key(F.col(id_col), F.col(full) + 1, seed)).withColumn(part, F.substring(key, 1, _SLICES))
    slices = keyed.groupBy(*names, rest, part).agg(F.sum(tokens).alias("t"))
    running = Window.partitionBy(*names).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn(upto, F.sum("t").over(running)).where(F.col(upto) > F.col(rest))
    ends = slices.groupBy(*names).agg(F.min(F.struct(F.col(part).alias("slice"), (F.col(upto) - F.col("t")).alias("before"))).alias("e"))
    ends = materialize(ends.select(*names, F.col("e.slice").alias(end), F.col("e.before").alias(before)), "ends")
    keyed = keyed.join(small(ends), names, "left")
    inside = F.col(end).isNull() | (F.col(part) < F.col(end))
    spare = F.when(inside & (F.col(rest) > 0), 1).otherwise(0)

    def shaped(found: DataFrame, epoch: Column) -> DataFrame:
        return found.select(*[F.col(f"`{c}`") for c in own], *[F.col(n).alias(f"_{x}") for n, x in zip(names, levels, strict=True)], F.col(tokens).alias("_tokens"), epoch.alias("_epoch"))

    passes = keyed.withColumn(times, F.col(full) + spare).where(F.col(times) > 0)
    chosen = shaped(passes, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    last = keyed.where((F.col(part) == F.col(end)) & (F.col(rest) > 0))
    within = Window.partitionBy(*names).orderBy(key, tokens).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn(upto, F.col(before) + F.sum(tokens).over(within)).where(F.col(upto) <= F.col(rest))
    return chosen.unionByName(shaped(last, F.col(full) + 1))
