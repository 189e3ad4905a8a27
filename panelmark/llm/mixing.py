"""Mixing sources to target weights by hierarchical budgets.

Documents hang in a tree domain - language - source. A token budget goes down
the tree: siblings share what their parent has in proportion to their weights,
and what one of them cannot use goes to its siblings first. Only what a whole
subtree cannot use is left to the siblings of its root, because a subtree's
capacity is known before its parent is shared out. A leaf's capacity is
``max_epochs`` times its tokens.

A leaf repeats its documents in seeded orders, one per epoch: whole epochs
first, then the longest prefix of the next order that fits into the rest.

Everything is SQL functions and integers. The tables of leaves are small; the
documents are cut by a threshold of the seeded key that is found bin by bin,
so a leaf with a third of all rows is never sorted in one task.

Defined cases: null keys of the tree are the empty name. Documents without
tokens go with their leaf's prefix; a leaf without tokens gives nothing. Rows
that repeat a doc_id in a leaf share one place in the order and go or stay
together. An empty table gives no rows. Weights must be positive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmark.llm.common import free_name
from panelmark.session import cut

#: leaves that may be broadcast (about 200 bytes each); more are joined by a shuffle
BROADCAST_LEAVES = 50_000
_BINS = (3, 6)  # hexadecimal digits of the key


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(children: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """``granted`` per child, from capacity, weight and the parent's ``budget``.

    Siblings in the order of capacity per weight: one is full if its fair
    share of what is left would be more than it can use.
    """
    place = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = place.orderBy(F.col("capacity") / F.col("weight"), name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    rows = children.withColumns({
        "_used": F.coalesce(F.sum(whole("capacity")).over(before), F.lit(0)),
        "_rest": F.sum("weight").over(place) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    full = whole("capacity") * F.col("_rest") <= (whole("budget") - F.col("_used")) * F.col("weight")
    rows = rows.withColumn("_full", full)
    left = whole("budget") - F.coalesce(F.sum(F.when(F.col("_full"), whole("capacity"))).over(place), F.lit(0))
    weights = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(place)
    rows = rows.withColumns({"_left": left, "_weights": weights})
    fair = F.expr("(_left * weight) div _weights")
    return rows.withColumn("granted", F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(fair, F.col("capacity"))).cast("long")).drop(
        "_used", "_rest", "_full", "_left", "_weights")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], budget: int, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with ``granted`` tokens; paths without a weight have weight 1."""
    table = F.create_map(*[F.lit(x) for path, w in weights.items() for x in ("\x1f".join(path), int(w))]) if weights else None
    at = leaves.withColumn("capacity", F.col("tokens") * max_epochs).withColumn("budget", F.lit(budget).cast("long"))
    for depth, name in enumerate(levels):
        path = list(levels[: depth + 1])
        weight = F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", *path)), F.lit(1)) if table is not None else F.lit(1)
        nodes = at.groupBy(*path).agg(F.sum("capacity").cast("long").alias("capacity"), F.first("budget").alias("budget"))
        shared = share_out(nodes.withColumn("weight", weight.cast("long")), path[:-1], name)
        at = at.drop("budget").join(shared.select(*path, F.col("granted").alias("budget")), path)
    return at.select(*levels, "tokens", F.col("budget").alias("granted"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _thresholds(rows: DataFrame, levels: Sequence[str], plan: DataFrame, seed: int) -> DataFrame:
    """levels -> the greatest key of the prefix that fits into ``rest``.

    ``rows``: levels, doc_id, tokens. Bins of the key are added up per leaf;
    the bin in which the rest runs out is looked at more closely.
    """
    keyed = rows.join(plan, list(levels)).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    keyed = keyed.select(*levels, "key", "tokens", "rest")
    crossing = None
    for digits in _BINS:
        inside = keyed.withColumn("bin", F.substring("key", 1, digits))
        if crossing is None:
            inside = inside.withColumn("before", F.lit(0).cast("long"))
        else:
            inside = inside.join(crossing, [*levels]).where(F.col("bin").startswith(F.col("last"))).drop("last")
        sums = inside.groupBy(*levels, "bin", "before", "rest").agg(F.sum("tokens").alias("tokens"))
        running = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("bin"))
        sums = sums.withColumn("sofar", F.col("before") + running)
        crossed = (F.col("sofar") > F.col("rest")) & (F.col("sofar") - F.col("tokens") <= F.col("rest"))
        # one row per leaf: hinted, it does not send the documents of a leaf to one task
        crossing = _small(cut(sums.where(crossed).select(
            *levels, F.col("bin").alias("last"), (F.col("sofar") - F.col("tokens")).alias("before"))))
    near = keyed.join(crossing, [*levels]).where(F.col("key").startswith(F.col("last")))
    together = Window.partitionBy(*levels).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    fits = F.col("before") + F.sum("tokens").over(together) <= F.col("rest")
    # keys of earlier bins are smaller than the bin's own digits, those inside are greater
    return near.withColumn("_fits", fits).groupBy(*levels).agg(
        F.coalesce(F.max(F.when(F.col("_fits"), F.col("key"))), F.first("last")).alias("last_key"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, hinted for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def mix(
    docs: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], int], share: Fraction, seed: int = 0, max_epochs: int = 1,
    lang: str = "lang", source: str = "source",
) -> DataFrame:
    """The chosen rows of ``docs``, once per epoch in which they are chosen.

    ``weights``: (domain,), (domain, lang) or (domain, lang, source) ->
    integer. ``share``: the budget as a part of all tokens. All columns of
    ``docs`` stay; ``mix_domain``, ``mix_tokens`` and ``mix_epoch`` are added.
    """
    docs = docs.drop("mix_domain", "mix_tokens", "mix_epoch")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    levels = ["_domain", "_lang", "_source"]
    path = [name(domain).alias("_domain"), name(F.col(lang)).alias("_lang"), name(F.col(source)).alias("_source")]
    rows = cut(docs.select(*path, "doc_id", token_count(F.col("text").cast("string")).alias("tokens")))
    leaves = cut(rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = min(int(total * share), total * max_epochs)
    granted = budgets(leaves, levels, weights, budget, max_epochs)
    plan = cut(granted.where("tokens > 0").select(
        *levels, F.expr("granted div tokens").alias("epochs"), F.expr("granted % tokens").alias("rest")))
    limits = _thresholds(rows, levels, _small(plan.where("rest > 0")), seed)
    plan = _small(cut(plan.join(limits, levels, "left")))
    made = {free_name(docs, f"_mix{i}"): c for i, c in enumerate(levels)}
    epochs, last, copies = (free_name(docs, n) for n in ("_epochs", "_last", "_copies"))
    right = plan.select(*[F.col(c).alias(n) for n, c in made.items()], F.col("epochs").alias(epochs), F.col("last_key").alias(last))
    match = [p == F.col(n) for p, n in zip([name(domain), name(F.col(lang)), name(F.col(source))], made)]
    joined = docs.join(right, match[0] & match[1] & match[2])
    extra = (order_key(seed, F.col(epochs), F.col("doc_id")) <= F.col(last)).cast("long")
    chosen = joined.withColumn(copies, F.col(epochs) + F.coalesce(extra, F.lit(0))).where(F.col(copies) > 0)
    return chosen.select(
        *docs.columns, F.col(next(iter(made))).alias("mix_domain"), token_count(F.col("text").cast("string")).alias("mix_tokens"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)).alias("mix_epoch"))
