"""Legal provenance: provision trees, amendment chains, as-of amendments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.operators import slices
from panelmark.session import cut


def climb(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Root, depth and path of every node of a forest.

    Pointer doubling: after k rounds a node knows its ancestor 2^k steps up, so
    a chain of a million links needs twenty joins, not a million. Each round
    is written once, which keeps the plan short and survives lost executors.
    Nodes that reached their root leave the work; the join key is the
    ancestor, unique on one side, so a popular ancestor only makes a large
    probe side, which adaptive execution splits.

    Columns: node, root, depth, path (root first, joined by '/'), reason. Nodes
    that lead into a cycle have no root; their reason is "cycle". A chain has
    fewer links than there are nodes, so what is still open when the jumps are
    longer than that can only go round.
    """
    known = nodes.select(F.col(node).alias("_id")).distinct()
    # a parent that does not exist ends the chain
    edges = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    joined = edges.join(known, edges["up"] == known["_id"], "left")
    # up: the ancestor reached so far; depth: steps to it; trail: from it down to the parent
    state = cut(
        joined.select(
            "node", F.col("_id").alias("up"),
            F.when(F.col("_id").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("_id").alias("trail"),
        )
    )
    roots = state.where("up IS NULL")
    done = roots.select("node", F.col("node").alias("root"), "depth", F.col("node").alias("path"), F.lit(None).cast("string").alias("reason"))
    nodes_left, jump = state.count(), 1
    open_ = state.where("up IS NOT NULL")
    while jump <= 2 * nodes_left and not open_.isEmpty():
        jump *= 2
        above = state.select(
            F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("trail").alias("_trail")
        )
        moved = cut(
            open_.join(above, open_["up"] == above["_n"]).select(
                "node", F.col("_up").alias("next"), "up", (F.col("depth") + F.col("_d")).alias("depth"),
                F.concat_ws("/", "_trail", "trail").alias("trail"),
            )
        )
        ended = moved.where("next IS NULL")
        done = done.unionByName(
            ended.select("node", F.col("up").alias("root"), "depth", F.concat_ws("/", "trail", "node").alias("path"),
                         F.lit(None).cast("string").alias("reason"))
        )
        open_ = moved.where("next IS NOT NULL").select("node", F.col("next").alias("up"), "depth", "trail")
        # a node that has reached its root keeps that jump for the nodes below it
        finished = ended.select("node", "up", "depth", "trail")
        state = roots.unionByName(open_).unionByName(finished).unionByName(_settled(state, moved))
    nothing = lambda kind: F.lit(None).cast(kind)
    return done.unionByName(open_.select(
        "node", nothing("string").alias("root"), nothing("long").alias("depth"), nothing("string").alias("path"), F.lit("cycle").alias("reason")))


def _settled(state: DataFrame, moved: DataFrame) -> DataFrame:
    """Nodes that reached their root in an earlier round."""
    return state.where("up IS NOT NULL").join(moved.select("node"), "node", "left_anti")


def rule_lineage(
    rules: DataFrame, provisions: DataFrame, amendments: DataFrame, documents: DataFrame, categories: DataFrame
) -> DataFrame:
    """Rule with its provision, amendment, source document and category.

    Plain left equi joins: Catalyst broadcasts whichever side is small enough.
    """
    return (
        rules.join(provisions, "provision_id", "left")
        .join(amendments, "amendment_id", "left")
        .join(documents, "document_id", "left")
        .join(categories, "category_id", "left")
    )


def asof_amendment(events: DataFrame, day: str, unique: str, amendments: DataFrame) -> DataFrame:
    """Amendment in force on each event's day: the latest commencement not after it.

    Amendments and distinct days are put in one time line and the amendment is
    carried forward, slice by slice; the events then join on their day. No
    range join, no limit on either side.
    """
    steps = amendments.groupBy(F.col("commencement_date").alias("_day")).agg(
        F.max("amendment_id").alias("_amendment")
    ).withColumn("_kind", F.lit(0))
    days = events.select(F.to_date(day).alias("_day")).distinct().select(
        "_day", F.lit(None).cast("string").alias("_amendment"), F.lit(1).alias("_kind")
    )
    line = steps.unionByName(days).where("_day IS NOT NULL").withColumn(
        "_stamp", F.when(F.col("_kind") == 0, F.struct("_day", "_amendment"))
    )
    carried = slices.running_max_before(line, [], [F.col("_day"), F.col("_kind")], "_stamp", "_last")
    answer = carried.where("_kind = 1").select("_day", F.col("_last._amendment").alias("amendment_id"),
                                               F.col("_last._day").alias("commencement_date"))
    return events.withColumn("_day", F.to_date(day)).join(answer, "_day", "left").drop("_day")
