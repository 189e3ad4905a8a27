"""Ordered work over keys of any size.

A window partitioned by a key puts all rows of that key into one task. The
operators here sort by (key, order) with a range exchange instead, so that a
hot key spreads over many slices. Each slice is worked on by itself, and a
small state is carried over the slice borders. Only the first and the last key
of a slice can reach over a border, so the carried table has at most two rows
per slice whatever the data size; that bound is why it may be broadcast.

``order`` must be a total order within a key: end it with a unique column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmark.session import cut

SLICE = "_slice"
ROW = "_in_slice"


def slice_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], row: str | None = None) -> DataFrame:
    """Rows in (key, order) ranges, with the range number in ``_slice``.

    The range exchange samples its bounds, so the result is written once: a
    later read, or a retry after a lost executor, must not see other bounds.
    ``row`` names a column for the number (from 1) of a row in its sorted
    slice.
    """
    keyed = [F.col(k) for k in keys]
    ranged = df.repartitionByRange(*keyed, *order)
    if row:
        # the lower 33 bits of this identifier count the rows of a task
        counted = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
        ranged = ranged.sortWithinPartitions(*keyed, *order).withColumn(row, counted)
    return cut(ranged.withColumn(SLICE, F.spark_partition_id()))


def _inside(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(SLICE, *keys).orderBy(*order)


def _earlier(keys: Sequence[str]):
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = left[SLICE] == right["_at"]
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"_k_{key}"])
    return condition


def _edge_state(sliced: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per slice and edge key with the given aggregates."""
    if not keys:
        return sliced.groupBy(SLICE).agg(*aggregates)
    key = F.struct(*[F.col(k) for k in keys])
    edges = (
        sliced.groupBy(SLICE)
        .agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
        .select(
            F.col(SLICE).alias("_at"),
            F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_key"),
        )
        .select("_at", *[F.col(f"_key.{k}").alias(f"_k_{k}") for k in keys])
    )
    rows = sliced.join(F.broadcast(edges), _matches(sliced, edges, keys), "left_semi")
    return rows.groupBy(SLICE, *keys).agg(*aggregates)


def _attach(local: DataFrame, state: DataFrame, keys: Sequence[str], carry: str) -> DataFrame:
    right = state.select(
        F.col(SLICE).alias("_at"), *[F.col(k).alias(f"_k_{k}") for k in keys], carry
    )
    joined = local.join(F.broadcast(right), _matches(local, right, keys), "left")
    return joined.drop("_at", *[f"_k_{k}" for k in keys])


def running_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """``row_number()`` over (keys, order)."""
    # without keys rows are numbered where the slice is written, so that they need not move once more
    sliced = slice_by(df, keys, order, row=None if keys else ROW)
    if keys:
        local = sliced.withColumn(name, F.row_number().over(_inside(keys, order)).cast("long"))
    else:
        local = sliced.withColumn(name, F.col(ROW)).drop(ROW)
    state = _edge_state(sliced, keys, F.count("*").alias("_rows"))
    state = state.withColumn("_carry", F.sum("_rows").over(_earlier(keys)))
    joined = _attach(local, state, keys, "_carry")
    return joined.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop(
        SLICE, "_carry"
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str, name: str
) -> DataFrame:
    """Running total of ``column`` up to and including this row."""
    sliced = slice_by(df, keys, order)
    window = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn(name, F.sum(column).over(window))
    state = _edge_state(sliced, keys, F.sum(column).alias("_total"))
    state = state.withColumn("_carry", F.sum("_total").over(_earlier(keys)))
    joined = _attach(local, state, keys, "_carry")
    return joined.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop(
        SLICE, "_carry"
    )


def running_max_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str, name: str
) -> DataFrame:
    """Largest ``column`` of the rows before this one, null on the first."""
    sliced = slice_by(df, keys, order)
    window = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn(name, F.max(column).over(window))
    state = _edge_state(sliced, keys, F.max(column).alias("_top"))
    state = state.withColumn("_carry", F.max("_top").over(_earlier(keys)))
    joined = _attach(local, state, keys, "_carry")
    return joined.withColumn(name, F.greatest(F.col(name), F.col("_carry"))).drop(SLICE, "_carry")


def _with_previous(sliced: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str]) -> DataFrame:
    window = _inside(keys, order)
    local = sliced.withColumn("_row", F.row_number().over(window))
    for source, target in columns.items():
        local = local.withColumn(target, F.lag(source).over(window))
    tail = F.struct(*[F.col(s) for s in columns])
    state = _edge_state(sliced, keys, F.max_by(tail, F.struct(*order)).alias("_tail"))
    nearest = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    state = state.withColumn("_carry", F.lag("_tail").over(nearest.orderBy(SLICE)))
    joined = _attach(local, state, keys, "_carry")
    for source, target in columns.items():
        joined = joined.withColumn(
            target, F.when(F.col("_row") == 1, F.col("_carry")[source]).otherwise(F.col(target))
        )
    return joined.drop("_carry", "_row")


def _with_streak(sliced: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str, name: str) -> DataFrame:
    window = _inside(keys, order)
    sofar = window.rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_row", F.row_number().over(window))
    local = local.withColumn("_broken", F.max(F.when(~F.col(flag), F.col("_row"))).over(sofar))
    state = _edge_state(
        local, keys, F.count("*").alias("_rows"), F.max("_broken").alias("_last_broken")
    )
    earlier = _earlier(keys)
    state = state.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    state = state.withColumn("_break_at", F.col("_start") + F.col("_last_broken"))
    state = state.withColumn(
        "_carry", F.col("_start") - F.coalesce(F.max("_break_at").over(earlier), F.lit(0))
    )
    joined = _attach(local, state, keys, "_carry")
    run_on = F.col("_row") + F.coalesce("_carry", F.lit(0))
    streak = F.when(F.col("_broken").isNull(), run_on).otherwise(F.col("_row") - F.col("_broken"))
    return joined.withColumn(name, streak.cast("long")).drop("_carry", "_row", "_broken")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str]
) -> DataFrame:
    """``lag`` of the named columns (source -> new name) over (keys, order)."""
    return _with_previous(slice_by(df, keys, order), keys, order, columns).drop(SLICE)


def running_streak(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str, name: str
) -> DataFrame:
    """Length of the current run of true ``flag`` rows, 0 on a false row."""
    return _with_streak(slice_by(df, keys, order), keys, order, flag, name).drop(SLICE)


def streak_beside_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str], derived: dict[str, Column], flag: str, name: str
) -> DataFrame:
    """``previous_value``, then the ``derived`` columns of it, then ``running_streak`` of one of them, over the same slices."""
    moved = _with_previous(slice_by(df, keys, order), keys, order, columns)
    for target, value in derived.items():
        moved = moved.withColumn(target, value)
    return _with_streak(moved, keys, order, flag, name).drop(SLICE)
