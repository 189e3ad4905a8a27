"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``BITS`` bits: numbers by their binary
logarithm, strings by the rank of the value among the distinct ones, so that
close values keep close cells. Rows are ordered by the index of their cell on
the Hilbert curve and cut into runs, one per shard, so each shard spans a
small box in every dimension and readers can skip whole shards.

The law is ``rows``: shard sizes differ by one row at most. The order is a
range exchange with counts carried over its borders (no global window), all of
it SQL functions.

Defined cases: null values of a dimension share cell 0 with the lowest ones.
Ties on the curve go by the other dimensions, then the checksum of the text,
then doc_id; rows that repeat lie next to each other, in any order. With fewer
rows than shards the last shards are empty; an empty table gives no rows. The
columns that are added replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import free_name
from panelmark.operators import slices
from panelmark.session import cut

BITS = 5


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """For state * 2**n + label: the digit of the index, and the next state.

    The rule is that of Hamilton's compact Hilbert indices (2006): a state is
    an entry corner and a direction, a label the next bit of each coordinate.
    """
    size, mask = 1 << n, (1 << n) - 1

    def left(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & mask

    def ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    gray = {w ^ (w >> 1): w for w in range(size)}
    digits, states = [], []
    for state in range(size * n):
        entry, direction = divmod(state, n)
        for label in range(size):
            w = gray[left(label ^ entry, n - (direction + 1) % n)]
            corner = 0 if w == 0 else (v := 2 * ((w - 1) // 2)) ^ (v >> 1)
            turn = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
            digits.append(w)
            states.append((entry ^ left(corner, direction + 1)) * n + (direction + turn + 1) % n)
    return digits, states


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """The index on the curve of a cell: one fold over the bits, the highest first."""
    n = len(cells)
    digits, states = (F.array(*map(F.lit, x)) for x in curve_table(n))

    def label(bit: int) -> Column:
        return sum(
            (F.shiftleft(F.shiftright(c.cast("int"), bit).bitwiseAND(1), i) for i, c in enumerate(cells)), F.lit(0))

    labels = F.array(*[label(b) for b in range(bits - 1, -1, -1)])
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def step(at: Column, bit: Column) -> Column:
        place = at["state"] * (1 << n) + bit
        return F.struct(F.get(states, place).alias("state"), (at["index"] * (1 << n) + F.get(digits, place)).alias("index"))

    return F.aggregate(labels, start, step)["index"]


def number_cell(value: Column, bits: int = BITS) -> Column:
    """Half steps of the binary logarithm."""
    half = F.floor(2 * F.log2(F.greatest(value, F.lit(0)) + 1))
    return F.least(F.coalesce(half, F.lit(0)).cast("int"), F.lit((1 << bits) - 1))


def _string_cells(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, cell): ranks of the distinct values, counted over a range exchange."""
    values = docs.groupBy(F.col(column).cast("string").alias("_value")).agg(F.lit(1).alias("_one")).where("_value IS NOT NULL")
    ranked = cut(slices.running_position(values.select("_value"), [], [F.col("_value")], "_rank"))
    n = ranked.count()
    return ranked.select("_value", ((F.col("_rank") - 1) * (1 << bits) / F.lit(max(n, 1))).cast("int").alias("_cell"))


def order(docs: DataFrame, numbers: Sequence[str], strings: Sequence[str], bits: int = BITS, carry: Sequence[str] = ()) -> DataFrame:
    """``carry`` and ``hilbert``, ``position`` (from 0) per row."""
    rows = docs
    cells, drop = [number_cell(F.col(c), bits) for c in numbers], []
    for column in strings:
        found = _string_cells(docs, column, bits)
        value, cell = free_name(rows, f"_v_{column}"), free_name(rows, f"_c_{column}")
        found = found.select(F.col("_value").alias(value), F.col("_cell").alias(cell))
        rows = rows.join(found, F.col(column).cast("string") == F.col(value), "left")
        cells.append(F.coalesce(F.col(cell), F.lit(0)))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate([*numbers, *strings])]
    ties = [F.col(f"_k{i}") for i in range(len(keys))]
    # carried columns get plain names on the way, as theirs may clash with those made here
    plain = {c: f"_d{i}" for i, c in enumerate(carry)}
    narrow = rows.select(*[F.col(c).alias(n) for c, n in plain.items()], *keys, hilbert_index(cells, bits).alias("hilbert"))
    total = [F.col(plain[c]) for c in ("text_crc32", "doc_id")]
    placed = slices.running_position(narrow, [], [F.col("hilbert"), *ties, *total], "position")
    return placed.select(*[F.col(n).alias(c) for c, n in plain.items()], "hilbert", (F.col("position") - 1).alias("position"))


def shard(docs: DataFrame, shards: int = 16, numbers: Sequence[str] = ("size",), strings: Sequence[str] = ("lang", "source"),
          whole: bool = True) -> DataFrame:
    """``docs`` with size, text_crc32, hilbert, law, shard, slot and grown_shard.

    ``size`` counts the UTF-8 bytes of the text and one more. With ``whole``
    all columns of ``docs`` travel through the exchange, else only doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = ["size", "text_crc32", "hilbert", "law", "shard", "slot", "grown_shard", "position"]
    kept = [c for c in docs.columns if c.lower() not in made] if whole else ["doc_id"]
    rows = docs.select(
        *dict.fromkeys([*kept, *strings, *[c for c in numbers if c not in made]]),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = cut(order(rows, numbers, strings, carry=[*kept, "size", "text_crc32"]))
    n = placed.count()
    # the first position of a shard is the ceiling of its share; integers only, as n may pass 2**53 / shards
    at = F.expr(f"position * {shards} div {max(n, 1)}")
    return placed.withColumn("shard", at.cast("int")).select(
        *kept, "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("position") - F.expr(f"(shard * {n} + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order inside each task's file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
