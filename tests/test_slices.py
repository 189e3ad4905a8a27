"""Ordered operators on a key that holds most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from panelmark.operators import slices


@pytest.fixture(scope="module", autouse=True)
def many_slices(spark):
    """Small data would be merged into one slice, and nothing be carried."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", rng.randrange(50), i, rng.random() < 0.6)
            for i in range(4000)]
    data += [(None, 3, 9001, True), (None, 1, 9002, False), (None, 2, 9003, True)]
    return data


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, id int, flag boolean").repartition(5)


def order():
    return [F.col("v"), F.col("id")]


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_hot_key_is_spread(table):
    sliced = slices.slice_by(table, ["k"], order())
    assert sliced.where("k = 'hot'").select("_slice").distinct().count() > 1


def test_position(table, rows):
    got = {r.id: r.n for r in slices.running_position(table, ["k"], order(), "n").collect()}
    want = {r[2]: i + 1 for g in groups(rows).values() for i, r in enumerate(g)}
    assert got == want


def test_global_position(table, rows):
    got = {r.id: r.n for r in slices.running_position(table, [], order(), "n").collect()}
    assert got == {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


def test_previous_value(table, rows):
    got = {r.id: r.p for r in slices.previous_value(table, ["k"], order(), {"v": "p"}).collect()}
    want = {r[2]: (g[i - 1][1] if i else None) for g in groups(rows).values() for i, r in enumerate(g)}
    assert got == want


def test_running_sum_and_max(table, rows):
    total = {r.id: r.s for r in slices.running_sum(table, ["k"], order(), "v", "s").collect()}
    top = {r.id: r.m for r in slices.running_max_before(table, ["k"], order(), "id", "m").collect()}
    for g in groups(rows).values():
        run, best = 0, None
        for r in g:
            run += r[1]
            assert total[r[2]] == run and top[r[2]] == best
            best = r[2] if best is None else max(best, r[2])


@pytest.mark.parametrize("share", [0.6, 1.0])
def test_streak(spark, rows, share):
    data = [(k, v, i, f or share == 1.0) for k, v, i, f in rows]
    table = spark.createDataFrame(data, "k string, v int, id int, flag boolean")
    got = {r.id: r.s for r in slices.running_streak(table, ["k"], order(), "flag", "s").collect()}
    for g in groups(data).values():
        run = 0
        for r in g:
            run = run + 1 if r[3] else 0
            assert got[r[2]] == run


def test_streak_of_a_flag_made_from_the_previous_row(table, rows):
    out = slices.streak_beside_previous(table, ["k"], [F.col("v"), F.col("id")], {"flag": "before"},
                                        {"same": F.col("flag").eqNullSafe(F.col("before"))}, "same", "streak")
    got = {r.id: (r.before, r.streak) for r in out.collect()}
    last, run = {}, {}
    for k, _, i, flag in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        run[k] = run.get(k, 0) + 1 if last.get(k) == flag else 0
        assert got[i] == (last.get(k), run[k])
        last[k] = flag
    assert len(got) == len(rows)
