"""Hard negatives, whitening and URL filters against brute force, and their odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmark.llm import mining, urlfilter, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, dims int, leaf int"


def clustered(seed, many, dims, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 3
    kind = rng.integers(0, groups, many)
    return centres[kind] + rng.normal(size=(many, dims)) * 0.2, rng.integers(0, 4, many)


def frame(spark, ids, values, labels):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], None if lab is None else int(lab), "x", 1, 2)
            for i, v, lab in zip(ids, values, labels)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def mined(df, **options):
    found = mining.mine(df, F.col("embedding"), F.col("vec_id"), F.col("label"), F.col("vec_id") % 10 == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def brute_mined(rows):
    """rows: {vec_id: (label, ints)}"""
    out = []
    for a, (label, x) in rows.items():
        if a % 10:
            continue
        score = {b: sum(p * q for p, q in zip(x, y)) for b, (_, y) in rows.items() if b != a}
        ranked = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in ranked if rows[b][0] == label][:5]:
            fit = [b for b in ranked if rows[b][0] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fit)]
    return sorted(out)


def ints(v):
    return tuple(math.floor(256 * c) for c in v)


@pytest.mark.parametrize("sample", [16384, 40])
def test_mining_matches_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(mining, "LEAF_SAMPLE", 8)
    monkeypatch.setattr(mining, "BLOCK", 30)
    monkeypatch.setattr(mining, "ANCHORS", 16)
    values, labels = clustered(3, 420, 5)
    df = frame(spark, range(420), values, labels)
    assert mined(df, sample=sample) == brute_mined({i: (int(l), ints(v)) for i, (v, l) in enumerate(zip(values, labels))})


def test_mining_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mining, "LEAF_SAMPLE", 8)
    values, labels = clustered(5, 120, 4)
    values[20:70] = values[20]  # ties and a hot vector
    good = {i: (int(l), ints(v)) for i, (v, l) in enumerate(zip(values, labels))}
    extra = [(500, None, 1), (510, [], 1), (520, [1.0, None, 1.0, 1.0], 1), (530, [1.0, math.inf, 1.0, 1.0], 1),
             (540, [1.0, math.nan, 1.0, 1.0], 1), (550, [1.0] * 4, None), (None, [9.0] * 4, 1), (560, [9.0] * 7, 1)]
    again = [(i, list(values[i]), good[i][0]) for i in (0, 1, 20)]
    ids, vecs, labs = zip(*extra, *again)
    df = frame(spark, [*range(120), *ids], [*map(list, values), *vecs], [*labels, *labs])
    assert mined(df) == brute_mined(good)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 500")) == [] and mined(df.where("vec_id = 0")) == []


def test_mining_large_numbers(spark):
    values, labels = clustered(7, 60, 3)
    values = np.round(values * 2.0**22) / 16
    df = frame(spark, range(60), values, labels)
    good = {i: (int(l), ints(v)) for i, (v, l) in enumerate(zip(values, labels))}
    assert max(abs(s) for r in mined(df) for s in r[4:]) > 1 << 53
    assert mined(df) == brute_mined(good)


def test_tree_eliminates_siblings(monkeypatch):
    """On clustered rows an annulus needs few leaves, and every row inside of it is in one of them."""
    monkeypatch.setattr(mining, "LEAF_SAMPLE", 30)
    rng = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(rng.normal(size=(12, 8)) * 4, 80, axis=0) + rng.normal(size=(960, 8)) * 0.1))
    tree = mining.grow(x[rng.permutation(960)[:400]])
    squares = (x * x).sum(axis=1)
    for number, rows, distance, taken in tree.descend(x):
        node = tree.nodes[number]
        for j in np.unique(taken):
            below = taken == j
            node.near[:, j], node.far[:, j] = distance[below].min(axis=0), distance[below].max(axis=0)
            node.short[j], node.long[j] = squares[rows[below]].min(), squares[rows[below]].max()
    leaf, needed, possible = tree.leaf_of(x), 0, 0
    score = x @ x.T
    top = np.sort(score, axis=1)[:, -20]
    found = {(leaf_, int(a)) for leaf_, rows in tree.needed(x, top[:, None], np.full((960, 1), np.inf)) for a in rows}
    for a in range(960):
        assert {int(v) for v in leaf[score[a] >= top[a]]} <= {v for v, b in found if b == a}
    needed, possible = len(found), 960 * tree.leaves
    assert tree.leaves > 12 and needed < 0.35 * possible


def brute_whitening(x):
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit.astype(float) - np.array([s / n for s in sums])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)) for v in x], values[::-1], vectors_[:, ::-1], np.array([s / n for s in sums])


def whitened(df):
    return {(r.vec_id, r.component): r for r in whitening.whiten(df, F.col("embedding"), F.col("vec_id")).collect()}


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(11)
    values = rng.normal(size=(300, 12)) * np.geomspace(1, 1e-2, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 3
    values[200:260] = values[0]  # a hot vector
    df = frame(spark, [*range(300), 900, 901, 902, None], [*values, None, [1.0, math.nan] + [0.0] * 10, [1.0], values[1]], [0] * 304)
    got = whitened(df)
    x = [ints(v) for v in values]
    n, away, spread, axes, mean = brute_whitening(x)
    assert {k[0] for k in got} == {*range(300), None} and len(got) == 301 * 4
    for k in range(4):
        column = np.array([got[i, k + 1].whitened for i in range(300)])
        wanted = (np.array(x) - mean) @ axes[:, k] / math.sqrt(spread[k])
        assert np.allclose(column, wanted * np.sign(wanted @ column), rtol=1e-9, atol=1e-9)
        assert math.isclose(got[0, k + 1].explained, spread[k] / spread.sum(), rel_tol=1e-10)
    assert all(r.n == n and r.identity_error < 1e-10 for r in got.values())
    assert [got[i, 1].deviation for i in range(300)] == away


def test_whitening_query(spark):
    from panelmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = [ints(r.embedding) for r in rows]
    n, away, spread, axes, mean = brute_whitening(x)
    got = {(r.vec_id, r.component): r for r in QUERIES["op12_whitening"](spark, sf).collect()}
    assert len(got) == 4 * len(rows)
    for k in range(4):
        column = np.array([got[r.vec_id, k + 1].whitened for r in rows])
        wanted = (np.array(x) - mean) @ axes[:, k] / math.sqrt(spread[k])
        assert np.allclose(column, wanted * np.sign(wanted @ column), rtol=1e-8, atol=1e-8)
        assert all(math.isclose(got[r.vec_id, k + 1].explained, spread[k] / spread.sum(), rel_tol=1e-9) for r in rows)
    assert [got[r.vec_id, 1].deviation for r in rows] == away
    assert all(r.n == n and r.identity_error < 1e-9 for r in got.values())


def test_whitening_of_dependent_vectors(spark):
    """Two independent directions in five dimensions; one of them constant."""
    rng = np.random.default_rng(4)
    values = np.floor(rng.integers(-40, 40, (90, 2)) @ np.array([[1, 2, 0, 1, 0], [0, 1, 0, -1, 3]])) / 256
    got = whitened(frame(spark, range(90), values, [0] * 90))
    assert all((got[i, k].whitened is None) == (k > 2) for i in range(90) for k in range(1, 5))
    assert got[0, 1].identity_error < 1e-10 and abs(got[0, 1].explained + got[0, 2].explained - 1) < 1e-10


def test_whitening_of_one_vector_and_of_none(spark):
    df = frame(spark, [1, 2], [[1.0, 2.0]] * 2, [0, 0])
    got = whitened(df)
    assert len(got) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in got.values())
    assert whitened(df.limit(0)) == {} and whitened(frame(spark, [1], [None], [0])) == {}


def test_packed_vectors_return():
    rows = np.array([[0, -128, 127], [128, 0, 0], [-40000, 1, 2], [1 << 40, -1, 0], [-(1 << 62), 1 << 62, 5]])
    packed = vectors.pack(rows)
    assert [b[0] for b in packed] == [1, 2, 4, 8, 8] and (vectors.unpack(packed) == rows).all()


ODD_URLS = [None, "", "no scheme", "http://", "http://ORG/x", "https://Example.ORG/es/1?x#y", "a://b.example.org/en/12", "http://com/fr/",
            "http://x.com/de/?q", "http://notcom/de/", "http://x.org?es/", "ftp://É.org/#", "http://a://b.org/de/", "http://x.org/\nes/"]


def test_urls(spark):
    rules = [urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "example.org", "/en/1"),
             urlfilter.Rule("allow", "com", "/fr/"), urlfilter.Rule("block", "com", "/de/")]
    urls = ODD_URLS * 2 + [f"http://h{i % 90}.net/{i % 700}" for i in range(1500)]
    df = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)], "page_id int, url string, `_key` string")
    for max_bytes in (urlfilter.MAX_BYTES, 40):  # one shard, and several
        judged = urlfilter.judge(df, rules, F.col("host").rlike("^h[0-9]\\."), max_bytes=max_bytes)
        got = {r.page_id: r for r in judged.collect()}
        assert len(got) == len(urls) and judged.columns == ["page_id", "url", "_key", "host", "path", "listed", "rule", "verdict"]
        for i, url in enumerate(urls):
            _, mark, rest = (url or "").partition("://")
            rest = rest if mark else ""
            end = min([p for p in map(rest.find, "/?#") if p >= 0], default=len(rest))
            host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:].split("?")[0].split("#")[0]
            fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
            rule = max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)
            listed = bool(host.startswith("h") and host[1:2].isdigit() and host[2:3] == ".")
            verdict = rule.verdict if rule else "block" if listed else "allow"
            row = got[i]
            assert (row.host, row.path, row.rule, row.listed, row.verdict) == (host, path, rule and rule.host + rule.path, listed, verdict), url


@pytest.mark.parametrize("share", [0, 1, 50, 1000])
def test_cascade_is_exact_and_needs_several_levels(spark, share):
    keys = spark.range(60000).select(F.concat(F.lit("k"), "id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(1000)) < share).alias("listed"))
    twice = keys.union(keys.limit(5)).union(keys.limit(3).withColumn("listed", F.lit(None)))
    cascades = urlfilter.fit(twice, F.col("key"), F.col("listed"))
    marked = cascades.mark(keys.union(spark.createDataFrame([(None, False)], "key string, listed boolean")), F.col("key"), "found")
    assert marked.where("found <> listed").count() == 0
    levels = cascades.shards[0].levels
    assert len(levels) >= {0: 0, 1: 1, 50: 3, 1000: 0}[share] and (levels or share in (0, 1000))
    # about as small as the entropy of the listing allows, up to whole blocks
    assert cascades.shards[0].size <= 60 * share * 2 + len(levels) * urlfilter.BLOCK_BITS / 8


def test_cascade_without_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(none, [], F.lit(True)).count() == 0
