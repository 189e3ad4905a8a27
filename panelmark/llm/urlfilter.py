"""URL filters: rules by host and path, and a Bloom filter cascade for long lists.

The cascade stores which keys of a complete universe are listed. Level 1 is a
Bloom filter of the listed keys, level 2 one of the unlisted keys that level 1
takes in, level 3 one of the listed keys that level 2 takes in, and so on until
no key is taken in wrongly. A key is looked up level by level; the first filter
that does not know it decides: level 1, 3, ... says unlisted, level 2, 4, ...
says listed. For keys of the universe the answer is exact, and a lookup needs
neither a join nor the list. For other keys nothing is promised.

A filter is cut into blocks of ``BLOCK_BITS`` bits, and a key sets bits of one
block only. So building shuffles each key once, to its block, and no filters
have to be merged. Keys are distinct and their blocks hashed, so no key or
block is hot. If the filters may outgrow ``max_bytes``, keys are dealt into
shards with a cascade each; each shard is built and broadcast by itself, and a
lookup scans the rows once for each shard, taking only its own rows.

Keys are compared by 128 bits of hash; should a listed and an unlisted key
agree in all of them, no cascade exists and building fails.

Defined cases: a null url, or one without ``://``, has an empty host and path.
A null key is unlisted. Without listed keys all is unlisted, without unlisted
ones all keys are listed. Repeated rows are judged alike. A key that is both
listed and unlisted in the given universe is listed. Empty tables give no rows.
Other columns are passed through; made columns replace those of their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import free_name, mix
from panelmark.session import cut

BLOCK_BITS = 4096
#: chance that a later level takes in a wrong key
RATE = 1 / 16
MAX_BYTES = 64 << 20
MAX_LEVELS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the fitting rule with the longest host, of several the longest path; null if none fits."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host), len(r.path))):
        text = F.when(rule.fits(host, path), F.lit(rule.host + rule.path)).otherwise(text)
        verdict = F.when(rule.fits(host, path), F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    number: int
    blocks: int
    hashes: int
    bits: bytes = b""

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each key, and its bits there."""
        with np.errstate(over="ignore"):
            salt = np.uint64(self.number + 1) * np.uint64(0x9E3779B97F4A7C15)
            block = mix(h1 + salt) % np.uint64(self.blocks)
            seed = mix(h2 ^ mix(h1 ^ salt))
            step = (seed >> np.uint64(32)) | np.uint64(1)
            bits = (seed[:, None] + step[:, None] * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(BLOCK_BITS)
        return block.astype(np.int64), bits.astype(np.int64)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        block, bits = self.places(h1, h2)
        at = block[:, None] * BLOCK_BITS + bits
        filled = np.frombuffer(self.bits, np.uint8)
        return (filled[at >> 3] >> (at & 7) & 1).all(axis=1)


@dataclass(frozen=True)
class Cascade:
    """The levels of one shard; ``default`` is the answer where no filter denies a key."""

    levels: tuple[Level, ...]
    default: bool

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(h1), self.default), np.arange(len(h1))
        for level in self.levels:
            known = level.holds(h1[open_], h2[open_])
            out[open_[~known]] = level.number % 2 == 1
            open_ = open_[known]
        return out

    @property
    def size(self) -> int:
        return sum(len(level.bits) for level in self.levels)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("cascade"), key)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))


def _filter_of(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """The Bloom filter of n keys (h1, h2), each block built where its keys meet."""
    bits = max(1.0, -math.log2(rate)) / math.log(2)
    level = Level(number, max(1, math.ceil(n * bits / BLOCK_BITS)), max(1, round(bits * math.log(2))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, _ = level.places(*_words(batch))
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("h1"), batch.column("h2")], names=["block", "h1", "h2"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bits_ = level.places(*_words(batch))
            order = np.argsort(block, kind="stable")
            for of in np.split(order, np.nonzero(np.diff(block[order]))[0] + 1) if len(order) else ():
                there = made.setdefault(int(block[of[0]]), np.zeros(BLOCK_BITS, bool))
                there[bits_[of].ravel()] = True
        yield pa.RecordBatch.from_arrays([
            pa.array(list(made), pa.int64()),
            pa.array([np.packbits(b, bitorder="little").tobytes() for b in made.values()], pa.binary())], names=["block", "bits"])

    dealt = keys.select("h1", "h2").mapInArrow(deal, "block long, h1 long, h2 long").repartition("block")
    whole = bytearray(level.blocks * BLOCK_BITS // 8)
    for block, filled in dealt.mapInArrow(fill, "block long, bits binary").collect():
        at = block * BLOCK_BITS // 8
        whole[at:at + BLOCK_BITS // 8] = filled
    return Level(level.number, level.blocks, level.hashes, bytes(whole))


def _taken_in(keys: DataFrame, level: Level) -> DataFrame:
    stored = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(stored.value.holds(*_words(batch))))

    return cut(keys.mapInArrow(keep, "h1 long, h2 long"))


def _first_rate(listed: int, others: int) -> float:
    """Rate of level 1: as many wrong keys should be left as are worth storing in level 2."""
    return min(0.5, max(2.0**-20, listed / (others * math.sqrt(2)))) if others else 0.5


def build(keys: DataFrame, rate: float = RATE) -> Cascade:
    """The cascade of distinct keys (h1, h2, listed), level by level."""
    inside, outside = keys.where("listed").select("h1", "h2"), keys.where("NOT listed").select("h1", "h2")
    n, m = inside.count(), outside.count()
    levels: list[Level] = []
    if not n or not m:
        return Cascade((), n > 0)
    chance = _first_rate(n, m)
    while True:
        level = _filter_of(inside, n, chance, len(levels))
        levels.append(level)
        wrong = _taken_in(outside, level)
        found = wrong.count()
        if not found:
            return Cascade(tuple(levels), len(levels) % 2 == 1)
        if len(levels) == MAX_LEVELS:
            raise ValueError("a listed and an unlisted key have equal hashes")
        inside, outside, n, chance = wrong, inside, found, rate


@dataclass(frozen=True)
class Cascades:
    """One cascade for each shard of the keys."""

    shards: tuple[Cascade, ...]

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` with the boolean column ``name``: is the key listed?"""
        h1, h2 = _hashes(key)
        shard = _shard(h1, h2, len(self.shards))
        marked = []
        for number, cascade in enumerate(self.shards):
            own = rows if len(self.shards) == 1 else rows.where(shard == number)
            if cascade.levels:
                said = F.coalesce(key.isNotNull() & _lookup(rows, cascade)(h1, h2), F.lit(False))
            else:
                said = key.isNotNull() & F.lit(cascade.default)
            marked.append(own.withColumn(name, said))
        return reduce(DataFrame.unionByName, marked)


def _shard(h1: Column, h2: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(h1, h2), F.lit(shards).cast("long"))


def _lookup(rows: DataFrame, cascade: Cascade):
    stored = rows.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def look_up(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(stored.value.listed(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)))

    return look_up


def fit(universe: DataFrame, key: Column, listed: Column, rate: float = RATE, max_bytes: int = MAX_BYTES) -> Cascades:
    """Cascades of all keys of ``universe``; a key is listed if any of its rows is."""
    distinct = universe.select(key.cast("string").alias("key"), F.coalesce(listed, F.lit(False)).alias("listed")).where("key IS NOT NULL")
    distinct = distinct.groupBy("key").agg(F.max("listed").alias("listed"))
    h1, h2 = _hashes(F.col("key"))
    keys = cut(distinct.select(h1.alias("h1"), h2.alias("h2"), "listed"))
    n, m = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    # level 1, and as much again for all levels behind it, with half as much to spare
    expected = 3 * n * -math.log2(_first_rate(n, m)) / math.log(2) / 8
    shards = max(1, math.ceil(expected / max_bytes))
    if shards == 1:
        return Cascades((build(keys, rate),))
    at = _shard(F.col("h1"), F.col("h2"), shards)
    return Cascades(tuple(build(keys.where(at == s), rate) for s in range(shards)))


def judge(pages: DataFrame, rules: Sequence[Rule], listed: Column, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict.

    ``listed`` says of a row with host and path whether its key (host and path
    together) is on the list. A rule decides before the list.
    """
    host, path = url_parts(F.col("url"))
    own = free_name(pages, "_key")
    split = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    split = split.withColumn(own, F.concat("host", "path"))
    cascades = fit(split, F.col(own), listed, max_bytes=max_bytes)
    marked = cascades.mark(split, F.col(own), "listed").drop(own)
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    return marked.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))})
