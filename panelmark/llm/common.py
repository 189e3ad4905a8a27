"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a process-wide store for models that Python workers build once
_BUILT: dict[str, object] = {}


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` (of any case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def built(key: str, make: Callable[[], object]) -> object:
    """The object of this key, made at first use in a worker; older ones go."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


def text_udf(schema: str, start: Callable[[], Callable[[str | None], tuple]]) -> Callable[[Column], Column]:
    """A pandas UDF from one text to one struct.

    ``start`` runs once per task and gives the function of one text. Texts are
    worked on one at a time, so memory is bounded by the longest one.
    """
    names = re.findall(r"(?:^|, )(\w+) ", schema)

    @F.pandas_udf(schema)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = start()
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=names)

    return apply


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() parts at just these six bytes."""
    return text.encode("utf-8", "surrogatepass").split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    array = np.empty(len(words), object)
    array[:] = words
    return pd.util.hash_array(array, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads a 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: an odd multiplier and its inverse modulo 2**64, for rolling sums
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                factors = np.full(max(n, 1 << 15), base, np.uint64)
                factors[0] = 1
                _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes; equal runs get equal values at any place."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(hashes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mix((total[width:] - total[:n]) * down[:n])
