"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 < 1 < ... < K share one weight vector; each step between
grades has its own threshold: P(grade >= k) = sigmoid(w.x - t_k), with the
thresholds in order. The output is the expected severity, the sum of these
chances, and a text is rejected if P(grade >= 1) is 0.5 or more.

Features are words of the lower-cased text and their first four to six
letters, present or absent, and such stems used twice or four times. A bounded sample of labelled rows is fitted:
features that speak for a higher grade are picked by their log-likelihood
ratio, and the weights follow from gradient steps on the ordinal likelihood. Labels of two grades (not toxic, toxic) give three: toxic texts with
more evidence in them than half of the toxic ones have are the severe ones.

Defined cases: a null or empty text has no feature, so it gets the base
severity of the model and is kept. Without labelled rows, or with one grade
only, nothing is known: severity 0, all kept. Rows that repeat are judged
alike; labels that repeat an id count once, with their highest grade. Texts
are read whole.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import free_name, text_udf
from panelmark.session import cut

_NORMAL = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
STEMS = (4, 5, 6)
OFTEN = (2, 4)
SCHEMA = "severity double, toxic_chance double, rejected boolean"


def words_of(text: str) -> list[str]:
    """Words of two letters or more, lower case."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(_NORMAL).decode("utf-8", "replace")
    return [w for w in data.split(" ") if len(w) > 1]


def features_of(words: Counter) -> set[str]:
    """The words, their stems with a star, and the stems used twice or four times."""
    stems: Counter = Counter()
    for word, n in words.items():
        for size in STEMS:
            if len(word) >= size:
                stems[word[:size] + "*"] += n
    found = set(words) | set(stems)
    for often in OFTEN:
        found.update(f"{stem}{often}" for stem, n in stems.items() if n >= often)
    return found


def features(text: str | None) -> set[str]:
    return features_of(Counter(words_of(text))) if text else set()


def _sample(labelled: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows at most, by a hash of the text."""
    rows = labelled.count()
    if rows <= limit:
        return labelled
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(1 << 30)
    return labelled.where(draw < limit / rows)


def fit(
    labelled: DataFrame, sample: int = 20_000, max_features: int = 2000, min_docs: int = 4, min_gain: float = 15.0,
    penalty: float = 0.1, steps: int = 500,
) -> dict:
    """Learns from ``labelled`` (text, grade); grades are small integers from 0.

    ``sample`` bounds the rows used, ``max_features`` what the model holds.
    Counting features runs in tasks; only the picked ones and their places in
    the sample come to the driver.
    """
    rows = labelled.select(F.col("text").cast("string"), F.col("grade").cast("int")).where("text IS NOT NULL AND grade IS NOT NULL")
    rows = cut(_sample(rows, sample))  # a bounded table, read four times
    sizes = {r[0]: r[1] for r in rows.groupBy("grade").count().collect()}
    grades = sorted(sizes)
    empty = {"weights": {}, "thresholds": [], "key": uuid.uuid4().hex}
    if len(grades) < 2:
        return empty
    n_low, n_high = sizes[grades[0]], sum(sizes[g] for g in grades[1:])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low, high = Counter(), Counter()
            for text, grade in zip(batch["text"], batch["grade"]):
                (high if grade > grades[0] else low).update(features(text))
            names = list(low.keys() | high.keys())
            yield pd.DataFrame({"feature": names, "low": [low[f] for f in names], "high": [high[f] for f in names]})

    counted = rows.mapInPandas(count, "feature string, low long, high long").groupBy("feature").agg(
        F.sum("low").alias("low"), F.sum("high").alias("high"))
    # the log-likelihood ratio of "present" against the grade, for features that speak for the higher ones
    share = F.lit(n_high / (n_low + n_high))
    both = F.col("low") + F.col("high")
    own = F.col("high") / both
    gain = 2 * (F.col("high") * F.log(own / share) + F.when(F.col("low") > 0, F.col("low") * F.log((1 - own) / (1 - share))).otherwise(0.0))
    picked = (
        counted.where((F.col("high") >= min_docs) & (own > 2 * share) | (F.col("high") >= min_docs) & (own > 0.9))
        .withColumn("gain", gain).where(F.col("gain") >= min_gain)
        .orderBy(F.desc("gain"), "feature").limit(max_features)
    )
    names = [r[0] for r in picked.select("feature").collect()]
    if not names:
        return empty
    place = {f: i for i, f in enumerate(names)}

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "grade": batch["grade"],
                "marks": [sorted(place[f] for f in features(t) if f in place) for t in batch["text"]]})

    # rows with equal features and grade are one row with a weight
    found = rows.mapInPandas(mark, "grade int, marks array<int>").groupBy("grade", "marks").count().collect()
    x = [np.array(r[1], np.int64) for r in found]
    y = np.array([grades.index(r[0]) for r in found])
    n = np.array([r[2] for r in found], float)
    if len(grades) == 2:
        # labels that only say yes or no: a "yes" with more evidence than half of them have is the graver grade
        amount = np.array([len(v) for v in x])
        yes = np.repeat(amount[y == 1], n[y == 1].astype(int))
        middle = min(np.median(yes), max(yes[yes < yes.max()], default=yes.max()))
        y = np.where((y == 1) & (amount > middle), 2, y)
    weights, thresholds = _solve(x, y, n, len(names), max(len(grades), int(y.max()) + 1), penalty, steps)
    return {"weights": {f: float(w) for f, w in zip(names, weights) if w}, "thresholds": thresholds.tolist(),
            "grades": grades, "key": uuid.uuid4().hex}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _solve(x, y, n, n_features, n_grades, penalty, steps, rate=0.05):
    """Adam on the ridge-penalised ordinal likelihood; weights are never negative (a feature is evidence for a higher grade)."""
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    column = np.concatenate(x) if len(row) else np.empty(0, np.int64)
    above = np.array([(n * (y > k)).sum() for k in range(n_grades - 1)])
    cuts = np.sort(-np.log((above + 0.5) / (n.sum() - above + 0.5)))
    w = np.zeros(n_features)
    first, second = np.zeros(n_features + len(cuts)), np.zeros(n_features + len(cuts))
    for step in range(1, steps + 1):
        score = np.bincount(row, w[column], len(x))
        # each row's grade lies between two thresholds: P = sigmoid(s - lower) - sigmoid(s - upper)
        lower = _sigmoid(score - np.concatenate([[-60.0], cuts])[y])
        upper = _sigmoid(score - np.concatenate([cuts, [60.0]])[y])
        chance = np.maximum(lower - upper, 1e-9)
        slope_low, slope_up = lower * (1 - lower) / chance, upper * (1 - upper) / chance
        cut_pull = np.zeros(n_grades + 1)
        np.add.at(cut_pull, y, -n * slope_low)
        np.add.at(cut_pull, y + 1, n * slope_up)
        pull = np.bincount(column, (n * (slope_low - slope_up))[row], n_features) - penalty * w
        gradient = np.concatenate([pull, cut_pull[1:-1]])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w = np.maximum(w + move[:n_features], 0.0)
        cuts = np.maximum.accumulate(cuts + move[n_features:])
    return w, cuts


def judge(text: str | None, weights: dict[str, float], thresholds: list[float], heads: set[str]) -> tuple:
    """``heads``: the first letters of all weighted features; other words need no look."""
    if not thresholds:
        return 0.0, 0.0, False
    size = min(STEMS)
    words = Counter(w for w in words_of(text) if w[:size] in heads) if text else Counter()
    score = math.fsum(weights[f] for f in features_of(words) & weights.keys()) if words else 0.0
    chances = [1.0 / (1.0 + math.exp(min(700.0, t - score))) for t in thresholds]
    return math.fsum(chances), chances[0], bool(text) and chances[0] >= 0.5


def scorer(docs: DataFrame, model: dict):
    """The column function from a text to SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["thresholds"]))

    def start():
        weights, thresholds = shared.value
        heads = {f.rstrip("*24")[:min(STEMS)] for f in weights}
        return lambda text: judge(text, weights, thresholds, heads)

    return text_udf(SCHEMA, start)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of ``docs``: doc_id and SCHEMA."""
    return docs.select("doc_id", scorer(docs, model)(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def keep_harmless(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    name = free_name(docs, "_found")
    judged = docs.withColumn(name, scorer(docs, model)(F.col("text").cast("string")))
    return judged.where(~F.col(name)["rejected"]).drop(name)


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, grade) of the labelled documents; the labels know toxic (1) or not (0)."""
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("grade"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(marks, "doc_id").select("text", "grade")
