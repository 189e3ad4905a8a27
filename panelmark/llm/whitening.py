"""Whitening of embeddings by shifted CholeskyQR.

The vectors are quantised to integers x (``vectors``). The fit list holds each
distinct x once. Its centred rows A = x - S/n are orthogonalised without ever
being stored: a Gram pass computes G = Q'Q over the cluster, where Q is A after
triangular solves by the factors found so far, the driver takes the Cholesky
factor of the small matrix G, and the next pass solves by it too. The first
factor is that of G plus a small multiple of the identity, so that it exists
for any condition of A; later ones are shifted only while G is still far from
the identity. The product R of all factors has A = QR with orthonormal Q, so the
singular value decomposition of R gives the components (right singular
vectors) and the eigenvalues of the covariance (squares over n), to the
precision of A itself, not of its squared condition.

A pass sums one matrix of dims x dims in each task and adds these by matrix
row; the driver holds dims x dims numbers (``MAX_DIMS`` checks that). Distinct
vectors are found by one shuffle of packed integers.

Defined cases: rows whose vector is null, empty or holds null or non-finite
entries take no part. Neither do vectors of another length than the most
frequent one among distinct vectors (of several such lengths the largest). Rows
that repeat are each scored, but fitted once. Components with a singular value below
``RANK`` times the first have no scale: their whitened is null, and they are
left out of identity_error (null if no component is left, as with one distinct
vector, when explained is null too). A deviation beyond the range of a long is
null. No usable rows give no rows. A null vec_id is returned as such. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.llm.vectors import integer_vectors, unpack, usual_dims
from panelmark.session import cut

COMPONENTS = 4
MAX_DIMS = 4096
#: Gram passes at most; three are enough unless the vectors are dependent
PASSES = 8
RANK = 1e-12
_CLOSE, _STEEP = 1e-10, 1e-8
#: numbers worked on at once in a task
_CHUNK = 1 << 20


@dataclass
class Whitening:
    dims: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float | None]
    defined: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, numbers: np.ndarray) -> np.ndarray:
        """Rows projected on the defined components, in units of their deviation."""
        kept = self.components[self.defined]
        return (numbers - self.mean) @ kept.T / np.sqrt(self.eigenvalues[self.defined])


def solve_right(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows @ inverse(upper), by substitution from the first column on."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        packed, step = batch.column("x").to_pylist(), max(1, _CHUNK // dims)
        for a in range(0, len(packed), step):
            yield unpack(packed[a:a + step])


def _matrix(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices that come by row (i, row): added where the rows of one i meet, then collected."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(row)
        yield _by_row(total.items())

    out = np.zeros(shape)
    for i, row in parts.repartition("i").mapInArrow(add, "i int, row binary").collect():
        out[i] = np.frombuffer(row)
    return out


def _by_row(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()),
                                       pa.array([r.tobytes() for _, r in rows], pa.binary())], names=["i", "row"])


def gram(fit_list: DataFrame, mean: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Q'Q of the centred rows after the triangular solves by ``factors``."""
    dims = len(mean)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for numbers in _chunks(batches, dims):
            q = numbers - mean
            for upper in factors:
                q = solve_right(q, upper)
            total += q.T @ q
        yield _by_row(enumerate(total))

    return _matrix(fit_list.select("x").mapInArrow(multiply, "i int, row binary"), (dims, dims))


def _root(g: np.ndarray) -> np.ndarray:
    """Some B with B'B = g, for a g that may be singular."""
    values, vectors = np.linalg.eigh(g)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def triangle(fit_list: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows, the product of the factors of all passes."""
    dims = len(mean)
    eye, eps = np.eye(dims), np.finfo(float).eps
    factors: list[np.ndarray] = []
    product = eye
    for number in range(PASSES):
        g = gram(fit_list, mean, factors)
        size = np.trace(g)
        if not size:
            return np.zeros((dims, dims))
        if number and np.abs(g - eye).max() < _CLOSE or number == PASSES - 1:
            return _root(g) @ product
        values = np.linalg.eigvalsh(g)
        shifted = number == 0 or values[0] < _STEEP * values[-1]
        shift = 11 * (_CHUNK + dims * (dims + 1)) * eps * size if shifted else 0.0
        factors.append(np.linalg.cholesky(g + shift * eye).T)
        product = factors[-1] @ product
    raise AssertionError("the last pass returns")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of integer vectors (x, dims); None without any."""
    fit_list = cut(vectors.select("x", "dims").dropDuplicates(["x", "dims"]))
    dims = usual_dims(fit_list)
    if not dims:
        return None
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions; the driver holds a square of at most {MAX_DIMS}")
    fit_list = fit_list.where(F.col("dims") == dims)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, object), 0
        for numbers in _chunks(batches, dims):
            small = np.abs(numbers).max() < 1 << 40
            total += (numbers.sum(axis=0) if small else numbers.astype(object).sum(axis=0)).astype(object)
            n += len(numbers)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(n), *map(str, total)])], names=["i", "v"])

    added = fit_list.select("x").mapInArrow(add_up, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r["i"]: int(r["v"]) for r in added.collect()}
    n, sums = found[-1], [found[i] for i in range(dims)]
    mean = np.array([s / n for s in sums])
    _, singular, right = np.linalg.svd(triangle(fit_list, mean))
    right *= np.where(right[np.arange(dims), np.abs(right).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    kept, trace = min(components, dims), float((singular**2).sum())
    model = Whitening(dims, n, sums, right[:kept], singular[:kept] ** 2 / n,
                      [float(s * s / trace) if trace else None for s in singular[:kept]],
                      (singular[:kept] > RANK * singular[0]) & (singular[0] > 0))
    model.identity_error = _identity_error(fit_list, model)
    return model


def _identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """How far the covariance of the whitened fit list is from the identity, in one more pass."""
    size = int(model.defined.sum())
    if not size:
        return None

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for numbers in _chunks(batches, model.dims):
            w = model.project(numbers)
            total += w.T @ w
        yield _by_row(enumerate(total))

    covariance = _matrix(fit_list.select("x").mapInArrow(multiply, "i int, row binary"), (size, size)) / model.n
    return float(np.abs(covariance - np.eye(size)).max())


def deviations(numbers: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S)**2."""
    top = n * int(np.abs(numbers).max(initial=0)) + max(map(abs, sums), default=0)
    exact = top * top * max(1, len(sums)) < 1 << 63
    away = numbers * n - np.array(sums, np.int64) if exact else numbers.astype(object) * n - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (away * away).sum(axis=1)]


_SCORES = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vector: Column, vec_id: Column, components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: its whitened coordinate and what the fit says of the component."""
    coded = integer_vectors(rows, vector, {"vec_id": (vec_id, "long")})
    model = fit(coded, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], _SCORES)
    names = [c.split()[0] for c in _SCORES.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, step = len(model.components), max(1, _CHUNK // model.dims)
        for whole in batches:
            for a in range(0, len(whole), step):
                batch = whole.slice(a, step)
                numbers = unpack(batch.column("x").to_pylist())
                values = np.full((len(numbers), kept), np.nan)
                values[:, model.defined] = model.project(numbers)
                away = deviations(numbers, model.n, model.sums)
                many = len(numbers)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), many)), pa.array([model.n] * (many * kept), pa.int64()),
                    pa.array([v for v in away for _ in range(kept)], pa.int64()),
                    pa.array(values.ravel(), pa.float64(), mask=np.tile(~model.defined, many)),
                    pa.array(model.explained * many, pa.float64()),
                    pa.array([model.identity_error] * (many * kept), pa.float64())], names=names)

    return coded.where(F.col("dims") == model.dims).select("vec_id", "x").mapInArrow(score, _SCORES)
