"""Integer vectors: embeddings quantised to whole numbers and packed small.

A component c becomes floor(256 * c), c as double. The numbers of a vector are
packed in the fewest of 1, 2, 4 or 8 bytes that hold all of them, after one
byte that names this width, so equal vectors have equal bytes.

Defined cases: a null or empty vector, or one with a null or non-finite
component, gives no row. Numbers beyond 2**62 stop there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
_LIMIT = float(1 << 62)
_WIDTHS = (1, 2, 4, 8)


def pack(numbers: np.ndarray) -> list[bytes]:
    """One byte string for each row of a matrix of int64."""
    top = np.maximum(numbers.max(axis=1), -1 - numbers.min(axis=1))
    out: list[bytes] = [b""] * len(numbers)
    done = np.zeros(len(numbers), bool)
    for width in _WIDTHS:
        fits = np.nonzero(~done & (top < (1 << (8 * width - 1))))[0]
        done[fits] = True
        small = numbers[fits].astype(f"<i{width}")
        for place, row in zip(fits.tolist(), small):
            out[place] = bytes((width,)) + row.tobytes()
    return out


def unpack(packed: Sequence[bytes]) -> np.ndarray:
    """The matrix of int64 of packed vectors of one length."""
    widths = np.array([b[0] for b in packed])
    dims = (len(packed[0]) - 1) // int(widths[0]) if len(packed) else 0
    out = np.empty((len(packed), dims), np.int64)
    for width in np.unique(widths):
        rows = np.nonzero(widths == width)[0]
        joined = b"".join(packed[r] for r in rows.tolist())
        out[rows] = np.frombuffer(joined, np.uint8).reshape(len(rows), -1)[:, 1:].copy().view(f"<i{width}")
    return out


def integer_vectors(rows: DataFrame, vector: Column, keep: dict[str, tuple[Column, str]]) -> DataFrame:
    """The columns of ``keep`` (name: column, type), with x (packed) and dims of each usable vector."""
    usable = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    names = list(keep)
    taken = rows.select(*[c.cast(kind).alias(name) for name, (c, kind) in keep.items()], vector.cast("array<double>").alias("_v"))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            with np.errstate(over="ignore"):
                numbers = np.clip(np.floor(SCALE * values), -_LIMIT, _LIMIT).astype(np.int64)
            packed = np.empty(len(sizes), object)
            for size in np.unique(sizes):
                of = np.nonzero(sizes == size)[0]
                packed[of] = pack(numbers[starts[of][:, None] + np.arange(size)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in names], pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())],
                names=[*names, "x", "dims"])

    schema = ", ".join(f"{name} {kind}" for name, (_, kind) in keep.items()) + ", x binary, dims int"
    return taken.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & usable).mapInArrow(quantise, schema)


def usual_dims(coded: DataFrame) -> int:
    """The most frequent length, of several the largest; 0 without rows."""
    first = coded.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    return first["dims"] if first else 0
