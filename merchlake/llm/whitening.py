"""Whitening of embeddings by shifted CholeskyQR.

Components become whole numbers, ``x = floor(64 * c) + 1000000``. Counts and sums of them are exact.

*Factors.* A pass over the rows centres them, carries them through triangular solves with the factors so far and sums
their Gram matrix; its Cholesky factor is the next R. The first Gram matrix is shifted, so that rounding cannot break its
factor down; a later one only where it is far from the identity. When the rows have become orthonormal, the product
``R = R_k .. R_1`` is that of a QR decomposition, although no row was ever moved. The singular value decomposition of R
gives the components (right vectors) and their variances (squared values by the number of rows), without squaring the
condition of the data as an eigendecomposition of the covariance would.

*Size.* A task sends one Gram matrix, d x d numbers, whatever number of rows it has read; they are added up before they
meet. Only d x d numbers reach the driver and the tasks. Rows are not shuffled, so equal vectors, however many, do no harm.

Takes no part: a vector that is null, holds null or non-finite components or one of 2^55 or more, or has another length
than most (of equally frequent lengths the longer counts). Repeated rows and repeated or null ids count and come out
each. Components are those of a variance above rounding: a table of one row, or of equal ones, has none, and an empty
table gives an empty result. Signs are those that make a component's largest entry positive. Long texts and other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from merchlake.llm.components import saved

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Rows whose Gram matrix is formed by one product.
BLOCK_ROWS = 4096
#: A component counts if its standard deviation is more than this share of the largest.
RANK_TOLERANCE = 1e-12
_LARGEST = 2.0**55
_LEAST_PASSES, _MOST_PASSES = 3, 8
_UNIT = float(np.finfo(float).eps) / 2


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that take part if their length is right, and all components one after the other."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    return lengths, column.flatten().to_numpy(zero_copy_only=False).astype(float)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, values = _vectors(batch.column(1))
        good = np.abs(values) < _LARGEST  # false for NaN, which nulls have become
        ends = np.cumsum(lengths.clip(0))
        whole = np.concatenate(([0], np.cumsum(good)))
        keep = (lengths > 0) & (whole[ends] - whole[ends - lengths.clip(0)] == lengths)
        x = (np.floor(np.where(good, values, 0) * SCALE)).astype(np.int64) + OFFSET
        kept = x[np.repeat(keep, lengths.clip(0))]
        offsets = np.concatenate(([0], np.cumsum(lengths[keep]))).astype(np.int32)
        rows = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows),
                pa.array(lengths[keep], pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept)),
            ],
            names=["id", "width", "x"],
        )


def whole_numbers(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``width`` and ``x`` of the vectors that take part, of one length; written once and read by each pass."""
    kind = embeddings.select(id_col).schema[0].dataType.simpleString()
    given = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = saved(given.mapInArrow(_integers, f"id {kind}, width int, x array<bigint>"), "whitening")
    usual = rows.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.col("width") == (usual["width"] if usual else 0))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Integer vectors, many rows at a time."""
    held, rows = [], 0
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        held.append(x)
        rows += len(x)
        if rows >= BLOCK_ROWS:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in _blocks(batches, width):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            totals = [Decimal((int(a) << 32) + int(b)) for a, b in zip(high, low)]
            columns = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(totals, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "total"])

    found = rows.select("x").mapInArrow(run, "dim int, n long, total decimal(38,0)")
    per_dim = {r["dim"]: r for r in found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    if not per_dim:
        return 0, [0] * width
    return per_dim[0]["n"], [int(per_dim[j]["total"]) for j in range(width)]


def _matrix_sum(rows: DataFrame, width: int, of_block: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of a ``size`` x ``size`` matrix of every block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, width):
            part = of_block(x)
            total = part if total is None else total + part
        if total is not None:
            columns = [pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "row"])

    parts = rows.select("x").mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((size, size))
    for r in cells.collect():
        out[r["i"], r["j"]] = r["value"]
    return out


def solve_rows(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular factor, column after column."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def next_factor(gram: np.ndarray, first: bool) -> np.ndarray:
    """Upper Cholesky factor of a Gram matrix, shifted where that is the first one or ill-conditioned."""
    width = len(gram)
    values = np.linalg.eigvalsh(gram)
    shift = 11 * (BLOCK_ROWS * width + width * (width + 1)) * _UNIT * values[-1]
    if first or values[0] < 0.5:
        gram = gram + max(shift, np.finfo(float).tiny) * np.eye(width)
    return np.linalg.cholesky(gram).T


@dataclass
class Fit:
    """What the rows of a table have in common."""

    n: int
    sums: list[int]
    #: One column per component: unit vectors, and the variance along each.
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0
    base: np.ndarray = field(init=False)
    rest: list[int] = field(init=False)

    def __post_init__(self):
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s % self.n for s in self.sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the sum of ``(n * x - sum)^2``, as whole numbers of any size."""
        y = x - self.base
        # Expanded, only the last step of a row leaves 64 bits unless components or the table are huge.
        reach = max(int(np.abs(y).max(initial=0)), 1)
        small = reach * max(reach, self.n) * len(self.sums) < 1 << 62
        y = y if small else y.astype(object)
        rest = np.array(self.rest, np.int64 if small else object)
        own, across = (y * y).sum(axis=1).tolist(), (y @ rest).tolist()
        constant = sum(r * r for r in self.rest)
        return [self.n * (self.n * a - 2 * b) + constant for a, b in zip(own, across)]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the rows ``x`` of one ``width``; none for an empty table."""
    some = rows.select("width").first()
    if some is None:
        return None
    width = some["width"]
    n, sums = exact_sums(rows, width)
    plain = Fit(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    factors: list[np.ndarray] = []

    def gram(x: np.ndarray) -> np.ndarray:
        q = plain.centred(x)
        for factor in factors:
            q = solve_rows(q, factor)
        return q.T @ q

    while True:
        current = _matrix_sum(rows, width, gram, width)
        if not current.any():
            # No variance, or none that is left.
            break
        factors.append(next_factor(current, not factors))
        values = np.linalg.eigvalsh(current)
        # Directions without variance stay near zero and shrink with every factor.
        settled = (np.abs(values - 1) < 1e-8) | (values < 1e-20)
        if len(factors) >= _MOST_PASSES or (len(factors) >= _LEAST_PASSES and settled.all()):
            break
    product = np.eye(width) if factors else np.zeros((width, width))
    for factor in factors:
        product = factor @ product
    _, lengths, right = np.linalg.svd(product)
    live = int((lengths > RANK_TOLERANCE * lengths[0]).sum()) if lengths[0] > 0 else 0
    vectors = right[: min(live, components)].T
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    found = Fit(n, sums, vectors, lengths[: vectors.shape[1]] ** 2 / n, float((lengths**2).sum()) / n)

    size = vectors.shape[1] + 1
    if size > 1:

        def products(x: np.ndarray) -> np.ndarray:
            w = np.column_stack([found.whitened(x), np.ones(len(x))])
            return w.T @ w

        moments = _matrix_sum(rows, width, products, size) / n
        means = moments[:-1, -1]
        found.identity_error = float(np.abs(moments[:-1, :-1] - np.outer(means, means) - np.eye(size - 1)).max())
    return found


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: ``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``. A deviation is null beyond 38 digits."""
    spark = embeddings.sparkSession
    rows = whole_numbers(embeddings, id_col, vector_col)
    rest = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = StructType([rows.schema["id"], *StructType.fromDDL(rest).fields])
    found = fit(rows, components)
    if found is None or not found.components.shape[1]:
        return spark.createDataFrame([], schema)
    width, count = found.components.shape
    arrow = to_arrow_schema(schema)
    explained = found.variances / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(size, width)
            each = pa.array(np.repeat(np.arange(size), count))
            exact = [Decimal(v) if v < 10**38 else None for v in found.deviations(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(each),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, found.n, np.int64)),
                    pa.array(exact, pa.decimal128(38, 0)).take(each),
                    pa.array(found.whitened(x).ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * count, found.identity_error)),
                ],
                schema=arrow,
            )

    return rows.select("id", "x").mapInArrow(run, schema)
