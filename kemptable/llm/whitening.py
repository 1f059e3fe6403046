"""Embedding whitening by shifted CholeskyQR.

The centred vectors are orthogonalised by passes over the table: each pass
solves the rows against the triangular factors found so far, adds up their
Gram matrix, and takes its Cholesky factor. The product of the factors is the R
of a QR decomposition, and the singular value decomposition of R gives the
components. A Gram matrix squares the condition of its vectors, so each pass
that needs it shifts the diagonal by a little; the passes after it mend what
the shift changed. Only matrices of (dimensions x dimensions) leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Entries are scaled by this and moved by that before they are cut to whole numbers.
SCALE, MOVED = 64, 1_000_000
# Components that are returned.
COMPONENTS = 32
# Vectors that a task works on at once.
BLOCK_ROWS = 4096
# Gram passes at most; three reach working precision whatever the condition.
PASSES = 5
# A pass whose Gram matrix differs from the identity by less ends the iteration.
ORTHOGONAL = 1e-12
# Components whose variance is below this share of the largest are constant directions and left out.
LEAST_SHARE = 1e-20
# Whole numbers stay within this, so that sums over any table are exact; larger entries are held at the bound.
BOUND = float(1 << 53)
_UNIT = np.finfo(float).eps / 2


@dataclass(frozen=True)
class Centre:
    """Number of fitted vectors and, per dimension, the exact sum of their whole numbers."""

    n: int
    sums: tuple[int, ...]

    @property
    def middle(self) -> np.ndarray:
        """Whole numbers next to the means; differences to them stay small."""
        return np.array([s // self.n for s in self.sums], np.int64)

    def deviations(self, whole: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit where they surely fit, Python's integers otherwise."""
        near, rest = whole - self.middle, [s - self.n * (s // self.n) for s in self.sums]
        most = int(np.abs(near).max(initial=0))
        kind = np.int64 if (most + 1) * self.n < 1 << 62 else object
        return near.astype(kind) * self.n - np.array(rest, kind)

    def centred(self, whole: np.ndarray) -> np.ndarray:
        """x - S/n as doubles."""
        return (self.deviations(whole) / self.n).astype(float)


@dataclass(frozen=True)
class Whitening:
    """A fitted model: ``axes`` has a column per component, ``variances`` fall, ``total`` is the trace of the covariance."""

    centre: Centre
    axes: np.ndarray
    variances: np.ndarray
    total: float

    def whitened(self, whole: np.ndarray) -> np.ndarray:
        return self.centre.centred(whole) @ self.axes / np.sqrt(self.variances)


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, entries as doubles) of rows that have a vector without null, NaN or infinite entries and at least one entry."""
    values = F.col(f"`{column}`").cast("array<double>")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(f"`{id_column}`").alias("vec_id"), values.alias("entries")).filter(
        F.col("entries").isNotNull() & sound & (F.size("entries") > 0)
    )


def _dimensions(found: DataFrame) -> int:
    """The length that most vectors have, the longer one on a tie; 0 without vectors."""
    row = found.groupBy(F.size("entries").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else 0


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """Whole numbers of a batch, one row per vector."""
    entries = batch.column(batch.schema.get_field_index("entries"))
    values = entries.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    moved = np.floor(values * SCALE) + MOVED
    return np.clip(moved, -BOUND, BOUND).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(first, BLOCK_ROWS)
            yield part, _matrix(part, d)


def _added(tables: DataFrame, schema: str) -> DataFrame:
    """Rows (i, values) of many tasks added up for each i, in two steps so that no task gets all of them."""
    tasks = F.spark_partition_id() % 256

    def add(table: pa.Table) -> pa.Table:
        i = table.column("i")[0].as_py()
        total = np.sum([np.asarray(x, float) for x in table.column("values").to_pylist()], axis=0)
        return pa.table({"i": pa.array([i], pa.int32()), "values": pa.array([total.tolist()], pa.list_(pa.float64()))})

    some = tables.withColumn("task", tasks).groupBy("i", "task").applyInArrow(add, schema)
    return some.groupBy("i").applyInArrow(add, schema)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Rows times the inverse of an upper triangular factor, by forward substitution over the columns."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def fit_centre(found: DataFrame, d: int) -> Centre:
    """Count and exact sums, from one pass."""

    def sums(batches):
        n, total = 0, [0] * d
        for part, whole in _blocks(batches, d):
            n += part.num_rows
            small = np.abs(whole).max() < 1 << 48
            part_sums = (whole if small else whole.astype(object)).sum(axis=0)
            total = [a + b for a, b in zip(total, part_sums.tolist())]
        if n:
            yield pa.RecordBatch.from_pydict(
                {"i": list(range(d)), "n": [n] * d, "total": [str(t) for t in total]},
                pa.schema([("i", pa.int32()), ("n", pa.int64()), ("total", pa.string())]),
            )

    rows = (
        found.mapInArrow(sums, "i int, n long, total string")
        .groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    ordered = sorted(rows, key=lambda r: r["i"])
    return Centre(ordered[0]["n"], tuple(int(r["total"]) for r in ordered))


def _gram(found: DataFrame, d: int, centre: Centre, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows solved against the factors in turn, from one pass."""

    def partial(batches):
        gram, seen = np.zeros((d, d)), False
        for _, whole in _blocks(batches, d):
            rows = centre.centred(whole)
            for factor in factors:
                rows = solved(rows, factor)
            gram += rows.T @ rows
            seen = True
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"i": list(range(d)), "values": gram.tolist()},
                pa.schema([("i", pa.int32()), ("values", pa.list_(pa.float64()))]),
            )

    schema = "i int, values array<double>"
    rows = _added(found.mapInArrow(partial, schema), schema).collect()
    gram = np.array([r["values"] for r in sorted(rows, key=lambda r: r["i"])])
    return (gram + gram.T) / 2


def shifted_factor(gram: np.ndarray) -> np.ndarray:
    """Upper Cholesky factor; the diagonal is shifted where the matrix is too close to singular without.

    The shift is the bound of what rounding may have done to a Gram matrix that
    was added up in blocks, as a share of its trace.
    """
    d = gram.shape[0]
    try:
        factor = np.linalg.cholesky(gram).T
        if np.diag(factor).min() > 1e-6 * np.diag(factor).max():
            return factor
    except np.linalg.LinAlgError:
        pass
    shift = 11 * (BLOCK_ROWS + d) * d * _UNIT * np.trace(gram) / d
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit_whitening(found: DataFrame, d: int, most: int = COMPONENTS) -> Whitening:
    """Components of the vectors, from one pass for the sums and two to five Gram passes.

    Unit eigenvectors of the covariance (divisor n) by falling variance; the
    largest entry of each is positive. Directions without variance are left out.
    """
    centre = fit_centre(found, d)
    factors: list[np.ndarray] = []
    product, total = np.eye(d), 0.0
    for _ in range(PASSES):
        gram = _gram(found, d, centre, factors)
        if not factors:
            total = float(np.trace(gram)) / centre.n
            if total == 0:
                return Whitening(centre, np.zeros((d, 0)), np.zeros(0), 0.0)
        elif np.abs(gram - np.eye(d)).max() < ORTHOGONAL:
            break
        factors.append(shifted_factor(gram))
        product = factors[-1] @ product
    _, singular, axes = np.linalg.svd(product)
    variances = singular**2 / centre.n
    kept = min(most, int((variances > LEAST_SHARE * variances[0]).sum()))
    axes = axes[:kept].T
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    return Whitening(centre, axes * signs, variances[:kept], total)


def identity_error(found: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity.

    Every block is centred before it is multiplied, and blocks are put together
    by their means, in one pass.
    """
    k = model.axes.shape[1]
    if k == 0:
        return 0.0

    def partial(batches):
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for _, whole in _blocks(batches, d):
            rows = model.whitened(whole)
            own = rows.mean(axis=0)
            apart, both = own - mean, n + len(rows)
            spread += (rows - own).T @ (rows - own) + np.outer(apart, apart) * (n * len(rows) / both)
            mean, n = mean + apart * (len(rows) / both), both
        if n:
            # What the tasks' means differ by: n, n * mean and n * mean * mean', next to zero means.
            table = np.vstack([spread + n * np.outer(mean, mean), n * mean, np.full(k, float(n))])
            yield pa.RecordBatch.from_pydict(
                {"i": list(range(k + 2)), "values": table.tolist()},
                pa.schema([("i", pa.int32()), ("values", pa.list_(pa.float64()))]),
            )

    schema = "i int, values array<double>"
    rows = _added(found.mapInArrow(partial, schema), schema).collect()
    table = np.array([r["values"] for r in sorted(rows, key=lambda r: r["i"])])
    n, mean = table[k + 1, 0], table[k] / table[k + 1, 0]
    return float(np.abs(table[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened_vectors(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries take no
    part, nor do vectors of another length than most have. Entries beyond 2^53
    after scaling are held there. Rows with the same id are kept as they are.
    ``deviation`` is null where it passes 64 bits. A table without vectors, or
    whose vectors are all equal, gives no rows, for it has no components.
    """
    types = f"vec_id {vectors.schema[id_column].dataType.simpleString()}"
    schema = f"{types}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = whole_vectors(vectors, id_column, column)
    d = _dimensions(found)
    if d == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    found = found.filter(F.size("entries") == d)
    model = fit_whitening(found, d, most)
    k = model.axes.shape[1]
    if k == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    error, explained = identity_error(found, d, model), model.variances / model.total

    def project(batches):
        for part, whole in _blocks(batches, d):
            rows, away = part.num_rows, model.centre.deviations(whole)
            most = int(np.abs(away).max(initial=0))
            squares = away if away.dtype == object or most * most * d < 1 << 62 else away.astype(object)
            sums = (squares * squares).sum(axis=1).tolist()
            sums = [s if s < 1 << 63 else None for s in sums]
            ids = part.column(part.schema.get_field_index("vec_id"))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.centre.n, np.int64)),
                    pa.array(sums, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(model.whitened(whole).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return found.mapInArrow(project, schema)
