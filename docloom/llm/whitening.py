"""Whitening of embeddings by a randomised range finder over all centred rows."""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, lean, materialize

#: Entries are counted in 1/1024 and moved so that they are positive in practice.
SCALE, SHIFT = 1024, 100_000
COMPONENTS, OVERSAMPLE, PASSES, SEED = 8, 8, 4, 42
#: A component's residual over the largest eigenvalue at most; an eigenvalue under FLATTEST of the trace is no component.
RESIDUAL, FLATTEST = 1e-13, 1e-12


def steps(vector: Column) -> Column:
    """A vector's entries as longs: ``floor(1024 * c) + 100000``."""
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & fine


def _rows(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(x: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: type = np.float64) -> np.ndarray:
    """The sum of ``part(rows)`` over all rows of the column ``x``.

    Each task adds up its own rows and hands on one matrix, a row of it a
    record; the records of one place are added in tasks of their own. So the
    driver gets the one matrix that it asks for, whose size depends on the
    vectors' length alone.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape, kind), False
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                rows = b.slice(at, 4096)
                total += part(_rows(rows, 0, size))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(some, kind)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], ["i", "sums"])

    size = x.size
    records = x.rows.select("x").mapInArrow(partial, "i int, sums binary").repartition("i")
    out = np.zeros(shape, kind)
    for r in records.mapInArrow(merge, "i int, sums binary").collect():
        out[r.i] = np.frombuffer(r.sums, kind)
    return out


@dataclass
class Vectors:
    """The vectors that are whitened: rows (row columns, x), their length, number, sums and trace of the covariance."""

    rows: DataFrame
    size: int
    n: int = 0
    sums: np.ndarray | None = None
    trace: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n: the whole part of the mean is taken off in integers, so that no digit is lost."""
        whole = self.sums // max(self.n, 1)
        rest = (self.sums - whole * self.n) / max(self.n, 1)
        return lambda x: (x - whole).astype(np.float64) - rest


def measure(rows: DataFrame, size: int) -> Vectors:
    """Count, exact sums and trace of rows that all hold a vector of one length."""
    found = Vectors(rows, size)
    sums = _summed(found, lambda x: np.concatenate([x.sum(axis=0), [len(x)]])[:, None], (size + 1, 1), np.int64).ravel()
    found.n, found.sums = int(sums[-1]), sums[:-1]
    centre = found.centre()
    squares = _summed(found, lambda x: (centre(x) ** 2).sum(axis=0)[None, :], (1, size))
    found.trace = float(squares.sum() / max(found.n, 1))
    return found


def _times(found: Vectors, basis: np.ndarray) -> np.ndarray:
    """The covariance times a basis, by one pass over all rows; the covariance itself is never formed."""
    centre = found.centre()

    def part(x: np.ndarray) -> np.ndarray:
        rows = centre(x)
        return rows.T @ (rows @ basis)

    return _summed(found, part, basis.shape) / max(found.n, 1)


def _ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenvalues by falling size and unit vectors within the basis, with each one's residual."""
    inner = basis.T @ product
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    values, turns = values[::-1], turns[:, ::-1]
    vectors = basis @ turns
    return values, vectors, np.linalg.norm(product @ turns - vectors * values, axis=0)


def components(found: Vectors, k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the covariance: the largest ``k`` that are above zero.

    A random basis of ``k + oversample`` columns is multiplied by the
    covariance and made orthonormal ``passes`` times, each time over all rows.
    Rayleigh-Ritz gives the components in it. If a residual is still over
    ``RESIDUAL`` of the largest eigenvalue, as where eigenvalues fall slowly,
    the basis is expanded to all dimensions, in which the components are exact
    up to rounding.
    """
    d = found.size
    k = min(k, d)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((d, min(k + oversample, d))))[0]
    for _ in range(passes):
        product = _times(found, basis)
        values, vectors, residuals = _ritz(basis, product)
        if (residuals[:k] <= RESIDUAL * max(values[0], 0)).all():
            break
        basis = np.linalg.qr(product)[0]
    else:
        basis = np.linalg.qr(np.concatenate([basis, rng.standard_normal((d, d - basis.shape[1]))], axis=1))[0]
        values, vectors, _ = _ritz(basis, _times(found, basis))
    real = values[:k] > FLATTEST * found.trace
    return values[:k][real], vectors[:, :k][:, real]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error): a row for each vector, arrays over components.

    The fit list is every vector that is kept. ``deviation`` is the exact sum
    over dimensions of ``(n * x - S)^2``, as decimal(38, 0). ``whitened`` and
    ``explained`` hold a value for each of up to ``k`` components, by falling
    eigenvalue; directions without variance are no components, so equal
    vectors give empty arrays. ``identity_error`` is measured by a pass of its
    own over what comes out.

    Dropped are null vectors and those with a null or non-finite entry, and
    vectors of another length than the most frequent one (the longer on a
    tie), which no covariance holds together. An entry whose ``x`` passes a long is
    an error. Null ids stay null; repeated rows count and come out each. An
    empty table gives an empty one. Other columns are ignored.
    """
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    kept = materialize(given.select("vec_id", steps(F.col("v")).alias("x")), "steps")
    length = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = length["size"] if length else 0
    rows = kept.where(F.size("x") == size)
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if not size:
        empty = rows.select("vec_id").mapInArrow(lambda batches: iter(()), schema)
        return empty
    found = measure(rows, size)
    values, axes = components(found, k, oversample, passes, seed)
    scaled, centre, n, sums, m = axes / np.sqrt(values), found.centre(), found.n, found.sums, len(values)
    explained = values / found.trace if m else values

    def moments(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ scaled
        return np.concatenate([z.T @ z, z.sum(axis=0)[None, :]])

    error = 0.0
    if m:
        both = _summed(found, moments, (m + 1, m)) / n
        error = float(np.abs(both[:m] - np.outer(both[m], both[m]) - np.eye(m)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x = _rows(b, 1, size)
                largest = float(np.abs(centre(x)).max(initial=0)) * n
                fits = max(largest**2 * size, float(np.abs(x).max(initial=0)) * n) < 2**62
                off = x * n - sums if fits else x.astype(object) * n - sums.astype(object)  # Python's integers past 64 bits
                exact = (off * off).sum(axis=1).tolist()
                deviation = pa.array([decimal.Decimal(v) for v in exact], pa.decimal128(38, 0))
                z = pa.array((centre(x) @ scaled).ravel())
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * m)
                same = lambda v, t: pa.array([v] * len(x), t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), same(n, pa.int64()), deviation, pa.ListArray.from_arrays(ends, z), same(explained.tolist(), pa.list_(pa.float64())), same(error, pa.float64())],
                    ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(lean(run), schema)


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    pairs = F.arrays_zip("whitened", "explained")
    long = whitened.select("vec_id", "n", "deviation", "identity_error", F.posexplode(pairs).alias("place", "pair"))
    return long.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error")
