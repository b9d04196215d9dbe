"""Whitening of embeddings by shifted CholeskyQR.

Centred rows are made orthonormal by passes over the table: a pass sums the Gram
matrix of the rows as solved so far, its Cholesky factor R is the next triangular
solve. The first pass, and any that finds the Gram matrix singular, adds a shift. The
product of all R has the singular values and right vectors of the centred table, so an
SVD of one small matrix gives the components. Only sums of a length's square of numbers
reach the driver; rows stay where they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integer grid of the contract: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond it have no place on a 64-bit grid and stay at its end.
FAR = 2**62
#: A Gram matrix this near to the identity needs one more factor only.
NEAR = 0.1
#: Passes that data of full rank never need; numerically dependent columns stop here.
PASSES = 12
#: Smallest singular value, as a share of the largest, that still counts as a component.
LEAST = 1e-11
COMPONENTS = 32


@dataclass
class Fit:
    """What the passes have found on all vectors of one length."""

    n: int
    sums: list[int]
    reach: int
    factors: list[np.ndarray] = field(default_factory=list)
    done: bool = False
    trace: float = 0.0
    axes: np.ndarray | None = None  # columns are the unit components
    eigenvalues: np.ndarray | None = None
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they hold it, Python's otherwise."""
        if self.n * self.reach < FAR:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n

    def solved(self, x: np.ndarray) -> np.ndarray:
        """Centred rows through the triangular solves of all factors."""
        q = self.centred(x)
        for r in self.factors:
            q = triangular_solve(q, r)
        return q

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.eigenvalues)


def triangular_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``r``, column by column."""
    out = np.empty_like(rows)
    for j in range(r.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def squares(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where a sum is beyond 64 bits."""
    most = int(np.abs(deviations).max()) if deviations.size else 0
    if most * most * max(1, deviations.shape[1]) < FAR:
        return (deviations.astype(np.int64) ** 2).sum(axis=1).tolist()
    exact = (deviations.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the rows whose vector has entries, all of them finite numbers."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
    return v.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, row numbers, integer rows)`` of a batch, one item per length."""
    lists = batch.column(batch.schema.get_field_index("v"))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        entries = values[starts[at][:, None] + np.arange(dim)]
        with np.errstate(over="ignore"):
            yield dim, at, np.clip(np.floor(SCALE * entries), -FAR, FAR).astype(np.int64) + OFFSET


def _first_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sums and largest entry of a partition's vectors, per length."""
    found: dict[int, list] = {}
    for batch in batches:
        for dim, at, x in by_length(batch):
            mine = found.setdefault(dim, [0, [0] * dim, 0])
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            mine[0] += len(at)
            mine[1] = [s + (h << 32) + l for s, h, l in zip(mine[1], high, low, strict=True)]
            mine[2] = max(mine[2], int(x.max()), -int(x.min()))
    for dim, (n, sums, reach) in found.items():
        yield pa.RecordBatch.from_pydict({"dim": [dim], "n": [n], "reach": [reach], "sums": [[str(s) for s in sums]]})


def _started(rows: DataFrame) -> dict[int, Fit]:
    parts = rows.mapInArrow(_first_sums, "dim long, n long, reach long, sums array<string>")
    each = parts.select("dim", "n", "reach", F.posexplode("sums").alias("at", "part"))
    total = each.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"))
    fits: dict[int, Fit] = {}
    for r in total.collect():  # one number per dimension
        fit = fits.setdefault(r.dim, Fit(r.n, [0] * r.dim, 0))
        fit.sums[r.at], fit.reach = int(r["sum"]), max(fit.reach, r.reach)
    return fits


def grams(rows: DataFrame, fits: dict[int, Fit], row_of: Callable[[Fit, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Per length the sum over all rows of the outer product of ``row_of(fit, row)`` with itself."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_length(batch):
                if dim in fits:
                    q = row_of(fits[dim], x)
                    found[dim] = found.get(dim, 0) + q.T @ q
        for dim, gram in found.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim], "gram": [gram[np.triu_indices(len(gram))].tolist()]})

    parts = rows.mapInArrow(partial, "dim long, gram array<double>").select("dim", F.posexplode("gram").alias("at", "part"))
    upper: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("dim", "at").agg(F.sum("part").alias("sum")).collect():  # one number per pair of dimensions
        upper.setdefault(r.dim, {})[r.at] = r["sum"]
    out = {}
    for dim, values in upper.items():
        size = int((2 * len(values)) ** 0.5)
        gram = np.zeros((size, size))
        gram[np.triu_indices(size)] = [values[i] for i in range(len(values))]
        out[dim] = gram + np.triu(gram, 1).T
    return out


def next_factor(fit: Fit, gram: np.ndarray) -> None:
    """Adds the Cholesky factor of a Gram matrix; the first is shifted, and so is any that would not be definite."""
    d = len(gram)
    if not fit.factors:
        fit.trace = float(np.trace(gram)) / fit.n
        if fit.trace == 0:
            fit.done = True
            return
    values = np.linalg.eigvalsh(gram)
    shift = 11 * (fit.n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(values[-1], 0.0)
    settled = np.abs(values - 1) < NEAR
    fit.done = bool(fit.factors) and bool((settled | (values < 1e-12)).all()) or len(fit.factors) + 1 >= PASSES
    regular = bool(fit.factors) and values[0] > 100 * d * np.finfo(float).eps * values[-1]
    while True:
        try:
            # A settled matrix of less than full rank needs its zeros lifted by no more than rounding.
            lift = 0.0 if regular else min(shift, 1e-13 * values[-1]) if fit.factors and settled.any() else shift
            fit.factors.append(np.linalg.cholesky(gram + lift * np.eye(d)).T)
            return
        except np.linalg.LinAlgError:
            regular, shift, settled = False, 10 * shift, np.zeros(d, dtype=bool)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Components of all usable rows, apart for each vector length."""
    fits = _started(rows)
    while open_ := {dim: fit for dim, fit in fits.items() if not fit.done}:
        for dim, gram in grams(rows, open_, Fit.solved).items():
            next_factor(fits[dim], gram)
    for dim, fit in fits.items():
        r = np.eye(dim)
        for factor in fit.factors:
            r = factor @ r
        _, singular, right = np.linalg.svd(r)
        kept = min(components, int((singular > LEAST * singular[0]).sum())) if fit.trace > 0 else 0
        axes = right[:kept].T
        signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
        fit.axes, fit.eigenvalues = axes * signs, singular[:kept] ** 2 / fit.n
    kept_fits = {dim: fit for dim, fit in fits.items() if len(fit.eigenvalues)}
    for dim, gram in grams(rows, kept_fits, Fit.whitened).items() if kept_fits else ():
        fits[dim].identity_error = float(np.abs(gram / fits[dim].n - np.eye(len(gram))).max())
    return kept_fits


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every usable row and component.

    Reads vec_id and embedding only, so other columns may have any name. Rows whose
    vector is null, empty or holds a null or non-finite entry take no part. Repeated
    rows and ids, and null ids, count and are returned one by one. Vectors of
    different lengths are fitted apart: ``n`` is the number of vectors of the row's
    length. A component needs variance (a singular value above 1e-11 of the largest):
    of fewer vectors than dimensions, or of dependent dimensions, the components
    without variance are left out, and vectors that are all equal give no rows, as an
    empty table does. Components of equal eigenvalue may turn within their plane; the
    largest entry of each is positive. ``deviation`` is null where the exact sum is
    beyond 64 bits; entries beyond 2^62 on the grid stay there.
    """
    rows = usable(vectors)
    fits = fit_whitening(rows, components)

    def projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for dim, at, x in by_length(batch):
                if dim not in fits:
                    continue
                fit = fits[dim]
                whitened = fit.whitened(x)
                ends = np.arange(len(at) + 1, dtype=np.int32) * whitened.shape[1]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(at)), "n": pa.array([fit.n] * len(at), pa.int64()),
                    "deviation": pa.array(squares(fit.deviations(x)), pa.int64()),
                    "whitened": pa.ListArray.from_arrays(pa.array(ends), pa.array(whitened.ravel())),
                    "explained": pa.array([(fit.eigenvalues / fit.trace).tolist()] * len(at), pa.list_(pa.float64())),
                    "identity_error": pa.array([fit.identity_error] * len(at), pa.float64()),
                })

    id_type = rows.schema["vec_id"].dataType.simpleString()
    wide = rows.mapInArrow(projected, f"vec_id {id_type}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    each = wide.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value.whitened").alias("whitened"), F.col("value.explained").alias("explained"), "identity_error"
    )
