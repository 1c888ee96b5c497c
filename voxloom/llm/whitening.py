"""Embedding whitening: the components come from FEAST contour integration of the exact covariance.

Entries are whole numbers, x = floor(64 c) + 1,000,000. Sums are exact: the means
first, then, in a second pass, products of entries centred on the whole number
next to the mean; the fraction that is left of the centre is taken off in whole
numbers too, so the covariance V is the correctly rounded one.

The spectrum of V is cut into intervals by bisection, where the inertia of
V - s (from its factors L D L', with pivots of order one and two) tells how many
eigenvalues lie above s. In each interval a block of vectors is projected by
Gauss-Legendre quadrature of the contour integral of (z - V)^-1, complex shifted
solves at nodes on the half circle, and Rayleigh-Ritz extracts the components.
That repeats until residuals are at rounding and the interval holds as many
components as the inertia counts; a last Rayleigh-Ritz over all of them makes
the set orthonormal. V has as many rows as the vectors have entries; it is the
only thing that meets in one place, and is solved there.

Rows are dropped whose vector is null, empty, or holds a null, a non-finite
entry, or one whose x is beyond 2^62. Vectors have one length, the commonest
(the longest of those equally common); others are dropped. Components whose
eigenvalue is zero to rounding cannot be whitened and are left out, so equal
vectors, or a single one, give no rows. Equal ids and repeated rows get rows
each and count as often in the fit. A deviation beyond 64 bits is null. Other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: An interval is halved until it holds at most so many eigenvalues.
CROWD = 8
NODES = 16
ROUNDS = 30
SEED = 23
_LARGEST = 2.0**62


# --- the solver: V is a symmetric array, rows and columns as many as a vector has entries


def eigenvalues_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric a exceed shift: the positive ones of
    D in L D L' of a - shift. The pivot is the largest diagonal entry, or the
    block of the largest other entry, which has one eigenvalue of each sign."""
    m, count = a - shift * np.eye(len(a)), 0
    while len(m):
        size = np.abs(m)
        d = int(np.argmax(size.diagonal()))
        other = size - np.diag(size.diagonal())
        i, j = divmod(int(np.argmax(other)), len(m))
        if size[d, d] >= 0.64 * other[i, j]:
            if size[d, d] == 0:
                break
            pivot, count = [d], count + int(m[d, d] > 0)
        else:
            pivot, count = [i, j], count + 1
        rest = np.setdiff1d(np.arange(len(m)), pivot)
        m = m[np.ix_(rest, rest)] - m[np.ix_(rest, pivot)] @ np.linalg.solve(m[np.ix_(pivot, pivot)], m[np.ix_(pivot, rest)])
    return count


def intervals(a: np.ndarray, components: int) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top of the spectrum down, disjoint, that hold
    the largest `components` eigenvalues above rounding, and those too near to
    the last one to be told apart."""
    top = float(np.abs(a).sum(axis=1).max())  # no eigenvalue is larger
    floor = top * len(a) * np.finfo(float).eps
    everything = eigenvalues_above(a, floor)
    wanted, out = min(components, everything), []
    # (low, high, how many lie above low, how many above high); the upper half is looked at first
    todo = [(floor, top * (1 + 1e-9) + floor, everything, 0)]
    while todo:
        low, high, above_low, above_high = todo.pop()
        n = above_low - above_high
        if n <= 0 or above_high >= wanted:
            continue
        narrow = high - low <= 1e-9 * high
        if narrow or (n <= CROWD and above_low <= wanted):
            out.append((low, high, n))
            continue
        middle = (low + high) / 2
        above = eigenvalues_above(a, middle)
        todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return out


def projected(a: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block through the spectral projector of (low, high), by quadrature on
    the upper half of the circle over it; a is real, so the lower half is the conjugate."""
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(block)
    for x, w in zip(nodes, weights, strict=True):
        turn = radius * np.exp(0.5j * np.pi * (1 + x))
        out += 0.5 * w * (turn * np.linalg.solve((centre + turn) * np.eye(len(a)) - a, block.astype(complex))).real
    return out


def ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values and orthonormal vectors of a in the span of the block."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    basis = u[:, s > s[0] * 1e-13] if len(s) and s[0] > 0 else u[:, :0]
    h = basis.T @ a @ basis
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    return values, basis @ vectors


def feast(a: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric, non-negative a, falling, and their unit vectors as columns."""
    found, random = [], np.random.default_rng(SEED)
    size = float(np.abs(a).sum(axis=1).max(initial=0.0))
    for low, high, count in intervals(a, components) if size > 0 else []:
        block = random.standard_normal((len(a), min(len(a), 2 * count + 8)))
        # an interval of equal eigenvalues has no width to integrate around
        pad = max(0.0, 1e-7 * high - (high - low)) / 2
        for _ in range(ROUNDS):
            values, vectors = ritz(a, projected(a, low - pad, high + pad, block))
            inside = (values > low) & (values <= high)
            error = np.abs(a @ vectors[:, inside] - vectors[:, inside] * values[inside]).max(initial=0.0)
            if int(inside.sum()) == count and error <= 8 * np.finfo(float).eps * size:
                break
            more = random.standard_normal((len(a), min(len(a), block.shape[1] + count) - vectors.shape[1])) if vectors.shape[1] < block.shape[1] or int(inside.sum()) != count else vectors[:, :0]
            block = np.hstack([vectors, more])
        if int(inside.sum()) != count:
            raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, and {int(inside.sum())} components were found")
        found.append(vectors[:, inside])
    if not found:
        return np.empty(0), np.empty((len(a), 0))
    values, vectors = ritz(a, np.hstack(found))
    order = np.argsort(-values, kind="stable")[:components]
    return values[order], vectors[:, order]


# --- the passes over all rows


def whole_vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows stay, and x - OFFSET of their entries as whole numbers."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    held = column.filter(right).flatten()
    entries = held.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    scaled = np.floor(entries * SCALE)
    fine = (np.abs(scaled) < _LARGEST).all(axis=1)  # false for what is not finite, nulls among them
    return at[fine], scaled[fine].astype(np.int64)


def exact_sums(d: np.ndarray) -> np.ndarray:
    largest = int(np.abs(d).max(initial=0))
    return d.sum(axis=0) if largest * max(1, len(d)) < 1 << 63 else d.astype(object).sum(axis=0)


def exact_products(d: np.ndarray) -> np.ndarray:
    """d' d in whole numbers: in doubles where they hold it, else in long ones of any size."""
    largest = int(np.abs(d).max(initial=0))
    if largest * largest * max(1, len(d)) < 1 << 53:
        f = d.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    o = d.astype(object)
    return o.T @ o


@dataclass
class Whitening:
    """What a fit knows: n, the sums of x, and for each component its eigenvalue and share, and the vectors as columns."""

    dims: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """The whole number next to each mean of x - OFFSET."""
        return np.array([(2 * (s - self.n * OFFSET) + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def whitened(self, d: np.ndarray) -> np.ndarray:
        rest = np.array([(s - self.n * (OFFSET + int(c))) / self.n for s, c in zip(self.sums, self.centre, strict=True)])
        return ((d - self.centre) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, d: np.ndarray) -> list[int | None]:
        own = [s - self.n * OFFSET for s in self.sums]
        largest = max((abs(self.n * int(v) - s) for e in (d.min(axis=0), d.max(axis=0)) for v, s in zip(e, own, strict=True)), default=0) if len(d) else 0
        if largest * largest * max(1, self.dims) < 1 << 63:
            off = self.n * d - np.array(own, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, own, strict=True)) for row in d.tolist()]
        return [x if x < 1 << 63 else None for x in exact]


def _cells(rows: DataFrame, dims: int, what, kind: str) -> dict[tuple[int, int], tuple]:
    """Sums over all rows of small arrays: what(d) gives a matrix for a batch, a
    partition sends one, cell by cell, and Spark adds them up."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            _, d = whole_vectors(batch.column("_v"), dims)
            n += len(d)
            more = what(d)
            # long ones of any size: a partition's sum may pass 64 bits
            total = more.astype(object) if total is None and kind != "double" else more if total is None else total + more
        if total is not None:
            i, j = np.triu_indices(total.shape[0], 0, total.shape[1]) if total.shape[0] == total.shape[1] else np.indices(total.shape).reshape(2, -1)
            values = [str(v) if kind != "double" else float(v) for v in total[i, j]]
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([n] * len(i), pa.int64()), pa.array(values)], ["i", "j", "n", "v"])

    made = rows.mapInArrow(part, f"i int, j int, n bigint, v {'double' if kind == 'double' else 'string'}")
    sums = made.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast(kind)).alias("v")).toArrow().to_pydict()
    return {(i, j): (n, v) for i, j, n, v in zip(*sums.values(), strict=True)}


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The components of all vectors; None if there is no vector."""
    rows = df.select(F.col(vector).alias("_v"))
    common = rows.where("size(_v) > 0").groupBy(F.size("_v").alias("_n")).count().orderBy(F.desc("count"), F.desc("_n")).first()
    if common is None:
        return None
    dims = common["_n"]
    first = _cells(rows, dims, lambda d: exact_sums(d)[None, :], "decimal(38,0)")
    n = max((x[0] for x in first.values()), default=0)
    if n == 0:
        return None
    sums = [int(first[0, j][1]) + n * OFFSET for j in range(dims)]
    model = Whitening(dims, n, sums, np.empty(0), np.empty((dims, 0)), 0.0)
    centre = model.centre
    products = _cells(rows, dims, lambda d: exact_products(d - centre), "decimal(38,0)")
    rest = [s - n * (OFFSET + int(c)) for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((dims, dims))
    for (i, j), (_, p) in products.items():
        v[i, j] = v[j, i] = (n * int(p) - rest[i] * rest[j]) / (n * n)
    model.values, model.vectors = feast(v, components)
    model.trace = float(np.trace(v))
    return model


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest entry of the covariance of all whitened rows minus the identity."""
    k = len(model.values)
    if k == 0:
        return 0.0
    rows = df.select(F.col(vector).alias("_v"))

    def moments(d: np.ndarray) -> np.ndarray:
        w = np.hstack([model.whitened(d), np.ones((len(d), 1))])
        return w.T @ w

    sums = _cells(rows, model.dims, moments, "double")
    mean = [sums[i, k][1] / model.n for i in range(k)]
    return max(abs(sums[i, j][1] / model.n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k))


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for each vector that stays and each component."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(df, vector, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], shape)
    error = identity_error(df, model, vector)
    sent = spark.sparkContext.broadcast(model)

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.values)
        share = model.values / model.trace
        for batch in batches:
            at, d = whole_vectors(batch.column("_v"), model.dims)
            rows = np.repeat(at, k)
            yield pa.record_batch(
                [batch.column("_k").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(rows), model.n, np.int64)),
                 pa.array([x for x in model.deviations(d) for _ in range(k)], pa.int64()), pa.array(model.whitened(d).ravel()), pa.array(np.tile(share, len(at))),
                 pa.array(np.full(len(rows), error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return df.select(F.col(key).alias("_k"), F.col(vector).alias("_v")).mapInArrow(white, shape)
