"""Whitening of embeddings by principal components found from one distributed covariance.

Entries become whole numbers, so counts, sums and deviations are exact at any size.  Spark sums
the covariance of the centred vectors; the driver only ever holds that one matrix, whose size
is the square of the vectors' length.  It is made tridiagonal by Householder reflections, the
leading eigenvalues come from Sturm counts and bisection, and the components from inverse
iteration.  The components then travel to every task, which projects its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import materialize
from .columns import ragged, trim

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors may be this long: the driver then holds three matrices of 128 MB.
LONGEST = 4_096
#: Numbers worked on at once, in one task.
BLOCK = 1 << 19
#: A component needs this share of the whole variance; less is rounding.
LEAST_SHARE = 1e-13
#: Eigenvalues nearer than this share of the largest are one cluster.
CLUSTER = 1e-3
#: Whole numbers beyond this are worked on one by one, in numbers of any size.
_SAFE = 1 << 44
_LONG = 2.0**62


def usable(vector: Column) -> Column:
    """Is it a vector without null, NaN and infinite entries?"""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(vector: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The rows' whole numbers, some rows at a time; entries a shorter vector lacks count as zero."""
    lengths = np.asarray(pc.list_value_length(vector), np.int64)
    values = np.asarray(vector.flatten().cast(pa.float64()))
    first = np.concatenate([[0], np.cumsum(lengths)])
    step = max(1, BLOCK // max(width, 1))
    for lo in range(0, len(lengths), step):
        n = lengths[lo : lo + step]
        x = np.zeros((len(n), width))
        x[np.arange(width) < n[:, None]] = values[first[lo] : first[lo + len(n)]]
        yield np.clip(np.floor(SCALE * x), -_LONG, _LONG).astype(np.int64) + SHIFT


def squares(d: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows, from three limbs of 21 bits of each number."""
    d = np.abs(d)
    low, middle, high = d & 0x1FFFFF, (d >> 21) & 0x1FFFFF, d >> 42
    parts = [(low * low, 0), (2 * low * middle, 21), (2 * low * high, 42), (middle * middle, 42), (2 * middle * high, 63), (high * high, 84)]
    sums = [(p.sum(1).tolist(), shift) for p, shift in parts if p.any()]
    return [sum(values[i] << shift for values, shift in sums) for i in range(len(d))]


@dataclass
class Fit:
    n: int
    sums: list[int]  # of the whole numbers, by dimension
    trace: float
    values: np.ndarray  # leading eigenvalues, falling
    vectors: np.ndarray  # one component per row

    @property
    def mean(self) -> np.ndarray:
        """The whole part and the rest, so that no digit of a large mean is lost."""
        return np.array([[s // self.n, (s % self.n) / self.n] for s in self.sums], float).reshape(-1, 2)

    def centred(self, x: np.ndarray) -> np.ndarray:
        mean = self.mean
        return (x - mean[:, 0].astype(np.int64)) - mean[:, 1]

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the sum of (n * x - sum) ** 2 over the dimensions."""
        far = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) >= _SAFE or self.n >= 1 << 40
        mean = [s // self.n for s in self.sums]
        if not far and max((abs(m) for m in mean), default=0) < _SAFE:
            near = x - np.array(mean, np.int64)
            if self.n * (int(np.abs(near).max(initial=0)) + 1) < 1 << 62:
                return squares(near * self.n - np.array([s % self.n for s in self.sums], np.int64))
        return [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]


def _sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    def run(batches):
        n, total = 0, [0] * width
        for batch in batches:
            for x in whole(batch.column(0), width):
                n += len(x)
                # Halves of 32 bits cannot overflow within a block.
                high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                total = [t + (h << 32) + u for t, h, u in zip(total, high, low)]
        trim()
        if n:
            places = pa.array(range(-1, width), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array([str(v) for v in [n, *total]])], names=["place", "number"])

    parts = vectors.mapInArrow(run, "place int, number string")
    rows = parts.groupBy("place").agg(F.sum(F.col("number").cast("decimal(38,0)")).alias("number")).collect()
    found = {r.place: int(r.number) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def _covariance(vectors: DataFrame, fit: Fit) -> np.ndarray:
    """Products of the centred vectors, summed in each task and then by matrix row, over n."""
    width = len(fit.sums)

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for x in whole(batch.column(0), width):
                d = fit.centred(x)
                total += d.T @ d
        if total.any():
            rows = ragged(total.ravel(), np.full(width, width), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), rows], names=["i", "row"])
        trim()

    parts = vectors.mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    matrix = np.zeros((width, width))
    for r in cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("row")).collect():
        matrix[r.i] = [cell.value for cell in r.row]
    return (matrix + matrix.T) / (2 * max(fit.n, 1))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, the one beside it, and the Householder reflections that lead there."""
    a, n, mirrors = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
        mirrors.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point: negative pivots."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squared = np.concatenate([[0.0], e * e])
    below = np.zeros(len(at), np.int64)
    pivot = np.ones(len(at))
    for i in range(len(d)):
        pivot = d[i] - at - squared[i] / pivot
        pivot[np.abs(pivot) < tiny] = -tiny
        below += pivot < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each halved down to neighbouring numbers."""
    beside = np.concatenate([[0.0], np.abs(e), [0.0]])
    radius = beside[:-1] + beside[1:]
    low = np.full(k, (d - radius).min())
    high = np.full(k, (d + radius).max())
    margin = np.finfo(float).eps * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny) * len(d)
    low, high = low - margin, high + margin
    wanted = len(d) - np.arange(k)  # as many lie below anything above the k-th largest
    while True:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        above = sturm_counts(d, e, middle) >= wanted
        high = np.where(above, middle, high)
        low = np.where(above, low, middle)


def solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges; pivots of zero become ``floor``."""
    n = len(d)
    rows = [[0.0, 0.0, 0.0] for _ in range(n)]
    x = b.tolist()
    diagonal, beside = (d - shift).tolist(), [*e.tolist(), 0.0]
    current = [diagonal[0], beside[0], 0.0]
    for i in range(n - 1):
        under = [beside[i], diagonal[i + 1], beside[i + 1]]
        if abs(under[0]) > abs(current[0]):
            current, under = under, current
            x[i], x[i + 1] = x[i + 1], x[i]
        if current[0] == 0:
            current[0] = floor
        factor = under[0] / current[0]
        x[i + 1] -= factor * x[i]
        rows[i] = current
        current = [under[1] - factor * current[1], under[2] - factor * current[2], 0.0]
    if abs(current[0]) < floor:
        current[0] = floor
    rows[n - 1] = current
    for i in range(n - 1, -1, -1):
        rest = x[i]
        if i + 1 < n:
            rest -= rows[i][1] * x[i + 1]
        if i + 2 < n:
            rest -= rows[i][2] * x[i + 2]
        x[i] = rest / rows[i][0]
    return np.array(x)


def components(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a symmetric matrix and their unit eigenvectors, one per row.

    Vectors of one cluster of near eigenvalues are made orthogonal to those before them after
    every step of inverse iteration.
    """
    k = min(k, len(matrix))
    size = float(np.abs(matrix).max(initial=0.0))
    if k == 0 or size == 0:
        return np.zeros(0), np.zeros((0, len(matrix)))
    d, e, mirrors = tridiagonal(matrix / size)
    values = leading_values(d, e, k)
    eps = np.finfo(float).eps
    near, floor = CLUSTER * abs(values[0]), eps * max(np.abs(d).max(), np.abs(e).max(initial=0.0))
    random = np.random.default_rng(7)
    found: list[np.ndarray] = []
    start = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > near:
            start = i
        v = random.standard_normal(len(d))
        # Equal eigenvalues are told apart by shifts of a rounding error.
        shift = value - (i - start) * eps * abs(values[0])
        for _ in range(6):
            v /= np.linalg.norm(v)
            v = solve(d, e, shift, v, floor)
            v /= np.linalg.norm(v)
            for _ in range(2):
                for other in found[start:]:
                    v -= (v @ other) * other
        found.append(v / np.linalg.norm(v))
    vectors = np.array(found)
    for at, mirror in reversed(mirrors):
        vectors[:, at:] -= 2 * np.outer(vectors[:, at:] @ mirror, mirror)
    return values * size, vectors


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Fit:
    """Sums, covariance and leading components of the one column of ``vectors``, all usable."""
    width = vectors.agg(F.max(F.size(vectors.columns[0]))).first()[0] or 0
    if width > LONGEST:
        raise ValueError(f"a vector of {width} entries; {LONGEST} are the most")
    n, sums = _sums(vectors, width)
    found = Fit(n, sums, 0.0, np.zeros(0), np.zeros((0, width)))
    if not n or not width:
        return found
    matrix = _covariance(vectors, found)
    found.trace = float(np.trace(matrix))
    values, axes = components(matrix, k)
    lasting = values > LEAST_SHARE * found.trace
    found.values, found.vectors = values[lasting], axes[lasting]
    return found


def _identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest entry by which the covariance of ``rows`` (whitened) differs from the identity.

    Each task gives a count, means and products about its own means, which are then moved to
    the common means.
    """

    def run(batches):
        blocks = []
        for batch in batches:
            y = np.asarray(batch.column(0).flatten()).reshape(-1, k)
            if len(y):
                mean = y.mean(0)
                blocks.append((len(y), mean, (y - mean).T @ (y - mean)))
        trim()
        if blocks:
            sizes = np.array([b[0] for b in blocks], float)
            means = np.array([b[1] for b in blocks])
            mean = sizes @ means / sizes.sum()
            products = sum(b[2] for b in blocks) + ((means - mean) * sizes[:, None]).T @ (means - mean)
            columns = [pa.array([int(sizes.sum())]), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])]
            yield pa.RecordBatch.from_arrays(columns, names=["size", "mean", "products"])

    parts = materialize(rows.mapInArrow(run, "size bigint, mean array<double>, products array<double>"), "whitened-parts")
    weighted = parts.select("size", F.posexplode("mean").alias("i", "m")).groupBy("i").agg(F.sum(F.col("size") * F.col("m")).alias("m"))
    common = {r.i: r.m / n for r in weighted.collect()}
    centre = F.array(*[F.lit(common[i]) for i in range(k)])
    i, j = F.floor(F.col("place") / F.lit(k)).cast("int"), (F.col("place") % F.lit(k)).cast("int")
    moved = F.col("product") + F.col("size") * (F.get("mean", i) - F.get(centre, i)) * (F.get("mean", j) - F.get(centre, j))
    cells = parts.select("size", "mean", F.posexplode("products").alias("place", "product")).select("place", moved.alias("v"))
    error = cells.groupBy("place").agg(F.sum("v").alias("v")).select(
        F.max(F.abs(F.col("v") / F.lit(float(n)) - F.when(i == j, 1.0).otherwise(0.0)))
    )
    return float(error.first()[0])


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = COMPONENTS) -> tuple[DataFrame, Fit]:
    """(key, deviation, whitened array) per usable vector, and what was fitted.

    ``deviation`` is a whole number as text, as it may have any number of digits.

    Rows whose vector is null or has a null, NaN or infinite entry are left out.  A shorter
    vector counts as filled up with zeros.  A null key stays; repeated rows stay and count each.
    Numbers beyond 2 ** 62 after scaling count as 2 ** 62.  Components without variance, as in
    a table of one row or of equal rows, cannot be whitened and are missing from the arrays; an
    empty table gives no row.  Other columns are not looked at.
    """
    given = embeddings.where(usable(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    found = fit(given.select("vector"), k)
    width, axes, scale = len(found.sums), found.vectors, np.sqrt(found.values)
    schema = StructType([given.schema["key"], *StructType.fromDDL("deviation string, whitened array<double>")])

    def run(batches):
        for batch in batches:
            deviations, rows = [], []
            for x in whole(batch.column(1), width):
                deviations += [str(v) for v in found.deviations(x)]
                rows.append((found.centred(x) @ axes.T) / scale)
            y = np.concatenate(rows) if rows else np.zeros((0, len(axes)))
            columns = [batch.column(0), pa.array(deviations, pa.string()), ragged(y.ravel(), np.full(len(y), y.shape[1]), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        trim()

    return given.mapInArrow(run, schema).withColumnRenamed("key", key), found


def whitened_rows(embeddings: DataFrame) -> DataFrame:
    """One row per vector and component, with the figures of the fit beside it.

    Nulls, ties and empty tables are as in :func:`whiten`.  ``deviation`` is null where the
    exact number, kept in ``deviation_exact``, fits no long.
    """
    rows, found = whiten(embeddings)
    kept = materialize(rows, "whitened")
    k = len(found.values)
    error = _identity_error(kept.select("whitened"), found.n, k) if k else None
    explained = F.array(*[F.lit(float(v / found.trace)) for v in found.values]) if k else F.array().cast("array<double>")
    return kept.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )
