"""Whitening of embedding vectors by components of their covariance.

Moments. Entries become whole numbers, so sums and sums of products are taken
exactly: the covariance, centred, follows from whole numbers alone and does not
depend on how rows are partitioned.

Components (FEAST). The top of the spectrum is cut into intervals, at points whose
inertia counts (signs of the pivots of shifted LDL^T, by Sylvester's law) say how
many eigenvalues lie above. For each interval the covariance, shifted to the nodes
of a contour around it in the complex plane, is solved for a block of vectors; the
quadrature of the solutions is nearly the projection on the interval's
eigenvectors. Rayleigh-Ritz extracts eigenpairs from it, and the projection is
repeated on them until their residuals reach rounding. Every interval must give as
many pairs as its inertia counts say, otherwise it is solved again with a larger
block. Intervals are solved side by side as Spark tasks.

Sizes. A task holds the moments of its rows, dimensions squared; so does the driver,
which never receives a row. Vectors are read once for the moments and once to be
whitened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.arrow import batch
from lotwise.llm.tables import set_aside
from lotwise.staging import Staging

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LIMIT = 1 << 62  # scaled entries beyond have no whole number of 64 bits
NODES = 16  # of the upper half of a contour
PER_INTERVAL = 8  # eigenvalues that an interval is cut to, if they differ
ROUNDS = 12
SEED = 5
LIMB = 20  # bits of a factor whose products of 2**12 rows add up exactly in doubles
CHUNK = 1 << 12
LOW = 1 << 60


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value), without SHIFT."""
    return np.floor(values * SCALE).astype(np.int64)


# ---- moments ---------------------------------------------------------------


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles that add up to y, times 2**LIMB from one to the next."""
    found = []
    while True:
        low = y & ((1 << LIMB) - 1)
        high = y >> LIMB
        if not (high + (high < 0)).any():  # 0 or -1 everywhere: the rest is one signed limb
            return [*found, y.astype(np.float64)]
        found.append(low.astype(np.float64))
        y = high


def exact_moments(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of the rows of an int64 matrix, as Python integers."""
    dim = y.shape[1]
    sums, products = np.zeros(dim, object), np.zeros((dim, dim), object)
    for start in range(0, len(y), CHUNK):
        limbs = _limbs(y[start : start + CHUNK])
        for i, a in enumerate(limbs):
            sums += a.sum(0).astype(np.int64).astype(object) << (LIMB * i)
            for j, b in enumerate(limbs):
                products += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return sums, products


_MOMENTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])


def _moments(dim: int):
    """Task: the exact moments of its rows; i = -1 for the plain sums."""

    def task(batches):
        sums, products = np.zeros(dim, object), np.zeros((dim, dim), object)
        for rows in batches:
            own = exact_moments(whole_numbers(matrix(rows["embedding"], dim)))
            sums, products = sums + own[0], products + own[1]
        i, j = np.triu_indices(dim)
        values = [*sums, *products[i, j]]
        i, j = [-1] * dim + i.tolist(), [*range(dim), *j.tolist()]
        high, low = [v // LOW for v in values], [v % LOW for v in values]
        decimals = [pa.array(list(map(str, c)), pa.string()).cast(pa.decimal128(38, 0)) for c in (high, low)]
        yield batch(_MOMENTS, i, j, *decimals)

    return task


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(-1, dim)


@dataclass
class Moments:
    """Exact moments of n integer vectors: sums, and n² times the covariance."""

    n: int
    sums: np.ndarray
    spread: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        scale = self.n * self.n  # quotients of whole numbers are rounded once
        return np.array([[v / scale for v in row] for row in self.spread], np.float64)


def moments(rows: DataFrame, dim: int, n: int) -> Moments:
    """Moments of ``rows`` (embedding, of ``dim`` entries); dim² numbers reach the driver."""
    found = rows.select("embedding").mapInArrow(_moments(dim), "i INT, j INT, high DECIMAL(38,0), low DECIMAL(38,0)")
    found = found.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums, products = np.zeros(dim, object), np.zeros((dim, dim), object)
    for r in found.collect():
        value = int(r["high"]) * LOW + int(r["low"])
        if r["i"] < 0:
            sums[r["j"]] = value
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = value
    # sum of (n x - S)(n x - S)' is n (n P - S S'), so this is centred, exactly
    return Moments(n, sums, n * products - np.outer(sums, sums))


# ---- components ------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of a matrix with the inertia of v, by reflections."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k:]
        rest -= 2 * np.outer(x, x @ rest)
        rest = a[k:, k + 1 :]
        rest -= 2 * np.outer(rest @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def counts_above(form: tuple[np.ndarray, np.ndarray], points: np.ndarray) -> np.ndarray:
    """Eigenvalues above each point: positive pivots of the shifted LDL^T."""
    diagonal, off = form
    tiny = np.finfo(float).tiny
    pivot = diagonal[0] - points
    above = (pivot > 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - points - e * e / pivot
        above += pivot > 0
    return above


def intervals(form, top: float, wanted: int, most: int, floor: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top, that hold ``wanted`` eigenvalues above ``floor``.

    Cuts lie where the spectrum has room, so that a group of close eigenvalues stays
    together even if there are more than ``most``.
    """
    available = int(counts_above(form, np.array([floor]))[0])
    wanted = min(wanted, available)
    found, high, above = [], top, 0
    while above < wanted:
        target = min(above + most, wanted)
        low = _cut_below(form, floor, high, target, available)
        inside = int(counts_above(form, np.array([low]))[0]) - above
        found.append((low, high, inside))
        high, above = low, above + inside
    return found


def _cut_below(form, floor: float, high: float, target: int, available: int) -> float:
    """A point with at least ``target`` eigenvalues above, in the widest gap near there."""
    if target >= available:
        return floor
    edges = [_bisect(form, floor, high, k) for k in range(target, min(target + 4, available) + 1)]
    upper = np.array([e[1] for e in edges[:-1]])  # just above the k-th eigenvalue's lower bound
    lower = np.array([e[0] for e in edges[1:]])
    middle = [(edges[k][0] + edges[k + 1][1]) / 2 for k in range(len(edges) - 1)]
    gaps = upper - lower
    return float(middle[int(np.argmax(gaps))])


def _bisect(form, low: float, high: float, k: int) -> tuple[float, float]:
    """Close bounds of the k-th largest eigenvalue."""
    for _ in range(60):
        middle = (low + high) / 2
        if counts_above(form, np.array([middle]))[0] >= k:
            low = middle
        else:
            high = middle
    return low, high


def project(v: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int = NODES) -> np.ndarray:
    """Quadrature of the contour integral of (z - v)^-1 block around [low, high].

    Nodes lie on a circle, those of the lower half are conjugates of the upper.
    """
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros(block.shape)
    for k in range(nodes):
        turn = np.exp(1j * np.pi * (k + 0.5) / nodes)
        z = centre + radius * turn
        shifted = -v.astype(complex)
        shifted[np.diag_indices(len(v))] += z
        out += np.real(radius * turn * np.linalg.solve(shifted, block)) / nodes
    return out


def feast(v: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of v in [low, high], falling.

    ``inside`` is how many there are, by inertia; fewer or more found is an error.
    """
    dim = len(v)
    size = min(dim, inside + max(4, inside // 2))
    floor = 8 * np.finfo(float).eps * dim * np.linalg.norm(v, 2)
    while True:
        block = np.random.default_rng(SEED).standard_normal((dim, size))
        for _ in range(ROUNDS):
            basis, triangle = np.linalg.qr(project(v, block, low, high))
            values, turn = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ turn
            residual = np.linalg.norm(v @ block - block * values, axis=0)
            chosen = (values > low) & (values <= high) & (residual <= floor)
            if chosen.sum() == inside:
                order = np.flatnonzero(chosen)[::-1]
                return values[order], block[:, order]
        if size == dim:
            raise ArithmeticError(f"{int(chosen.sum())} of {inside} eigenvalues found in [{low}, {high}]")
        size = min(dim, 2 * size)


def components(v: np.ndarray, wanted: int, spark: SparkSession | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of v and their unit eigenvectors (columns).

    Eigenvalues that are zero up to rounding have none. With ``spark`` intervals are
    solved as tasks, which receive v.
    """
    dim = len(v)
    if not v.any():
        return np.zeros(0), np.zeros((dim, 0))
    size = np.abs(v).sum(1).max()  # no eigenvalue is larger
    form = tridiagonal(v)
    cut = intervals(form, size * 1.01, wanted, PER_INTERVAL, size * dim * np.finfo(float).eps * 4)
    if spark is None:
        solved = [feast(v, *own) for own in cut]
    else:
        solved = _solved(spark, v, cut)
    values, vectors = (np.concatenate(own, axis=-1) for own in zip(*solved))
    # one Rayleigh-Ritz step over all intervals makes their vectors orthogonal to rounding
    basis, _ = np.linalg.qr(vectors)
    values, turn = np.linalg.eigh(basis.T @ v @ basis)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    missed = counts_above(form, np.array([cut[-1][0]]))[0] - len(values)
    if missed:
        raise ArithmeticError(f"{missed} eigenvalues missed")
    return values[:wanted], vectors[:, :wanted]


def _solved(spark: SparkSession, v: np.ndarray, cut: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Eigenpairs of each interval, one task each: at most ``wanted`` vectors come back."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, low, high, inside in frame.itertuples(index=False):
                values, vectors = feast(v, low, high, int(inside))
                yield pd.DataFrame({"number": number, "value": values, "vector": list(vectors.T)})

    rows = [(number, float(low), float(high), inside) for number, (low, high, inside) in enumerate(cut)]
    dealt = spark.createDataFrame(rows, "number INT, low DOUBLE, high DOUBLE, inside INT").repartition(len(rows), "number")
    found = dealt.mapInPandas(task, "number INT, value DOUBLE, vector ARRAY<DOUBLE>").collect()
    out = []
    for number in range(len(rows)):
        own = sorted((r for r in found if r["number"] == number), key=lambda r: -r["value"])
        out.append((np.array([r["value"] for r in own]), np.array([r["vector"] for r in own]).T))
    return out


# ---- whitening -------------------------------------------------------------


def _whitened(dim: int, weights: np.ndarray, n: int, sums: np.ndarray):
    """Task: deviation and whitened entries of every row.

    n x - S is split as n (x - m) - (S - n m) with whole m, which keeps products small.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
    middle = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([int(s) - n * int(m) for s, m in zip(sums, middle)], object)
    fraction = np.array([r / n for r in rest], np.float64)

    def squares(y: np.ndarray) -> list[int]:
        """Sum over dimensions of (n y - rest)², exact."""
        reach = n * (int(np.abs(y).max(initial=0)) + 1)
        if reach * reach * dim < 1 << 62:
            off = n * y - rest.astype(np.int64)
            return (off * off).sum(1).tolist()
        off = n * y.astype(object) - rest
        return [int((row * row).sum()) for row in off]

    def task(batches):
        for rows in batches:
            y = whole_numbers(matrix(rows["embedding"], dim)) - middle
            deviation = pa.array(list(map(str, squares(y))), pa.string()).cast(pa.decimal128(38, 0))
            out = (y - fraction) @ weights
            flat = pa.array(out.ravel(), pa.float64())
            edges = pa.array(np.arange(len(y) + 1) * weights.shape[1], pa.int32())
            yield batch(schema, rows["vec_id"], deviation, pa.ListArray.from_arrays(edges, flat))

    return task


def _products(centre: np.ndarray):
    """Task: sums of products of its whitened rows, less ``centre``."""
    k = len(centre)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def task(batches):
        total = np.zeros((k, k))
        for rows in batches:
            w = matrix(rows["whitened"], k) - centre
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield batch(schema, i, j, total[i, j])

    return task


def _covariance_of(whitened: DataFrame, k: int, n: int) -> np.ndarray:
    """Covariance of the whitened rows; k² numbers reach the driver."""
    means = whitened.select(F.posexplode("whitened").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("s"))
    centre = np.zeros(k)
    for r in means.collect():
        centre[r["i"]] = r["s"] / n
    found = whitened.select("whitened").mapInArrow(_products(centre), "i INT, j INT, value DOUBLE")
    out = np.zeros((k, k))
    for r in found.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"] / n
    return out


_RESULT = "vec_id BIGINT, component INT, n BIGINT, deviation DECIMAL(38,0), whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows without a null or non-finite entry."""
    rows, _ = set_aside(vectors, "vec_id", "embedding")
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fits = f"x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < {LIMIT // SCALE}D"
    return rows.where(f"size(embedding) > 0 AND forall(embedding, {fits})")


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, staging: Staging | None = None) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding) and component.

    vec_id, component (from 1, by falling eigenvalue), n (usable rows), deviation,
    whitened, explained and identity_error: with x = floor(64 * entry) + 1000000 and
    S the sums of x, deviation is the sum over dimensions of (n x - S)² and whitened
    the projection of x - S / n, divided by the root of the eigenvalue.

    Rows are dropped whose embedding is null, empty, holds null or non-finite
    entries or such as leave no whole number of 64 bits, or differs in length from
    most (of equally frequent lengths the greater counts). Repeated rows count each;
    vec_id may be null. Directions without variance are no components, so without
    rows, or if all are alike, the result is empty. Deviations are whole numbers of up
    to 38 digits.
    """
    spark = vectors.sparkSession
    staging = staging or Staging(spark)
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not most:
        return spark.createDataFrame([], _RESULT)
    dim, n = most[0]["dim"], most[0]["n"]
    rows = rows.where(F.size("embedding") == dim)
    found = moments(rows, dim, n)
    v = found.covariance
    values, axes = components(v, wanted, spark)
    if not len(values):
        return spark.createDataFrame([], _RESULT)
    fields = "vec_id BIGINT, deviation DECIMAL(38,0), whitened ARRAY<DOUBLE>"
    out = rows.mapInArrow(_whitened(dim, axes / np.sqrt(values), n, found.sums), fields)
    out = staging.table(out, "whitened")
    error = float(np.abs(_covariance_of(out, len(values), n) - np.eye(len(values))).max())
    shares = F.array(*[F.lit(float(e)) for e in values / np.trace(v)])
    listed = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return listed.select(
        "vec_id", F.expr("at + 1").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
