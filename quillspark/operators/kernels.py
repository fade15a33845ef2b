"""Kernel densities and regressions. Queries are asked in blocks against all points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import vec
from quillspark.sources.files import delete, shared_folder, write_whole

from .blocks import over_cells
from .neighbors import _cells, _squares, knn
from .rows import stacked, whole

Kernel = Callable[[np.ndarray], np.ndarray]

#: Points of a block of the kernel matrix.
BLOCK = 4096


def gaussian(s: float) -> Kernel:
    return lambda d2: np.exp(-d2 / (2 * s * s))


def epanechnikov(s: float, dim: int) -> Kernel:
    return lambda d2: np.where(d2 <= s * s, (1 - d2 / (s * s)) * 0.75**dim, 0.0)


def triangle(s: float) -> Kernel:
    return lambda d2: np.where(d2 <= s * s, (s - np.sqrt(d2)) / s, 0.0)


def triweight(s: float) -> Kernel:
    return lambda d2: np.where(d2 <= s * s, ((s * s - d2) / (s * s)) ** 3, 0.0)


def anisotropic(covariance: np.ndarray, floor: float = 0.001) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """exp(-(a - b)' C^-1 (a - b)) with the eigenvalues of C at `floor` at least."""
    values, vectors = np.linalg.eigh(covariance)
    inverse = vectors @ np.diag(1 / np.maximum(values, floor)) @ vectors.T
    return lambda a, b: np.exp(-np.einsum("...i,ij,...j->...", a - b, inverse, a - b))


def mahalanobis_kernel(directions: np.ndarray, variances: np.ndarray, orthogonal: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """exp(-sum (e_i'd)² / var_i - rest² / orthogonal), with the directions as rows."""

    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        along = d @ directions.T
        rest = (d * d).sum(axis=-1) - (along * along).sum(axis=-1)
        return np.exp(-(along**2 / variances).sum(axis=-1) - rest / orthogonal)

    return k


def _sums(queries: DataFrame, points: DataFrame, kernel: Kernel, value: str | None, leave_out: bool, cut: float | None) -> DataFrame:
    """Per query: the sum of kernel weights, and of weights times `value` (array) if given."""
    pts = points.select("id", "x", *([F.col(value).cast("array<double>").alias("y")] if value else []))
    table = pts.select(F.col("id"), F.concat("x", *(["y"] if value else [])).alias("x")) if value else pts
    width = points.select(F.size("x")).first()[0]

    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"q": [], "w": [], "wy": []})
        all_, ids = stacked(c["x"]), c["i"].to_numpy()
        x, y = all_[:, :width], all_[:, width:]
        out, step = [], max(1, (1 << 22) // max(1, x.size))
        for at in range(0, len(q), step):
            part = q.iloc[at : at + step]
            d2 = _squares(stacked(part["x"]), x)
            w = kernel(d2)
            if cut is not None:
                w = np.where(d2 <= cut * cut, w, 0.0)
            if leave_out:
                w = np.where(part["q"].to_numpy()[:, None] == ids[None], 0.0, w)
            out.append(pd.DataFrame({"q": part["q"].to_numpy(), "w": w.sum(axis=1), "wy": list(w @ y)}))
        return pd.concat(out)

    found = _cells(queries, table, work, "q long, w double, wy array<double>")
    if not value:
        return found.groupBy("q").agg(F.sum("w").alias("w"))
    flat = found.select("q", "w", F.posexplode("wy").alias("dim", "v")).groupBy("q", "dim").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    return flat.groupBy("q").agg(F.max("w").alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("wy"))


def density(queries: DataFrame, points: DataFrame, kernel: Kernel, *, leave_out: bool = False) -> DataFrame:
    """(q, density): the sum of the kernel over all points, without the query's own row if asked; not normalised."""
    return _sums(queries, points, kernel, None, leave_out, None).withColumnRenamed("w", "density")


def weighted_density(queries: DataFrame, points: DataFrame, kernel: Kernel, weight: str) -> DataFrame:
    found = _sums(queries, points.withColumn("_y", F.array(F.col(weight).cast("double"))), kernel, "_y", False, None)
    return found.select("q", F.get("wy", F.lit(0)).alias("density"))


def adaptive_density(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """0.75 * sum(1 - d_i / d_k) / sqrt(d_k) over the k nearest, with squared distances d."""
    near = knn(queries, points, k, metric="sq")
    last = near.groupBy("q").agg(F.max("dist").alias("dk"))
    return near.join(last, "q").groupBy("q").agg(F.sum(F.when(F.col("dk") > 0, 0.75 * (1 - F.col("dist") / F.col("dk")) / F.sqrt("dk"))).alias("density"))


def regression(queries: DataFrame, points: DataFrame, kernel: Kernel, value: str, *, cut: float | None = None) -> DataFrame:
    """(q, y): the kernel-weighted mean of `value` (array) over the points, within `cut` if given; null without weight."""
    found = _sums(queries, points, kernel, value, False, cut)
    return found.select("q", F.when(F.col("w") > 0, F.transform("wy", lambda v: v / F.col("w"))).alias("y"))


def local_linear(queries: DataFrame, points: DataFrame, k: int, s: float, value: str) -> DataFrame:
    """(q, y, slope, error): weighted least squares over the k nearest points, per query."""
    near = knn(queries, points, k).join(points.select(F.col("id").alias("i"), "x", F.col(value).alias("_y")), "i")
    near = near.join(queries.select(F.col("id").alias("q"), F.col("x").alias("_q")), "q")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(pdf["x"].to_numpy()), pdf["_y"].to_numpy(float)
        w = np.exp(-(pdf["dist"].to_numpy() ** 2) / (2 * s * s))
        a = np.concatenate((np.ones((len(x), 1)), x - np.asarray(pdf["_q"].iloc[0])), axis=1)
        beta = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        error = float((w * (a @ beta - y) ** 2).sum() / max((w * w).sum(), 1e-300))
        return pd.DataFrame({"q": [pdf["q"].iloc[0]], "y": [beta[0]], "slope": [beta[1:].tolist()], "error": [error]})

    return near.groupBy("q").applyInPandas(fit, "q long, y double, slope array<double>, error double")


@dataclass(frozen=True)
class Radial:
    """A kernel of the distance with its derivatives: by the point (`gradient`) and by its scale (`by_scale`)."""

    value: Callable[[Column], Column]
    slope: Callable[[Column], Column]  # of the kernel by the squared distance
    by_scale: Callable[[Column], Column]

    def __call__(self, a: Column, b: Column) -> Column:
        return self.value(vec.sqdist(a, b))

    def gradient(self, a: Column, b: Column) -> Column:
        """By a's coordinates."""
        return vec.scale(vec.subtract(a, b), 2 * self.slope(vec.sqdist(a, b)))


def radial(kind: str, s: float, dim: int = 1) -> Radial:
    """gaussian, epanechnikov, triangle or triweight with scale s."""
    inside = lambda d, v: F.when(d <= s * s, v).otherwise(0.0)
    root = lambda d: F.when(d > 0, F.sqrt(d)).otherwise(1e-300)
    u = lambda d: 1 - d / (s * s)
    c = 0.75**dim
    return {
        "gaussian": Radial(lambda d: vec.gaussian(d, s), lambda d: -vec.gaussian(d, s) / (2 * s * s), lambda d: vec.gaussian(d, s) * d / s**3),
        "epanechnikov": Radial(lambda d: vec.epanechnikov(d, s, dim), lambda d: inside(d, F.lit(-c / (s * s))), lambda d: inside(d, 2 * c * d / s**3)),
        "triangle": Radial(lambda d: vec.triangle(d, s), lambda d: inside(d, -1 / (2 * s * root(d))), lambda d: inside(d, F.sqrt(d) / (s * s))),
        "triweight": Radial(lambda d: vec.triweight(d, s), lambda d: inside(d, -3 * u(d) * u(d) / (s * s)), lambda d: inside(d, 6 * u(d) * u(d) * d / s**3)),
    }[kind]


def interpolator(points: DataFrame, s: float, value: str, *, ridge: float = 0.0, most: int = 4000) -> Callable[[DataFrame], DataFrame]:
    """A function that gives (q, y) for queries: Gaussian sums through the points' values.

    The weights solve the points' kernel matrix: up to `most` points on the driver, more by conjugate gradients, whose
    steps compute the matrix anew in blocks of points. The driver holds points and weights, but no pairs.
    """
    pts = whole(points).select("id", F.col("x").cast("array<double>").alias("x"), F.col(value).cast("double").alias("y"))
    rows = pts.toArrow().sort_by("id")
    x, y = _matrix(rows.column("x")), rows.column("y").to_numpy()
    spark = points.sparkSession
    if len(y) > most:
        weights = _solved(spark, x, y, s, ridge)
    else:
        weights = np.linalg.solve(np.exp(-_squares(x, x) / (2 * s * s)) + ridge * np.eye(len(x)), y)
    table = spark.createDataFrame(pa.table({"id": rows.column("id"), "x": rows.column("x"), "w": _lists(weights[:, None])}))

    def ask(queries: DataFrame) -> DataFrame:
        return _sums(queries, table, gaussian(s), "w", False, None).select("q", F.get("wy", F.lit(0)).alias("y"))

    return ask


#: Points that the preconditioner compares all with; kernel from which points are near; near points that are solved together.
LANDMARKS, NEAR, TOGETHER = 128, 0.5, 1024
#: Relative error of the values at which the steps end, that of a run of steps in single precision, and steps at most.
TOLERANCE, RUN, STEPS = 1e-7, 1e-3, 2000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors, which have one length."""
    rows = column.combine_chunks()
    widths = np.unique(rows.value_lengths().to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors have different lengths: {widths[:5].tolist()}")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _sides(x: np.ndarray, s: float, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Points as left and right factors: exp(left @ right.T) is their Gaussian kernel."""
    x = x / s
    half, one = -(x * x).sum(axis=1)[:, None] / 2, np.ones((len(x), 1))
    return np.concatenate((x, half, one), axis=1).astype(kind), np.concatenate((x, one, half), axis=1).astype(kind)


def _gauss(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    k = left @ right.T
    return np.exp(np.minimum(k, 0, out=k), out=k)


def _solved(spark: SparkSession, x: np.ndarray, y: np.ndarray, s: float, ridge: float) -> np.ndarray:
    """Weights of the points `x` whose Gaussian sums are `y` at the points.

    Conjugate gradients in runs: single precision brings a run's error down to RUN, double precision says what is left.
    """
    if not np.isfinite(y).all():
        raise ValueError("a point's value is null or not finite")
    x = x - x.mean(axis=0)
    blocks = -(-len(x) // BLOCK)
    table = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "x": _lists(x)}))
    folder = shared_folder(spark, "kernel")
    write_whole(table.withColumn("block", F.floor(F.col("id") / BLOCK).cast("int")).repartition("block").sortWithinPartitions("id"), folder, "block")
    # the factors' products lose too much where points are very far from each other
    wide = np.abs(x).max() / s > 1e3

    def ready(part: pa.Table):
        part = part.sort_by("id")
        rows = _matrix(part.column("x"))
        return int(part.column("id")[0].as_py()), rows, _sides(rows, s, np.float32), _sides(rows, s, np.float64)

    def kernel(a, b, exact: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of the kernel matrix of two blocks, a few at a time."""
        for at in range(0, len(a[1]), 256):
            if wide:
                yield at, np.exp(-_squares(a[1][at : at + 256], b[1]) / (2 * s * s))
            else:
                yield at, _gauss(a[3 if exact else 2][0][at : at + 256], b[3 if exact else 2][1])

    def cells(work, schema: str) -> DataFrame:
        return over_cells(spark, folder, blocks, ["id", "x"], ready, work, schema, together=8)

    def times(p: np.ndarray, exact: bool) -> np.ndarray:
        """The kernel matrix times p."""
        held = spark.sparkContext.broadcast(p)

        def work(a, b, same: bool) -> Iterator[pa.RecordBatch]:
            kind = np.float64 if exact else np.float32
            p, q = held.value[a[0] : a[0] + len(a[1])].astype(kind), held.value[b[0] : b[0] + len(b[1])].astype(kind)
            left, right = np.zeros(len(p)), np.zeros(len(q))
            for at, k in kernel(a, b, exact):
                left[at : at + len(k)] = k @ q
                right += p[at : at + len(k)] @ k
            out = [(a[0], left)] + ([] if same else [(b[0], right)])
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1].tobytes() for o in out], pa.binary())], names=["low", "v"])

        total = ridge * p
        for r in cells(work, "low long, v binary").collect():
            v = np.frombuffer(r.v)
            total[r.low : r.low + len(v)] += v
        held.unpersist()
        return total

    def close(a, b, same: bool) -> Iterator[pa.RecordBatch]:
        """For each point the first one before it that is near, of each block."""
        for at, k in kernel(a, b, False):
            near = k >= NEAR
            j = near.argmax(axis=1)
            i = np.flatnonzero(near[np.arange(len(k)), j])
            p, q = a[0] + at + i, b[0] + j[i]
            p, q = p[q < p], q[q < p]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary())], names=["p", "q"])

    links = [(np.frombuffer(r.p, np.int64), np.frombuffer(r.q, np.int64)) for r in cells(close, "p binary, q binary").collect()]
    rough = _rough(x, s, ridge, *(np.concatenate([n[k] for n in links] or [np.zeros(0, np.int64)]) for k in (0, 1)))
    w, step = np.zeros(len(y)), 0
    rest, most = y.copy(), np.abs(y).max()
    while np.abs(rest).max() > TOLERANCE * most:
        end = max(RUN * np.abs(rest).max(), TOLERANCE * most / 2)
        more, left = np.zeros(len(y)), rest.copy()
        z = rough(left)
        p, size = z, left @ z
        while np.abs(left).max() > end:
            step += 1
            if step > STEPS:
                raise ValueError(f"the values are not reached in {STEPS} steps: points with different values are too near to each other")
            q = times(p, False)
            part = size / (p @ q)
            more, left = more + part * p, left - part * q
            z = rough(left)
            size, before = left @ z, size
            p = z + size / before * p
        w = w + more
        rest = y - times(w, True)
    delete(spark, folder)
    return w


def _rough(x: np.ndarray, s: float, ridge: float, p: np.ndarray, q: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """About the inverse of the kernel matrix: that of landmarks' part of it, and what is left of it inside groups of near points.

    `p` and `q` are near each other, one by one.
    """
    group = np.arange(len(x))
    while True:
        new = group.copy()
        np.minimum.at(new, p, group[q])
        np.minimum.at(new, q, group[p])
        new = new[new]
        if (new == group).all():
            break
        group = new
    firsts, sizes = np.unique(group, return_counts=True)
    marks = np.sort(np.random.default_rng(0).permutation(firsts)[:LANDMARKS])
    left, right = _sides(x, s, np.float64)
    values, vectors = np.linalg.eigh(_gauss(left[marks], right[marks]))
    u = _gauss(left, right[marks]) @ (vectors / np.sqrt(np.maximum(values, 1e-8)))
    single = 1 / np.maximum(1 + ridge - (u * u).sum(axis=1), 1e-4)
    # all inverses together are bounded
    together = TOGETHER if (np.minimum(sizes[sizes > 1], TOGETHER) * sizes[sizes > 1]).sum() <= 1 << 24 else 128
    order = np.argsort(group, kind="stable")
    inverses = []
    for own in np.split(order, np.cumsum(sizes)[:-1]):
        for at in range(0, len(own) if len(own) > 1 else 0, together):
            i = own[at : at + together]
            values, vectors = np.linalg.eigh(_gauss(left[i], right[i]) + ridge * np.eye(len(i)) - u[i] @ u[i].T)
            inverses.append((i, (vectors / np.maximum(values, 1e-6)) @ vectors.T))

    def inside(r: np.ndarray) -> np.ndarray:
        out = r * (single if r.ndim == 1 else single[:, None])
        for i, inverse in inverses:
            out[i] = inverse @ r[i]
        return out

    middle = np.eye(len(marks))
    for at in range(0, len(marks), 64):
        middle[:, at : at + 64] += u.T @ inside(u[:, at : at + 64])
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    middle = (vectors / np.maximum(values, 0.5)) @ vectors.T

    def rough(r: np.ndarray) -> np.ndarray:
        v = inside(r)
        return v - inside(u @ (middle @ (u.T @ v)))

    return rough


def project(queries: DataFrame, points: DataFrame, k: int, s: float) -> DataFrame:
    """(q, y): each query moved to the kernel-weighted mean of its k nearest points."""
    near = knn(queries, points, k).join(points.select(F.col("id").alias("i"), F.col("x").cast("array<double>").alias("x")), "i")
    w = F.exp(-F.col("dist") * F.col("dist") / (2 * s * s))
    flat = near.select("q", w.alias("w"), F.posexplode("x").alias("dim", "v")).groupBy("q", "dim").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    return flat.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda r: r["m"]).alias("y"))


def tangent_project(queries: DataFrame, points: DataFrame, k: int, dim: int) -> DataFrame:
    """(q, y): each query moved to the plane of `dim` directions that fits its k nearest points."""
    near = knn(queries, points, k).join(points.select(F.col("id").alias("i"), F.col("x").cast("array<double>").alias("x")), "i")
    near = near.join(queries.select(F.col("id").alias("q"), F.col("x").cast("array<double>").alias("_q")), "q")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, q = stacked(pdf["x"]), np.asarray(pdf["_q"].iloc[0])
        mean = x.mean(axis=0)
        basis = np.linalg.svd(x - mean, full_matrices=False)[2][:dim]
        return pd.DataFrame({"q": [pdf["q"].iloc[0]], "y": [(mean + (q - mean) @ basis.T @ basis).tolist()]})

    return near.groupBy("q").applyInPandas(fit, "q long, y array<double>")


def conditional_columns(points: DataFrame, target: int, *, weight: str | None = None) -> DataFrame:
    """(id, expected, variance, density): one coordinate given the others, under the Gaussian of all (weighted) points.

    Mean and covariance are summed inside each partition; each row is then an expression of its own. The variance
    is 1e-8 at least.
    """
    from .linalg import partial_moments

    sums = partial_moments(points, weight).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sw", "sa", "sb", "ab"))).collect()
    d = max(r.i for r in sums) + 1
    mean, c = np.zeros(d), np.zeros((d, d))
    for r in sums:
        mean[r.i] = r.sa / r.sw
        c[r.i, r.j] = (r.ab - r.sa * r.sb / r.sw) / (r.sw if weight else r.n - 1)
    others = [i for i in range(d) if i != target]
    try:
        beta = np.linalg.solve(c[np.ix_(others, others)], c[others, target])
    except np.linalg.LinAlgError:
        beta = np.zeros(len(others))
    variance = float(max(c[target, target] - beta @ c[others, target], 1e-8))
    expected = F.lit(float(mean[target]))
    for i, b in zip(others, beta, strict=True):
        expected = expected + float(b) * (F.get("x", F.lit(i)) - float(mean[i]))
    rest = F.get("x", F.lit(target)) - F.col("expected")
    rows = whole(points).select("id", F.col("x").cast("array<double>").alias("x")).withColumn("expected", expected)
    return rows.select("id", "expected", F.lit(variance).alias("variance"), (F.exp(-rest * rest / (2 * variance)) / math.sqrt(2 * math.pi * variance)).alias("density"))


def conditional_gaussian(mean: np.ndarray, covariance: np.ndarray, target: int, rest: np.ndarray) -> tuple[float, float]:
    """Expectation and variance of one coordinate given the others; the variance is 1e-8 at least."""
    others = [i for i in range(len(mean)) if i != target]
    c = covariance[np.ix_(others, others)]
    try:
        coefficients = np.linalg.solve(c, covariance[others, target])
    except np.linalg.LinAlgError:
        coefficients = np.zeros(len(others))
    expected = mean[target] + coefficients @ (rest - mean[others])
    return float(expected), float(max(covariance[target, target] - coefficients @ covariance[others, target], 1e-8))
