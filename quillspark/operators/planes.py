"""Plane arrangements: errors, local multiscale dimension, spectral affinity, and the whole clustering."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.files import stored

from .cluster import Plane, assign_planes, group_planes, kmeans
from .neighbors import farthest, knn
from .rows import stacked, whole


@dataclass
class Options:
    """What the arrangement needs to know; unset values follow from the points."""

    n0: int | None = None  # seeds to sample
    dmax: int | None = None  # greatest dimension of a plane
    kmax: int = 10  # greatest number of planes tried
    k: int | None = None  # the number of planes, if known
    seeds: list[int] | None = None
    alpha0: float = 0.3  # a singular value below this share of the one before is noise
    scales: int = 8
    outliers: int = 0
    normalise_u: bool = True
    seed_type: str = "farthest"
    seed: int = 7
    dimension_limit: int | None = None  # a hard bound of dmax
    discard_rows: tuple[int, ...] = ()
    discard_columns: tuple[int, ...] = ()

    def settled(self, points: DataFrame) -> Options:
        """All values set."""
        width = points.select(F.size("x")).first()[0]
        dmax = min(self.dmax or max(1, width - 1), self.dimension_limit or width)
        return Options(**{**self.__dict__, "n0": self.n0 or 20 * (self.k or self.kmax), "dmax": dmax})


def plane_distances(points: DataFrame, planes: dict[int, Plane]) -> DataFrame:
    """(id, cluster, dist): the squared distance of every point to every plane."""
    keys = sorted(planes)

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                x = stacked(part["x"])
                far = [((y := x - planes[k][0]) ** 2).sum(axis=1) - ((y @ planes[k][1].T) ** 2).sum(axis=1) for k in keys]
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), len(keys)), "cluster": np.tile(keys, len(part)), "dist": np.maximum(np.stack(far, axis=1), 0).ravel()})

    rows = whole(points).select("id", F.col("x").cast("array<double>").alias("x"))
    return rows.mapInPandas(run, "id long, cluster int, dist double") if keys else rows.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("dist")).limit(0)


def l2_error(points: DataFrame, planes: dict[int, Plane], dims: dict[int, int], *, label: str = "label") -> float:
    """Root of the mean over labelled points of the squared residual per free dimension.

    Clusters with no more points than dimensions add nothing, nor do those that fill the space.
    """
    from quillspark.functions.vec import plane_residual

    from .cluster import _literal, _nested

    value, free = F.lit(None).cast("double"), F.lit(None).cast("int")
    for k, (c, b) in planes.items():
        value = F.when(F.col(label) == k, plane_residual(F.col("x"), _literal(c), _nested(b))).otherwise(value)
        free = F.when(F.col(label) == k, F.size("x") - dims[k]).otherwise(free)
    rows = points.where(F.col(label).isNotNull()).select(F.col(label).alias("k"), value.alias("r"), free.alias("f"))
    parts = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.max("f").alias("f")).collect()
    total = sum(p.n for p in parts)
    found = sum(p.r / p.f for p in parts if p.k in planes and p.f and p.f > 0 and p.n > dims[p.k])
    return float(np.sqrt(found / total)) if total else 0.0


def estimate_dimension(radii: np.ndarray, spectra: np.ndarray, alpha0: float, dmax: int) -> tuple[int, int, int]:
    """Local dimension from singular values at growing radii, with the first and last scale that show it.

    Noise directions keep their size while true ones grow with the radius. The dimension is where, at the
    scales past the noise, a value first falls below alpha0 of the one before.
    """
    scales, width = spectra.shape
    ratio = spectra[:, 1:] / np.maximum(spectra[:, :-1], 1e-300)
    votes = []
    for s in range(scales):
        drop = np.flatnonzero(ratio[s, :dmax] < alpha0)
        votes.append(int(drop[0]) + 1 if len(drop) else min(dmax, width))
    late = votes[scales // 3 :]
    dim = int(np.bincount(late).argmax())
    good = [s for s in range(scales) if votes[s] == dim]
    last = good[-1]
    for s in range(good[0], scales):
        if votes[s] != dim:
            last = s - 1
            break
    return dim, good[0], max(last, good[0])


@dataclass
class LocalPlanes:
    """Seeds with the region, dimension and plane that fit them."""

    seeds: list[int] = field(default_factory=list)
    dims: list[int] = field(default_factory=list)
    scales: list[tuple[int, int]] = field(default_factory=list)
    regions: list[tuple[int, float]] = field(default_factory=list)  # points, and the sum of their squared distances to the plane
    planes: list[Plane] = field(default_factory=list)


def local_svd(points: DataFrame, options: Options) -> LocalPlanes:
    """Multiscale singular values around sampled seeds: one task per seed, over its neighbours only."""
    o = options.settled(points)
    n = points.count()
    if o.seeds is not None:
        seeds = points.where(F.col("id").isin([int(s) for s in o.seeds]))
    else:
        seeds = points.orderBy(F.xxhash64("id", F.lit(o.seed)), "id").limit(min(o.n0, n))
    width = points.select(F.size("x")).first()[0]
    most = max(min(n, max(8 * (o.dmax + 1), n // max(2, o.kmax))), min(n, 2 * (o.dmax + 1)))
    near = knn(seeds, points, most).join(points.select(F.col("id").alias("i"), "x"), "i")
    least, scales, alpha0, dmax = min(most, 2 * (o.dmax + 1)), o.scales, o.alpha0, min(o.dmax, width)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "i"])
        x = stacked(pdf["x"])
        sizes = np.unique(np.linspace(least, len(x), scales).astype(int))
        spectra = np.array([np.linalg.svd(x[:m] - x[:m].mean(axis=0), compute_uv=False)[: min(least - 1, width)] / np.sqrt(m) for m in sizes])
        dim, low, high = estimate_dimension(pdf["dist"].to_numpy()[sizes - 1], spectra, alpha0, dmax)
        own = x[: sizes[high]]
        center = own.mean(axis=0)
        basis = np.linalg.svd(own - center, full_matrices=False)[2][:dim]
        # the region's squared distances to its plane: only their sum goes on
        rest = ((own - center) ** 2).sum() - (((own - center) @ basis.T) ** 2).sum()
        return pd.DataFrame(
            {"q": [pdf["q"].iloc[0]], "dim": [dim], "low": [low], "high": [high], "size": [int(sizes[high])], "rest": [max(float(rest), 0.0)], "center": [center.tolist()], "basis": [basis.ravel().tolist()]}
        )

    schema = "q long, dim int, low int, high int, size long, rest double, center array<double>, basis array<double>"
    out = LocalPlanes()
    for r in near.groupBy("q").applyInPandas(fit, schema).orderBy("q").collect():
        out.seeds.append(r.q)
        out.dims.append(r.dim)
        out.scales.append((r.low, r.high))
        out.regions.append((r["size"], r.rest))
        out.planes.append((np.array(r.center), np.array(r.basis).reshape(r.dim, width)))
    return out


def noise_scale(local: LocalPlanes) -> float:
    """The mean squared distance of the regions' points to their planes."""
    n = sum(m for m, _ in local.regions)
    return max(sum(r for _, r in local.regions) / n if n else 0.0, 1e-12)


def affinity_coordinates(points: DataFrame, local: LocalPlanes, k: int, *, normalise_u: bool = True) -> DataFrame:
    """Rows of the first k left singular vectors of exp(-dist² / (2 eps)) between points and local planes."""
    from .linalg import Factors, partial_moments

    planes, eps = dict(enumerate(local.planes)), noise_scale(local)
    dist = plane_distances(points, planes)
    rows = dist.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "dist"))), lambda s: F.exp(-s["dist"] / (2 * eps))).alias("x"))
    g = partial_moments(rows).groupBy("i", "j").agg(F.sum("ab").alias("ab")).collect()
    m = np.zeros((len(planes), len(planes)))
    for r in g:
        m[r.i, r.j] = r.ab
    unit = 1 / np.sqrt(np.maximum(np.diag(m), 1e-300))
    values, vectors = np.linalg.eigh(m * unit[:, None] * unit)
    order = np.argsort(-values)[:k]
    u = Factors(np.sqrt(np.maximum(values[order], 1e-300)), vectors[:, order] * unit[:, None], np.zeros(len(planes))).coordinates(rows, unit=True)
    if normalise_u:
        from quillspark.functions.vec import normalise

        u = u.withColumn("x", normalise(F.col("x")))
    return u


def cluster_rows(u: DataFrame, k: int, *, seed_type: str = "farthest") -> DataFrame:
    """(id, label): clusters of the rows of U by k-means; one cluster needs no search."""
    if k == 1:
        return u.select("id", F.lit(0).alias("label"))
    _, labelled = kmeans(u, k, init=seed_type)
    return labelled.select("id", F.col("cluster").alias("label"))


@dataclass
class Arrangement:
    """Planes that were found: labelled rows (null: outlier), per plane its dimension, centre and basis (rows), the error, the
    error for each number of planes that was tried, and the noise scale."""

    labelled: DataFrame
    dims: dict[int, int]
    planes: dict[int, Plane]
    error: float
    errors: dict[int, float]
    eps: float


def spectral_analysis(points: DataFrame, local: LocalPlanes, k: int, options: Options) -> Arrangement:
    """The arrangement of k planes: rows of U are clustered, dimensions are the modes of the seeds' in each cluster,
    and planes are fitted and points assigned in turns while the distances fall."""
    o = options
    dims_of = dict(zip(local.seeds, local.dims, strict=True))
    whole_dim = int(np.bincount(local.dims).argmax())
    u = stored(affinity_coordinates(points, local, k, normalise_u=o.normalise_u), "rows-of-u") if k > 1 else points
    now = points.join(cluster_rows(u, k, seed_type=o.seed_type), "id")
    now = stored(now, "clusters")
    own = now.where(F.col("id").isin(local.seeds)).select("id", "label").collect()
    dims = {}
    for c in range(k):
        found = [dims_of[r.id] for r in own if r.label == c]
        dims[c] = int(np.bincount(found).argmax()) if found else whole_dim
    planes = group_planes(now, "label", dims)
    labelled, error, used = now, None, planes
    for _ in range(10):  # refit while the distances fall
        placed = assign_planes(points, planes)
        if o.outliers:
            placed = farthest(placed, o.outliers).withColumn("label", F.when(~F.col("outlier"), F.col("cluster"))).drop("outlier")
        else:
            placed = placed.withColumn("label", F.col("cluster"))
        total = placed.where("label IS NOT NULL").agg(F.sum(F.sqrt("dist"))).first()[0] or 0.0
        if error is not None and total >= error * (1 - 1e-9):
            break
        labelled, error, used = placed.select("id", "x", "label"), total, planes
        planes = planes | group_planes(labelled, "label", dims)
    model = l2_error(labelled, planes, dims)
    return Arrangement(labelled, dims, planes if labelled is not now else used, model, {k: model}, noise_scale(local))


def arrangement(points: DataFrame, options: Options | None = None) -> Arrangement:
    """Planes through the points, with all that the analysis finds.

    Local planes around seeds give an affinity; `spectral_analysis` is done for the given number of planes or
    for 1 up to kmax, where a further plane must halve the error. Outliers, if any, are the farthest points;
    points in `discard_rows` and coordinates in `discard_columns` take no part.
    """
    o = options or Options()
    points = whole(points).select("id", F.col("x").cast("array<double>").alias("x"))
    if o.discard_rows:
        points = points.where(~F.col("id").isin([int(i) for i in o.discard_rows]))
    if o.discard_columns:
        points = points.withColumn("x", F.filter("x", lambda _, i: ~i.isin([int(c) for c in o.discard_columns])))
    o = o.settled(points)
    local = local_svd(points, o)
    best, errors = None, {}
    for k in [o.k] if o.k else range(1, o.kmax + 1):
        now = spectral_analysis(points, local, k, o)
        errors[k] = now.error
        if best is None or now.error < 0.5 * best.error:
            best = now
    best.errors = errors
    return best


def arrange(points: DataFrame, options: Options | None = None) -> tuple[DataFrame, dict[int, int], float]:
    """Labels (null: outlier), plane dimensions and model error of `arrangement`."""
    found = arrangement(points, options)
    return found.labelled, found.dims, found.error
