"""Seeding, k-means, flats and subspaces, and connected components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vec import plane_residual, sqdist
from quillspark.sources.files import stored

from .aggregate import mean_vector
from .rows import stacked, whole

Plane = tuple[np.ndarray, np.ndarray]


def _literal(x) -> Column:
    return F.array(*(F.lit(float(v)) for v in x))


def _nested(m) -> Column:
    return F.array(*(_literal(r) for r in m)) if len(m) else F.array().cast("array<array<double>>")


def farthest_sum_seeds(points: DataFrame, k: int, *, allow_fewer: bool = False) -> list[tuple[int, list[float]]]:
    """Seeds (id, x): the point farthest from the mean, then those with the greatest sum of squared distances to all seeds.

    Points within 1e-8 of a seed can't become one. One aggregation per seed; only seeds reach the driver.
    """
    start = [r.mean for r in mean_vector(points).orderBy("dim").collect()]
    seeds: list[tuple[int, list[float]]] = []
    for step in range(k):
        if step:
            from_seeds = [sqdist(F.col("x"), _literal(x)) for _, x in seeds]
            gain = sum(from_seeds[1:], from_seeds[0])
            rows = points.where(F.least(*from_seeds, F.lit(float("inf"))) > 1e-16)
        else:
            gain, rows = sqdist(F.col("x"), _literal(start)), points
        best = rows.agg(F.max_by(F.struct("id", "x"), F.struct(gain.alias("g"), (-F.col("id")).alias("i"))).alias("b")).first().b
        if best is None:
            break
        seeds.append((best.id, list(best.x)))
    if len(seeds) < k and not allow_fewer:
        raise ValueError(f"only {len(seeds)} of {k} seeds are apart")
    return seeds


def weighted_seeds(points: DataFrame, k: int, *, seed: int = 42, spread: str = "min") -> list[tuple[int, list[float]]]:
    """Seeds drawn with chances proportional to the squared distance from the nearest seed ("min") or from all ("sum").

    Each draw is a race of exponential clocks: one aggregation, the same for any partitioning.
    """
    clock = lambda step: -F.log((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(step)), F.lit(1 << 40)) + 0.5) / float(1 << 40))
    seeds: list[tuple[int, list[float]]] = []
    for step in range(k):
        if seeds:
            d = [sqdist(F.col("x"), _literal(x)) for _, x in seeds]
            weight = F.least(*d, F.lit(float("inf"))) if spread == "min" else sum(d[1:], d[0])
        else:
            weight = F.lit(1.0)
        rows = points.withColumn("_w", weight).where("_w > 0")
        best = rows.agg(F.min_by(F.struct("id", "x"), F.struct((clock(step) / F.col("_w")).alias("t"), "id")).alias("b")).first().b
        if best is None:
            break
        seeds.append((best.id, list(best.x)))
    return seeds


def partition_seeds(points: DataFrame, k: int) -> tuple[list[int], DataFrame]:
    """Greedy seeds, each the point farthest from the origin and the seeds so far, and all points with their nearest."""
    seeds: list[tuple[int, list[float]]] = []
    for _ in range(k):
        d = [sqdist(F.col("x"), _literal(x)) for _, x in seeds]
        far = F.least(*d, F.lit(float("inf"))) if d else F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
        best = points.agg(F.max_by(F.struct("id", "x"), F.struct(far.alias("d"), (-F.col("id")).alias("i"))).alias("b")).first().b
        seeds.append((best.id, list(best.x)))
    return [i for i, _ in seeds], assign(points, [x for _, x in seeds])


def assign(points: DataFrame, centers: list[list[float]]) -> DataFrame:
    """`points` with the nearest centre (the first of equals) and the squared distance."""
    options = F.array(*(F.struct(sqdist(F.col("x"), _literal(c)).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centers)))
    return points.withColumn("_n", F.array_min(options)).withColumns({"cluster": F.col("_n.c"), "dist": F.col("_n.d")}).drop("_n")


def kmeans(
    points: DataFrame, k: int, *, steps: int = 100, init: str = "farthest", seed: int = 42, seeds: list[list[float]] | None = None, tol: float = 0.0
) -> tuple[list[list[float]], DataFrame]:
    """Lloyd's algorithm: centres and assignment. A step is one aggregation; an empty cluster keeps its centre."""
    n = points.count()
    if not 1 < k < n:
        raise ValueError("k must be between 1 and the number of points")
    if seeds is None:
        found = farthest_sum_seeds(points, k, allow_fewer=True) if init == "farthest" else weighted_seeds(points, k, seed=seed)
        seeds = [x for _, x in found]
    centers = [list(map(float, c)) for c in seeds]
    for _ in range(steps):
        now = np.array(centers)
        sums = _group_sums(points, lambda x, now=now: (((x[:, None] - now[None]) ** 2).sum(axis=2).argmin(axis=1), None), squares=False)
        after = [(sums[i][1] / sums[i][0]).tolist() if i in sums else c for i, c in enumerate(centers)]
        moved = max(abs(a - b) for x, y in zip(centers, after, strict=True) for a, b in zip(x, y, strict=True))
        centers = after
        if moved <= tol:
            break
    return centers, assign(points, centers)


def _group_sums(points: DataFrame, place, *, squares: bool = True, label: str | None = None) -> dict[int, tuple]:
    """Per cluster: points, their sum, X'X (if `squares`) and the sum of residuals.

    `place` maps a block of rows to clusters (negative: none) and residuals; with `label`, it gets that column
    too. Each partition sends one row per cluster, and rows of one cluster are summed by position, so that
    no group's points meet in one task. One job.
    """
    columns = [F.col("x").cast("array<double>").alias("x"), *([F.col(label).cast("double").alias("k")] if label else [])]

    def sums(batches):
        total: dict[int, list] = {}
        for b in batches:
            if not len(b):
                continue
            x = stacked(b["x"])
            at = 0
            while at < len(x):
                part = x[at : at + 2048]
                own, rest = place(part, b["k"].to_numpy()[at : at + 2048]) if label else place(part)
                for key in np.unique(own[own >= 0]).tolist():
                    mine = part[own == key]
                    got = total.setdefault(int(key), [0, 0.0, 0.0, 0.0])
                    got[0] += len(mine)
                    got[1] = got[1] + mine.sum(axis=0)
                    got[2] = got[2] + (mine.T @ mine if squares else 0.0)
                    got[3] += float(rest[own == key].sum()) if rest is not None else 0.0
                at += 2048
        if total:
            rows = [(k, n, [r, *s.tolist(), *(g.ravel().tolist() if squares else [])]) for k, (n, s, g, r) in total.items()]
            yield pd.DataFrame(rows, columns=["k", "n", "v"])

    parts = whole(points).select(*columns).mapInPandas(sums, "k int, n long, v array<double>").select("k", "n", F.posexplode("v").alias("at", "v"))
    held: dict[int, dict] = {}
    for r in parts.groupBy("k", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        held.setdefault(r.k, {"n": r.n})[r.at] = r.v
    out = {}
    for key, own in held.items():
        n = own.pop("n")
        v = np.array([own[i] for i in range(len(own))])
        d = int((np.sqrt(1 + 4 * (len(v) - 1)) - 1) / 2 + 1e-9) if squares else len(v) - 1
        out[key] = n, v[1 : d + 1], v[d + 1 :].reshape(d, d) if squares else None, float(v[0])
    return out


def _fit(sums: dict[int, tuple], dims: dict[int, int], affine: bool) -> dict[int, Plane]:
    """Means and first directions of the clusters that hold more points than dimensions."""
    out = {}
    for key, (n, total, g, _) in sums.items():
        dim = dims.get(key, 0)
        if n < dim + 1:
            continue
        mean = total / n if affine else np.zeros(len(total))
        out[key] = mean, np.linalg.eigh(g - n * np.outer(mean, mean))[1][:, ::-1][:, :dim].T
    return out


def group_planes(points: DataFrame, label: str, dims: dict[int, int], *, affine: bool = True) -> dict[int, Plane]:
    """Per label: the mean (0 if not affine) and its first directions; labels with too few points or null have none.

    Moments are summed per partition and label: no group's points meet in one task.
    """
    rows = points.where(F.col(label).isNotNull())
    return _fit(_group_sums(rows, lambda x, k: (k.astype(np.int64), None), label=label), dims, affine)


def assign_planes(points: DataFrame, planes: dict[int, Plane]) -> DataFrame:
    """`points` with the nearest plane (the smallest label of equals) and the squared distance to it."""
    options = [
        F.struct(plane_residual(F.col("x"), _literal(c), _nested(b)).alias("d"), F.lit(int(k)).alias("c")) for k, (c, b) in sorted(planes.items())
    ]
    if not options:
        return points.withColumns({"cluster": F.lit(None).cast("int"), "dist": F.lit(float("inf"))})
    return points.withColumn("_n", F.array_min(F.array(*options))).withColumns({"cluster": F.col("_n.c"), "dist": F.col("_n.d")}).drop("_n")


def random_labels(points: DataFrame, k: int, seed: int) -> DataFrame:
    return points.withColumn("label", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int"))


def kflats(points: DataFrame, dims: list[int], *, steps: int = 100, tol: float = 1e-6, seed: int = 1, affine: bool = True) -> tuple[dict[int, Plane], DataFrame]:
    """Planes of the given dimensions by turns of fitting and assigning, from `label` or at random.

    Points with a null label never move. A cluster that runs empty starts again from the farthest points.
    """
    now = points if "label" in points.columns else random_labels(points, len(dims), seed)
    rows = points.where("label IS NOT NULL") if "label" in points.columns else points
    want, error = dict(enumerate(dims)), None
    planes = group_planes(now, "label", want, affine=affine)
    for _ in range(steps):
        for k in set(want) - set(planes):
            far = assign_planes(rows, planes).orderBy(F.desc("dist"), "id").limit(want[k] + 1).collect()
            x = np.array([r.x for r in far])
            mean = x.mean(axis=0) if affine else np.zeros(x.shape[1])
            planes[k] = mean, np.linalg.svd(x - mean, full_matrices=False)[2][: want[k]]
        fixed = dict(planes)

        def nearest(x: np.ndarray, fixed=fixed):
            keys = sorted(fixed)
            far = np.stack([((y := x - fixed[k][0]) ** 2).sum(axis=1) - ((y @ fixed[k][1].T) ** 2).sum(axis=1) for k in keys])
            own = far.argmin(axis=0)
            return np.array(keys)[own], np.maximum(far[own, np.arange(len(x))], 0)

        # one pass assigns, measures the error and gathers what the next planes need
        sums = _group_sums(rows, nearest)
        total = sum(n for n, *_ in sums.values())
        after = float(np.sqrt(sum(r / (len(s) - want[k]) for k, (n, s, _, r) in sums.items() if n > want[k] < len(s)) / max(total, 1)))
        if error is not None and abs(error - after) <= tol:
            break
        error = after
        planes = _fit(sums, want, affine)
    return planes, _relabelled(points, planes)


def _relabelled(points: DataFrame, planes: dict[int, Plane]) -> DataFrame:
    """Nearest planes as labels; null labels stay null."""
    placed = assign_planes(points, planes)
    label = F.when(F.col("label").isNotNull(), F.col("cluster")) if "label" in points.columns else F.col("cluster")
    return placed.withColumn("label", label).drop("cluster", "dist")


def ksubspaces(points: DataFrame, dims: list[int], *, steps: int = 100, seed: int = 1) -> tuple[dict[int, Plane], DataFrame]:
    """Linear flats through the origin."""
    return kflats(points, dims, steps=steps, seed=seed, affine=False)


@dataclass
class Subspaces:
    """Linear flats, labelled rows, the root mean squared distance, the steps taken and how it ended: settled or steps."""

    planes: dict[int, Plane]
    labelled: DataFrame
    error: float
    steps: int
    status: str


def ksubspaces_restarted(points: DataFrame, dims: list[int], *, restarts: int = 5, steps: int = 50, angle: float = 1e-6, seed: int = 1) -> Subspaces:
    """The best of several runs from random labels (the first from `label`, if there is one).

    A run ends when no subspace turns by more than `angle` between two steps.
    """
    from .linalg import subspace_angle

    best = None
    given = "label" in points.columns
    for run in range(restarts):
        start = points if given and run == 0 else random_labels(points.drop("label"), len(dims), seed + run)
        planes = group_planes(start, "label", dict(enumerate(dims)), affine=False)
        status, step = "steps", 0
        for step in range(1, steps + 1):  # noqa: B007  the last is reported
            after, labelled = kflats(assign_planes(points.drop("label"), planes).withColumn("label", F.col("cluster")).drop("cluster", "dist"), dims, steps=1, affine=False)
            turned = max((subspace_angle(planes[k][1].T, after[k][1].T) if k in planes else np.inf for k in after), default=0.0)
            planes = after
            if turned <= angle:
                status = "settled"
                break
        labelled = _relabelled(points.drop("label"), planes)
        error = assign_planes(points, planes).agg(F.avg("dist")).first()[0] or 0.0
        found = Subspaces(planes, labelled, float(np.sqrt(error)), step, status)
        if best is None or found.error < best.error:
            best = found
    return best


def kmeans_subspaces(bases: list[np.ndarray], k: int, *, steps: int = 100, seed: int = 1) -> tuple[list[int], list[np.ndarray]]:
    """k-means of subspaces (orthonormal columns) by the angles to the span that fits a class best."""
    from .linalg import subspace_angle

    rng = np.random.default_rng(seed)
    centers = [bases[i] for i in rng.choice(len(bases), k, replace=False)]
    labels: list[int] = []
    for _ in range(steps):
        after = [int(np.argmin([subspace_angle(c, b) for c in centers])) for b in bases]
        if after == labels:
            break
        labels = after
        for j in range(k):
            own = [b for b, l in zip(bases, labels, strict=True) if l == j]
            if own:
                d = max(b.shape[1] for b in own)
                centers[j] = np.linalg.svd(np.concatenate(own, axis=1), full_matrices=False)[0][:, :d]
    return labels, centers


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, *, limit: int = 60) -> DataFrame:
    """(id, component): the smallest id that can be reached over undirected edges (src, dst).

    Alternates large-star and small-star steps (Kiveris et al., 2014); each is written to the shared folder. Joins
    on a node are salted by its neighbour, so that no node's edges meet in one task. Nodes without an edge (from
    `nodes`, or with an edge to themselves alone) are their own component.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    ids = (ids.union(nodes.select("id")) if nodes is not None else ids).distinct()
    now = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    for _ in range(limit):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _salted(both.where("v > u"), low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        a, b = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after))
        now = after
        if tuple(a) == tuple(b):
            found = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
            return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    raise RuntimeError("components have not settled")


#: Ways a node's edges are spread over.
SALTS = 8


def _salted(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Rows (u, v) with the one value m of their u, joined by u and a part of v."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    every = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return spread.join(every, ["u", "_salt"]).drop("_salt")
