"""Algebraic subspace clustering: Veronese maps, vanishing polynomials, votes of their normals, and refinements."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import Plane, assign_planes, kflats
from .combinatorics import balls_and_bins, group_dimensions, hilbert_function
from .linalg import subspace_angle
from .rows import stacked, whole


def exponents(degree: int, ambient: int) -> np.ndarray:
    return np.array(list(balls_and_bins(degree, ambient)))


def veronese(x: Column, degree: int, ambient: int) -> Column:
    """All monomials of a degree of a vector's coordinates, in reverse lexicographic order of the exponents."""

    def monomial(powers: Sequence[int]) -> Column:
        out = F.lit(1.0)
        for d, p in enumerate(powers):
            for _ in range(p):
                out = out * F.get(x, F.lit(d))
        return out

    return F.array(*(monomial(p) for p in balls_and_bins(degree, ambient)))


def hilbert_constraint(ambient: int, dims: Sequence[int]) -> int:
    """Independent forms, of the degree of their number, that vanish on subspaces of these dimensions in general position."""
    return hilbert_function(len(dims), ambient, [ambient - d for d in dims])


def hilbert_table(ambient: int, groups: int) -> list[tuple[tuple[int, ...], int]]:
    """The dimensions of all configurations, with their constraint."""
    return [(dims, hilbert_constraint(ambient, dims)) for dims in group_dimensions(ambient, groups)]


def _map(x: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return np.prod(x[:, None, :] ** powers[None], axis=2)


def vanishing_forms(points: DataFrame, degree: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (columns) of the `count` forms that are least on the points, and the exponents.

    The moment matrix of the Veronese map is summed inside each partition; points count by their direction.
    """
    ambient = points.select(F.size("x")).first()[0]
    powers = exponents(degree, ambient)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(powers), len(powers)))
        for b in batches:
            if len(b):
                x = stacked(b["x"])
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                v = _map(x, powers)
                total += v.T @ v
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, "v": total.ravel()})

    rows = whole(points).select(F.col("x").cast("array<double>").alias("x")).mapInPandas(sums, "i int, j int, v double")
    m = np.zeros((len(powers), len(powers)))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        m[r.i, r.j] = r.v
    return np.linalg.eigh(m)[1][:, :count], powers


def _gradients(x: np.ndarray, forms: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """(points, ambient, forms): the derivatives of the forms at the points."""
    out = np.zeros((len(x), x.shape[1], forms.shape[1]))
    for d in range(x.shape[1]):
        own = powers[:, d] > 0
        lower = powers[own].copy()
        lower[:, d] -= 1
        out[:, d] = (_map(x, lower) * powers[own, d]) @ forms[own]
    return out


def vote(points: DataFrame, dims: Sequence[int], *, angle: float = 0.25, candidates: int = 500, seed: int = 5) -> list[np.ndarray]:
    """Orthonormal bases (columns) of subspaces with the given dimensions, by votes of the points' normals.

    The derivatives of the vanishing forms at a point span the complement of its subspace. Normals at at most
    `candidates` points stand for election; all points vote, inside their partitions, for those within `angle`.
    The winner of each dimension takes its voters out of the race.
    """
    ambient = points.select(F.size("x")).first()[0]
    forms, powers = vanishing_forms(points, len(dims), hilbert_constraint(ambient, dims))
    rows = whole(points).select("id", F.col("x").cast("array<double>").alias("x")).where(F.exists("x", lambda v: v != 0))

    def normals(x: np.ndarray, codim: int) -> np.ndarray:
        return np.linalg.svd(_gradients(x / np.linalg.norm(x, axis=1, keepdims=True), forms, powers), full_matrices=False)[0][:, :, :codim]

    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(candidates).collect()
    sample = np.array([r.x for r in picked])
    gone, out = [], []
    for dim in sorted(dims):
        codim = ambient - dim
        stand = normals(sample, codim)

        def count(batches: Iterator[pd.DataFrame], stand=stand, codim=codim, gone=tuple(gone)) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(stand), np.int64)
            for b in batches:
                for at in range(0, len(b), 1024):
                    x = stacked(b["x"].iloc[at : at + 1024])
                    for basis in gone:
                        rest = x - x @ basis @ basis.T
                        x = x[np.linalg.norm(rest, axis=1) > np.sin(angle) * np.linalg.norm(x, axis=1)]
                    if len(x):
                        own = normals(x, codim)
                        # squared cosines of the angles between the complements, least of all directions
                        cross = np.einsum("cda,pdb->cpab", stand, own)
                        total += (np.linalg.svd(cross, compute_uv=False)[..., -1] >= np.cos(angle)).sum(axis=1)
            yield pd.DataFrame({"c": np.arange(len(stand)), "n": total})

        tally = rows.mapInPandas(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
        best = tally.orderBy(F.desc("n"), "c").first()
        if best is None:
            break
        complement = stand[best.c]
        basis = np.linalg.svd(np.eye(ambient) - complement @ complement.T)[0][:, :dim]
        gone.append(basis)
        out.append(basis)
    return out


def gpca(points: DataFrame, dims: Sequence[int], *, affine: bool = False, steps: int = 20, **options) -> tuple[dict[int, Plane], DataFrame]:
    """Planes and labelled points: elected subspaces, then assignment and refits in turns until labels stay.

    With `affine`, points get a further coordinate 1 and planes of one dimension more through the origin; the
    rows that come back keep it.
    """
    if affine:
        points = points.withColumn("x", F.concat(F.col("x").cast("array<double>"), F.array(F.lit(1.0))))
        dims = [d + 1 for d in dims]
    bases = vote(points, dims, **options)
    start = {k: (np.zeros(len(b)), b.T) for k, b in enumerate(bases)}
    labelled = assign_planes(points.drop("label"), start).withColumn("label", F.col("cluster")).drop("cluster", "dist")
    return kflats(labelled, sorted(dims), steps=steps, affine=False)


def energy_subspaces(samples: Sequence[np.ndarray], energy: float = 0.95, *, angle: float = 0.3) -> tuple[list[int], list[np.ndarray]]:
    """Classes of small point sets (rows), and a basis of each class.

    A set's dimension is the least whose directions hold the share `energy` of its squared lengths; it joins the
    first class of that dimension within `angle`, or begins one. Bases are those of all a class's sets together.
    """
    def fit(x: np.ndarray) -> np.ndarray:
        _, s, vt = np.linalg.svd(x, full_matrices=False)
        share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
        return vt[: int(np.searchsorted(share, energy - 1e-12)) + 1].T

    labels, bases, held = [], [], []
    for x in samples:
        own = fit(np.asarray(x, float))
        for k, b in enumerate(bases):
            if b.shape[1] == own.shape[1] and subspace_angle(b, own) <= angle:
                held[k].append(x)
                bases[k] = np.linalg.svd(np.concatenate(held[k]), full_matrices=False)[2][: b.shape[1]].T
                labels.append(k)
                break
        else:
            labels.append(len(bases))
            bases.append(own)
            held.append([x])
    return labels, bases


def veronese_rank(points: DataFrame, degree: int, *, cut: float = 1e-9) -> int:
    """The rank of the Veronese map of the points: monomials less the forms that vanish on all of them."""
    ambient = points.select(F.size("x")).first()[0]
    size = math.comb(degree + ambient - 1, ambient - 1)
    forms, powers = vanishing_forms(points, degree, size)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                x = stacked(b["x"])
                total += ((_map(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), powers) @ forms) ** 2).sum(axis=0)
        yield pd.DataFrame({"c": np.arange(size), "v": total})

    found = whole(points).select(F.col("x").cast("array<double>").alias("x")).mapInPandas(least, "c int, v double").groupBy("c").agg(F.sum("v").alias("v")).collect()
    values = np.sqrt([r.v for r in found])
    return int((values > cut * max(values.max(initial=0), 1e-300)).sum())
