"""Seeded samples of plane arrangements."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Arrangement:
    x: np.ndarray
    labels: list[int | None]
    bases: list[np.ndarray]

    def points(self, spark: SparkSession) -> DataFrame:
        rows = [(i, [float(v) for v in x], label) for i, (x, label) in enumerate(zip(self.x, self.labels, strict=True))]
        return spark.createDataFrame(rows, "id long, x array<double>, label int")


def rotation(rng: np.random.Generator, dim: int) -> np.ndarray:
    """A random rotation (determinant 1)."""
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    q = q * np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return q


def inside_hypersphere(rng: np.random.Generator, n: int, dim: int) -> np.ndarray:
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.random((n, 1)) ** (1 / dim)


def on_hypersphere(rng: np.random.Generator, n: int, dim: int) -> np.ndarray:
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def uniform_noise(rng: np.random.Generator, x: np.ndarray, size: float) -> np.ndarray:
    return x + rng.uniform(-size, size, x.shape)


def uniform(key: str, seed: int) -> Column:
    """A number between 0 and 1 (both left out) for each key: the same wherever the row is."""
    return (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 50)) + 0.5) / float(1 << 50)


def normal(key: str, seed: int) -> Column:
    """A standard normal number for each key, from two uniform ones in polar form."""
    other = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 50)) + 0.5) / float(1 << 50)
    return F.sqrt(-2 * F.log(uniform(key, seed))) * F.cos(2 * np.pi * other)


def permutation(rows: DataFrame, key: str, *, seed: int) -> DataFrame:
    """`rows` with their place (from 0) in a random order that the keys and the seed fix."""
    from .select import numbered

    return numbered(rows.withColumn("_draw", F.xxhash64(F.col(key), F.lit(seed))), ["_draw", key], "place").drop("_draw")


def generate_samples(
    ambient: int, sizes: Sequence[int], dims: Sequence[int], *, noise: float = 0.0, noise_kind: str = "normal", affine: bool = False, outliers: float = 0.0, least_angle: float = 0.0,
    avoid: float = 0.0, seed: int = 42,
) -> Arrangement:
    """Points on random planes, with noise (normal or uniform), and a share of uniform outliers whose label is null.

    With `avoid`, points nearer than that to another plane are drawn again. Planes are drawn again until each pair is `least_angle` (radians) apart, at most 1000 times.
    """
    from .linalg import subspace_angle

    rng = np.random.default_rng(seed)
    for _ in range(1000):
        bases = [rotation(rng, ambient)[:, :d] for d in dims]
        if all(subspace_angle(a, b) >= least_angle for i, a in enumerate(bases) for b in bases[:i]):
            break
    else:
        raise ValueError("no planes so far apart were found")
    centers = [rng.normal(0, 0.5, ambient) if affine else np.zeros(ambient) for _ in dims]
    rest = lambda x, k: np.linalg.norm((x - centers[k]) - (x - centers[k]) @ bases[k] @ bases[k].T, axis=1)
    parts, labels = [], []
    for k, (n, basis) in enumerate(zip(sizes, bases, strict=True)):
        x = np.zeros((0, ambient))
        for _ in range(1000):
            more = inside_hypersphere(rng, n, basis.shape[1]) @ basis.T + centers[k]
            if avoid:
                more = more[np.all([rest(more, j) >= avoid for j in range(len(dims)) if j != k] or [np.ones(n, bool)], axis=0)]
            x = np.concatenate((x, more))[:n]
            if len(x) == n:
                break
        else:
            raise ValueError("the planes are too near each other to be avoided")
        x = uniform_noise(rng, x, noise) if noise_kind == "uniform" else x + noise * rng.standard_normal(x.shape)
        parts.append(x)
        labels += [k] * n
    extra = round(outliers * len(labels))
    if extra:
        parts.append(rng.uniform(-1, 1, (extra, ambient)))
        labels += [None] * extra
    return Arrangement(np.concatenate(parts), labels, bases)
