"""Agreement of labels: confusion matrix, best matching, errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """(truth, inferred, n) over the ids in both, with zeros for pairs that don't occur."""
    both = truth.select("id", F.col("label").alias("truth")).join(inferred.select("id", F.col("label").alias("inferred")), "id")
    counts = both.groupBy("truth", "inferred").agg(F.count("*").alias("n"))
    labels = counts.select("truth").distinct().crossJoin(F.broadcast(counts.select("inferred").distinct()))
    return labels.join(counts, ["truth", "inferred"], "left").select("truth", "inferred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def hungarian(cost: np.ndarray) -> list[int]:
    """The column of each row in an assignment of least cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            slack = np.append(np.inf, cost[i0 - 1] - u[i0] - v[1:])
            better = ~used & (slack < low)
            low[better], way[better] = slack[better], j0
            open_ = np.where(used, np.inf, low)
            open_[0] = np.inf
            j1 = int(open_.argmin())
            step = open_[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def clustering_error(truth: DataFrame, inferred: DataFrame) -> tuple[float, int, dict[int, int]]:
    """Share of points outside the best one-to-one matching of labels, the matched count, and the matching.

    Only the table of counts reaches the driver; any number of clusters, equal or not.
    """
    rows = confusion(truth, inferred).collect()
    a, b = sorted({r.truth for r in rows if r.truth is not None}), sorted({r.inferred for r in rows if r.inferred is not None})
    size = max(len(a), len(b))
    table = np.zeros((size, size))
    total = sum(r.n for r in rows)
    for r in rows:
        if r.truth is not None and r.inferred is not None:
            table[a.index(r.truth), b.index(r.inferred)] = r.n
    match = hungarian(-table) if size else []
    right = int(sum(table[i, j] for i, j in enumerate(match)))
    names = {b[j]: a[i] for i, j in enumerate(match) if i < len(a) and j < len(b)}
    return (1 - right / total if total else 0.0), right, names


def relabel(truth: DataFrame, inferred: DataFrame, dims: dict[int, int]) -> DataFrame:
    """Inferred labels renamed to the best matching true ones of the same dimension; null labels stay null."""
    rows = [r for r in confusion(truth, inferred).collect() if r.truth is not None and r.inferred is not None]
    a, b = sorted({r.truth for r in rows}), sorted({r.inferred for r in rows})
    size = max(len(a), len(b))
    cost = np.zeros((size, size))
    for r in rows:
        cost[a.index(r.truth), b.index(r.inferred)] = -r.n if dims.get(r.truth) == dims.get(r.inferred) else 1e6
    names = {b[j]: a[i] for i, j in enumerate(hungarian(cost)) if i < len(a) and j < len(b)}
    label = F.lit(None).cast("int")
    for k, v in names.items():
        label = F.when(F.col("label") == k, v).otherwise(label)
    return inferred.withColumn("label", label.cast("int"))
