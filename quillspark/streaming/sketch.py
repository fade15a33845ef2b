"""A running sketch of the range of streamed rows, one batch at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.linalg import Factors, _orthonormal, _sketch


class RangeSketch:
    """Sums A'A O over the batches of a stream of (id, x); its columns then span what the rows vary in.

    Use `update` as the function of writeStream.foreachBatch. A batch that is sent again is recognised by its
    number, so that each row counts once.
    """

    def __init__(self, width: int, k: int, *, extra: int = 8, seed: int = 7) -> None:
        self._test = np.random.default_rng(seed).standard_normal((width, k + extra))
        self._y = np.zeros_like(self._test)
        self._gram = np.zeros((width, width)) if width <= 512 else None
        self._k, self._last, self.rows = k, -1, 0

    def update(self, batch: DataFrame, number: int) -> None:
        if number <= self._last or batch.isEmpty():
            self._last = max(self._last, number)
            return
        test = self._test
        part = _sketch(batch, lambda ids, x: x.T @ (x @ test), test.shape[1])
        self._y = self._y + part
        if self._gram is not None:
            self._gram = self._gram + _sketch(batch, lambda ids, x: x.T @ x, len(self._test))
        self.rows += batch.agg(F.count("*")).first()[0]
        self._last = number

    def factors(self) -> Factors:
        """Singular values and right vectors of all rows so far; values need rows of 512 columns at most."""
        q = _orthonormal(self._y)
        if self._gram is None:
            return Factors(np.full(min(self._k, q.shape[1]), np.nan), q[:, : self._k], np.zeros(len(q)))
        values, vectors = np.linalg.eigh(q.T @ self._gram @ q)
        order = np.argsort(-values)[: self._k]
        return Factors(np.sqrt(np.maximum(values[order], 0)), q @ vectors[:, order], np.zeros(len(q)))
