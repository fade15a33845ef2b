import math
import random

import duckdb
import pyarrow as pa
import pytest

from quillspark.llm import queries, topk


def expected(rows, k=10, every=100, scale=1024):
    whole = []
    for i, x in rows:
        if i is not None and x is not None and all(e is not None and math.isfinite(e) for e in x):
            whole.append((i, [math.floor(scale * e) for e in x]))
    out = []
    for own, (q, v) in enumerate(whole):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for at, (i, w) in enumerate(whole) if at != own and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<float>, score int")
    return sorted(tuple(x) for x in topk.top_k(df, **more).select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 300)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = random.Random(3)
    f = lambda: [round(r.gauss(0, 1) * 64) / 64 for _ in range(6)]  # noqa: E731  exact as float32
    rows = [(i, f()) for i in range(900)]
    same = f()
    rows += [(i, same) for i in range(900, 1300)]  # ties beyond k
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2100, [float("nan")] * 6), (2200, [float("inf")] * 6), (2300, [1.0, 2.0]), (2301, [2.0, 2.0])]
    rows += [(None, f()), (7, rows[7][1]), (8, f()), (8, [9.0] * 6), (200, f()), (2400, [0.0] * 6), (2500, []), (-100, f())]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, k=3, every=50) == expected(rows, 3, 50)


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (5, [0.5])]) == [(0, 1, 5, 1024 * 512)]
    big = [(0, [2.0**17, 1.0]), (1, [2.0**17, 1.0]), (2, [2.0**16, 3.0])]
    assert run(spark, big) == expected(big)


def test_great_components(spark):
    big = [(0, [2.0**20, 1.0]), (1, [2.0**19, 1.0]), (2, [2.0**18, 3.0]), (3, [-(2.0**20), 0.5]), (100, [0.5, 2.0**19]), (101, [1.0, 1.0])]
    assert run(spark, big) == expected(big)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [2.0**22, 1.0]), (1, [2.0**22, 1.0])])


def test_equal_to_its_sql(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(250)] + [(5, [4.0] * 4), (5, [-4.0] * 4), (100, [1.0] * 4), (100, [1.0] * 4), (300, [3e5, 0.0, -3e5, 1.0])]
    rows += [(400, [2.0**17.9] * 600), (401, [2.0**14] * 600), (402, [-(2.0**13)] * 600), (500, [2.0**13] * 599 + [-3.0])]
    table = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([x for _, x in rows], pa.list_(pa.float32()))})
    duck = duckdb.connect()
    duck.register("embeddings", table)
    want = sorted(duck.execute(queries.ORACLES["op6_exact_topk"].replace("AS BIGINT) AS score", "AS HUGEINT) AS score")).fetchall())
    with pytest.raises(Exception, match="64 bits"):
        run(spark, rows[:-4] + [rows[-4]] * 2)
    assert run(spark, rows) == want == expected([(i, [float(e) for e in x]) for i, x in zip(*table.to_pydict().values(), strict=True)])
