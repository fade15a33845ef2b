import random

from quillspark.llm import _shared


def test_components_against_union_find(spark, tmp_path):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(0, i) for i in range(400, 900)] + [(5, 5), (7, 8), (8, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {x.id: x.component_id for x in _shared.components(df, f"file://{tmp_path}/c").collect()}
    assert got == {x: root(x) for x in parent}
    assert _shared.components(df.where("src < 0"), f"file://{tmp_path}/d").count() == 0


def test_marked_never_misses(spark):
    df = spark.range(20_000).selectExpr("id", "cast(id as string) as k")
    some = df.where("id % 7 = 0").select("k")
    got = _shared.marked(df, "k", some, "k", bits=1 << 18)
    assert got.where("id % 7 = 0 AND NOT _marked").count() == 0
    assert got.where("id % 7 > 0 AND _marked").count() < 1000
    assert got.count() == 20_000
    assert _shared.marked(df, "k", some.limit(0), "k").where("_marked").count() == 0


def test_bounded_sample(spark):
    df = spark.range(5000)
    assert 700 < _shared.bounded_sample(df, ["id"], 1000).count() <= 1000
    assert _shared.bounded_sample(df, ["id"], 5000).count() == 5000
