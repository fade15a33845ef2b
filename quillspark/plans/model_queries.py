"""Queries over decompositions, seeds, clusters and planes, in forms whose results SQL can give too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillspark import factorise
from quillspark.functions import vec
from quillspark.operators import cluster, combinatorics, gpca, linalg, planes, score, synth
from quillspark.operators.select import numbered

from .registry import ORACLES, query
from .table_queries import read
from .vector_queries import _P, points, rounded

_ENTRIES = f"WITH {_P} SELECT id, CAST(unnest(range(len(x))) AS INT) AS dim, round(unnest(x), 4) + 0 AS v FROM p"


def entries_of(rows):
    return rows.select("id", F.posexplode("x").alias("dim", "v")).select("id", "dim", (F.round("v", 4) + 0).alias("v"))


def _reconstruction(name: str, factors):
    """All singular triples give the matrix back: the entries of U S V'."""

    @query(name, _ENTRIES)
    def run(spark, sf_dir):
        pts = points(spark, sf_dir)
        f = factors(pts)
        return entries_of(factorise.reconstructed(f.coordinates(pts, unit=True), f.s, f.v))

    return run


_reconstruction("svd_reconstruction", lambda pts: linalg.svd(pts))
_reconstruction("randomised_svd_reconstruction", lambda pts: linalg.randomised_svd(pts, 64))
_reconstruction("double_sided_svd_reconstruction", lambda pts: linalg.double_sided_svd(pts, 64))


def _streamed(pts):
    """The running sketch, fed in four batches of the table."""
    from quillspark.streaming.sketch import RangeSketch

    sketch = RangeSketch(64, 64)
    for n in range(4):
        sketch.update(pts.where(F.col("id") % 4 == n), n)
    return sketch.factors()


_reconstruction("streamed_svd_reconstruction", _streamed)


@query("jacobi_svd_reconstruction", f"""WITH {_P}, f AS (SELECT id, unnest(range(len(x))) AS d, unnest(x) AS v FROM p)
    SELECT CAST(a.d AS INT) AS i, CAST(b.d AS INT) AS j, round(sum(a.v * b.v), 3) + 0 AS v FROM f a JOIN f b USING (id) GROUP BY ALL""")
def jacobi_svd(spark, sf_dir):
    """V S² V' by rotations of the triangle's columns: the Gram matrix."""
    _, s, v = linalg.jacobi_svd(linalg.triangle(points(spark, sf_dir))[1])
    g = (v * s**2) @ v.T
    return spark.createDataFrame([(i, j, float(round(g[i, j], 3)) + 0.0) for i in range(64) for j in range(64)], "i int, j int, v double")


@query("symmetric_eigen_reconstruction", ORACLES["jacobi_svd_reconstruction"])
def symmetric_eigen(spark, sf_dir):
    """V D V' of the sketched eigenvectors of the Gram matrix."""
    _, _, g = linalg.gram(points(spark, sf_dir))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(g)], "id long, x array<double>")
    values, vectors = linalg.symmetric_sketch(rows, 64)
    low, high = linalg.symmetric_eigen(g)
    assert np.allclose(np.sort(values), low, atol=1e-6 * max(1.0, float(np.abs(low).max()))) and high.shape == (64, 64)
    m = (vectors * values) @ vectors.T
    return spark.createDataFrame([(i, j, float(round(m[i, j], 3)) + 0.0) for i in range(64) for j in range(64)], "i int, j int, v double")


@query("pca_full_energy", f"""WITH {_P}, f AS (SELECT unnest(range(len(x))) AS dim, unnest(x) AS v FROM p), c AS (SELECT list(m ORDER BY dim) AS c FROM (SELECT dim, avg(v) AS m FROM f GROUP BY dim))
    SELECT id, round(power(list_distance(x, c), 2), 5) AS energy FROM p, c""")
def pca_full_energy(spark, sf_dir):
    """Squared lengths in all principal directions are the squared distances to the mean."""
    pts = points(spark, sf_dir)
    own = linalg.svd(pts, center=True).coordinates(pts)
    return own.select("id", F.round(vec.dot(F.col("x"), F.col("x")), 5).alias("energy"))


@query("pca_downsample_energy", f"WITH {_P} SELECT id, round(list_sum(list_transform(x, lambda v: v * v)), 5) AS energy FROM p")
def pca_downsample(spark, sf_dir):
    """Without a threshold, all directions are kept, and with them the rows' squared lengths."""
    own = linalg.pca_downsample(points(spark, sf_dir), 1e-12)
    return own.select("id", F.round(vec.dot(F.col("x"), F.col("x")), 5).alias("energy"))


_CHAIN = f"WITH {_P} SELECT a.id AS a, b.id AS b, round(list_distance(a.x, b.x), 5) AS dist FROM p a JOIN p b ON b.id = a.id + 1"


def _chain(rows):
    after = rows.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return rounded(rows.join(after, "id").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), vec.l2(F.col("x"), F.col("y")).alias("dist")), "dist", places=5)


@query("mds_distances", _CHAIN)
def mds_distances(spark, sf_dir):
    """Coordinates by all pairs' distances keep the distance from each point to the next."""
    return _chain(linalg.mds(points(spark, sf_dir), 64))


@query("isomap_distances", _CHAIN)
def isomap_distances(spark, sf_dir):
    """With all points as neighbours, paths are straight: the coordinates keep the distances."""
    pts = points(spark, sf_dir)
    return _chain(linalg.isomap(pts, pts.count() - 1, 64))


_CELLS = """SELECT c_nationkey AS i, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS j,
    CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY ALL"""


def cells(spark, sf_dir):
    """Customers by nation and segment: a sparse matrix of 25 rows."""
    segment = F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END")
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i"), segment.cast("long").alias("j"))
    return rows.agg(F.count("*").cast("double").alias("v"))


@query("sparse_svd_reconstruction", f"WITH e AS ({_CELLS}) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 4) AS v FROM e")
def sparse_svd_reconstruction(spark, sf_dir):
    """The entries of U S V' of a sparse matrix, at the places it holds."""
    e = cells(spark, sf_dir)
    f = linalg.sparse_factors(e, 5)
    both = e.select("i", "j").join(f.coordinates("i").withColumnsRenamed({"id": "i", "x": "a"}), "i").join(f.v.withColumnRenamed("x", "b"), "j")
    return both.select("i", "j", F.round(vec.dot(F.col("a"), F.col("b")), 4).alias("v"))


@query("document_coordinates", f"""WITH e AS ({_CELLS}), g AS (SELECT a.i, b.j, coalesce(e.v, 0) AS v FROM (SELECT DISTINCT i FROM e) a CROSS JOIN (SELECT DISTINCT j FROM e) b LEFT JOIN e ON e.i = a.i AND e.j = b.j)
    SELECT CAST(a.j AS BIGINT) AS a, CAST(b.j AS BIGINT) AS b, round(sqrt(sum(power(a.v - b.v, 2))), 4) AS dist FROM g a JOIN g b ON a.i = b.i AND a.j < b.j GROUP BY ALL""")
def document_coordinates(spark, sf_dir):
    """Columns as rows of V times S keep their distances."""
    x = linalg.sparse_factors(cells(spark, sf_dir), 5).coordinates("j")
    y = x.select(F.col("id").alias("b"), F.col("x").alias("y"))
    return rounded(x.join(y, F.col("id") < F.col("b")).select(F.col("id").alias("a"), "b", vec.l2(F.col("x"), F.col("y")).alias("dist")), "dist", places=4)


@query("document_coordinates_tdm")
def document_coordinates_tdm(spark, sf_dir):
    """Squared lengths of the documents in the first ten directions of the whole term-document matrix."""
    from .text_queries import tdm

    counts = tdm(spark, sf_dir)
    names = numbered(counts.select("term").distinct(), ["term"], "j")
    f = linalg.sparse_factors(counts.join(names, "term").select(F.col("doc_id").alias("i"), "j", F.col("tf").alias("v")), 10)
    return f.coordinates("i").select("id", F.round(vec.dot(F.col("x"), F.col("x")), 2).alias("energy"))


# --- seeds and k-means ---------------------------------------------------------------------------


def _farthest(k: int) -> str:
    """Common table expressions s1, ..., sk (id, x): farthest-sum seeds."""
    out = ["f AS (SELECT unnest(range(len(x))) AS dim, unnest(x) AS v FROM p)", "m0 AS MATERIALIZED (SELECT list(m ORDER BY dim) AS c FROM (SELECT dim, avg(v) AS m FROM f GROUP BY dim))"]
    out.append("s1 AS MATERIALIZED (SELECT id, x FROM p, m0 ORDER BY list_distance(x, c) DESC, id LIMIT 1)")
    for n in range(2, k + 1):
        tables = ", ".join(f"s{i}" for i in range(1, n))
        d = [f"power(list_distance(p.x, s{i}.x), 2)" for i in range(1, n)]
        out.append(f"s{n} AS MATERIALIZED (SELECT p.id, p.x FROM p, {tables} WHERE least({', '.join(d)}) > 1e-16 ORDER BY {' + '.join(d)} DESC, p.id LIMIT 1)")
    return ", ".join(out)


ORACLES["seeds_farthest_sum"] = f"WITH {_P}, {_farthest(5)} " + " UNION ALL ".join(f"SELECT {k - 1} AS step, id FROM s{k}" for k in range(1, 6))


def _partition(k: int) -> str:
    out = ["s1 AS MATERIALIZED (SELECT id, x FROM p ORDER BY list_sum(list_transform(x, lambda v: v * v)) DESC, id LIMIT 1)"]
    for n in range(2, k + 1):
        d = ", ".join(f"list_distance(p.x, s{i}.x)" for i in range(1, n))
        out.append(f"s{n} AS MATERIALIZED (SELECT p.id, p.x FROM p, {', '.join(f's{i}' for i in range(1, n))} ORDER BY least({d}) DESC, p.id LIMIT 1)")
    out.append("s AS (" + " UNION ALL ".join(f"SELECT {i - 1} AS cluster, id AS seed, x FROM s{i}" for i in range(1, k + 1)) + ")")
    return ", ".join(out)


ORACLES["seeds_partition"] = f"""WITH {_P}, {_partition(4)}, d AS (SELECT p.id, cluster, seed, list_distance(p.x, s.x) AS d FROM p, s),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS r FROM d) SELECT CAST(cluster AS INT) AS cluster, count(*) AS n, seed FROM r WHERE r = 1 GROUP BY ALL"""


def _lloyd(k: int, steps: int) -> str:
    """c0, ..., c<steps> (k, c): centres from the farthest-sum seeds on; a<i> (id, k, d) is the assignment to c<i>."""
    out = ["c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i - 1} AS k, x AS c FROM s{i}" for i in range(1, k + 1)) + ")"]
    for n in range(steps + 1):
        out.append(f"""a{n} AS MATERIALIZED (SELECT id, x, k, d FROM (SELECT p.id, p.x, k, power(list_distance(p.x, c), 2) AS d, row_number() OVER (PARTITION BY p.id ORDER BY list_distance(p.x, c), k) AS r
            FROM p, c{n}) WHERE r = 1)""")
        if n < steps:
            out.append(f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT k, list(m ORDER BY dim) AS c FROM
                (SELECT k, dim, avg(v) AS m FROM (SELECT k, unnest(range(len(x))) AS dim, unnest(x) AS v FROM a{n}) GROUP BY ALL) GROUP BY k) m ON m.k = c{n}.k)""")
    return ", ".join(out)


ORACLES["kmeans"] = f"WITH {_P}, {_farthest(5)}, {_lloyd(5, 20)} SELECT id, CAST(k AS INT) AS cluster, round(d, 6) AS dist FROM a20"


def _matching(labels: int) -> str:
    """The greatest sum of counts n(truth, inferred) over one-to-one matchings, by sets of inferred labels."""
    out = ["b0 AS (SELECT 0 AS mask, CAST(0 AS BIGINT) AS best)"]
    for i in range(labels):
        out.append(f"""b{i + 1} AS MATERIALIZED (SELECT mask | (1 << j) AS mask, max(best + coalesce(n, 0)) AS best FROM b{i}, range({labels}) r(j)
            LEFT JOIN n ON truth = {i} AND inferred = j WHERE mask & (1 << j) = 0 GROUP BY ALL)""")
    return ", ".join(out)


ORACLES["clustering_error"] = f"""WITH {_P}, {_farthest(10)}, {_lloyd(10, 10)}, n AS (SELECT p.label AS truth, a10.k AS inferred, count(*) AS n FROM p JOIN a10 USING (id) GROUP BY ALL),
    {_matching(10)} SELECT round(1 - best / (SELECT count(*) FROM p), 6) AS error, CAST(best AS BIGINT) AS matched FROM b10"""


@query("matching_error", f"""WITH {_P}, n AS (SELECT label AS truth, (id * 7 + label * id) % 10 AS inferred, count(*) AS n FROM p GROUP BY ALL), {_matching(10)}
    SELECT round(1 - best / (SELECT count(*) FROM p), 6) AS error, CAST(best AS BIGINT) AS matched FROM b10""")
def matching_error(spark, sf_dir):
    """The error of given labels under the best matching."""
    pts = points(spark, sf_dir)
    other = ((F.col("id") * 7 + F.col("label") * F.col("id")) % 10).cast("int")
    error, right, _ = score.clustering_error(pts, pts.select("id", other.alias("label")))
    return spark.createDataFrame([(round(error, 6), right)], "error double, matched long")


@query("weighted_seeds_distinct", "SELECT 6 AS n")
def weighted_seeds(spark, sf_dir):
    """Seeds drawn by distance are different points."""
    found = cluster.weighted_seeds(points(spark, sf_dir), 6, seed=4)
    return spark.createDataFrame([(len({i for i, _ in found}),)], "n int")


# --- planes --------------------------------------------------------------------------------------

ORACLES["bases_by_label"] = f"""WITH {_P}, f AS (SELECT label, unnest(range(len(x))) AS dim, unnest(x) AS v FROM p), m AS (SELECT label, dim, avg(v) AS m FROM f GROUP BY ALL)
    SELECT label, 3 AS dim, round(sqrt(sum(m * m)), 6) AS center_norm FROM m GROUP BY label"""


@query("subspace_bases_energy", f"WITH {_P} SELECT id, round(list_sum(list_transform(x, lambda v: v * v)), 5) AS energy FROM p")
def subspace_bases(spark, sf_dir):
    """Whole bases of each label's points, uncentred, keep the squared lengths."""
    pts = points(spark, sf_dir)
    found = cluster.group_planes(pts.withColumn("one", F.lit(0)), "one", {0: 64}, affine=False)
    basis = found[0][1]
    own = linalg.Factors(np.ones(64), basis.T, np.zeros(64)).coordinates(pts)
    return own.select("id", F.round(vec.dot(F.col("x"), F.col("x")), 5).alias("energy"))


def axis_planes(spark, sf_dir):
    """Planes of the first three axes through the labels' means."""
    from quillspark.operators import aggregate

    rows = aggregate.centers(points(spark, sf_dir), "label").collect()
    return {r.label: (np.array(r.center), np.eye(64)[:3]) for r in rows}


_MEANS = f"{_P}, f AS (SELECT label, unnest(range(len(x))) AS dim, unnest(x) AS v FROM p), c AS (SELECT label AS k, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(v) AS m FROM f GROUP BY ALL) GROUP BY label)"
_REST = "list_sum(list_transform(list_zip(x[4:], c[4:]), lambda z: power(z[1] - z[2], 2)))"


@query("p2pdist_axes", f"WITH {_MEANS} SELECT id, CAST(k AS INT) AS cluster, round({_REST}, 6) AS dist FROM p, c")
def p2pdist_axes(spark, sf_dir):
    return rounded(planes.plane_distances(points(spark, sf_dir), axis_planes(spark, sf_dir)), "dist")


@query("l2error_axes", f"WITH {_MEANS} SELECT round(sqrt(sum({_REST} / 61) / count(*)), 6) AS error FROM p JOIN c ON p.label = c.k")
def l2error_axes(spark, sf_dir):
    found = axis_planes(spark, sf_dir)
    return spark.createDataFrame([(round(planes.l2_error(points(spark, sf_dir), found, dict.fromkeys(found, 3)), 6),)], "error double")


@query("assign_planes_axes", f"WITH {_MEANS}, d AS (SELECT id, k, {_REST} AS d FROM p, c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM d) SELECT id, CAST(k AS INT) AS cluster, round(d, 6) AS dist FROM r WHERE r = 1")
def assign_planes_axes(spark, sf_dir):
    return rounded(cluster.assign_planes(points(spark, sf_dir), axis_planes(spark, sf_dir)).select("id", "cluster", "dist"), "dist")


def planted(spark, sf_dir, affine: bool = False):
    """Points of two planes in four dimensions from the table's coordinates, with labels that are wrong for every tenth point."""
    a, b, zero = F.get("x", F.lit(0)), F.get("x", F.lit(1)), F.lit(0.0)
    even = F.col("id") % 2 == 0
    shift = F.lit(3.0 if affine else 0.0)
    x = F.when(even, F.array(a, b, zero, zero)).otherwise(F.array(shift, zero, a, b))
    truth = (F.col("id") % 2).cast("int")
    return points(spark, sf_dir).select("id", x.alias("x"), F.when(F.col("id") % 10 == 0, 1 - truth).otherwise(truth).alias("label"))


def named_by_least(labelled):
    """Clusters named by their smallest id: no label to choose."""
    least = labelled.groupBy("label").agg(F.min("id").alias("cluster"))
    return labelled.join(F.broadcast(least), "label").select("id", "cluster")


_PLANTED = f"WITH {_P} SELECT id, id % 2 AS cluster FROM p"


@query("kflats_planted", _PLANTED)
def kflats_planted(spark, sf_dir):
    return named_by_least(cluster.kflats(planted(spark, sf_dir, affine=True), [2, 2], steps=30)[1])


@query("ksubspaces_planted", _PLANTED)
def ksubspaces_planted(spark, sf_dir):
    found = cluster.ksubspaces_restarted(planted(spark, sf_dir), [2, 2], restarts=2, steps=15)
    assert found.status == "settled"
    return named_by_least(found.labelled)


@query("gpca_planted", f"WITH {_P} SELECT id, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 1 ELSE 2 END AS cluster FROM p")
def gpca_planted(spark, sf_dir):
    """Two planes and a line in space, elected by the normals of vanishing forms."""
    a, b, zero = F.get("x", F.lit(0)), F.get("x", F.lit(1)), F.lit(0.0)
    x = F.when(F.col("id") % 3 == 0, F.array(a, b, zero)).when(F.col("id") % 3 == 1, F.array(zero, a, b)).otherwise(F.array(a, a, a))
    pts = points(spark, sf_dir).select("id", x.alias("x"))
    return named_by_least(gpca.gpca(pts, [2, 2, 1])[1])


@query("gpca_affine_planted", f"WITH {_P} SELECT id, id % 2 AS cluster FROM p")
def gpca_affine_planted(spark, sf_dir):
    """Two lines in the plane that miss the origin, with a further coordinate of ones."""
    a = F.get("x", F.lit(0))
    x = F.when(F.col("id") % 2 == 0, F.array(a, F.lit(2.0))).otherwise(F.array(F.lit(3.0), a - 5))
    return named_by_least(gpca.gpca(points(spark, sf_dir).select("id", x.alias("x")), [1, 1], affine=True)[1])


@query("veronese_map", f"""WITH {_P} SELECT id, CAST(k AS INT) AS k, round([x[1] * x[1], x[1] * x[2], x[1] * x[3], x[2] * x[2], x[2] * x[3], x[3] * x[3]][k + 1], 6) + 0 AS v FROM p, range(6) r(k)""")
def veronese_map(spark, sf_dir):
    rows = points(spark, sf_dir).select("id", F.posexplode(gpca.veronese(F.col("x"), 2, 3)).alias("k", "v"))
    return rows.select("id", "k", (F.round("v", 6) + 0).alias("v"))


@query("veronese_rank", "SELECT 4 AS rank")
def veronese_rank(spark, sf_dir):
    """Squares of a plane's and a line's points span three and one of the six monomials."""
    a, b, zero = F.get("x", F.lit(0)), F.get("x", F.lit(1)), F.lit(0.0)
    x = F.when(F.col("id") % 2 == 0, F.array(a, b, zero)).otherwise(F.array(zero, zero, a))
    return spark.createDataFrame([(gpca.veronese_rank(points(spark, sf_dir).select("id", x.alias("x")), 2),)], "rank int")


@query("hilbert_table", """WITH c AS (SELECT a, b, d FROM range(1, 4) x(a), range(1, 4) y(b), range(1, 4) z(d) WHERE a <= b AND b <= d),
    s AS (SELECT a, b, d, m, (CASE WHEN m & 1 > 0 THEN 4 - a ELSE 0 END) + (CASE WHEN m & 2 > 0 THEN 4 - b ELSE 0 END) + (CASE WHEN m & 4 > 0 THEN 4 - d ELSE 0 END) AS c,
        CASE WHEN bit_count(m) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM c, range(8) r(m)),
    t AS (SELECT a, b, d, sign, 6 - c AS n, 3 - c AS k FROM s WHERE c < 4)
    SELECT CAST(a AS INT) AS d1, CAST(b AS INT) AS d2, CAST(d AS INT) AS d3, CAST(sum(sign * factorial(CAST(n AS INT)) / (factorial(CAST(k AS INT)) * factorial(CAST(n - k AS INT)))) AS INT) AS forms FROM t GROUP BY ALL""")
def hilbert_table(spark, sf_dir):
    rows = [(*dims, forms) for dims, forms in gpca.hilbert_table(4, 3)]
    return spark.createDataFrame(rows, "d1 int, d2 int, d3 int, forms int")


@query("energy_subspaces", "SELECT CAST(k AS INT) AS sample, CAST(CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 1 ELSE 2 END AS INT) AS cluster FROM range(10) r(k)")
def energy_subspaces(spark, sf_dir):
    """Ten sets of points by label, moved to three subspaces, by the dimension that holds their energy."""
    rows = points(spark, sf_dir).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("id", F.slice("x", 1, 2).alias("x")))).alias("m")).orderBy("label").collect()
    samples = []
    for r in rows:
        x = np.array([list(m.x) for m in r.m])
        z = np.zeros((len(x), 4))
        if r.label % 3 == 0:
            z[:, :2] = x
        elif r.label % 3 == 1:
            z[:, 2:] = x
        else:
            z[:, 0] = z[:, 3] = x[:, 0]
        samples.append(z)
    labels, _ = gpca.energy_subspaces(samples, 0.999)
    return spark.createDataFrame(list(enumerate(labels)), "sample int, cluster int")


@query("kmeans_subspaces", "SELECT CAST(k AS INT) AS sample, CAST(k % 2 AS INT) AS cluster FROM range(8) r(k)")
def kmeans_subspaces(spark, sf_dir):
    """Eight planes, near one of two, by their angles."""
    rng = np.random.default_rng(2)
    bases = [np.linalg.qr(np.eye(4)[:, (0, 1) if k % 2 == 0 else (2, 3)] + 0.01 * rng.standard_normal((4, 2)))[0] for k in range(8)]
    best = None
    for seed in range(6):
        labels, centers = cluster.kmeans_subspaces(bases, 2, seed=seed)
        cost = sum(linalg.subspace_angle(centers[l], b) for l, b in zip(labels, bases, strict=True))
        best = min(best or (cost, labels), (cost, labels))
    first = {}
    return spark.createDataFrame([(k, min(first.setdefault(l, k), k)) for k, l in enumerate(best[1])], "sample int, cluster int")


@query("subspace_angles", f"WITH {_P} SELECT id, round(degrees(asin(least(1, abs(x[3]) / sqrt(x[1] * x[1] + x[2] * x[2] + x[3] * x[3])))), 4) AS angle FROM p")
def subspace_angles(spark, sf_dir):
    """Angle between each point's direction in space and the plane of the first two axes, in degrees."""
    plane = np.eye(3)[:, :2]

    def angles(batches):
        for b in batches:
            x = [np.asarray(v[:3], float).reshape(3, 1) for v in b["x"]]
            b["angle"] = [linalg.average_basis_error([plane], [v / np.linalg.norm(v)]) for v in x]
            yield b[["id", "angle"]]

    return rounded(points(spark, sf_dir).select("id", "x").mapInPandas(angles, "id long, angle double"), "angle", places=4)


@query("local_dimensions", f"WITH {_P} SELECT id % 2 + 1 AS dim, least(count(*), 8) > 0 AS found FROM p GROUP BY ALL")
def local_dimensions(spark, sf_dir):
    """Seeds on a line and on a plane far apart show their dimensions at growing radii."""
    a, b, zero = F.get("x", F.lit(0)), F.get("x", F.lit(1)), F.lit(0.0)
    x = F.when(F.col("id") % 2 == 0, F.array(a, zero, zero)).otherwise(F.array(a, b, F.lit(50.0)))
    pts = points(spark, sf_dir).select("id", x.alias("x"))
    found = planes.local_svd(pts, planes.Options(n0=12, dmax=2, kmax=4))
    right = all(d == i % 2 + 1 for i, d in zip(found.seeds, found.dims, strict=True))
    return spark.createDataFrame([(d, right) for d in sorted(set(found.dims))], "dim long, found boolean")


@query("arrangement_planted", f"WITH {_P} SELECT id, id % 2 AS cluster FROM p")
def arrangement_planted(spark, sf_dir):
    """The whole analysis on a line and a plane that are far apart."""
    a, b, zero = F.get("x", F.lit(0)), F.get("x", F.lit(1)), F.lit(0.0)
    x = F.when(F.col("id") % 2 == 0, F.array(a, zero, zero)).otherwise(F.array(a, b, F.lit(50.0)))
    pts = points(spark, sf_dir).select("id", x.alias("x"))
    found = planes.arrangement(pts, planes.Options(k=2, dmax=2, n0=40))
    assert sorted(found.dims.values()) == [1, 2] and set(found.planes) == {0, 1} and found.eps > 0
    return named_by_least(found.labelled)


# --- numbers and samples -------------------------------------------------------------------------


@query("next_permutations", """WITH q AS (SELECT a, b, c, d FROM range(1, 5) w(a), range(1, 5) x(b), range(1, 5) y(c), range(1, 5) z(d)
    WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d), r AS (SELECT *, row_number() OVER (ORDER BY a, b, c, d) AS n FROM q)
    SELECT CASE WHEN n = 1 THEN 24 ELSE n - 1 END AS step, CAST(a * 1000 + b * 100 + c * 10 + d AS BIGINT) AS digits FROM r""")
def next_permutations(spark, sf_dir):
    found = combinatorics.next_permutations([1, 2, 3, 4], 24)
    return spark.createDataFrame([(i + 1, int("".join(map(str, p)))) for i, p in enumerate(found)], "step long, digits long")


@query("balls_and_bins", "SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(c AS INT) AS c FROM range(6) x(a), range(6) y(b), range(6) z(c) WHERE a + b + c = 5")
def balls_and_bins(spark, sf_dir):
    return spark.createDataFrame(list(combinatorics.balls_and_bins(5, 3)), "a int, b int, c int")


@query("group_dimensions", "SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(c AS INT) AS c FROM range(1, 5) x(a), range(1, 5) y(b), range(1, 5) z(c) WHERE a <= b AND b <= c")
def group_dimensions(spark, sf_dir):
    return spark.createDataFrame(combinatorics.group_dimensions(5, 3), "a int, b int, c int")


@query("hypersphere", "SELECT CAST(d AS INT) AS dim, round(power(pi(), d / 2) / gamma(d / 2 + 1) * power(1.5, d), 6) AS volume, round(d * power(pi(), d / 2) / gamma(d / 2 + 1) * power(1.5, d - 1), 6) AS area FROM range(1, 13) r(d)")
def hypersphere(spark, sf_dir):
    rows = [(d, round(combinatorics.hypersphere_volume(d, 1.5), 6), round(combinatorics.hypersphere_area(d, 1.5), 6)) for d in range(1, 13)]
    return spark.createDataFrame(rows, "dim int, volume double, area double")


@query("random_shapes", "SELECT true AS rotation, true AS surface, true AS ball, true AS noise")
def random_shapes(spark, sf_dir):
    """Rotations are orthonormal with determinant 1, points lie on or in the ball, uniform noise within its bounds."""
    rng = np.random.default_rng(3)
    turns = [synth.rotation(rng, d) for d in range(2, 8)]
    on, within = synth.on_hypersphere(rng, 500, 5), synth.inside_hypersphere(rng, 500, 5)
    noise = synth.uniform_noise(rng, on, 0.25)
    facts = (
        all(np.allclose(t @ t.T, np.eye(len(t))) and np.isclose(np.linalg.det(t), 1) for t in turns), bool(np.allclose(np.linalg.norm(on, axis=1), 1)),
        bool((np.linalg.norm(within, axis=1) <= 1).all()), bool((np.abs(noise - on) <= 0.25).all()),
    )
    return spark.createDataFrame([tuple(map(bool, facts))], "rotation boolean, surface boolean, ball boolean, noise boolean")


@query("random_permutation", f"WITH {_P} SELECT row_number() OVER (ORDER BY id) - 1 AS place, true AS there FROM p")
def random_permutation(spark, sf_dir):
    """Places of a random permutation of the points: each once."""
    found = synth.permutation(points(spark, sf_dir).select("id"), "id", seed=9)
    return found.groupBy("place").agg((F.count("*") == 1).alias("there"))


@query("random_moments", "SELECT true AS uniform, true AS normal FROM (SELECT count(*) FROM orders)")
def random_moments(spark, sf_dir):
    """Means and spreads of uniform and normal numbers by key, within five standard errors."""
    rows = read(spark, sf_dir, "orders").select(synth.uniform("o_orderkey", 1).alias("u"), synth.normal("o_orderkey", 2).alias("z"))
    r = rows.agg(F.count("*").alias("n"), F.avg("u").alias("mu"), F.var_samp("u").alias("vu"), F.avg("z").alias("mz"), F.var_samp("z").alias("vz")).first()
    error = 5 / r.n**0.5
    facts = abs(r.mu - 0.5) < error and abs(r.vu - 1 / 12) < error, abs(r.mz) < error and abs(r.vz - 1) < 2 * error
    return spark.createDataFrame([facts], "uniform boolean, normal boolean")


@query("generated_samples", "SELECT CAST(k AS INT) AS label, 100 AS n, true AS flat, true AS apart FROM range(3) r(k)")
def generated_samples(spark, sf_dir):
    """Points of planes without noise: each class lies in a plane of its dimension, and classes that avoid each other are apart."""
    a = synth.generate_samples(4, [100, 100, 100], [2, 2, 1], avoid=0.05, seed=6)
    labels, out = np.array(a.labels), []
    for k, d in enumerate((2, 2, 1)):
        x = a.x[labels == k]
        s = np.linalg.svd(x, compute_uv=False)
        others = [b for j, b in enumerate(a.bases) if j != k]
        far = min(np.linalg.norm(x - x @ b @ b.T, axis=1).min() for b in others)
        out.append((k, len(x), bool((s[d:] < 1e-9 * s[0]).all()), bool(far >= 0.05)))
    return spark.createDataFrame(out, "label int, n int, flat boolean, apart boolean")
