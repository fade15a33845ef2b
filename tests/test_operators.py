import math
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import geometry, vec
from quillspark.operators import aggregate, cluster, combinatorics, graph, kernels, linalg, matrix, neighbors, planes, score, select, synth, text


def frame(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], *([] if labels is None else [labels[i]])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>" + ("" if labels is None else ", label int"))


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(0).standard_normal((300, 6)) * [5, 3, 2, 1, 0.5, 0.1]


# --- decompositions ------------------------------------------------------------------------------


def test_svd_of_the_known_matrix(spark):
    m = np.zeros((4, 3))
    m[0, 0], m[1, 0], m[2, 1], m[3, 2] = 5.3, 2, 8.91, 0.11
    assert np.allclose(linalg.svd(frame(spark, m)).s, [8.91, 5.6648036, 0.11], atol=1e-6)
    entries = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double")
    assert np.allclose(linalg.sparse_svd(entries, 3), [8.91, 5.6648036, 0.11], atol=1e-6)


def test_svd_against_numpy(spark, cloud):
    pts = frame(spark, cloud)
    u, s, vt = np.linalg.svd(cloud, full_matrices=False)
    f = linalg.svd(pts, 4)
    assert np.allclose(f.s, s[:4]) and np.allclose(np.abs((f.v * vt[:4].T).sum(axis=0)), 1)
    own = np.array([r.x for r in f.coordinates(pts).orderBy("id").collect()])
    assert np.allclose(np.abs(own), np.abs(u[:, :4] * s[:4]))
    centred = cloud - cloud.mean(axis=0)
    assert np.allclose(linalg.svd(pts, center=True).s, np.linalg.svd(centred, compute_uv=False))
    assert np.allclose(linalg.randomised_svd(pts, 3, power=3).s, s[:3], rtol=1e-3)
    assert len(linalg.svd(pts, cut=0.5).s) == (s > 0.5 * s[0]).sum()
    assert len(linalg.randomised_svd(frame(spark, np.zeros((5, 4))), 2).s) == 0


def test_mds_isomap_and_angles(spark):
    x = np.random.default_rng(1).standard_normal((15, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    y = linalg.metric_mds(d, 3)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2)), d)
    t = np.linspace(0, np.pi, 40)
    arc = frame(spark, np.stack([np.cos(t), np.sin(t)], axis=1))
    z = np.array([r.x[0] for r in linalg.isomap(arc, 2, 1).orderBy("id").collect()])
    assert abs(np.corrcoef(z, t)[0, 1]) > 0.999  # the arc unrolls
    a, b = np.eye(3)[:, :2], np.array([[1.0], [1.0], [1.0]]) / math.sqrt(3)
    assert linalg.subspace_angle(a, b) == pytest.approx(math.asin(1 / math.sqrt(3)))
    q, s = linalg.polar(x[:3])
    assert np.allclose(q @ s, x[:3]) and np.linalg.det(q) == pytest.approx(1)


def test_covariance_forms(spark, cloud):
    w = np.arange(1, len(cloud) + 1)
    pts = frame(spark, cloud).withColumn("w", F.col("id") + 1.0)

    def got(**o):
        out = np.zeros((6, 6))
        for r in aggregate.covariance(pts, **o).collect():
            out[r.i, r.j] = out[r.j, r.i] = r.cov
        return out

    assert np.allclose(got(), np.cov(cloud.T))
    assert np.allclose(got(centered=False), cloud.T @ cloud / (len(cloud) - 1))
    assert np.allclose(got(weight="w"), np.cov(cloud.T, aweights=w, bias=True))


def test_spatial_median(spark):
    x = np.random.default_rng(2).standard_normal((101, 2))
    x[:10] += 1000
    got = np.array(aggregate.spatial_median(frame(spark, x), steps=100))
    cost = lambda p: np.linalg.norm(x - p, axis=1).sum()
    assert all(cost(got) <= cost(got + s) + 1e-6 for s in 0.05 * np.array([[1, 0], [-1, 0], [0, 1], [0, -1]]))


# --- neighbours ----------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["l2", "l1", "sq"])
def test_knn_in_many_cells(spark, cloud, monkeypatch, metric):
    monkeypatch.setattr(neighbors, "CANDIDATES", 40)
    monkeypatch.setattr(neighbors, "QUERIES", 30)
    x = np.concatenate((cloud[:90], cloud[:10]))  # ties
    pts = frame(spark, x)
    d = {"l2": lambda a: np.sqrt(((x - a) ** 2).sum(axis=1)), "sq": lambda a: ((x - a) ** 2).sum(axis=1), "l1": lambda a: np.abs(x - a).sum(axis=1)}[metric]
    got = {(r.q, r["rank"]): (r.i, r.dist) for r in neighbors.knn(pts, pts, 4, metric=metric, include_self=False).collect()}
    for q in range(100):
        row = d(x[q])
        order = [i for i in np.lexsort((np.arange(100), row)) if i != q][:4]
        assert [got[q, r + 1][0] for r in range(4)] == order


def test_radius_and_approximate(spark, cloud):
    pts = frame(spark, cloud)
    got = neighbors.within_radius(pts.where("id < 20"), pts, 2.0, 3).collect()
    d = np.sqrt(((cloud[:20, None] - cloud[None]) ** 2).sum(axis=2))
    for r in got:
        assert r.n == (d[r.q] <= 2.0).sum() and (r.i is None) == (r["rank"] > r.n)
    exact = {(r.q, r.i) for r in neighbors.knn(pts, pts, 3).collect()}
    near = {(r.q, r.i) for r in neighbors.approximate_knn(pts, pts, 3, eps=0.5, leaves=16).collect()}
    assert len(exact & near) > 0.9 * len(exact)


# --- clusters and planes -------------------------------------------------------------------------


def test_farthest_sum_seeds(spark, cloud):
    got = [i for i, _ in cluster.farthest_sum_seeds(frame(spark, cloud), 4)]
    want = [int(((cloud - cloud.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    while len(want) < 4:
        gain = sum(((cloud - cloud[s]) ** 2).sum(axis=1) for s in want)
        gain[want] = -1
        want.append(int(gain.argmax()))
    assert got == want
    with pytest.raises(ValueError, match="seeds are apart"):
        cluster.farthest_sum_seeds(frame(spark, np.zeros((5, 2))), 3)


@pytest.mark.parametrize("init", ["farthest", "plusplus"])
def test_kmeans(spark, init):
    r = np.random.default_rng(3)
    truth = np.repeat([0, 1, 2], 60)
    x = r.standard_normal((180, 2)) * 0.3 + np.array([[0, 0], [5, 0], [0, 5]])[truth]
    pts = frame(spark, x, truth.tolist()).cache()
    centers, placed = cluster.kmeans(pts, 3, init=init, seed=5)
    error, _, _ = score.clustering_error(pts, placed.select("id", F.col("cluster").alias("label")))
    assert error < 0.02
    assert all(min(np.linalg.norm(np.array(c) - t) for c in centers) < 0.3 for t in ([0, 0], [5, 0], [0, 5]))
    with pytest.raises(ValueError, match="between"):
        cluster.kmeans(pts, 1)


def test_planes_and_errors(spark):
    a = synth.generate_samples(3, [100, 100], [1, 2], noise=0.0, affine=True, least_angle=0.5, seed=4)
    pts = a.points(spark)
    found = cluster.group_planes(pts, "label", {0: 1, 1: 2})
    for k, (_, basis) in found.items():
        assert linalg.subspace_angle(basis.T, a.bases[k]) < 1e-5
    assert planes.l2_error(pts, found, {0: 1, 1: 2}) < 1e-6
    assert 5 not in cluster.group_planes(pts.withColumn("label", F.when(F.col("id") < 2, 5).otherwise(F.col("label"))), "label", {0: 1, 1: 2, 5: 2})
    dist = {(r.id, r.cluster): r.dist for r in planes.plane_distances(pts, found).collect()}
    x = a.x[7] - found[1][0]
    assert dist[7, 1] == pytest.approx(((x - found[1][1].T @ (found[1][1] @ x)) ** 2).sum(), abs=1e-9)


@pytest.mark.parametrize("affine", [True, False])
def test_kflats(spark, affine):
    a = synth.generate_samples(3, [120, 120], [1, 1], noise=0.005, affine=affine, least_angle=1.0, seed=6)
    pts = a.points(spark).cache()
    best = min(score.clustering_error(pts, cluster.kflats(pts.drop("label"), [1, 1], seed=s, affine=affine, steps=20)[1])[0] for s in range(3))
    assert best < 0.1


@pytest.mark.parametrize(("dims", "outliers"), [([1, 2, 1], 0), ([1, 1], 10)])
def test_arrangement(spark, dims, outliers):
    a = synth.generate_samples(3, [150] * len(dims), dims, noise=0.01, least_angle=0.6, seed=42, outliers=outliers / (150 * len(dims)))
    pts = a.points(spark).cache()
    labelled, found, model = planes.arrange(pts, planes.Options(k=len(dims), dmax=2, n0=60, outliers=outliers))
    assert sorted(found.values()) == sorted(dims)
    own = pts.where("label IS NOT NULL")
    error, _, _ = score.clustering_error(own, labelled.where("label IS NOT NULL"))
    assert error < 0.1 and model < 0.05
    assert labelled.where("label IS NULL").count() == outliers


def test_number_of_planes_is_found(spark):
    a = synth.generate_samples(3, [150, 150], [1, 1], noise=0.005, least_angle=1.0, seed=9)
    _, dims, _ = planes.arrange(a.points(spark).cache(), planes.Options(kmax=3, dmax=2, n0=40))
    assert len(dims) == 2


def test_hungarian_and_relabel(spark):
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 7):
        c = r.random((n, n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert sum(c[i, j] for i, j in enumerate(linalg_free(c))) == pytest.approx(best)
    truth = frame(spark, np.zeros((9, 1)), [0, 0, 0, 1, 1, 1, 2, 2, 2])
    inferred = frame(spark, np.zeros((9, 1)), [2, 2, 2, 0, 0, 1, 1, 1, 1])
    assert score.clustering_error(truth, inferred)[0] == pytest.approx(1 / 9)
    named = score.relabel(truth, inferred, {0: 1, 1: 1, 2: 1}).orderBy("id").collect()
    assert [x.label for x in named] == [0, 0, 0, 1, 1, 2, 2, 2, 2]


def linalg_free(c):
    return score.hungarian(c)


def test_components_and_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)] + [(i, i + 1) for i in range(20, 60)], "src long, dst long")
    got = {r.id: r.component for r in cluster.connected_components(edges).collect()}
    assert got[3] == 1 and got[6] == 5 and got[9] == 9 and got[60] == 20
    dag = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "src long, dst long")
    assert {r.id: r.level for r in graph.topological_order(dag).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert {r.id: r.level for r in graph.levels(dag, 2).collect()} == {2: 0, 4: 1, 5: 2}
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_order(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_mesh(spark):
    faces = spark.createDataFrame([(0, [0, 1, 2]), (1, [0, 2, 3])], "face long, vertices array<long>")
    verts = frame(spark, [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [9, 9, 9]])
    assert graph.mesh_edges(faces).count() == 5 and graph.boundary_edges(faces).count() == 4
    assert graph.is_manifold(faces).first().manifold
    assert [r.area2 for r in graph.double_areas(faces, verts).collect()] == [1.0, 1.0]
    assert graph.remove_unreferenced(verts, faces).count() == 4
    assert graph.bounding_box_diagonal(verts.where("id < 4")).first().diagonal == pytest.approx(math.sqrt(2))
    assert {(r.a, r.b): round(r.length, 6) for r in graph.edge_lengths(faces, verts).collect()}[0, 2] == round(math.sqrt(2), 6)
    assert graph.face_neighbours(faces).count() == 1


# --- kernels, vectors, combinatorics -------------------------------------------------------------


def test_densities_and_regressions(spark, cloud):
    pts = frame(spark, cloud).withColumn("y", F.array(F.col("x")[0] * 2 + 1)).withColumn("w", F.col("id") + 0.5).withColumn("v", F.col("x")[0] * 2 + 1)
    q = pts.where("id < 10")
    d2 = ((cloud[:10, None] - cloud[None]) ** 2).sum(axis=2)
    k = np.exp(-d2 / 2)
    get = lambda df, c: np.array([r[c] for r in df.orderBy("q").collect()])
    assert np.allclose(get(kernels.density(q, pts, kernels.gaussian(1.0)), "density"), k.sum(axis=1))
    assert np.allclose(get(kernels.weighted_density(q, pts, kernels.gaussian(1.0), "w"), "density"), k @ (np.arange(300) + 0.5))
    y = cloud[:, 0] * 2 + 1
    assert np.allclose(get(kernels.regression(q, pts, kernels.gaussian(1.0), "y"), "y")[:, 0], k @ y / k.sum(axis=1))
    fit = kernels.local_linear(q, pts, 40, 3.0, "v").orderBy("q").collect()
    assert np.allclose([r.y for r in fit], y[:10], atol=1e-6) and np.allclose([r.slope[0] for r in fit], 2, atol=1e-6)
    for f in (kernels.epanechnikov(1.0, 2), kernels.triangle(1.0), kernels.triweight(1.0)):
        assert f(np.array([4.0]))[0] == 0 < f(np.array([0.1]))[0]


def test_conditional_gaussian():
    r = np.random.default_rng(7)
    x = r.standard_normal((50_000, 2)) @ np.array([[1, 0.8], [0, 0.6]])
    e, v = kernels.conditional_gaussian(x.mean(axis=0), np.cov(x.T), 1, np.array([1.0]))
    near = x[np.abs(x[:, 0] - 1) < 0.05, 1]
    assert abs(e - near.mean()) < 0.05 and abs(v - near.var()) < 0.05


def test_vector_expressions(spark):
    r = np.random.default_rng(8)
    a, b = r.standard_normal(3), r.standard_normal(3)
    df = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b])], "a array<double>, b array<double>")
    w = [[1.0, 2.0, 0.0], [0.0, 1.0, 0.5], [0.3, 0.0, 2.0]]
    A, B = F.col("a"), F.col("b")
    got = df.select(
        vec.cross(A, B).alias("cross"), vec.matvec(vec.hat(A), B).alias("hat"), vec.angle(A, B).alias("angle"), vec.mahalanobis_root(w)(A, B).alias("m"),
        vec.rotate_by_quat(A, vec.axis_angle_to_quat(B, F.lit(0.7))).alias("turned"), vec.l1(A, B).alias("l1"), vec.normalise_sum(A).alias("s"),
    ).first()
    assert np.allclose(got.cross, np.cross(a, b)) and np.allclose(got.hat, np.cross(a, b))
    assert got.angle == pytest.approx(math.acos(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))
    assert got.m == pytest.approx(np.linalg.norm(np.array(w).T @ (a - b)))
    u = b / np.linalg.norm(b)
    turned = a * math.cos(0.7) + np.cross(u, a) * math.sin(0.7) + u * (u @ a) * (1 - math.cos(0.7))
    assert np.allclose(got.turned, turned) and got.l1 == pytest.approx(np.abs(a - b).sum()) and sum(got.s) == pytest.approx(1)


def test_combinatorics():
    assert combinatorics.subsets(4, 2) == list(combinations(range(1, 5), 2))
    assert combinatorics.next_permutations([1, 2, 3], 6) == [*list(permutations([1, 2, 3]))[1:], (1, 2, 3)]
    assert list(combinatorics.balls_and_bins(2, 2)) == [(2, 0), (1, 1), (0, 2)]
    assert combinatorics.group_dimensions(3, 2) == [(1, 1), (1, 2), (2, 2)]
    assert combinatorics.hypersphere_volume(3) == pytest.approx(4 / 3 * math.pi) and combinatorics.hypersphere_area(2) == pytest.approx(2 * math.pi)
    # quadrics that vanish on two planes (codimension 1) in space: just their product
    assert combinatorics.hilbert_function(2, 3, [1, 1]) == 1
    # on two lines (codimension 2) in space: 6 - 2 * 1 ... of degree 2
    assert combinatorics.hilbert_function(2, 3, [2, 2]) == 4


def test_selection_helpers(spark):
    df = spark.range(20).select(F.col("id"), (F.col("id") % 5).cast("double").alias("v"))
    with pytest.raises(ValueError, match="no such comparison"):
        select.where_compare(df, "v", "ne", 1)
    assert select.rand_sample(df, 7, 3).distinct().count() == 7
    assert [r.ix for r in select.sort_with_index(df, "v", "id", descending=True).orderBy("rank").collect()][:4] == [4, 9, 14, 19]
    assert select.dedup_points(frame(spark, [[0, 0], [0.01, 0], [1, 1]]), "id", "x", 0.5).count() == 2


def test_matrix_entries(spark):
    m = np.array([[1.0, 0, 2], [0, 3, 0], [2, 0, 5]])
    e = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double")
    dense = lambda df, shape: (lambda out: [out.__setitem__((r.i, r.j), r.v) for r in df.collect()] and out)(np.zeros(shape))
    assert matrix.is_symmetric(e).first().symmetric and not matrix.is_symmetric(e.where("i <= j")).first().symmetric
    assert (dense(matrix.slice_matrix(e, [2, 0, 2], [0, 2]), (3, 2)) == m[[2, 0, 2]][:, [0, 2]]).all()
    assert (dense(matrix.repeat_diagonal(e, 2, 3, 3), (6, 6))[3:, 3:] == m).all()
    assert np.allclose(dense(matrix.invert_diagonal(matrix.diagonal(e)), (3, 3)), np.diag([1, 1 / 3, 1 / 5]))
    assert [r.x for r in matrix.points_of(e, 3).orderBy("id").collect()] == m.tolist()
    csc = matrix.compressed_columns(e).orderBy("j").collect()
    assert [(r.start, r.rows) for r in csc] == [(0, [0, 2]), (2, [1]), (3, [0, 2])]
    assert matrix.sparse(e.union(e)).where("i = 1").first().v == 6 and matrix.identity(spark, 4).count() == 4


def test_geometry_expressions(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [3.0, 4.0, 0.0])], "p array<double>, a array<double>, b array<double>, q array<double>")
    p, a, b, q = (F.col(c) for c in "pabq")
    r = df.select(
        geometry.project_to_line(p, a, b).alias("line"), geometry.project_to_segment(q, a, b).alias("segment"),
        geometry.ray_sphere(F.array(*map(F.lit, (-5.0, 0.0, 0.0))), F.array(*map(F.lit, (1.0, 0.0, 0.0))), a, F.lit(2.0)).alias("hits"),
        geometry.in_polygon(F.lit(0.5), F.lit(0.5), [(0, 0), (1, 0), (1, 1), (0, 1)]).alias("inside"),
        geometry.in_polygon(F.lit(1.5), F.lit(0.5), [(0, 0), (1, 0), (1, 1), (0, 1)]).alias("outside"),
        geometry.rgb_to_hsv(F.lit(0.2), F.lit(0.4), F.lit(0.6)).alias("hsv"), geometry.hsv_to_rgb(F.lit(210.0), F.lit(2 / 3), F.lit(0.6)).alias("rgb"),
    ).first()
    assert (r.line, r.segment, r.hits, r.inside, r.outside) == (1.0, 17.0, [3.0, 7.0], True, False)
    assert np.allclose(r.hsv, [210, 2 / 3, 0.6]) and np.allclose(r.rgb, [0.2, 0.4, 0.6])


def test_paths_and_forests(spark):
    w = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 2.0), (7, 8, 1.0)], "src long, dst long, w double")
    assert {r.id: r.dist for r in graph.shortest_paths(w, 1).collect()} == {1: 0, 2: 1, 3: 2, 4: 4}
    assert sorted((r.src, r.dst) for r in graph.minimum_spanning_forest(w).collect()) == [(1, 2), (2, 3), (3, 4), (7, 8)]
    assert graph.connected(w, 1, 4) and not graph.connected(w, 1, 8) and graph.eccentricity(w, 1) == 2
    assert graph.grid_graph(spark, 3, 4).count() == 17
    ring = graph.small_world(spark, 50, 2, 0.1, 3).collect()
    assert len(ring) == 100 and 0 < sum((r.dst - r.src) % 50 > 2 for r in ring) < 30
    components = cluster.connected_components(w)
    joined = w.select("src", "dst").union(graph.connecting_edges(components))
    assert cluster.connected_components(joined).select("component").distinct().count() == 1


def test_pairs_write_vectors_once(spark, monkeypatch):
    """Blocks are read by the tasks, not repeated along a grid."""
    monkeypatch.setattr(neighbors, "QUERIES", 7)
    rng = np.random.default_rng(8)
    x = {int(i): rng.standard_normal(3) for i in range(-20, 20)}
    points = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()] + [(50, None)], "id long, x array<double>")
    found = neighbors.pairs(points)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    got = {(r.a, r.b): r.dist for r in found.collect()}
    assert set(got) == {(a, b) for a in x for b in x if a < b} and found.count() == len(got)
    assert all(abs(d - np.linalg.norm(x[a] - x[b])) < 1e-12 for (a, b), d in got.items())


@pytest.mark.parametrize("idf", [False, True])
def test_cosine_pairs_in_blocks(spark, monkeypatch, idf):
    """All pairs above the threshold over several blocks, copies included; candidate pairs are never a table."""
    monkeypatch.setattr(text, "BLOCK", 16)
    monkeypatch.setattr(text, "AT_ONCE", 50)
    rng = np.random.default_rng(5)
    base = rng.poisson(0.5, (12, 30)) + np.eye(12, 30, dtype=int)
    m = {i - 30: base[i % 12] + (rng.poisson(0.1, 30) if i % 3 else 0) for i in range(100)}
    rows = [(i, f"t{j}", int(v)) for i, x in m.items() for j, v in enumerate(x) if v]
    found = text.cosine_pairs(spark.createDataFrame(rows, "doc_id long, term string, tf long"), 0.7, "tf", **({"idf": True} if idf else {}))
    assert found._jdf.queryExecution().toString().count("distinct") == 0
    w = np.array(list(m.values()), float)
    if idf:
        w = w * np.log(len(w) / (1 + (w > 0).sum(axis=0)))
    u = w / np.linalg.norm(w, axis=1, keepdims=True)
    c, ids = u @ u.T, list(m)
    want = {(ids[i], ids[j]): c[i, j] for i in range(100) for j in range(i + 1, 100) if c[i, j] >= 0.7}
    got = [((r.a, r.b), r.cosine) for r in found.collect()]
    assert len(want) > 300 and len(got) == len(want) and all(abs(want[k] - v) < 1e-12 for k, v in got)


def test_mds_of_any_number(spark):
    """More points than all pairs of which the driver took."""
    x = np.random.default_rng(4).standard_normal((4100, 3))
    pts = frame(spark, x)
    y = linalg.mds(pts, 5)
    assert linalg.misfit(pts, y) < 1e-9 and len(y.first().x) == 5
    moved = pts.withColumn("x", F.when(F.col("id") == 7, F.array(*(F.lit(0.0) for _ in range(3)))).otherwise(F.col("x")))
    assert linalg.misfit(moved, y) > 0.1 and linalg.misfit(pts.where("id > 3"), y) == float("inf")


def test_isomap_of_a_whole_graph(spark):
    x = np.random.default_rng(4).standard_normal((4100, 3))
    pts = frame(spark, x)
    assert linalg.misfit(pts, linalg.isomap(pts, 4099, 3)) < 1e-9
    with pytest.raises(ValueError, match="all pairs"):
        linalg.isomap(pts, 5, 2)


def test_integer_recovery_of_halves(spark):
    """Counts over an even smallest count: n.5 goes up, whatever the weights lose by rounding."""
    rows = [(d, f"t{i}", v) for d in range(60) for i, v in enumerate([2, 3, 5, 7, 9, 2 * d + 11])]
    counts = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    got = {(r.doc_id, r.term): r.tf for r in text.integer_recovery(text.column_normalise(counts)).collect()}
    assert got == {(d, t): (v + 1) // 2 for d, t, v in rows}


def test_interpolation_of_any_number(spark, monkeypatch):
    """More points than the driver's matrix takes: the sums go through the values, near points included."""
    monkeypatch.setattr(kernels, "BLOCK", 50)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((180, 4))
    x[90:95] = x[:5] + 0.05
    pts = frame(spark, x).withColumn("y", F.col("id") % 7)
    got = kernels.interpolator(pts, 0.5, "y", most=100)(pts).collect()
    assert len(got) == 180 and all(abs(r.y - r.q % 7) < 1e-5 for r in got)


def test_cosine_candidates_are_few(monkeypatch):
    """Pairs that share rare terms aren't computed in full, unless their common terms sum up to enough."""
    rng = np.random.default_rng(6)
    n = 200
    m = np.zeros((n, 1000))
    for i in range(n):
        m[i, rng.choice(1000, 50, replace=False)] = rng.uniform(0.5, 1, 50)
    m[1] = m[0] * rng.uniform(0.9, 1.1, 1000)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = [np.flatnonzero(x) for x in u]
    table = pa.table({"doc_id": np.arange(n), "name": [bytes([i // 256, i % 256]) for i in range(n)], "terms": [r.astype("<i8").tobytes() for r in rows], "u": [x[r].astype("<f8").tobytes() for x, r in zip(u, rows, strict=True)]})
    seen, before = [], text._ranges
    monkeypatch.setattr(text, "_ranges", lambda start, k: seen.append(int(k.sum())) or before(start, k))
    block = text._vectors(0.7)(table)
    got = {(p, q): c for b in text._similar(0.7)(block, block, True) for p, q, c in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    want = {(i, j): c for (i, j), c in np.ndenumerate(u @ u.T) if i < j and c >= 0.7}
    assert got.keys() == want.keys() and (0, 1) in got and all(abs(c - want[k]) < 1e-12 for k, c in got.items())
    assert sum(seen) < n * n // 2 * 50 // 3


def test_kernel_steps_are_few(monkeypatch):
    """Large groups of near points don't slow the steps down: landmarks and groups leave a matrix near the identity."""
    monkeypatch.setattr(kernels, "LANDMARKS", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate((x, x[0] + rng.standard_normal((100, 32)) * 0.01))
    k = np.exp(-neighbors._squares(x, x) / 0.5)
    p = np.arange(300, 400)
    rough = kernels._rough(x, 0.5, 0.0, p, np.zeros(100, np.int64))
    values = np.abs(np.linalg.eigvals(np.stack([rough(c) for c in k], axis=1)))
    assert np.linalg.cond(k) > 1e4 and values.max() / values.min() < 20
