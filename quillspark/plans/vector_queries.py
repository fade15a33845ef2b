"""Queries over the embeddings table: distances, neighbours, moments, clusters, planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import vec
from quillspark.operators import aggregate, cluster, kernels, linalg, matrix, neighbors, planes, score

from .registry import query

_P = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
_L1 = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def ten(df: DataFrame) -> DataFrame:
    """The query points of the neighbour queries: those whose id is divisible by 100."""
    return df.where("id % 100 = 0")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("dist_l2", f"WITH {_P} SELECT a.id AS a, b.id AS b, round(list_distance(a.x, b.x), 6) AS dist FROM p a JOIN p b ON a.id < b.id")
def dist_l2(spark, sf_dir):
    return rounded(neighbors.pairs(points(spark, sf_dir)), "dist")


@query("dist_l1", f"WITH {_P} SELECT a.id AS q, b.id AS i, round({_L1}, 6) AS dist FROM p a, p b WHERE a.id % 100 = 0")
def dist_l1(spark, sf_dir):
    pts = points(spark, sf_dir)
    return rounded(neighbors.between(ten(pts), pts, metric="l1"), "dist")


@query("dist_sq", f"WITH {_P} SELECT a.id AS q, b.id AS i, round(power(list_distance(a.x, b.x), 2), 6) AS dist FROM p a, p b WHERE a.id % 100 = 0")
def dist_sq(spark, sf_dir):
    pts = points(spark, sf_dir)
    return rounded(neighbors.between(ten(pts), pts, metric="sq"), "dist")


@query("knn_k", f"""WITH {_P}, d AS (SELECT a.id AS q, b.id AS i, list_distance(a.x, b.x) AS dist FROM p a, p b WHERE a.id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, i) AS rank FROM d)
    SELECT q, CAST(rank AS INT) AS rank, i, round(dist, 6) AS dist FROM r WHERE rank <= 6""")
def knn_k(spark, sf_dir):
    pts = points(spark, sf_dir)
    return rounded(neighbors.knn(ten(pts), pts, 6), "dist")


@query("knn_radius", f"""WITH {_P}, d AS (SELECT a.id AS q, b.id AS i, list_distance(a.x, b.x) AS dist FROM p a, p b WHERE a.id % 100 = 0),
    c AS (SELECT q, count(*) FILTER (dist <= 1.2) AS n FROM d GROUP BY q),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, i) AS rank FROM d WHERE dist <= 1.2)
    SELECT c.q, n, CAST(s.k AS INT) AS rank, r.i, CASE WHEN r.i IS NULL THEN 'Infinity'::DOUBLE ELSE round(r.dist, 6) END AS dist
    FROM c CROSS JOIN range(1, 5) s(k) LEFT JOIN r ON r.q = c.q AND r.rank = s.k""")
def knn_radius(spark, sf_dir):
    pts = points(spark, sf_dir)
    found = neighbors.within_radius(ten(pts), pts, 1.2, 4)
    return found.withColumn("dist", F.when(F.col("i").isNull(), float("inf")).otherwise(F.round("dist", 6)))


@query("snap_nearest", f"""WITH {_P}, d AS (SELECT a.id AS q, b.id AS i, list_distance(a.x, b.x) AS dist FROM p a, p b WHERE b.id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, i) AS rank FROM d) SELECT q, i, round(dist, 6) AS dist FROM r WHERE rank = 1""")
def snap_nearest(spark, sf_dir):
    pts = points(spark, sf_dir)
    return rounded(neighbors.snap(pts, ten(pts)), "dist")


@query("label_smoothing", f"""WITH {_P}, d AS (SELECT a.id AS q, b.id AS i, b.label, list_distance(a.x, b.x) AS dist FROM p a, p b),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, i) AS rank FROM d),
    v AS (SELECT q, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL HAVING count(*) * 2 > 5)
    SELECT p.id, coalesce(v.label, p.label) AS label FROM p LEFT JOIN v ON v.q = p.id""")
def label_smoothing(spark, sf_dir):
    return neighbors.smooth_labels(points(spark, sf_dir), 5).select("id", "label")


@query("centroid_by_label", f"""WITH {_P}, f AS (SELECT label, unnest(range(len(x))) AS dim, unnest(x) AS v FROM p)
    SELECT label, CAST(dim AS INT) AS dim, round(avg(v), 6) AS mean FROM f GROUP BY ALL""")
def centroid_by_label(spark, sf_dir):
    return rounded(aggregate.mean_vector(points(spark, sf_dir), ["label"]), "mean")


@query("weighted_mean", f"""WITH {_P}, f AS (SELECT id + 1 AS w, unnest(range(len(x))) AS dim, unnest(x) AS v FROM p)
    SELECT CAST(dim AS INT) AS dim, round(sum(w * v) / sum(w), 6) AS mean FROM f GROUP BY dim""")
def weighted_mean(spark, sf_dir):
    return rounded(aggregate.mean_vector(points(spark, sf_dir), weight=F.col("id") + 1.0), "mean")


def _covariance(name: str, moment: str, **options):
    @query(name, f"""WITH {_P}, f AS (SELECT id, unnest(range(len(x))) AS d, unnest(x) AS v FROM p)
        SELECT CAST(a.d AS INT) AS i, CAST(b.d AS INT) AS j, round({moment}, 6) + 0 AS cov FROM f a JOIN f b USING (id) WHERE a.d <= b.d GROUP BY ALL""")
    def run(spark, sf_dir):
        found = aggregate.covariance(points(spark, sf_dir).withColumn("w", F.col("id") + 1.0), **options)
        return found.select("i", "j", (F.round("cov", 6) + 0).alias("cov"))

    return run


_covariance("covariance", "(sum(a.v * b.v) - sum(a.v) * sum(b.v) / count(*)) / (count(*) - 1)")
_covariance("covariance_raw", "sum(a.v * b.v) / (count(*) - 1)", centered=False)
_covariance("covariance_weighted", "(sum((id + 1) * a.v * b.v) - sum((id + 1) * a.v) * sum((id + 1) * b.v) / sum(id + 1)) / sum(id + 1)", weight="w")


@query("variance_by_dim", f"""WITH {_P}, f AS (SELECT unnest(range(len(x))) AS dim, unnest(x) AS v FROM p)
    SELECT CAST(dim AS INT) AS dim, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS var, round(stddev_samp(v), 6) AS std FROM f GROUP BY dim""")
def variance_by_dim(spark, sf_dir):
    return rounded(aggregate.variance(points(spark, sf_dir)), "mean", "var", "std")


@query("variance_scale", f"""WITH {_P}, f AS (SELECT id, unnest(range(len(x))) AS dim, unnest(x) AS v FROM p), s AS (SELECT dim, stddev_samp(v) AS s FROM f GROUP BY dim)
    SELECT id, CAST(dim AS INT) AS dim, round(v / s, 6) AS v FROM f JOIN s USING (dim)""")
def variance_scale(spark, sf_dir):
    return rounded(aggregate.variance_scale(points(spark, sf_dir)).select("id", F.posexplode("x").alias("dim", "v")), "v")


@query("row_normalise", f"""WITH {_P}, n AS (SELECT id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM p)
    SELECT id, CAST(unnest(range(len(x))) AS INT) AS dim, round(unnest(x) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS v FROM n""")
def row_normalise(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("id", F.posexplode(vec.normalise(F.col("x"))).alias("dim", "v")), "v")


@query("p2c_assign", f"""WITH {_P}, f AS (SELECT label, unnest(range(len(x))) AS dim, unnest(x) AS v FROM p), m AS (SELECT label, dim, avg(v) AS m FROM f GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY dim) AS c FROM m GROUP BY label),
    d AS (SELECT p.id, c.label AS cluster, list_distance(p.x, c.c) AS d FROM p, c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS r FROM d)
    SELECT id, cluster, round(d * d, 6) AS dist FROM r WHERE r = 1""")
def p2c_assign(spark, sf_dir):
    pts = points(spark, sf_dir)
    found = aggregate.centers(pts, "label").orderBy("label").collect()  # one row per label
    placed = cluster.assign(pts, [list(r.center) for r in found])
    names = F.array(*(F.lit(r.label) for r in found))
    return rounded(placed.select("id", F.get(names, F.col("cluster")).alias("cluster"), "dist"), "dist")


@query("kernel_density", f"""WITH {_P} SELECT a.id AS q, round(sum(exp(-power(list_distance(a.x, b.x), 2) / 2)), 6) AS density
    FROM p a, p b WHERE a.id % 100 = 0 AND a.id <> b.id GROUP BY a.id""")
def kernel_density(spark, sf_dir):
    pts = points(spark, sf_dir)
    return rounded(kernels.density(ten(pts), pts, kernels.gaussian(1.0), leave_out=True), "density")


@query("adaptive_density", f"""WITH {_P}, d AS (SELECT a.id AS q, b.id AS i, power(list_distance(a.x, b.x), 2) AS d FROM p a, p b WHERE a.id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, i) AS rank FROM d), k AS (SELECT *, max(d) OVER (PARTITION BY q) AS dk FROM r WHERE rank <= 8)
    SELECT q, round(sum(0.75 * (1 - d / dk) / sqrt(dk)), 6) AS density FROM k GROUP BY q""")
def adaptive_density(spark, sf_dir):
    pts = points(spark, sf_dir)
    return rounded(kernels.adaptive_density(ten(pts), pts, 8), "density")


@query("kernel_regression", f"""WITH {_P} SELECT a.id AS q, round(sum(exp(-power(list_distance(a.x, b.x), 2) / 2) * b.label) / sum(exp(-power(list_distance(a.x, b.x), 2) / 2)), 6) AS y
    FROM p a, p b WHERE a.id % 100 = 0 GROUP BY a.id""")
def kernel_regression(spark, sf_dir):
    pts = points(spark, sf_dir).withColumn("y", F.array(F.col("label").cast("double")))
    found = kernels.regression(ten(pts), pts, kernels.gaussian(1.0), "y")
    return found.select("q", F.round(F.get("y", F.lit(0)), 6).alias("y"))


@query("confusion_matrix", f"""WITH {_P}, i AS (SELECT id, label, id % 3 AS inferred FROM p), c AS (SELECT label AS truth, inferred, count(*) AS n FROM i GROUP BY ALL)
    SELECT t.truth, j.inferred, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT label AS truth FROM p) t CROSS JOIN (SELECT DISTINCT inferred FROM i) j
    LEFT JOIN c ON c.truth = t.truth AND c.inferred = j.inferred""")
def confusion_matrix(spark, sf_dir):
    pts = points(spark, sf_dir)
    return score.confusion(pts, pts.select("id", (F.col("id") % 3).alias("label")))


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("seeds_farthest_sum")
def seeds_farthest_sum(spark, sf_dir):
    seeds = cluster.farthest_sum_seeds(points(spark, sf_dir).cache(), 5, allow_fewer=True)
    return _frame(spark, [(k, i) for k, (i, _) in enumerate(seeds)], "step int, id long")


@query("seeds_partition")
def seeds_partition(spark, sf_dir):
    ids, placed = cluster.partition_seeds(points(spark, sf_dir).cache(), 4)
    return placed.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("seed", F.get(F.array(*map(F.lit, ids)), F.col("cluster")))


@query("kmeans")
def kmeans(spark, sf_dir):
    _, placed = cluster.kmeans(points(spark, sf_dir).cache(), 5, steps=20, tol=1e-9)
    return placed.select("id", "cluster", F.round("dist", 6).alias("dist"))


@query("clustering_error")
def clustering_error(spark, sf_dir):
    pts = points(spark, sf_dir).cache()
    _, placed = cluster.kmeans(pts, 10, steps=10)
    error, right, _ = score.clustering_error(pts, placed.select("id", F.col("cluster").alias("label")))
    return _frame(spark, [(round(error, 6), right)], "error double, matched long")


@query("svd_topk")
def svd_topk(spark, sf_dir):
    s = linalg.svd(points(spark, sf_dir), 10).s
    return _frame(spark, [(i + 1, round(float(v), 6)) for i, v in enumerate(s)], "rank int, singular_value double")


@query("svd_randomised")
def svd_randomised(spark, sf_dir):
    s = linalg.randomised_svd(points(spark, sf_dir), 5, power=3).s
    return _frame(spark, [(i + 1, round(float(v), 3)) for i, v in enumerate(s)], "rank int, singular_value double")


@query("pca_energy")
def pca_energy(spark, sf_dir):
    """Squared length of each point in the first five principal directions (no sign to choose)."""
    pts = points(spark, sf_dir)
    own = linalg.svd(pts, 5, center=True).coordinates(pts)
    return own.select("id", F.round(vec.dot(F.col("x"), F.col("x")), 6).alias("energy"))


@query("bases_by_label")
def bases_by_label(spark, sf_dir):
    """Per label: size of the plane and its centre's length."""
    found = cluster.group_planes(points(spark, sf_dir), "label", {k: 3 for k in range(10)})
    return _frame(spark, [(k, len(b), round(float((c * c).sum() ** 0.5), 6)) for k, (c, b) in sorted(found.items())], "label int, dim int, center_norm double")


@query("p2pdist")
def p2pdist(spark, sf_dir):
    pts = points(spark, sf_dir)
    found = cluster.group_planes(pts, "label", {k: 3 for k in range(10)})
    return rounded(planes.plane_distances(pts, found), "dist")


@query("l2error")
def l2error(spark, sf_dir):
    pts = points(spark, sf_dir)
    dims = {k: 3 for k in range(10)}
    return _frame(spark, [(round(planes.l2_error(pts, cluster.group_planes(pts, "label", dims), dims), 6),)], "error double")


@query("kflats")
def kflats(spark, sf_dir):
    _, placed = cluster.kflats(points(spark, sf_dir).drop("label").cache(), [2, 2, 2], steps=8)
    return placed.select("id", "label")


@query("ksubspaces")
def ksubspaces(spark, sf_dir):
    _, placed = cluster.ksubspaces(points(spark, sf_dir).drop("label").cache(), [2, 2, 2], steps=8)
    return placed.select("id", "label")


@query("arrangement")
def arrangement(spark, sf_dir):
    """Four planes of three dimensions at most through all points: each one's plane."""
    found = planes.arrangement(points(spark, sf_dir), planes.Options(k=4, dmax=3, n0=40))
    return found.labelled.select("id", "label")


@query("mds", "SELECT true AS kept FROM (SELECT count(*) FROM embeddings)")
def mds(spark, sf_dir):
    """Coordinates of all points by their distances keep those distances: a rotation and a shift make them the points."""
    pts = points(spark, sf_dir)
    return _frame(spark, [(bool(linalg.misfit(pts, linalg.mds(pts, 64)) < 1e-9),)], "kept boolean")


_E = f"WITH {_P}, e AS (SELECT id AS i, unnest(range(len(x))) AS j, unnest(x) AS v FROM p), n AS (SELECT count(*) AS n FROM p)"


def entries(spark, sf_dir):
    return matrix.rows_of(points(spark, sf_dir)).withColumn("j", F.col("j").cast("long"))


@query("matrix_transpose", f"{_E} SELECT j AS i, i AS j, round(v, 6) AS v FROM e")
def matrix_transpose(spark, sf_dir):
    return rounded(matrix.transpose(entries(spark, sf_dir)), "v")


@query("matrix_reshape", f"{_E} SELECT (j * n + i) % (2 * n) AS i, (j * n + i) // (2 * n) AS j, round(v, 6) AS v FROM e, n")
def matrix_reshape(spark, sf_dir):
    n = points(spark, sf_dir).count()
    return rounded(matrix.reshape(entries(spark, sf_dir), n, 2 * n), "v")


@query("matrix_cat", f"{_E} SELECT i, j, round(v, 6) AS v FROM e UNION ALL SELECT i + n, j, round(v, 6) FROM e, n")
def matrix_cat(spark, sf_dir):
    e = entries(spark, sf_dir)
    return rounded(matrix.cat(e, e, size=points(spark, sf_dir).count(), dimension=1), "v")


@query("matrix_product", f"{_E} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 4) AS v FROM e a JOIN e b USING (i) GROUP BY ALL")
def matrix_product(spark, sf_dir):
    e = entries(spark, sf_dir)
    return rounded(matrix.multiply(matrix.transpose(e), e), "v", places=4)


@query("matrix_columns", f"{_E}, c AS (SELECT j, count(*) AS n FROM e GROUP BY j) SELECT j, n AS count, CAST(sum(n) OVER (ORDER BY j) - n AS BIGINT) AS start FROM c")
def matrix_columns(spark, sf_dir):
    return matrix.compressed_columns(entries(spark, sf_dir)).select("j", F.size("rows").cast("long").alias("count"), "start")
