"""Queries over vectors row by row: metrics, kernels, projections, statistics of rows and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import vec
from quillspark.operators import aggregate, kernels, neighbors, score, select, text

from .registry import query
from .table_queries import read
from .text_queries import _TDM, _WEIGHT, docs, tdm
from .vector_queries import _P, points, rounded, ten

#: The first point, to which all are compared.
_O = f"{_P}, o AS (SELECT x AS y FROM p WHERE id = 0)"
_D2 = "power(list_distance(x, y), 2)"


def beside_first(spark, sf_dir):
    """All points with the vector of point 0 as y."""
    pts = points(spark, sf_dir)
    return pts.join(F.broadcast(pts.where("id = 0").select(F.col("x").alias("y"))))


def _weights(n: int) -> list[list[float]]:
    """A symmetric, positive matrix: 2 on the diagonal, 1/2 beside it."""
    return [[2.0 if i == j else 0.5 if abs(i - j) == 1 else 0.0 for j in range(n)] for i in range(n)]


_DIFF = "list_transform(list_zip(x, y), lambda z: z[1] - z[2])"
_WD = "list_transform(range(64), lambda i: 2 * d[i + 1] + 0.5 * coalesce(d[nullif(i, 0)], 0) + 0.5 * coalesce(d[i + 2], 0))"


@query("mahalanobis_root", f"WITH {_O}, f AS (SELECT id, {_DIFF} AS d FROM p, o), w AS (SELECT id, {_WD} AS e FROM f) SELECT id, round(sqrt(list_sum(list_transform(e, lambda v: v * v))), 6) AS dist FROM w")
def mahalanobis_root(spark, sf_dir):
    metric = vec.mahalanobis_root(_weights(64))
    return beside_first(spark, sf_dir).select("id", F.round(metric(F.col("x"), F.col("y")), 6).alias("dist"))


@query("mahalanobis", f"WITH {_O}, f AS (SELECT id, {_DIFF} AS d FROM p, o), w AS (SELECT id, d, {_WD} AS e FROM f) SELECT id, round(sqrt(list_sum(list_transform(list_zip(d, e), lambda z: z[1] * z[2]))), 6) AS dist FROM w")
def mahalanobis(spark, sf_dir):
    metric = vec.mahalanobis(_weights(64))
    return beside_first(spark, sf_dir).select("id", F.round(metric(F.col("x"), F.col("y")), 6).alias("dist"))


@query("metric_callable", f"WITH {_O} SELECT id, round(list_distance(x, y), 6) AS l2, round({_D2}, 6) AS sq, round(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))), 6) AS l1 FROM p, o")
def metric_callable(spark, sf_dir):
    metrics = {"l2": vec.l2, "sq": vec.sqdist, "l1": vec.l1}
    return beside_first(spark, sf_dir).select("id", *(F.round(m(F.col("x"), F.col("y")), 6).alias(n) for n, m in metrics.items()))


def _kernel(kind: str, s: float, value: str, slope: str, by_scale: str):
    """One kernel's value, its derivative by the point's first coordinate, and by its scale."""
    inside = "" if kind == "gaussian" else f"CASE WHEN d <= {s * s} THEN"
    end = "" if kind == "gaussian" else "ELSE 0 END"

    @query(
        f"kernel_{kind}",
        f"""WITH {_O}, f AS (SELECT id, {_D2} AS d, x[1] - y[1] AS e FROM p, o WHERE id <> 0)
        SELECT id, round({inside} {value} {end}, 6) + 0 AS value, round(2 * e * {inside} {slope} {end}, 6) + 0 AS gradient, round({inside} {by_scale} {end}, 6) + 0 AS by_scale FROM f""",
    )
    def run(spark, sf_dir):
        k = kernels.radial(kind, s, 2)
        rows = beside_first(spark, sf_dir).where("id <> 0")
        x, y = F.col("x"), F.col("y")
        parts = {"value": k(x, y), "gradient": F.get(k.gradient(x, y), F.lit(0)), "by_scale": k.by_scale(vec.sqdist(x, y))}
        return rows.select("id", *((F.round(v, 6) + 0).alias(n) for n, v in parts.items()))

    return run


_S = 1.6
_kernel("gaussian", _S, f"exp(-d / {2 * _S * _S})", f"(-exp(-d / {2 * _S * _S}) / {2 * _S * _S})", f"exp(-d / {2 * _S * _S}) * d / {_S**3}")
_kernel("epanechnikov", _S, f"(1 - d / {_S * _S}) * 0.5625", f"({-0.5625 / (_S * _S)})", f"2 * 0.5625 * d / {_S**3}")
_kernel("triangle", _S, f"({_S} - sqrt(d)) / {_S}", f"(-1 / (2 * {_S} * sqrt(d)))", f"sqrt(d) / {_S * _S}")
_kernel("triweight", _S, f"power(({_S * _S} - d) / {_S * _S}, 3)", f"(-3 * power(1 - d / {_S * _S}, 2) / {_S * _S})", f"6 * power(1 - d / {_S * _S}, 2) * d / {_S**3}")


@query("kernel_anisotropic", f"""WITH {_O}, f AS (SELECT id, {_DIFF} AS d FROM p, o)
    SELECT id, round(exp(-list_sum(list_transform(range(64), lambda i: d[i + 1] * d[i + 1] / (i + 2)))), 6) AS value FROM f""")
def kernel_anisotropic(spark, sf_dir):
    """exp(-d' C^-1 d) for a diagonal C of 2, 3, ..."""
    inverse = [[1.0 / (i + 2) if i == j else 0.0 for j in range(64)] for i in range(64)]
    metric = vec.mahalanobis(inverse)
    rows = beside_first(spark, sf_dir).withColumn("d", metric(F.col("x"), F.col("y")))
    return rows.select("id", F.round(F.exp(-F.col("d") * F.col("d")), 6).alias("value"))


@query("kernel_mahalanobis", f"""WITH {_O}, f AS (SELECT id, {_DIFF} AS d FROM p, o)
    SELECT id, round(exp(-d[1] * d[1] / 0.5 - d[2] * d[2] / 2 - (list_sum(list_transform(d, lambda v: v * v)) - d[1] * d[1] - d[2] * d[2]) / 4), 6) AS value FROM f""")
def kernel_mahalanobis(spark, sf_dir):
    """Two directions with variances of their own, all others with one."""
    d = vec.subtract(F.col("x"), F.col("y"))
    rows = beside_first(spark, sf_dir).withColumn("d", d).withColumn("a", F.get("d", F.lit(0))).withColumn("b", F.get("d", F.lit(1)))
    rest = vec.dot(F.col("d"), F.col("d")) - F.col("a") * F.col("a") - F.col("b") * F.col("b")
    return rows.select("id", F.round(F.exp(-F.col("a") * F.col("a") / 0.5 - F.col("b") * F.col("b") / 2.0 - rest / 4.0), 6).alias("value"))


@query("weighted_density", f"""WITH {_P} SELECT a.id AS q, round(sum(b.label * exp(-power(list_distance(a.x, b.x), 2) / 2)), 6) AS density
    FROM p a, p b WHERE a.id % 100 = 0 GROUP BY a.id""")
def weighted_density(spark, sf_dir):
    pts = points(spark, sf_dir)
    return rounded(kernels.weighted_density(ten(pts), pts, kernels.gaussian(1.0), "label"), "density")


@query("kernel_interpolation", f"WITH {_P} SELECT id AS q, CAST(label AS DOUBLE) AS y FROM p WHERE id % 100 = 0")
def kernel_interpolation(spark, sf_dir):
    """Sums through all points' labels give the labels at the points themselves."""
    pts = points(spark, sf_dir)
    return kernels.interpolator(pts, 0.5, "label")(ten(pts)).select("q", (F.round("y", 5) + 0.0).alias("y"))


_NEAR = f"""{_P}, n AS (SELECT a.id AS q, b.id AS i, b.x, b.label, list_distance(a.x, b.x) AS d FROM p a, p b WHERE a.id % 100 = 0),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, i) AS r FROM n) WHERE r <= 8)"""


@query("knn_projection", f"""WITH {_NEAR}, f AS (SELECT q, exp(-d * d / 2) AS w, unnest(range(64)) AS dim, unnest(x) AS v FROM k)
    SELECT q, CAST(dim AS INT) AS dim, round(sum(w * v) / sum(w), 6) + 0 AS v FROM f GROUP BY ALL""")
def knn_projection(spark, sf_dir):
    pts = points(spark, sf_dir)
    found = kernels.project(ten(pts), pts, 8, 1.0)
    return found.select("q", F.posexplode("y").alias("dim", "v")).select("q", "dim", (F.round("v", 6) + 0).alias("v"))


@query("tangent_projection", f"WITH {_P} SELECT id AS q, CAST(unnest(range(64)) AS INT) AS dim, round(unnest(x), 5) + 0 AS v FROM p WHERE id % 100 = 0")
def tangent_projection(spark, sf_dir):
    """The plane of seven directions through eight points holds all of them, the query too."""
    pts = points(spark, sf_dir)
    found = kernels.tangent_project(ten(pts), pts, 8, 7)
    return found.select("q", F.posexplode("y").alias("dim", "v")).select("q", "dim", (F.round("v", 5) + 0).alias("v"))


@query("local_linear", f"WITH {_P} SELECT id AS q, round(3 * x[1] - 2 * x[2] + 1, 4) + 0 AS y, 3.0::DOUBLE AS slope1, -2.0::DOUBLE AS slope2 FROM p WHERE id % 100 = 0")
def local_linear(spark, sf_dir):
    """Local lines of a linear function of two coordinates are that function."""
    pts = points(spark, sf_dir).select("id", F.slice("x", 1, 2).alias("x"), (3 * F.get("x", F.lit(0)) - 2 * F.get("x", F.lit(1)) + 1).alias("y"))
    found = kernels.local_linear(ten(pts), pts, 12, 1.0, "y")
    slope = lambda i: F.round(F.get("slope", F.lit(i)), 4) + 0
    return found.select("q", (F.round("y", 4) + 0).alias("y"), slope(0).alias("slope1"), slope(1).alias("slope2"))


def _conditional(name: str, weight: str | None, w: str, free: str):
    @query(
        name,
        f"""WITH {_P}, f AS (SELECT id, {w} AS w, x[1] AS a, x[2] AS b FROM p), t AS (SELECT sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM f),
        c AS (SELECT sum(w * (a - ma) * (a - ma)) / {free} AS aa, sum(w * (a - ma) * (b - mb)) / {free} AS ab, sum(w * (b - mb) * (b - mb)) / {free} AS bb FROM f, t),
        e AS (SELECT id, a, ma + ab / bb * (b - mb) AS expected, greatest(aa - ab * ab / bb, 1e-8) AS variance FROM f, t, c)
        SELECT id, round(expected, 6) + 0 AS expected, round(variance, 6) AS variance, round(exp(-power(a - expected, 2) / (2 * variance)) / sqrt(2 * pi() * variance), 6) AS density FROM e""",
    )
    def run(spark, sf_dir):
        pts = points(spark, sf_dir).select("id", F.slice("x", 1, 2).alias("x"), (F.col("id") + 1.0).alias("w"))
        found = kernels.conditional_columns(pts, 0, weight=weight)
        return found.select("id", (F.round("expected", 6) + 0).alias("expected"), F.round("variance", 6).alias("variance"), F.round("density", 6).alias("density"))

    return run


_conditional("conditional_gaussian", None, "1", "(sum(w) - 1)")
_conditional("conditional_gaussian_weighted", "w", "(id + 1)", "max(sw)")


@query("hat_matrix", f"""WITH {_P}, h AS (SELECT id, [[0, -x[3], x[2]], [x[3], 0, -x[1]], [-x[2], x[1], 0]] AS m FROM p)
    SELECT id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(m[i + 1][j + 1], 6) + 0 AS v FROM h, range(3) a(i), range(3) b(j)""")
def hat_matrix(spark, sf_dir):
    rows = points(spark, sf_dir).select("id", F.posexplode(vec.hat(F.slice("x", 1, 3))).alias("i", "r"))
    return rows.select("id", "i", F.posexplode("r").alias("j", "v")).select("id", "i", "j", (F.round("v", 6) + 0).alias("v"))


@query("points_2d_3d", f"""WITH {_O} SELECT id, round(sqrt(power(x[1] - y[1], 2) + power(x[2] - y[2], 2)), 6) AS plane, round(x[2] * y[3] - x[3] * y[2], 6) + 0 AS cross1,
    round(x[3] * y[1] - x[1] * y[3], 6) + 0 AS cross2, round(x[1] * y[2] - x[2] * y[1], 6) + 0 AS cross3, round(x[1] * y[1] + x[2] * y[2] + x[3] * y[3], 6) + 0 AS dot,
    round(x[1] + y[1], 6) + 0 AS sum1, round(x[1] * 2.5, 6) + 0 AS scaled1 FROM p, o""")
def points_2d_3d(spark, sf_dir):
    a, b = F.slice("x", 1, 3), F.slice("y", 1, 3)
    c, at = vec.cross(a, b), lambda m, i: F.get(m, F.lit(i))
    parts = {
        "plane": vec.l2(F.slice("x", 1, 2), F.slice("y", 1, 2)), "cross1": at(c, 0), "cross2": at(c, 1), "cross3": at(c, 2), "dot": vec.dot(a, b),
        "sum1": at(vec.add(a, b), 0), "scaled1": at(vec.scale(a, F.lit(2.5)), 0),
    }
    return beside_first(spark, sf_dir).select("id", *((F.round(v, 6) + 0).alias(n) for n, v in parts.items()))


@query("point_to_space", f"WITH {_P} SELECT id, round(list_sum(list_transform(x[4:], lambda v: v * v)), 6) AS dist FROM p")
def point_to_space(spark, sf_dir):
    """The squared distance to the space of the first three coordinates."""
    basis = vec.matrix([[1.0 if i == j else 0.0 for j in range(64)] for i in range(3)])
    zero = F.transform(F.col("x"), lambda v: F.lit(0.0))
    return points(spark, sf_dir).select("id", F.round(vec.plane_residual(F.col("x"), zero, basis), 6).alias("dist"))


@query("std_by_row", f"WITH {_P}, f AS (SELECT id, unnest(x) AS v FROM p) SELECT id, round(avg(v), 6) + 0 AS mean, round(stddev_samp(v), 6) AS std FROM f GROUP BY id")
def std_by_row(spark, sf_dir):
    return aggregate.row_spread(points(spark, sf_dir)).select("id", (F.round("mean", 6) + 0).alias("mean"), F.round("std", 6).alias("std"))


@query("normalise_columns", f"""WITH {_P}, f AS (SELECT id, unnest(range(len(x))) AS dim, unnest(x) AS v FROM p), n AS (SELECT dim, sqrt(sum(v * v)) AS n FROM f GROUP BY dim)
    SELECT id, CAST(dim AS INT) AS dim, round(v / CASE WHEN n > 0 THEN n ELSE 1 END, 6) + 0 AS v, round(CASE WHEN n > 0 THEN n ELSE 1 END, 6) AS factor FROM f JOIN n USING (dim)""")
def normalise_columns(spark, sf_dir):
    scaled, factors = aggregate.column_normalise(points(spark, sf_dir))
    rows = scaled.select("id", F.posexplode("x").alias("dim", "v")).join(F.broadcast(factors), "dim")
    return rows.select("id", "dim", (F.round("v", 6) + 0).alias("v"), F.round("factor", 6).alias("factor"))


@query("variance_unscale", f"WITH {_P} SELECT id, CAST(unnest(range(len(x))) AS INT) AS dim, round(unnest(x), 6) + 0 AS v FROM p")
def variance_unscale(spark, sf_dir):
    """Scaling and its inverse."""
    pts = points(spark, sf_dir)
    factors = aggregate.spreads(pts)
    back = aggregate.scaled_by(aggregate.scaled_by(pts, factors, inverse=False), factors, inverse=True)
    return back.select("id", F.posexplode("x").alias("dim", "v")).select("id", "dim", (F.round("v", 6) + 0).alias("v"))


@query("head_values", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rank FROM events)
    SELECT event_type, value, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def head_values(spark, sf_dir):
    return aggregate.head(read(spark, sf_dir, "events"), ["event_type"], "value", 5)


@query("unique_rows_map", """WITH u AS (SELECT *, CAST(dense_rank() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1 AS INT) AS ic FROM orders) SELECT o_orderkey, ic FROM u""")
def unique_rows_map(spark, sf_dir):
    return select.unique_map(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("farthest_outliers", f"""WITH {_P}, m AS (SELECT unnest(range(len(x))) AS dim, unnest(x) AS v FROM p), c AS (SELECT list(a ORDER BY dim) AS c FROM (SELECT dim, avg(v) AS a FROM m GROUP BY dim)),
    d AS (SELECT id, list_distance(x, c) AS d FROM p, c), r AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS r FROM d) SELECT id, r <= 12 AS outlier FROM r""")
def farthest_outliers(spark, sf_dir):
    pts = points(spark, sf_dir)
    mean = aggregate.mean_vector(pts).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c"))
    rows = pts.join(F.broadcast(mean)).select("id", vec.l2(F.col("x"), F.col("c")).alias("dist"))
    return neighbors.farthest(rows, 12).select("id", "outlier")


@query("index_map", f"WITH {_P} SELECT id, CASE WHEN id % 7 = 0 THEN id // 7 ELSE -1 END AS pos FROM p")
def index_map(spark, sf_dir):
    pts = points(spark, sf_dir).select("id")
    return neighbors.index_map(pts, pts.where("id % 7 = 0").withColumn("pos", F.floor(F.col("id") / 7)))


@query("dist_rectangular", f"WITH {_P} SELECT a.id AS q, b.id AS i, round(list_distance(a.x, b.x), 6) AS dist FROM p a, p b WHERE a.id % 100 = 0 AND b.id % 100 <> 0")
def dist_rectangular(spark, sf_dir):
    pts = points(spark, sf_dir)
    return rounded(neighbors.between(ten(pts), pts.where("id % 100 <> 0")), "dist")


@query("approximate_knn", f"""WITH {_P}, d AS (SELECT a.id AS q, b.id AS i, list_distance(a.x, b.x) AS dist FROM p a, p b),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, i) AS rank FROM d) SELECT q, CAST(rank AS INT) AS rank, i, round(dist, 6) AS dist FROM r WHERE rank <= 5""")
def approximate_knn(spark, sf_dir):
    """With eps 0, the pruned search gives the exact neighbours."""
    pts = points(spark, sf_dir)
    return rounded(neighbors.approximate_knn(pts, pts, 5), "dist")


@query("success_rate", "SELECT round(avg(CASE WHEN least(a, b) = 1 AND greatest(a, b) = 2 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM (SELECT o_orderkey % 3 AS a, o_custkey % 3 AS b FROM orders)")
def success_rate(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select(F.array((F.col("o_orderkey") % 3).cast("int"), (F.col("o_custkey") % 3).cast("int")).alias("dims"))
    return aggregate.success_rate(runs, "dims", [2, 1]).withColumn("rate", F.round("rate", 9))


def _median_steps(n: int) -> str:
    out = ["s0 AS MATERIALIZED (SELECT list(m ORDER BY dim) AS c FROM (SELECT dim, avg(v) AS m FROM f GROUP BY dim))"]
    for i in range(n):
        out.append(f"w{i} AS MATERIALIZED (SELECT id, 1 / greatest(list_distance(x, c), 1e-12) AS w FROM p, s{i})")
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT list(m ORDER BY dim) AS c FROM (SELECT dim, sum(w * v) / sum(w) AS m FROM f JOIN w{i} USING (id) GROUP BY dim))")
    return ", ".join(out)


@query("spatial_median", f"WITH {_P}, f AS (SELECT id, unnest(range(len(x))) AS dim, unnest(x) AS v FROM p), {_median_steps(6)} SELECT CAST(unnest(range(64)) AS INT) AS dim, round(unnest(c), 6) + 0 AS v FROM s6")
def spatial_median(spark, sf_dir):
    found = aggregate.spatial_median(points(spark, sf_dir), steps=6, eps=0.0)
    return spark.createDataFrame([(i, round(v, 6) + 0.0) for i, v in enumerate(found)], "dim int, v double")


@query("keep_labelled", f"WITH {_TDM} SELECT tdm.doc_id, term, tf, quality AS label FROM tdm JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)")
def keep_labelled(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return text.keep_labelled(tdm(spark, sf_dir), labels).select("doc_id", "term", "tf", "label")


@query("top_centroid_terms", f"""WITH {_WEIGHT}, k AS (SELECT doc_id, min(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id), n AS (SELECT label, count(*) AS n FROM k GROUP BY label),
    m AS (SELECT label, term, sum(weight) / any_value(n.n) AS w FROM t JOIN k USING (doc_id) JOIN n USING (label) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(w, 9) DESC, term) AS rank FROM m) SELECT label, CAST(rank AS INT) AS rank, term, round(w, 6) AS weight FROM r WHERE rank <= 20""")
def top_centroid_terms(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("label"))
    return rounded(text.top_centroid_terms(text.tfidf(tdm(spark, sf_dir)), labels, 20), "weight")


@query("zero_norm_documents", f"WITH {_WEIGHT}, z AS (SELECT doc_id FROM t GROUP BY doc_id HAVING max(abs(weight)) > 0) SELECT doc_id, term, round(weight, 6) + 0 AS weight FROM t JOIN z USING (doc_id)")
def zero_norm_documents(spark, sf_dir):
    return text.zero_norm_documents(text.tfidf(tdm(spark, sf_dir))).select("doc_id", "term", (F.round("weight", 6) + 0).alias("weight"))


@query("backprojection_signed", f"""WITH {_TDM}, b AS (SELECT doc_id % 3 AS component, term, sum(CASE WHEN doc_id % 2 = 0 THEN tf ELSE -tf END) AS u FROM tdm GROUP BY ALL),
    x AS (SELECT id, term, sum((id + 1 - component) * u) AS weight FROM range(4) c(id), b GROUP BY ALL),
    r AS (SELECT *, CASE WHEN weight > 0 THEN '+' ELSE '-' END AS sign, row_number() OVER (PARTITION BY id, weight > 0 ORDER BY abs(weight) DESC, term) AS rank FROM x WHERE weight <> 0)
    SELECT id, sign, CAST(rank AS INT) AS rank, term, CAST(weight AS DOUBLE) AS weight FROM r WHERE rank <= 15""")
def backprojection_signed(spark, sf_dir):
    """Coordinates times a basis of three components, and the terms of greatest and least weight."""
    sign = F.when(F.col("doc_id") % 2 == 0, F.col("tf")).otherwise(-F.col("tf"))
    basis = tdm(spark, sf_dir).groupBy((F.col("doc_id") % 3).alias("component"), "term").agg(F.sum(sign).alias("u"))
    own = spark.range(4).select("id", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("component"))
    weights = text.backproject(own.withColumn("v", F.col("id") + 1 - F.col("component")), basis)
    return text.signed_terms(weights, 15).withColumn("weight", F.col("weight").cast("double"))


@query("lsa_numbered", """WITH w AS (SELECT doc_id, string_split_regex(text, '[ \\t\\n\\r\\f\\v]+') AS ws FROM documents),
    k AS (SELECT doc_id, list_filter(list_transform(ws, lambda x: lower(regexp_extract(x, '^[^A-Za-z0-9]*([A-Za-z0-9]+)', 1))), lambda x: x <> '') AS ks FROM w),
    f AS (SELECT doc_id, unnest(range(len(ks[1:100]))) AS place, unnest(ks[1:100]) AS term FROM k), g AS (SELECT doc_id, term, min(place) AS place FROM f GROUP BY ALL),
    s AS (SELECT doc_id FROM g GROUP BY doc_id HAVING count(*) >= 10), h AS (SELECT g.* FROM g JOIN s USING (doc_id)),
    m AS (SELECT term, min(doc_id * 1000 + place) AS seen FROM h GROUP BY term), n AS (SELECT term, row_number() OVER (ORDER BY seen) - 1 AS j FROM m) SELECT doc_id, term, j FROM h JOIN n USING (term)""")
def lsa_numbered(spark, sf_dir):
    """Terms numbered as they are first seen."""
    places = text.lsa_places(docs(spark, sf_dir))
    return text.numbered_features(places.select("doc_id", "term"), places)


@query("relabelled", f"""WITH {_P}, i AS (SELECT id, label, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE (label * 3 + 1) % 10 END AS inferred FROM p),
    c AS (SELECT label, inferred, count(*) AS n FROM i GROUP BY ALL), b AS (SELECT inferred, arg_max(label, n) AS name FROM c GROUP BY inferred) SELECT id, CAST(name AS INT) AS label FROM i JOIN b USING (inferred)""")
def relabelled(spark, sf_dir):
    pts = points(spark, sf_dir)
    other = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise((F.col("label") * 3 + 1) % 10)
    return score.relabel(pts, pts.select("id", other.cast("int").alias("label")), dict.fromkeys(range(10), 1))


@query("good_sample_half", "SELECT count(*) > 0 AS found FROM part")
def good_sample(spark, sf_dir):
    """A random row among the best by two measures: whether it is one of them."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("length"), F.col("p_retailprice").alias("normal"))
    got = select.good_sample(rows, "length", "normal", "p_partkey", 3)
    half = rows.orderBy(F.desc("length"), "p_partkey").limit(max(1, rows.count() // 2))
    return got.join(half.select("p_partkey"), "p_partkey").agg((F.count("*") == 1).alias("found"))


@query("rand_sample_size", "SELECT least(count(*), 25) AS n, least(count(*), 25) AS different FROM customer")
def rand_sample(spark, sf_dir):
    return select.rand_sample(read(spark, sf_dir, "customer"), 25, 11).agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("different"))
