"""Operations on edge tables (src, dst) and on meshes given as faces (face, vertex arrays)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.files import stored

from .select import numbered


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Each node's neighbours, ascending."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    return both.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def bandwidth(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.abs(F.col("src") - F.col("dst"))).alias("bandwidth"))


def condensation(edges: DataFrame, component: DataFrame) -> DataFrame:
    """The edges between components (id, component), once each."""
    a = component.select(F.col("id").alias("src"), F.col("component").alias("a"))
    b = component.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def stored_step(df: DataFrame) -> DataFrame:
    """One step's result, written: lineage doesn't grow with the steps."""
    return stored(df, "graph")


def levels(edges: DataFrame, start: int, *, limit: int = 100) -> DataFrame:
    """(id, level): steps of a breadth-first search from `start` over directed edges."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "id long, level int")
    front = seen
    for step in range(1, limit):
        reached = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        front = reached.join(seen, "id", "left_anti").withColumn("level", F.lit(step))
        front = stored_step(front)
        if front.isEmpty():
            return seen
        seen = seen.union(front)
    raise RuntimeError("the search has not ended")


def topological_order(edges: DataFrame, *, limit: int = 1000) -> DataFrame:
    """(id, level): the longest path that leads to each node; fails on a cycle."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    now = nodes.withColumn("level", F.lit(0))
    for _ in range(min(limit, nodes.count() + 1)):
        far = edges.join(now.withColumnRenamed("id", "src"), "src").groupBy("dst").agg((F.max("level") + 1).alias("l")).withColumnRenamed("dst", "id")
        after = now.join(far, "id", "left").select("id", F.coalesce("l", F.lit(0)).alias("level"), F.col("level").alias("old"))
        after = stored_step(after)
        changed = not after.where("level <> old").isEmpty()
        now = after.drop("old")
        if not changed:
            return now
    raise ValueError("the graph has a cycle")


def face_edges(faces: DataFrame) -> DataFrame:
    """(face, a, b) with a < b: the sides of faces given as arrays of vertices."""
    sides = F.transform("vertices", lambda v, i: F.struct(v.alias("p"), F.get("vertices", (i + 1) % F.size("vertices")).alias("q")))
    rows = faces.select("face", F.explode(sides).alias("s"))
    return rows.select("face", F.least("s.p", "s.q").alias("a"), F.greatest("s.p", "s.q").alias("b"))


def mesh_edges(faces: DataFrame) -> DataFrame:
    return face_edges(faces).select("a", "b").distinct()


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Sides of one face only."""
    return face_edges(faces).groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 1").select("a", "b")


def face_neighbours(faces: DataFrame) -> DataFrame:
    """Pairs of faces (f < g) that share a side."""
    e = face_edges(faces)
    return e.toDF("f", "a", "b").join(e.toDF("g", "a", "b"), ["a", "b"]).where("f < g").select("f", "g", "a", "b")


def is_manifold(faces: DataFrame) -> DataFrame:
    """Whether no side has more than two faces."""
    return face_edges(faces).groupBy("a", "b").agg(F.count("*").alias("n")).agg((F.max("n") <= 2).alias("manifold"))


def edge_lengths(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, length) of all sides; vertices are (id, x)."""
    from quillspark.functions.vec import l2

    e = mesh_edges(faces).join(vertices.toDF("a", "xa"), "a").join(vertices.toDF("b", "xb"), "b")
    return e.select("a", "b", l2(F.col("xa"), F.col("xb")).alias("length"))


def barycenters(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(face, dim, v): the mean of each face's vertices."""
    rows = faces.select("face", F.explode("vertices").alias("id")).join(vertices, "id").select("face", F.posexplode("x").alias("dim", "v"))
    return rows.groupBy("face", "dim").agg(F.avg("v").alias("v"))


def double_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(face, area2): twice the area of triangles in space."""
    from quillspark.functions.vec import cross, norm, subtract

    t = faces.select("face", *(F.get("vertices", F.lit(i)).alias(f"v{i}") for i in range(3)))
    for i in range(3):
        t = t.join(vertices.toDF(f"v{i}", f"x{i}"), f"v{i}")
    return t.select("face", norm(cross(subtract(F.col("x1"), F.col("x0")), subtract(F.col("x2"), F.col("x0")))).alias("area2"))


def bounding_box_diagonal(vertices: DataFrame) -> DataFrame:
    rows = vertices.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg((F.max("v") - F.min("v")).alias("d"))
    return rows.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("diagonal"))


def unique_simplices(faces: DataFrame) -> DataFrame:
    """One face of each set of vertices: the first."""
    return faces.groupBy(F.array_sort("vertices").alias("vertices")).agg(F.min("face").alias("face"))


def remove_unreferenced(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.join(faces.select(F.explode("vertices").alias("id")).distinct(), "id", "left_semi")


def smooth_attribute(faces: DataFrame, values: DataFrame) -> DataFrame:
    """(id, v): each vertex's mean over the means of its faces."""
    corner = faces.select("face", F.explode("vertices").alias("id"))
    face = corner.join(values, "id").groupBy("face").agg(F.avg("v").alias("m"))
    return corner.join(face, "face").groupBy("id").agg(F.avg("m").alias("v"))


def wavefront(edges: DataFrame) -> DataFrame:
    """(i, wavefront): the rows a frontal solver holds open at each step: those up to i's and their later neighbours."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    first = both.groupBy("dst").agg(F.min("src").alias("first")).select(F.col("dst").alias("id"), F.least("first", "dst").alias("first"))
    opened = first.groupBy(F.col("first").alias("i")).agg(F.count("*").alias("opened"))
    rows = first.select(F.col("id").alias("i")).join(opened, "i", "left").select("i", F.coalesce("opened", F.lit(0)).alias("opened"))
    placed = numbered(numbered(rows, ["i"], "before", weight="opened"), ["i"], "place")
    return placed.select("i", (F.col("before") + F.col("opened") - F.col("place")).alias("wavefront"))


def connected(edges: DataFrame, a: int, b: int) -> bool:
    """Whether b can be reached from a over directed edges."""
    return not levels(edges, a).where(F.col("id") == b).isEmpty()


def eccentricity(edges: DataFrame, start: int) -> int:
    """The most steps to any node that can be reached."""
    return levels(edges, start).agg(F.max("level")).first()[0]


def connecting_edges(component: DataFrame) -> DataFrame:
    """Edges that join all components (id, component) in a row, by their smallest nodes."""
    roots = numbered(component.select("component").distinct(), ["component"], "n")
    after = roots.select((F.col("n") - 1).alias("n"), F.col("component").alias("dst"))
    return roots.join(after, "n").select(F.col("component").alias("src"), "dst")


def flow_cost(edges: DataFrame) -> DataFrame:
    """The sum of flow times cost."""
    return edges.agg(F.sum(F.col("flow") * F.col("cost")).alias("cost"))


def relax(distance: DataFrame, edges: DataFrame) -> DataFrame:
    """One step of shortest paths: (id, dist) lowered over weighted edges (src, dst, w)."""
    near = edges.join(distance.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"))
    return distance.unionByName(near).groupBy("id").agg(F.min("dist").alias("dist"))


def shortest_paths(edges: DataFrame, start: int, *, limit: int = 1000) -> DataFrame:
    """(id, dist) from `start` over edges (src, dst, w) with weights of 0 or more."""
    now = edges.sparkSession.createDataFrame([(start, 0.0)], "id long, dist double")
    for _ in range(limit):
        after = stored_step(relax(now, edges))
        if after.exceptAll(now).isEmpty():
            return after
        now = after
    raise RuntimeError("paths have not settled")


def minimum_spanning_forest(edges: DataFrame, *, limit: int = 40) -> DataFrame:
    """The edges (src, dst, w) of least total weight that keep components: each round, every component takes its lightest edge."""
    from .cluster import connected_components

    edges = edges.where("src <> dst")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    own, chosen = nodes.withColumn("component", F.col("id")), edges.limit(0)
    for _ in range(limit):
        tagged = edges.join(own.toDF("src", "a"), "src").join(own.toDF("dst", "b"), "dst").where("a <> b")
        both = tagged.select("a", "src", "dst", "w").union(tagged.select("b", "src", "dst", "w"))
        key = F.struct("w", F.least("src", "dst"), F.greatest("src", "dst"))
        light = both.groupBy("a").agg(F.min_by(F.struct("src", "dst", "w"), key).alias("e")).select("e.*").distinct()
        light = stored_step(light)
        if light.isEmpty():
            return chosen
        chosen = stored_step(chosen.unionByName(light).distinct())
        own = connected_components(chosen, nodes)
    raise RuntimeError("the forest has not settled")


def grid_graph(spark, rows: int, columns: int) -> DataFrame:
    """The edges of a grid, its nodes numbered row by row."""
    cells = spark.range(rows * columns).select(F.col("id"), (F.col("id") % columns).alias("c"))
    right = cells.where(F.col("c") < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cells.where(F.col("id") < (rows - 1) * columns).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return right.unionByName(down)


def small_world(spark, n: int, k: int, chance: float, seed: int) -> DataFrame:
    """A ring with k neighbours to each side, whose edges go elsewhere with the given chance."""
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("d"))
    draw = lambda salt: F.pmod(F.xxhash64("src", "d", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    far = F.floor(draw(1) * n)
    return ring.select("src", F.when(draw(0) < chance, far).otherwise((F.col("src") + F.col("d")) % n).cast("long").alias("dst"))
