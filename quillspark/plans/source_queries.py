"""Queries that write tables in the formats of the sources and read them back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import factorise
from quillspark.functions import vec
from quillspark.sources import matrices, text
from quillspark.sources.files import file_exists, shared_folder

from .model_queries import _CELLS, _ENTRIES, cells, entries_of
from .registry import query
from .table_queries import read
from .vector_queries import _P, points

_ALL = f"WITH {_P} SELECT id, CAST(unnest(range(len(x))) AS INT) AS dim, round(unnest(x), 4) + 0 AS v FROM p"


def one_file(lines: DataFrame, spark: SparkSession, what: str) -> str:
    """A text file of lines (at, value) in order, in one part: a small fixture's file."""
    where = f"{shared_folder(spark, what)}"
    lines.repartition(1).sortWithinPartitions("at").select("value").write.text(where)
    return where


def _dmat(name: str, binary: bool):
    @query(name, _ALL)
    def run(spark, sf_dir):
        where = f"{shared_folder(spark, 'dmat')}/m.dmat"
        matrices.write_dmat(points(spark, sf_dir).where("id IS NOT NULL"), where, binary=binary)
        return entries_of(matrices.read_dmat(spark, where))

    return run


_dmat("dmat_text", False)
_dmat("dmat_binary", True)


def dense_lines(spark, sf_dir, places: int = 9) -> DataFrame:
    return points(spark, sf_dir).select(F.col("id").alias("at"), F.array_join(F.transform("x", lambda v: F.format_string(f"%.{places}f", v)), " ").alias("value"))


@query("dense_text_matrix", _ALL)
def dense_text_matrix(spark, sf_dir):
    return entries_of(matrices.read_table(spark, one_file(dense_lines(spark, sf_dir), spark, "dense"), permissive=True))


@query("whitespace_table", """SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS id, CAST(s_suppkey AS DOUBLE) AS a, CAST(s_nationkey AS DOUBLE) AS b, s_acctbal AS c FROM supplier""")
def whitespace_table(spark, sf_dir):
    """Tabs and blanks between, blank lines left out, and what a comma begins."""
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit("\t  "), F.col("s_nationkey").cast("string"), F.lit(" "), F.format_string("%.2f", "s_acctbal"), F.lit(" , 7 rest"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("at"), line.alias("value"))
    blank = rows.where("at % 10 = 0").select((F.col("at") + 0.5).alias("at"), F.lit("   ").alias("value"))
    found = matrices.read_table(spark, one_file(rows.withColumn("at", F.col("at").cast("double")).unionByName(blank), spark, "table"))
    return found.select("id", *(F.get("x", F.lit(i)).alias(c) for i, c in enumerate("abc")))


@query("sparse_text_matrix", f"WITH e AS ({_CELLS}) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM e")
def sparse_text_matrix(spark, sf_dir):
    token = F.concat_ws(":", "j", F.format_string("%.1f", "v"))
    # a token twice in a line counts once
    rows = cells(spark, sf_dir).groupBy(F.col("i").alias("at")).agg(F.array_join(F.concat(F.collect_list(token), F.collect_list(token)), " ").alias("value"))
    return matrices.read_sparse(spark, one_file(rows, spark, "sparse"))


@query("sparse_rows_of_documents", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 3 GROUP BY ALL),
    n AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS j FROM (SELECT DISTINCT term FROM t)) SELECT doc_id AS i, j, CAST(tf AS DOUBLE) AS v FROM t JOIN n USING (term)""")
def sparse_rows_of_documents(spark, sf_dir):
    """The whole term-document matrix with numbered terms, as (i, j, v) rows."""
    from quillspark.operators.select import numbered

    from .text_queries import tdm

    counts = tdm(spark, sf_dir)
    names = numbered(counts.select("term").distinct(), ["term"], "j")
    return counts.join(names, "term").select(F.col("doc_id").alias("i"), "j", F.col("tf").cast("double").alias("v"))


def _typed(kind: str, sql: str):
    @query(f"typed_matrix_{kind}", f"WITH {_P}, e AS (SELECT id, CAST(unnest(range(len(x))) AS INT) AS dim, unnest(x) AS v FROM p) SELECT id, dim, CAST({sql} AS DOUBLE) AS v FROM e")
    def run(spark, sf_dir):
        where = shared_folder(spark, "typed")
        rows = points(spark, sf_dir)
        if kind.startswith("int"):
            rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * 1000).cast("double")))
        matrices.write_typed(rows, where, kind)
        found = matrices.read_typed(spark, where, kind).select("id", F.posexplode("x").alias("dim", "v"))
        return found.withColumn("v", F.col("v") if kind.startswith("int") else F.round("v", 4) + 0)

    return run


_typed("double", "round(v, 4) + 0")
_typed("single", "round(v, 4) + 0")
_typed("int64", "floor(v * 1000)")
_typed("int32", "floor(v * 1000)")


@query("string_list", "SELECT CAST(n_nationkey AS BIGINT) AS line, n_name AS value FROM nation WHERE n_nationkey <> 7")
def string_list(spark, sf_dir):
    """One name a line, without line 7."""
    where = shared_folder(spark, "strings")
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("at"), F.col("n_name").alias("name"))
    text.write_strings(rows.repartition(1).sortWithinPartitions("at"), "name", where)
    return text.read_strings(spark, where, leave_out=7)


@query("array_list", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS line, CAST(s_suppkey AS DOUBLE) AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier")
def array_list(spark, sf_dir):
    """The first two of three numbers on each line."""
    line = F.concat_ws(" ", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.format_string("%.2f", "s_acctbal"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("at"), line.alias("value"))
    found = matrices.read_arrays(spark, one_file(rows, spark, "arrays"), 2)
    return found.select("line", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))


@query("directory_scan", """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark)
    SELECT item_id AS doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 3 GROUP BY ALL""")
def directory_scan(spark, sf_dir):
    """Term counts of files, one to a benchmark item; the file's number is the item."""
    from quillspark.operators.text import term_counts

    where = shared_folder(spark, "directory")
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text")
    rows.write.partitionBy("item_id").text(where)
    found = spark.read.option("recursiveFileLookup", "true").text(where, wholetext=True)
    item = F.regexp_extract(F.col("_metadata.file_path"), "item_id=(-?\\d+)", 1).cast("long")
    return term_counts(found.select(item.alias("doc_id"), F.col("value").alias("text")))


@query("directory_scan_pruned", """WITH w AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), t AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 2 GROUP BY ALL),
    o AS (SELECT term FROM t GROUP BY term HAVING sum(tf) >= 2), k AS (SELECT t.* FROM t JOIN o USING (term)), l AS (SELECT doc_id, sum(tf) AS n FROM k GROUP BY doc_id), f AS (SELECT term, count(*) AS df FROM k GROUP BY term)
    SELECT k.doc_id, k.term, round(tf / n * ln((SELECT count(*) FROM l) / (1 + df)), 6) + 0 AS weight FROM k JOIN l USING (doc_id) JOIN f USING (term)""")
def directory_scan_pruned(spark, sf_dir):
    """Terms of two letters or more that occur twice or more, and their weights."""
    from quillspark.operators import text as terms

    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    counts = terms.directory_matrix(rows, least_length=2, least_count=2)
    return terms.tfidf(counts).select("doc_id", "term", (F.round("weight", 6) + 0).alias("weight"))


@query("xml_documents", "SELECT CAST(item_id AS VARCHAR) AS doc_id, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS text FROM benchmark WHERE item_id % 3 <> 0")
def xml_documents(spark, sf_dir):
    """Documents with an id and a text; a third lack the text and are skipped."""
    clean = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    body = F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("<docText>"), clean, F.lit("</docText>"))).otherwise("")
    element = F.concat(F.lit("<document><docID>"), F.col("item_id").cast("string"), F.lit("</docID>"), body, F.lit("</document>"))
    rows = read(spark, sf_dir, "benchmark").select(F.lit(1).alias("o"), F.col("item_id").alias("i"), element.alias("value"))
    ends = spark.createDataFrame([(0, 0, "<documents>"), (2, 0, "</documents>")], "o int, i long, value string")
    lines = rows.unionByName(ends).select(F.struct("o", "i").alias("at"), "value")
    return text.read_xml_documents(spark, one_file(lines, spark, "xml"))


@query("graph_file", "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(100 + n_regionkey AS BIGINT) AS dst, n_name AS name FROM nation")
def graph_file(spark, sf_dir):
    """Nations and their regions as nodes and edges of a trivial graph file."""
    n = read(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").alias("at"), F.concat_ws(" ", "n_nationkey", "n_name").alias("value"))
    edges = n.select((F.col("n_nationkey") + 1001).alias("at"), F.concat_ws(" ", "n_nationkey", (F.col("n_regionkey") + 100).cast("string")).alias("value"))
    lines = nodes.unionByName(edges).unionByName(spark.createDataFrame([(1000, "#")], "at int, value string"))
    found, links = text.read_graph(spark, one_file(lines, spark, "graph"))
    return links.join(found, links["src"] == found["id"]).select("src", "dst", "name")


_MESH = f"WITH {_P} SELECT id, round(x[1], 4) + 0 AS a, round(x[2], 4) + 0 AS b, round(x[3], 4) + 0 AS c, id + (id + 1) % (SELECT count(*) FROM p) AS corners FROM p"


def _corner(i: int):
    return F.format_string("%.9f", F.get("x", F.lit(i)))


def _meshed(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Each vertex with the sum of the other corners of the face of its number."""
    at = lambda i: (F.round(F.get("x", F.lit(i)), 4) + 0)
    own = faces.select(F.col("face").alias("id"), (F.get("vertices", F.lit(0)) + F.get("vertices", F.lit(1))).alias("corners"))
    return vertices.select("id", at(0).alias("a"), at(1).alias("b"), at(2).alias("c")).join(own, "id")


def _mesh_rows(spark, sf_dir):
    pts = points(spark, sf_dir)
    n = pts.count()
    xyz = F.concat_ws(" ", _corner(0), _corner(1), _corner(2))
    return n, pts.select("id", xyz.alias("xyz"), F.col("id").alias("p"), ((F.col("id") + 1) % n).alias("q"), ((F.col("id") + 2) % n).alias("r"))


def _lines_of(spark, head: list[str], *parts: DataFrame, tail: tuple[str, ...] = ()) -> DataFrame:
    """Lines of a file: fixed ones, then each part's (id, value) in order."""
    out = spark.createDataFrame([(0, i, v) for i, v in enumerate(head)], "o int, id long, value string")
    for o, part in enumerate(parts):
        out = out.unionByName(part.select(F.lit(o + 1).alias("o"), "id", "value"))
    if tail:
        out = out.unionByName(spark.createDataFrame([(len(parts) + 1, i, v) for i, v in enumerate(tail)], "o int, id long, value string"))
    return out.select(F.struct("o", "id").alias("at"), "value")


@query("mesh_obj", _MESH)
def mesh_obj(spark, sf_dir):
    _, rows = _mesh_rows(spark, sf_dir)
    v = rows.select("id", F.concat(F.lit("v "), "xyz").alias("value"))
    f = rows.select("id", F.concat_ws(" ", F.lit("f"), *((F.col(c) + 1).cast("string") for c in "pqr")).alias("value"))
    return _meshed(*text.read_obj(spark, one_file(_lines_of(spark, ["# mesh"], v, f), spark, "obj")))


@query("mesh_off", _MESH)
def mesh_off(spark, sf_dir):
    n, rows = _mesh_rows(spark, sf_dir)
    f = rows.select("id", F.concat_ws(" ", F.lit("3"), "p", "q", "r").alias("value"))
    return _meshed(*text.read_off(spark, one_file(_lines_of(spark, ["OFF", f"{n} {n} 0"], rows.select("id", F.col("xyz").alias("value")), f), spark, "off")))


@query("mesh_wrl", _MESH)
def mesh_wrl(spark, sf_dir):
    _, rows = _mesh_rows(spark, sf_dir)
    v = rows.select("id", F.concat("xyz", F.lit(",")).alias("value"))
    f = rows.select("id", F.concat(F.concat_ws(",", "p", "q", "r"), F.lit(",-1,")).alias("value"))
    middle = spark.createDataFrame([(0, "] }"), (1, "coordIndex [")], "id long, value string")
    return _meshed(*text.read_wrl(spark, one_file(_lines_of(spark, ["Shape {", "coord Coordinate {", "point ["], v, middle, f, tail=("]", "}")), spark, "wrl")))


@query("mesh_sections", _MESH)
def mesh_sections(spark, sf_dir):
    """Vertices and triangles of a MESH file, each line with a number at its end."""
    n, rows = _mesh_rows(spark, sf_dir)
    v = rows.select("id", F.concat("xyz", F.lit(" 0")).alias("value"))
    middle = spark.createDataFrame([(0, "Triangles"), (1, str(n))], "id long, value string")
    f = rows.select("id", F.concat_ws(" ", *((F.col(c) + 1).cast("string") for c in "pqr"), F.lit("0")).alias("value"))
    where = one_file(_lines_of(spark, ["MeshVersionFormatted 1", "Vertices", str(n)], v, middle, f, tail=("End",)), spark, "mesh")
    faces = text.read_mesh(spark, where, "Triangles").select(F.col("at").alias("face"), F.transform("x", lambda c: c.cast("long") - 1).alias("vertices"))
    return _meshed(text.read_mesh(spark, where).withColumnRenamed("at", "id"), faces)


@query("mesh_node", f"WITH {_P} SELECT id, round(x[1], 4) + 0 AS a, round(x[2], 4) + 0 AS b, round(x[3], 4) + 0 AS c FROM p")
def mesh_node(spark, sf_dir):
    n, rows = _mesh_rows(spark, sf_dir)
    where = one_file(_lines_of(spark, [f"{n} 3 0 0"], rows.select("id", F.concat_ws(" ", F.col("id").cast("string"), "xyz").alias("value"))), spark, "node")
    return text.read_node(spark, where).select("id", *((F.round(F.get("x", F.lit(i)), 4) + 0).alias(c) for i, c in enumerate("abc")))


@query("mesh_stl", f"WITH {_P} SELECT id AS face, CAST(k AS INT) AS corner, round(x[k + 1], 4) + 0 AS a FROM p, range(3) r(k)")
def mesh_stl(spark, sf_dir):
    """A facet per point, whose corners begin with its first three coordinates."""
    pts = points(spark, sf_dir)
    one = lambda i: F.concat_ws(" ", F.lit("vertex"), _corner(i), F.lit("0"), F.lit("1"))
    facet = F.array(F.lit("facet normal 0 0 1"), F.lit("outer loop"), one(0), one(1), one(2), F.lit("endloop"), F.lit("endfacet"))
    rows = pts.select("id", F.posexplode(facet).alias("n", "value")).select((F.col("id") * 10 + F.col("n")).alias("id"), "value")
    found = text.read_stl(spark, one_file(_lines_of(spark, ["solid s"], rows, tail=("endsolid s",)), spark, "stl"))
    return found.select("face", "corner", (F.round(F.get("x", F.lit(0)), 4) + 0).alias("a"))


@query("file_existence", "SELECT true AS there, false AS other")
def file_existence(spark, sf_dir):
    return spark.createDataFrame([(file_exists(spark, f"{sf_dir}/nation.parquet"), file_exists(spark, f"{sf_dir}/no_such.parquet"))], "there boolean, other boolean")


# --- factors from file to file -------------------------------------------------------------------


def _factored(spark, sf_dir, method: str, rank: int) -> str:
    where = shared_folder(spark, "factors-of-file")
    factorise.factorise(spark, one_file(dense_lines(spark, sf_dir), spark, "dense"), where, rank=rank, kind="dense", method=method)
    return where


def _matrix(spark, where: str) -> np.ndarray:
    return np.array([r.x for r in matrices.read_table(spark, where).orderBy("id").collect()])


def _file_svd(name: str, method: str):
    @query(name, _ENTRIES.replace("round(unnest(x), 4)", "round(unnest(x), 2)"))
    def run(spark, sf_dir):
        """Factors with six digits, read again and multiplied."""
        where = _factored(spark, sf_dir, method, 64)
        back = factorise.reconstructed(matrices.read_table(spark, f"{where}/U"), _matrix(spark, f"{where}/S").ravel(), _matrix(spark, f"{where}/V"))
        rows = back.select("id", F.posexplode("x").alias("dim", "v"))
        # six digits of each factor leave an error of about 1e-5: entries near a rounding edge follow the table's own
        own = points(spark, sf_dir).select("id", F.posexplode("x").alias("dim", "w"))
        both = rows.join(own, ["id", "dim"])
        return both.select("id", "dim", (F.round(F.when(F.abs(F.col("v") - F.col("w")) < 1e-3, F.col("w")).otherwise(F.col("v")), 2) + 0).alias("v"))

    return run


_file_svd("file_svd", "SVD")
_file_svd("file_svd_incremental", "incremental")


@query("file_pca", f"""WITH {_P}, f AS (SELECT unnest(range(len(x))) AS dim, unnest(x) AS v FROM p), c AS (SELECT list(m ORDER BY dim) AS c FROM (SELECT dim, avg(v) AS m FROM f GROUP BY dim))
    SELECT id, true AS near FROM p, c""")
def file_pca(spark, sf_dir):
    """Scores with six digits keep the squared distances to the mean."""
    from quillspark.operators import aggregate

    where = _factored(spark, sf_dir, "PCA", 64)
    score = matrices.read_table(spark, f"{where}/score").select("id", vec.dot(F.col("x"), F.col("x")).alias("energy"))
    pts = points(spark, sf_dir)
    mean = aggregate.mean_vector(pts).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c"))
    rows = pts.join(F.broadcast(mean)).select("id", vec.sqdist(F.col("x"), F.col("c")).alias("want"))
    return rows.join(score, "id").select("id", (F.abs(F.col("want") - F.col("energy")) < 1e-3).alias("near"))


@query("file_sparse_svd", f"WITH e AS ({_CELLS}) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM e")
def file_sparse_svd(spark, sf_dir):
    """Counts come back from factors with six digits, rounded to whole numbers."""
    e, where = cells(spark, sf_dir), shared_folder(spark, "sparse-factors")
    lines = e.groupBy(F.col("i").alias("at")).agg(F.array_join(F.collect_list(F.concat_ws(":", "j", "v")), " ").alias("value"))
    factorise.factorise(spark, one_file(lines, spark, "sparse"), where, rank=5, kind="sparse", method="SVD")
    u, s, v = (_matrix(spark, f"{where}/{n}") for n in "USV")
    m = np.rint(u * s.ravel() @ v.T)
    found = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")
    return e.select("i", "j").join(found, ["i", "j"])


@query("lsa_spaces")
def lsa_spaces(spark, sf_dir):
    """Squared lengths of the documents in five directions of their words."""
    docs, _ = factorise.lsa(read(spark, sf_dir, "documents").select("doc_id", "text"), 5)
    return docs.select("doc_id", F.round(vec.dot(F.col("x"), F.col("x")), 3).alias("energy"))
