"""Documents from directories, XML files and lists of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each regular file of a directory, without its subdirectories; the id is the file's name."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def read_xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of <document> elements with both a docID and a docText; others are skipped."""
    rows = spark.read.format("xml").option("rowTag", "document").schema("docID string, docText string").load(path)
    return rows.where("docID IS NOT NULL AND docText IS NOT NULL").select(F.col("docID").alias("doc_id"), F.col("docText").alias("text"))


def read_strings(spark: SparkSession, path: str, *, leave_out: int | None = None) -> DataFrame:
    """(line, value) of a file's lines, without line number `leave_out`."""
    from .matrices import _lines

    rows = _lines(spark, path)
    return rows if leave_out is None else rows.where(F.col("line") != leave_out)


def write_strings(df: DataFrame, column: str, path: str) -> None:
    """One string per line, in the frame's order within each file."""
    df.select(column).write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (src, dst) of a trivial graph format file: a line '#' lies between."""
    from .matrices import _lines

    rows = _lines(spark, path).withColumn("value", F.trim("value")).where("value <> ''")
    cut = rows.where("value = '#'").agg(F.min("line").alias("cut"))
    rows = rows.join(F.broadcast(cut))
    words = F.split("value", "\\s+")
    nodes = rows.where("line < cut OR cut IS NULL").select(words[0].try_cast("long").alias("id"), F.array_join(F.slice(words, 2, 1000), " ").alias("name"))
    edges = rows.where("line > cut").select(words[0].try_cast("long").alias("src"), words[1].try_cast("long").alias("dst"))
    return nodes, edges


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, x) and faces (face, vertices) of an OBJ file, both counted from 0."""
    return _mesh(spark, path, "v", "f")


def _mesh(spark: SparkSession, path: str, vertex: str, face: str) -> tuple[DataFrame, DataFrame]:
    from .matrices import _lines, numbered

    rows = _lines(spark, path).select("line", F.split(F.trim("value"), "\\s+").alias("w"))
    rest = lambda: F.slice("w", 2, 1000)
    vertices = numbered(rows.where(F.col("w")[0] == vertex), ["line"], "id").select("id", F.slice(rest(), 1, 3).try_cast("array<double>").alias("x"))
    corner = lambda t: F.substring_index(t, "/", 1).cast("long") - 1
    faces = numbered(rows.where(F.col("w")[0] == face), ["line"], "face").select("face", F.transform(rest(), corner).alias("vertices"))
    return vertices, faces


def _words(spark: SparkSession, path: str, without: str = "") -> DataFrame:
    """(at, w): the words of the lines that hold any, numbered from 0; comments begin with #."""
    from .matrices import _lines, numbered

    rows = _lines(spark, path).withColumn("value", F.trim(F.regexp_replace("value", "#.*$", ""))).where((F.col("value") != "") & (F.col("value") != without))
    return numbered(rows, ["line"], "at").select("at", F.split("value", "\\s+").alias("w"))


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, x) and faces (face, vertices) of an OFF file."""
    rows = _words(spark, path, "OFF").withColumn("at", F.col("at") - 1)
    sizes = rows.where("at = -1").select(F.col("w")[0].try_cast("long").alias("n"))
    rows = rows.where("at >= 0").join(F.broadcast(sizes))
    vertices = rows.where("at < n").select(F.col("at").alias("id"), F.slice("w", 1, 3).try_cast("array<double>").alias("x"))
    faces = rows.where("at >= n").select((F.col("at") - F.col("n")).alias("face"), F.slice("w", 2, 1000).try_cast("array<bigint>").alias("vertices"))
    return vertices, faces


def read_node(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) of a NODE file: a head line, then a number and the coordinates on each line."""
    rows = _words(spark, path)
    head = rows.where("at = 0").select(F.col("w")[1].try_cast("int").alias("d"))
    return rows.where("at > 0").join(F.broadcast(head)).select(F.col("w")[0].try_cast("long").alias("id"), F.expr("slice(w, 2, d)").try_cast("array<double>").alias("x"))


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """(face, corner, x) of a text STL file: three corners for each face."""
    from .matrices import numbered

    rows = _words(spark, path).where(F.lower(F.col("w")[0]) == "vertex")
    rows = numbered(rows, ["at"], "n").select("n", F.slice("w", 2, 3).try_cast("array<double>").alias("x"))
    return rows.select(F.floor(F.col("n") / 3).alias("face"), (F.col("n") % 3).cast("int").alias("corner"), "x")


def read_mesh(spark: SparkSession, path: str, section: str = "Vertices") -> DataFrame:
    """(at, x): the numbers of one section (Vertices, Triangles, Tetrahedra, ...) of a MESH file, in order."""
    rows = _words(spark, path)
    # sections by the place of their names: one row each
    names = rows.where(F.col("w")[0].rlike("^[A-Za-z]") & (F.size("w") == 1)).select(F.col("at").alias("begin"), F.col("w")[0].alias("name"))
    own = names.where(F.lower("name") == section.lower()).agg(F.min("begin").alias("begin"))
    after = names.join(F.broadcast(own.withColumnRenamed("begin", "b")), F.col("begin") > F.col("b")).agg(F.min("begin").alias("end"))
    picked = rows.join(F.broadcast(own)).join(F.broadcast(after)).where("at > begin + 1 AND (end IS NULL OR at < end)")
    return picked.select((F.col("at") - F.col("begin") - 2).alias("at"), F.col("w").try_cast("array<double>").alias("x"))


def read_wrl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, x) and faces (face, vertices) of the first point and coordIndex lists of a WRL file, one entry a line."""
    from .matrices import numbered

    rows = _words(spark, path)
    text = F.array_join("w", " ")
    opened = lambda word: rows.where(text.rlike(f"\\b{word}\\s*\\[")).agg(F.min("at").alias("begin"))

    def body(word: str) -> DataFrame:
        begin = F.broadcast(opened(word))
        end = rows.join(begin).where((F.col("at") > F.col("begin")) & text.contains("]")).agg(F.min("at").alias("end"))
        return rows.join(begin).join(F.broadcast(end)).where("at > begin AND at < end").select("at", F.split(F.trim(F.regexp_replace(text, ",", " ")), "\\s+").alias("v"))

    vertices = numbered(body("point"), ["at"], "id").select("id", F.slice("v", 1, 3).try_cast("array<double>").alias("x"))
    faces = numbered(body("coordIndex"), ["at"], "face").select("face", F.filter(F.col("v").try_cast("array<bigint>"), lambda i: i >= 0).alias("vertices"))
    return vertices, faces
