import numpy as np
import pytest

from quillspark.sources import matrices, text
from quillspark.streaming.sketch import RangeSketch


def points(spark, m):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, x array<double>")


@pytest.mark.parametrize("binary", [False, True])
def test_dmat_round_trip(spark, tmp_path, binary):
    m = np.random.default_rng(0).standard_normal((7, 3))
    path = f"{tmp_path}/m.dmat"
    matrices.write_dmat(points(spark, m), path, binary=binary)
    got = np.array([r.x for r in matrices.read_dmat(spark, path).orderBy("id").collect()])
    assert (got == m).all()


def test_dmat_by_hand(spark, tmp_path):
    (tmp_path / "a.dmat").write_bytes(b"2 3\n1\n2\n3\n4\n5\n6\n")
    assert [r.x for r in matrices.read_dmat(spark, str(tmp_path / "a.dmat")).orderBy("id").collect()] == [[1, 4], [2, 5], [3, 6]]


def test_tables(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("1 2  3\n\n 4\t5 6, 9\n")
    assert [r.x for r in matrices.read_table(spark, str(p)).orderBy("id").collect()] == [[1, 2, 3], [4, 5, 6]]
    p.write_text("1 2\n3\n")
    with pytest.raises(ValueError, match="rows have"):
        matrices.read_table(spark, str(p))
    assert [r.x for r in matrices.read_table(spark, str(p), permissive=True).orderBy("id").collect()] == [[1, 2], [3, 0]]


def test_sparse_strings_and_arrays(spark, tmp_path):
    p = tmp_path / "s.txt"
    p.write_text("0:1.5 2:3 2:3\n\n1:-2\n")
    assert sorted(tuple(r) for r in matrices.read_sparse(spark, str(p)).collect()) == [(0, 0, 1.5), (0, 2, 3.0), (2, 1, -2.0)]
    p.write_text("a\nb\nc\n")
    assert [r.value for r in text.read_strings(spark, str(p), leave_out=1).orderBy("line").collect()] == ["a", "c"]
    p.write_text("1 2 3 4\nx\n5 6 7 8\n")
    assert [r.x for r in matrices.read_arrays(spark, str(p), 2).orderBy("line").collect()] == [[1, 2], [5, 6]]


def test_documents(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "one").write_text("first\ntext")
    (tmp_path / "d" / "two").write_text("")
    (tmp_path / "d" / "sub" / "three").write_text("no")
    got = {r.doc_id: r.text for r in text.read_directory(spark, str(tmp_path / "d")).collect()}
    assert got["one"] == "first\ntext" and "three" not in got
    x = tmp_path / "x.xml"
    x.write_text("<documents><document><docID>a</docID><docText>t &amp; u</docText></document><document><docID>b</docID></document></documents>")
    assert [tuple(r) for r in text.read_xml_documents(spark, str(x)).collect()] == [("a", "t & u")]


def test_graph_and_meshes(spark, tmp_path):
    g = tmp_path / "g.tgf"
    g.write_text("1 first node\n2 second\n#\n1 2 edge\n")
    nodes, edges = text.read_graph(spark, str(g))
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [(1, 2)]
    o = tmp_path / "m.obj"
    o.write_text("# c\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\n")
    v, f = text.read_obj(spark, str(o))
    assert v.count() == 3 and f.first().vertices == [0, 1, 2]
    o = tmp_path / "m.off"
    o.write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    v, f = text.read_off(spark, str(o))
    assert v.count() == 3 and f.first().vertices == [0, 1, 2]


def test_streamed_sketch(spark, tmp_path):
    m = np.random.default_rng(1).standard_normal((120, 5)) * [9, 4, 2, 1, 0.5]
    for i in range(3):
        points(spark, m[40 * i : 40 * i + 40]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sketch = RangeSketch(5, 3)
    stream = spark.readStream.schema("id long, x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(sketch.update).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sketch.rows == 120
    assert np.allclose(sketch.factors().s, np.linalg.svd(m, compute_uv=False)[:3], rtol=1e-6)
    sketch.update(points(spark, m), 0)  # a batch that is sent again
    assert sketch.rows == 120


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_folder_of_lines_in_order(spark, tmp_path, split):
    """A folder's files follow each other by name, whatever their sizes and splits."""
    n = 0
    for part, size in enumerate((50, 900, 200, 1500, 10)):
        (tmp_path / f"part-{part:05d}-x.txt").write_text("".join(f"{i} {-i}\n" for i in range(n, n + size)))
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = matrices.read_table(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.id, r.x) for r in rows) == [(i, [float(i), float(-i)]) for i in range(n)]
