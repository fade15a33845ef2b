import hashlib

from quillspark.llm import warc


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        h = html or ""
        if len(h.encode()) >= 100 and page_id is not None:
            first[h] = min(page_id, first.get(h, page_id))
    out = []
    for page_id, url, html in rows:
        h = html or ""
        again = h in first and page_id != first[h]
        out.append((page_id, url, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long = "<p>é</p>" * 40
    rows = [(1, "u1", long), (2, "u%\r\n2", long), (3, None, None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "y" * 3_000_000)]
    rows += [(2, "u%\r\n2", long), (None, "n", long), (9, "a", "z" * 100), (8, "b", "z" * 100)] + [(100 + i, f"h/{i}", f"<b>{i}</b>" * 30) for i in range(300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = warc.round_trip(df).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_dictionary_leads_each_file(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"<html><p>common words of page {i}</p></html>" * 20) for i in range(400)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(df, folder, file_bytes=4096)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.endswith(warc.SUFFIX) and not p.name.startswith(".")]
    assert len(files) > 4
    for p in files:
        assert int.from_bytes(p.read_bytes()[:4], "little") == warc.SKIPPABLE
    (tmp_path / "w" / "part-000000-999-00000.warc.zst").write_bytes(files[0].read_bytes())  # a failed attempt's
    assert warc.read_archives(manifest, folder).count() == 400
