"""WARC archives with one shared Zstandard dictionary, revisits for repeated payloads, and their reader."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import Shared, attempt_name, read_back
from ._shared import bounded_sample, keep, marked, salted_join, scratch, small_batches

#: Fixed values of the formats: magic numbers of a skippable frame and of a Zstandard frame.
SKIPPABLE = 0x184D2A5D
ZSTD = 0xFD2FB528

SUFFIX = ".warc.zst"
_MANIFEST = "page_id long, file string, at long, length long, record_type string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, at long"


def train(pages: DataFrame, records: int, record_bytes: int, size: int) -> bytes:
    """A dictionary from a bounded sample of whole records: at most `records`, none above `record_bytes`.

    The sample only steers compression. With too little text to train on, its bytes are the dictionary.
    """
    short = pages.where((F.octet_length("html") > 0) & (F.octet_length("html") <= record_bytes))
    picked = bounded_sample(short, ["page_id", "url"], records)
    rows = sorted(picked.select("page_id", "url", "html").collect(), key=str)
    sample = [_http(len(r.html.encode())) + r.html.encode() for r in rows]
    try:
        return zstandard.train_dictionary(size, sample, level=3, d=8, k=256).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-size:]


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _urn(page_id: int | None, row: int) -> str:
    """A record's name: its page and its row, as rows may share a page."""
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def _record(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_row: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = _http(len(payload)) + payload if refers_to is None else b""
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, row)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {_urn(refers_to, refers_row)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def classify(pages: DataFrame, least: int) -> DataFrame:
    """Adds payload_digest, row (a number), and refers_to and refers_row: the smallest page_id, and of its rows the
    first, among equal payloads of `least` bytes or more."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("payload_digest", F.sha2("html", 256))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))
    first = pages.where(F.octet_length("html") >= least).groupBy("payload_digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1")
    # only pages whose digest may repeat are shuffled
    rows = marked(pages, "payload_digest", first, "payload_digest")
    some = salted_join(rows.where("_marked"), first.drop("n"), ["payload_digest"], "row", merge=True)
    joined = some.unionByName(rows.where("NOT _marked"), allowMissingColumns=True)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    refers = lambda c: F.when(again, F.col(f"first.{c}"))
    return joined.select("page_id", "row", "url", "html", "payload_digest", refers("page_id").alias("refers_to"), refers("row").alias("refers_row"))


def _writer(folder: str, dictionary: bytes, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True)
        out, sequence = None, 0
        try:
            for batch in batches:
                rows = {"page_id": [], "file": [], "at": [], "length": [], "record_type": []}
                for page_id, row, url, html, digest, refers, refers_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        out = Shared(folder, attempt_name(sequence, SUFFIX))
                        sequence += 1
                        out.write(SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
                    frame = packer.compress(_record(page_id, row, url, html.encode(), digest, refers, refers_row))
                    for name, value in zip(rows, (page_id, out.name, out.size, len(frame), "response" if refers is None else "revisit"), strict=True):
                        rows[name].append(value)
                    out.write(frame)
                    if out.size >= file_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pydict(
                    rows, schema=pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("record_type", pa.string())])
                )
            if out is not None:
                out.close()
                out = None
        finally:
            if out is not None:
                out.abort()

    return write


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its block headers."""
    flags = data[at + 4]
    single, checksum, size_code, dict_code = flags >> 5 & 1, flags >> 2 & 1, flags >> 6, flags & 3
    step = at + 5 + (1 - single) + (0, 1, 2, 4)[dict_code] + ((1 if single else 0), 2, 4, 8)[size_code]
    while True:
        head = int.from_bytes(data[step : step + 3], "little")
        step += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return step + 4 * checksum


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, payload) of each record of one archive."""
    data, at, unpacker = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if magic == SKIPPABLE and size:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        if magic != ZSTD:
            raise ValueError(f"no frame at byte {at}")
        end = frame_end(data, at)
        record = unpacker.decompress(data[at:end])
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        yield at, fields, block.partition(b"\r\n\r\n")[2]
        at = end


def _number(urn: str | None) -> int | None:
    page = "" if urn is None else urn[10:-1].split(":")[0]
    return int(page) if page else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _RECORDS.split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = []
            for at, fields, payload in parse(content.as_buffer()):
                kind, size, digest = fields["WARC-Type"], int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"][7:]
                if kind == "response":
                    size, found = len(payload), hashlib.sha256(payload).hexdigest()
                    if found != digest:
                        raise ValueError(f"{file}: the payload at {at} has another digest")
                url = fields.get("WARC-Target-URI")
                url = url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                rows.append((_number(fields["WARC-Record-ID"]), url, size, digest, kind, _number(fields.get("WARC-Refers-To")), file.as_py(), at))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)


def write_archives(
    pages: DataFrame, folder: str, *, least: int = 100, sample_records: int = 512, sample_bytes: int = 65536, dictionary_bytes: int = 65536, file_bytes: int = 16 << 20
) -> DataFrame:
    """Write one WARC record per row of `pages` (page_id, url, html) below `folder`; returns the manifest.

    Files of about `file_bytes` begin with a skippable frame that holds the dictionary; each record is a
    frame of its own. Of equal payloads of `least` bytes or more, the smallest page_id is a response and the
    others are revisits without a block. A null html is an empty payload, a null url leaves out the target,
    a null page_id can't be referred to; repeated rows of the smallest page_id are responses each; an
    empty table writes nothing. Other columns are ignored. The dictionary is fitted on at most
    `sample_records` whole records, none of more than `sample_bytes` bytes; very long pages are records like others.
    """
    small_batches(pages.sparkSession)
    dictionary = train(pages, sample_records, sample_bytes, dictionary_bytes)
    records = classify(pages, least).mapInArrow(_writer(folder, dictionary, file_bytes), _MANIFEST)
    return keep(records, f"{folder}-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives that the manifest's tasks committed; payload digests are checked."""
    return read_back(folder, manifest).mapInArrow(_reader, _RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` to fresh archives in the shared folder and return what they hold."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    if manifest.isEmpty():
        return pages.sparkSession.createDataFrame([], _RECORDS)
    return read_archives(manifest, folder)
