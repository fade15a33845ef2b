"""Token ids in files of independent, interleaved rANS blocks with one static frequency table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.select import numbered

from ._bytes import U64
from ._files import Shared, attempt_name, read_back
from ._shared import keep, scratch, shuffle_partitions, small_batches
from .tokens import Encoder, merged

#: Fixed values of the file format: magic, tokens of a block, lanes of a block, steps between checkpoints.
MAGIC, BLOCK, LANES, CHECKPOINT = b"QRANS1\0\0", 1 << 16, 64, 256
#: A lane's state stays in [2**31, 2**63) and moves 32 bits at a time.
LOW, WORD = 31, 32
SUFFIX = ".rans"
#: Blocks that are coded side by side.
ABREAST = 64
#: Bytes of ids that one task writes, about.
PART_BYTES = 64 << 20

_HEADER = struct.Struct("<8sIIII")  # magic, precision, symbols, bytes and crc32 of the packed table
_BLOCK = struct.Struct("<IIIIIQ")  # tokens, pieces, words, crc32 of ids, crc32 of the body, ids before it in the file
_PIECE = np.dtype([("doc", "<i8"), ("tokens", "<u4"), ("flags", "<u4")])
#: Flags of a piece: the document begins or ends with it, or has no id.
BEGINS, ENDS, NO_ID = 1, 2, 4


@dataclass
class Table:
    """Frequencies of all symbols that sum to 2**precision, with those that occur at 1 at least."""

    freq: np.ndarray
    precision: int

    @classmethod
    def fit(cls, symbols: np.ndarray, counts: np.ndarray, size: int) -> Table:
        precision = max(18, int(len(symbols)).bit_length() + 2)
        freq = np.zeros(size, np.int64)
        if len(symbols):
            spare = (1 << precision) - len(symbols)
            freq[symbols] = 1 + (counts.astype(np.float64) / counts.sum() * spare).astype(np.int64)
            freq[symbols[np.argmax(counts)]] += (1 << precision) - freq.sum()
        return cls(freq, precision)

    def __post_init__(self) -> None:
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(U64)
        # a last symbol fills lanes that have run out: it costs nothing and changes no state
        self._f = np.append(self.freq, 1 << self.precision).astype(U64)
        self._c = np.append(self.start, U64(0))

    def pack(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes(), 9)

    @property
    def lookup(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]]:
        """Of each block: its lanes' first states for decoding, its words, and (step, words before, states) checkpoints."""
        steps, n = max(-(-len(b) // LANES) for b in blocks), len(blocks)
        symbol = np.full((n, steps * LANES), len(self.freq), np.int64)
        for i, b in enumerate(blocks):
            symbol[i, : len(b)] = b
        symbol = np.ascontiguousarray(symbol.reshape(n, steps, LANES).transpose(1, 0, 2)).reshape(steps, n * LANES)
        x = np.full(n * LANES, 1 << LOW, U64)
        words, moved = np.zeros(symbol.shape, np.uint32), np.zeros(symbol.shape, bool)
        shift, precision, states = U64(LOW + WORD - self.precision), U64(self.precision), {}
        for s in range(steps - 1, -1, -1):
            f = self._f[symbol[s]]
            out = x >= (f << shift)
            words[s], moved[s] = x, out  # the low 32 bits
            x = np.where(out, x >> U64(WORD), x)
            q = x // f
            x += (q << precision) - q * f + self._c[symbol[s]]
            if s % CHECKPOINT == 0:
                states[s] = x
        moved, words, found = moved.reshape(steps, n, LANES), words.reshape(steps, n, LANES), []
        for i, b in enumerate(blocks):
            before = np.concatenate(([0], np.cumsum(moved[:, i].sum(axis=1))))
            marks = [(s, int(before[s]), states[s].reshape(n, LANES)[i]) for s in range(CHECKPOINT, -(-len(b) // LANES), CHECKPOINT)]
            found.append((states[0].reshape(n, LANES)[i], words[:, i][moved[:, i]], marks))
        return found

    def decode(self, blocks: list[tuple[int, np.ndarray, np.ndarray]], lookup: np.ndarray) -> list[np.ndarray]:
        """The ids of blocks, each given as its length, lane states and words."""
        n, steps = len(blocks), max(-(-size // LANES) for size, _, _ in blocks)
        x = np.concatenate([s for _, s, _ in blocks]).astype(U64)
        size = np.repeat([b[0] for b in blocks], LANES)
        lane = np.tile(np.arange(LANES), n)
        words = np.concatenate([w for _, _, w in blocks] + [np.zeros(1, np.uint32)]).astype(U64)
        at = np.concatenate(([0], np.cumsum([len(w) for _, _, w in blocks])))[:-1]
        out = np.zeros((steps, n * LANES), np.uint32)
        mask, precision, full = U64((1 << self.precision) - 1), U64(self.precision), min(b[0] for b in blocks) // LANES
        for s in range(steps):
            slot = x & mask
            symbol = lookup[slot]
            y = self._f[symbol] * (x >> precision) + slot - self._c[symbol]
            if s >= full:
                live = s * LANES + lane < size
                y = np.where(live, y, x)
                need = (y < U64(1 << LOW)) & live
            else:
                need = y < U64(1 << LOW)
            x, out[s] = y, symbol
            took = need.reshape(n, LANES)
            place = (np.cumsum(took, axis=1) - 1 + at[:, None])[took]
            x[need] = (x[need] << U64(WORD)) | words[place]
            at = at + took.sum(axis=1)
        out = out.reshape(steps, n, LANES)
        return [out[:, i].reshape(-1)[: b[0]] for i, b in enumerate(blocks)]


class _Out:
    """Files of one task: documents in order, cut into blocks, coded ABREAST at a time."""

    def __init__(self, folder: str, table: Table, file_tokens: int) -> None:
        self._folder, self._table, self._most = folder, table, file_tokens
        self._file, self._sequence, self._tokens = None, 0, 0
        self._ids, self._pieces, self._size = [], [], 0
        self._blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.done: list[tuple[str, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, BLOCK - self._size)
            self._ids.append(ids[at : at + take])
            flags = BEGINS * (at == 0) | ENDS * (at + take == len(ids)) | NO_ID * (doc is None)
            self._pieces.append((doc or 0, take, flags))
            at, self._size = at + take, self._size + take
            if self._size == BLOCK:
                self._close_block()
        if self._tokens + self._size + BLOCK * len(self._blocks) >= self._most:
            self.close()

    def _close_block(self) -> None:
        if self._size:
            self._blocks.append((np.concatenate(self._ids), np.array(self._pieces, _PIECE)))
            self._ids, self._pieces, self._size = [], [], 0
        if len(self._blocks) == ABREAST:
            self._flush()

    def _flush(self) -> None:
        if not self._blocks:
            return
        if self._file is None:
            self._file = Shared(self._folder, attempt_name(self._sequence, SUFFIX))
            self._sequence += 1
            packed = self._table.pack()
            self._file.write(_HEADER.pack(MAGIC, self._table.precision, len(self._table.freq), len(packed), zlib.crc32(packed)) + packed)
        for (ids, pieces), (state, words, marks) in zip(self._blocks, self._table.encode([b[0] for b in self._blocks]), strict=True):
            marked = b"".join(struct.pack("<II", s, w) + x.astype("<u8").tobytes() for s, w, x in marks)
            body = pieces.tobytes() + struct.pack("<I", len(marks)) + marked + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
            check = zlib.crc32(ids.astype("<u4").tobytes())
            self._file.write(_BLOCK.pack(len(ids), len(pieces), len(words), check, zlib.crc32(body), self._tokens) + body)
            self._tokens += len(ids)
        self._blocks = []

    def close(self) -> None:
        self._close_block()
        self._flush()
        if self._file is not None:
            self._file.close()
            self.done.append((self._file.name, self._sequence - 1, self._tokens))
            self._file, self._tokens = None, 0


def _writer(folder: str, table, file_tokens: int, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = _Out(folder, table.value, file_tokens)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.add(doc, np.frombuffer(ids.as_buffer(), kind))
        out.close()
        part = TaskContext.get().partitionId()
        rows = [(name, part, sequence, tokens) for name, sequence, tokens in out.done]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["file", "part", "sequence", "tokens"])

    return write


def read_table(content: memoryview) -> tuple[Table, int]:
    """The frequency table at a file's head, and where its blocks begin."""
    magic, precision, symbols, size, check = _HEADER.unpack_from(content, 0)
    packed = bytes(content[_HEADER.size : _HEADER.size + size])
    if magic != MAGIC or zlib.crc32(packed) != check:
        raise ValueError("not such a file, or its table is damaged")
    freq = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
    if len(freq) != symbols:
        raise ValueError("the table has another size")
    return Table(freq, precision), _HEADER.size + size


def read_blocks(content: memoryview, at: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Of each block: ids before it, its tokens and their crc32, pieces, states, words, checkpoints. Bodies are checked."""
    while at < len(content):
        tokens, pieces, words, check, body, before = _BLOCK.unpack_from(content, at)
        at = begin = at + _BLOCK.size
        piece = np.frombuffer(content, _PIECE, pieces, at)
        at += pieces * _PIECE.itemsize
        (marks,) = struct.unpack_from("<I", content, at)
        at, found = at + 4, []
        for _ in range(marks):
            s, w = struct.unpack_from("<II", content, at)
            found.append((s, w, np.frombuffer(content, "<u8", LANES, at + 8)))
            at += 8 + 8 * LANES
        state = np.frombuffer(content, "<u8", LANES, at)
        word = np.frombuffer(content, "<u4", words, at + 8 * LANES)
        at += 8 * LANES + 4 * words
        if zlib.crc32(content[begin:at]) != body:
            raise ValueError("a block is damaged")
        yield before, tokens, check, piece, state, word, found


def documents(content: memoryview) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, ids) of the documents of one file; ids are checked."""
    table, at = read_table(content)
    lookup, group, held, start = table.lookup, [], [], 0

    def decoded() -> Iterator[tuple[int | None, int, np.ndarray]]:
        nonlocal held, start
        for (before, _, check, pieces, _, _, _), ids in zip(group, table.decode([(b[1], b[4], b[5]) for b in group], lookup), strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != check:
                raise ValueError("a block's ids have another checksum")
            low = 0
            for doc, size, flags in pieces.tolist():
                if flags & BEGINS:
                    held, start = [], before + low
                held.append(ids[low : low + size])
                low += size
                if flags & ENDS:
                    yield None if flags & NO_ID else doc, start, np.concatenate(held)
                    held = []

    for block in read_blocks(content, at):
        group.append(block)
        if len(group) == ABREAST:
            yield from decoded()
            group = []
    if group:
        yield from decoded()


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ["doc_id", "local", "n_tokens", "ids_crc32", "file"]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for doc, start, ids in documents(memoryview(content.as_buffer())):
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), file))
                if len(rows) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _tokenise(path: str, spaces: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, spaces)
        last = np.array([end], encoder.kind).tobytes()
        width = encoder.kind.itemsize
        for batch in merged(batches, 1):
            ids, at = encoder.encode(batch.column(1))
            data = ids.tobytes()
            rows = pa.array([data[a * width : b * width] + last for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["doc_id", "ids"])

    return run


def _count(size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size) if len(ids.as_buffer()) > size else 0
            short = b"".join(x.as_buffer() for x in batch.column(0) if len(x.as_buffer()) <= size)
            total += np.bincount(np.frombuffer(short, kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    return run


def write_files(docs: DataFrame, folder: str, tokenizer: str, *, spaces: str = "kept", end: int = 2, file_tokens: int = 8 << 20) -> DataFrame:
    """Tokenise `docs` (doc_id, text) and write their ids in ascending doc_id order; returns the files.

    Each document's ids end with `end`. Files hold about `file_tokens` ids (a document is never cut
    between files) and begin with the frequency table, fitted on all ids. Their blocks are coded
    independently by interleaved lanes, and hold an index of their documents, checkpoints (all lanes'
    states at every 256th step, from which decoding may start) and checksums of body and ids.
    A null or empty text is the end id alone, documents without id come first, rows with the same doc_id
    follow each other, in the order of a hash of their ids; very long texts are one document's pieces over many
    blocks. An empty table writes nothing. Other columns are ignored.
    Returns file, base (ids before it in all files), tokens.
    """
    spark = docs.sparkSession
    small_batches(spark, 1024)
    where = scratch(spark, "ids")
    encoder = Encoder.of(tokenizer, spaces)
    size, kind = max(encoder.size, end + 1), encoder.kind.str
    ids = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenise(tokenizer, spaces, end), "doc_id long, ids binary")
    ids = keep(ids, f"{where}/ids")
    counts = ids.select("ids").mapInArrow(_count(size, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    table = Table.fit(np.array([r.id for r in counts], np.int64), np.array([r.n for r in counts], np.int64), size)
    total = ids.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), -(-total // PART_BYTES))
    # rows of one id, or without any, are spread by what they hold
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc()]
    ordered = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = keep(
        ordered.mapInArrow(_writer(folder, spark.sparkContext.broadcast(table), file_tokens, kind), "file string, part int, sequence int, tokens long"), f"{where}/files"
    )
    return keep(numbered(files, ["part", "sequence"], "base", weight="tokens").select("file", "base", "tokens"), f"{where}/bases")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of all documents in the files."""
    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read_back(folder, files).mapInArrow(_reader, "doc_id long, local long, n_tokens long, ids_crc32 long, file string")
    return found.join(files.hint("merge"), "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to fresh files in the shared folder and return what they hold."""
    folder = scratch(docs.sparkSession, "rans")
    return read_files(write_files(docs, folder, tokenizer), folder)
