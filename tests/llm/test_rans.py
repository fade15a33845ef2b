import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspark.llm import rans, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    r = random.Random(1)
    out = ["", "a  b", " a", "a \n b", "a  b", "<|endoftext|> x", "x  y  ", "\t\t a", "don't 's  's", "ΑΣ ΣΑ", "é ́", "日本 語", "a\x1c b \x1c c", "a\x85b \x85 c"]
    out += ["".join(r.choice("abB ,.\n\t '1 ́éx\x1c\x00") for _ in range(30)) for _ in range(800)]
    return [*out, "".join(r.choice("ab c.é") for _ in range(50_000)), "x" * 3000 + " y"]


@pytest.mark.parametrize(("path", "spaces"), [(BYTE, "kept"), (WORD, "dropped")])
@pytest.mark.parametrize("block", [1 << 22, 64])
def test_encoder_agrees_with_the_library(monkeypatch, path, spaces, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    library = Tokenizer.from_file(path)
    texts = odd_texts()
    ids, at = tokens.Encoder(path, spaces).encode(pa.array([*texts, None]))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    assert at[-1] == at[-2]


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize(("path", "spaces"), [(BYTE, "kept"), (WORD, "dropped")])
def test_words_of_one_polynomial_hash_and_added_tokens(path, spaces):
    library, encoder = Tokenizer.from_file(path), tokens.Encoder(path, spaces)
    texts = [w for n in (1024, 2048, 4096) for w in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")))]
    texts += ["a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|><|endoftext|>y", "<|ENDOFTEXT|> <|endoftext|> <|EndOfText|>", "<|startoftext|>Q, r <|endoftext|", ">", "<|endoftext|>  \n", "a.<|endoftext|>,b"]
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "spaces"), [(BYTE, "kept"), (WORD, "dropped")])
@pytest.mark.parametrize("remembered", [1_000_000, 3])
def test_words_that_share_a_hash(monkeypatch, path, spaces, remembered):
    real = tokens.Encoder._hashes
    monkeypatch.setattr(tokens.Encoder, "_hashes", lambda *a: real(*a) % tokens.U64(5))
    monkeypatch.setattr(tokens, "mix", lambda x: x % tokens.U64(7))
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    library, encoder, texts = Tokenizer.from_file(path), tokens.Encoder(path, spaces), odd_texts()[:200]
    for low in range(0, 200, 20):
        ids, at = encoder.encode(pa.array(texts[low : low + 20]))
        for i, text in enumerate(texts[low : low + 20]):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("symbols", [1, 2, 300])
def test_blocks_round_trip(symbols):
    r = np.random.default_rng(0)
    blocks = [r.integers(0, symbols, n) ** 2 % symbols for n in (1, 63, 64, 65, 40_000, rans.BLOCK)]
    table = rans.Table.fit(*np.unique(np.concatenate(blocks), return_counts=True), symbols)
    coded = table.encode(blocks)
    lookup = table.lookup
    for b, out in zip(blocks, table.decode([(len(b), s, w) for b, (s, w, _) in zip(blocks, coded, strict=True)], lookup), strict=True):
        assert (out == b).all()
    for b, (_, words, marks) in zip(blocks, coded, strict=True):
        assert len(marks) == (-(-len(b) // rans.LANES) - 1) // rans.CHECKPOINT
        for step, before, state in marks:  # decoding may start at any checkpoint
            rest = b[step * rans.LANES :]
            assert (table.decode([(len(rest), state, words[before:])], lookup)[0] == rest).all()


def expected(rows, library):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    library = Tokenizer.from_file(BYTE)
    r = random.Random(9)
    rows = [(i * 3, t) for i, t in enumerate(odd_texts()[-300:])] + [(1, None), (2, ""), (None, "no id"), (5, "same"), (5, "same"), (-7, "word " * 70_000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    got = sorted((tuple(x) for x in rans.round_trip(df, BYTE).collect()), key=lambda x: x[1])
    assert got == expected(rows, library)


def test_small_files_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(200)], "doc_id long, text string")
    folder = f"file://{tmp_path}/r"
    files = rans.write_files(df, folder, BYTE, file_tokens=2000)
    assert files.count() > 10
    assert rans.read_files(files, folder).count() == 200
    data = bytearray((tmp_path / "r" / files.first().file).read_bytes())
    data[-5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(rans.documents(memoryview(bytes(data))))


def test_empty(spark):
    assert rans.round_trip(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0
