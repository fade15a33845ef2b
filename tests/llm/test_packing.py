import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def check(rows, pieces, room=2048):
    """Each id in exactly one piece, sequences gapless; returns the share of padding."""
    library = Tokenizer.from_file(WORD)
    want = defaultdict(list)
    for doc, text in rows:
        want[doc].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    assert set(got) == set(want)
    for doc, own in got.items():
        if len(want[doc]) == 1:
            ids = want[doc][0]
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                part = np.array(ids[at : at + p.length], "<u4")
                assert p.ids_crc32 == zlib.crc32(part.tobytes()) and np.frombuffer(p.ids, "<u2").tolist() == part.tolist()
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in own) == sum(map(len, want[doc]))
    size, ends = defaultdict(int), defaultdict(list)
    for p in pieces:
        size[p.sequence_id] += p.length
        ends[p.sequence_id].append((p.offset, p.length))
    for s, parts in ends.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size[s] <= room
    assert sorted(size) == list(range(len(size)))
    padded = sum(0 if n & (n - 1) == 0 else room - n for n in size.values())
    return padded / (padded + sum(size.values())) if size else 0


def test_pack(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "Quick", "brown.", "fox", "é", "zyx"]) for _ in range(int(r.lognormvariate(5, 1.5))))) for i in range(700)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (3, rows[3][1]), (1002, "word " * 20_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int").repartition(5)
    out = packing.pack(df, WORD)
    pieces = out.collect()
    assert check(rows, pieces) < 0.02
    whole = {x.sequence_id: len(x.ids) // 2 for x in packing.sequences(out).collect()}
    assert sum(whole.values()) == sum(p.length for p in pieces)


def test_small_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert packing.pack(df([]), WORD).collect() == []
    check([(1, None)], packing.pack(df([(1, None)]), WORD).collect())
    check([(1, "a " * 2047)], packing.pack(df([(1, "a " * 2047)]), WORD).collect())


def test_column_generation_is_optimal_on_a_known_case():
    # three rolls of 10: 3 + 3 + 4 twice uses all of it
    sizes, counts = np.array([3, 4]), np.array([4, 2])
    patterns, use = packing.column_generation(sizes, counts, 10)
    assert abs(use.sum() - 2) < 1e-6
    chosen = packing.rounded(sizes, counts, 10, patterns, use)
    assert sum(n for _, n in chosen) == 2


def test_plan_bound():
    r = np.random.default_rng(1)
    lengths = np.minimum(2032, 16 * (1 + r.geometric(0.03, 200_000)))
    histogram = dict(zip(*(x.tolist() for x in np.unique(np.concatenate((lengths, r.integers(1, 16, 200_000))), return_counts=True)), strict=True))
    plan = packing.Plan.of(histogram, 2048)
    total = sum(s * n for s, n in histogram.items())
    assert plan.sequences * 2048 < total * 1.002
