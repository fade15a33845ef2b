import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import suffixes as S


def expected(rows, span):
    first = {}
    for doc, text in rows:
        data, key = (text or "").encode(), S.LAST if doc is None else doc
        for i in range(len(data) - span + 1):
            w = data[i : i + span]
            first[w] = min(key, first.get(w, key))
    out = []
    for doc, text in rows:
        data, key = (text or "").encode(), S.LAST if doc is None else doc
        cover = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - span + 1):
            if first[data[i : i + span]] < key:
                cover[i : i + span] = True
        kept = bytes(b for b, c in zip(data, cover, strict=False) if not c)
        runs = sum(1 for i in range(len(data)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((doc, len(data), int(cover[:-1].sum()) if len(data) else 0, runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_order(letters):
    r = np.random.default_rng(letters)
    for n in [*range(12), 100, 101, 102, 1000]:
        x = r.integers(1, letters + 1, n)
        order = S.suffix_order(x, 1 << 30)
        assert order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
        for depth in (4, 20):
            heads = [tuple(x[i : i + depth].tolist()) for i in S.suffix_order(x, depth)]
            assert len(heads) == n and heads == sorted(heads)


def test_classes():
    r = random.Random(1)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(0, 40))).encode() for _ in range(60)] + [b"", b"a" * 300]
    string, place, number = S.classes(strings, 9)
    names = {}
    for s, p, c in zip(string.tolist(), place.tolist(), number.tolist(), strict=True):
        assert names.setdefault(strings[s][p : p + 9], c) == c
    assert len(set(names.values())) == len(names) and len(string) == sum(max(0, len(s) - 8) for s in strings)


def cases(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (40, 49, 50, 51, 70, 200, 900)]
    docs = [(0, None), (1, ""), (2, "a" * 600), (3, "a" * 300 + "b"), (4, "ab" * 200), (5, "éa" * 99)]
    for i in range(10, 90):
        docs.append((i, "".join(r.choice([text(r.randrange(60)), r.choice(shared)]) for _ in range(r.randrange(1, 7)))))
    base = text(3000)
    for i in range(90, 120):
        at = r.randrange(3000)
        docs.append((i, base[:at] + text(3) + base[at + 3 :]))
    docs += [(i, base) for i in range(120, 130)] + [(125, base), (126, base[100:400]), (None, base + text(80)), (None, base), (7, shared[5] * 2)]
    docs.append((130, text(200_000)))
    docs.append((131, text(100) + docs[-1][1][5_000:90_000]))
    r.shuffle(docs)
    return docs


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row int").repartition(3)
    out = S.remove_repeats(df).collect()
    for x in out:
        assert hashlib.sha256(x.kept).hexdigest() == x.kept_sha256
    return sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out), key=str)


@pytest.mark.parametrize(("seed", "many", "block"), [(1, 2048, 1 << 20), (2, 2, 200)])
def test_against_brute_force(spark, monkeypatch, seed, many, block):
    monkeypatch.setattr(S, "MANY", many)
    monkeypatch.setattr(S, "BLOCK", block)
    rows = cases(seed)
    assert run(spark, rows) == expected(rows, S.SPAN)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == expected([(1, None)], 50)
    for n in (25, 26, 33, 40, 49, 50, 57):
        rows = [(1, "x" * n), (2, "ab" * (n // 2))]
        assert run(spark, rows) == expected(rows, 50)


def test_files_out_of_order(spark):
    """A task that reads several files of texts begins with the largest."""
    rows = cases(7)
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == expected(rows, S.SPAN)


def test_rounds(spark, monkeypatch):
    """Each round settles a share of the strings, and its intermediates are gone before the next."""
    import os
    from urllib.parse import urlparse

    rows = cases(7)
    seen, before = [], S._unique

    def unique(strings, where):
        folder = urlparse(where).path.rsplit("/", 1)[0]
        left = [d for r in os.listdir(folder) if r.startswith("round") for d in os.listdir(f"{folder}/{r}") if d in ("unique", "ranked")]
        seen.append((strings.count(), left))
        return before(strings, where)

    monkeypatch.setattr(S, "_unique", unique)
    monkeypatch.setattr(S, "ROUND", sum(len((t or "").encode()) for _, t in rows) // 3)
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == expected(rows, S.SPAN)
    assert len(seen) == 4 and all(0 < n < sum(m for m, _ in seen) and not left for n, left in seen)


def test_few_rows_of_a_key_meet_at_once(spark, monkeypatch):
    """Only keys with very many rows are made unique, split and merged."""
    rows = cases(7)
    monkeypatch.setattr(S, "_ranked", None)
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == expected(rows, S.SPAN)
