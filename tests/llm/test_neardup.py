import random
import re

import numpy as np

from quillspark.llm import neardup


def shingle_set(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(rows, share=85):
    sets = [shingle_set(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                p, q = sorted((root(rows[x][0]), root(rows[y][0])))
                parent[q] = p
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def chain(seed, n, words, step):
    """Each text changes a few words of the one before, so that only neighbours are alike."""
    r = random.Random(seed)
    text = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(text))
        for _ in range(step):
            text[r.randrange(words)] = f"w{r.randrange(10**6)}"
    return out


def cases():
    r = random.Random(5)
    texts = [None, "", " \n", "One", "one", "one two", "One TWO", "one two three", "x" * 100_000]
    texts += chain(1, 30, 80, 2) + chain(2, 20, 40, 1) + chain(3, 25, 12, 1)
    base = chain(4, 1, 120, 0)[0].split()
    for _ in range(60):  # many near copies of one text, alike or not with each other
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            t[r.randrange(120)] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(base)] * 20 + [" ".join(base[:20]) * 2000]
    r.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows):
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, kept int")
    return sorted(tuple(x) for x in neardup.near_duplicates(df, k=3, share=85).collect())


def test_against_brute_force(spark):
    rows = cases()
    assert run(spark, rows) == expected(rows)


def test_repeated_rows_and_ids(spark):
    got = run(spark, [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "z")])
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True)]
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert sorted((tuple(x) for x in neardup.near_duplicates(df, k=3, share=85).collect()), key=str) == [(4, 2, 4, True), (None, 2, None, True)]


def test_empty(spark):
    assert run(spark, []) == []


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    for size in (5, 60, 3000):
        pool = r.integers(1, 2**63, size * 4 // 3).astype(np.uint64)
        a, b = pool[:size], pool[size // 3 :]
        both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        runs = []
        for salt in range(40):
            s = neardup.mix(np.concatenate((a, b)) + np.uint64(salt))
            sig = neardup.superminhash(s, np.array([0, len(a), len(a) + len(b)]), 160)
            assert (sig < (160 << 48)).all()
            runs.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(runs) - both) < 0.03
        assert np.std(runs) < 0.06


def test_repeated_ids_with_different_texts(spark):
    r = random.Random(9)
    a, b = chain(21, 1, 40, 0)[0], chain(22, 1, 60, 0)[0]
    near = " ".join([*b.split()[:-1], "other"])
    rows = [(3, a), (7, a), (7, b), (8, b), (9, near), (20, "alone among them all")]
    assert run(spark, rows) == expected(rows)
    texts = [t for seed in range(30, 60) for t in chain(seed, 2, 70, 2)]
    rows = [(r.randrange(100), r.choice(texts)) for _ in range(90)]
    assert run(spark, rows) == expected(rows)
