import hashlib
import random
import re

from quillspark.llm import decontaminate as D

PATTERN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return PATTERN.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[x]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed):
    r = random.Random(seed)
    vocabulary = ["ab", "Cd", "éf", "g1", "h"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([0, 3, 9, 10, 11, 30]))) for i in range(12)] + [(12, None), (None, text(14)), (13, "...")]
    docs = [(i, text(r.choice([0, 2, 9, 10, 60]))) for i in range(40)] + [(40, None), (41, " , "), (1, "a b")]
    for i, (_, t) in enumerate(items):
        docs.append((100 + i, f"{text(7)}, {t}! {text(5)}"))
        docs.append((200 + i, f"{text(20)} {' '.join((t or '').upper().split()[2:])}"))
    docs.append((300, " ".join(["ab"] * 20000)))
    return docs, items


def run(spark, docs, items, **more):
    a = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(x) for x in D.decontaminate(a, b, **more).collect()), key=str)


def test_against_brute_force(spark):
    docs, items = cases(1)
    assert run(spark, docs, items) == expected(docs, items)


def test_several_passes(spark):
    docs, items = cases(2)
    assert run(spark, docs, items, pass_windows=20) == expected(docs, items)


def test_empty_tables(spark):
    docs, items = cases(3)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == expected(docs, [])
