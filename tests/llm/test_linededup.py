import random
import re
from collections import defaultdict

from quillspark.llm import linededup


def clean(line):
    return re.sub(r"[ \t\r\f\x0B]+", " ", line).strip(" ")


def mask(line):
    c = clean(line)
    ts = c.split(" ") if c else []
    return c if len(ts) < 4 else " ".join("<*>" if re.search("[0-9]", t) else t for t in ts)


def size_of(m):
    n = len(m.split(" "))
    return max(n, len(m) // 2) if re.search("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]", m) else n


def least(size):
    return 20 if size < 4 else max(2, 10 - (size - 4) * 8 // 46)


def expected(rows, depth=3, similar=80):
    docs = {key: [mask(x) for x in key[1].split("\n")] for key in {(d, t) for d, t in rows if t is not None}}
    texts, n = defaultdict(set), defaultdict(int)
    for ms in docs.values():
        for m in ms:
            if m:
                texts[m].add(tuple(ms))
                n[m] += 1
    copy = {k for k, ms in docs.items() if sum(len(m) for m in ms if m and len(texts[m]) > 1) * 2 > sum(map(len, ms))}
    hosts = defaultdict(set)
    for k, ms in docs.items():
        for m in ms:
            if m:
                hosts[m].add(0 if k in copy else tuple(ms))
    leaves = defaultdict(list)
    for m in n:
        t = m.split(" ")
        leaves[len(t), tuple(t[:depth])].append(m)
    found = {m for m in n if len(texts[m]) > 1 and n[m] >= least(size_of(m)) and len(hosts[m]) >= least(size_of(m))}
    for (length, _), ms in leaves.items():
        if len(ms) < 2 or sum(n[m] for m in ms) < least(max(map(size_of, ms))):
            continue
        found |= {m for m in ms if len(hosts[m]) >= least(size_of(m))}
        if length <= depth:
            continue
        w, k = defaultdict(int), defaultdict(int)
        for m in ms:
            for at, t in enumerate(m.split(" ")[depth:], depth):
                w[at, t] += len(hosts[m])
                k[at, t] += 1
        groups = defaultdict(list)
        for m in ms:
            own = [(w[at, t], -at, t.encode()) for at, t in enumerate(m.split(" ")[depth:], depth) if k[at, t] > 1]
            if own:
                groups[max(own)[1:]].append(m)
        for own in groups.values():
            total, constant = sum(len(hosts[m]) for m in own), {}
            for at in range(depth, length):
                v = defaultdict(int)
                for m in own:
                    v[m.split(" ")[at]] += len(hosts[m])
                best = max(v, key=lambda t: v[t])  # a majority is unique
                if v[best] * 2 > total:
                    constant[at] = best
            alike = [m for m in own if (depth + sum(m.split(" ")[at] == t for at, t in constant.items())) * 100 >= length * similar]
            if len(own) > 1 and alike and len(set().union(*(hosts[m] for m in alike))) >= least(min(map(size_of, alike))):
                found |= set(alike)
    out = []
    for d, t in rows:
        ls = [] if t is None else t.split("\n")
        left = [x for x in ls if mask(x) not in found]
        out.append((d, len(ls), len(ls) - len(left), None if t is None else "\n".join(left)))
    return sorted(out, key=str)


def cases():
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice("abcdefghij") + str.lower(r.choice("KLMNOP")) * r.randrange(1, 4) for _ in range(n))
    boiler = ["Licensed under the X License, version 2.0.", "Share this page with  friends", "Read more"]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "x" * 50_000 + "\n" + "a1" * 30_000)]
    for i in range(10, 80):
        ls = [prose(r.randrange(1, 22)) for _ in range(r.randrange(3, 9))]
        ls.insert(r.randrange(len(ls) + 1), r.choice(boiler))
        ls.insert(r.randrange(len(ls) + 1), f"Posted by user {prose(1)} on day {r.randrange(30)} of May")
        ls.insert(r.randrange(len(ls) + 1), f"Posted by user {prose(1)} in the {r.randrange(30)} th year")
        ls.insert(r.randrange(len(ls) + 1), f"visits to this page {r.randrange(10**6)}")
        rows.append((i, "\n".join(ls)))
    copy = "\n".join(prose(9) for _ in range(8))
    rows += [(100 + i, copy) for i in range(40)] + [(100, copy), rows[20], (200, "\n".join(["one and the same line"] * 30)), (None, "one line without an id"), (None, copy)]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "s", 3) for d, t in rows], "doc_id long, text string, rid string, n_lines int")
    out = linededup.dedup_lines(df)
    assert set(out.columns) == {"doc_id", "text", "rid", "n_lines", "n_dropped"}
    return sorted((tuple(x) for x in out.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


def test_against_brute_force(spark):
    rows = cases()
    want = expected(rows)
    assert run(spark, rows) == want
    assert sum(x[2] for x in want) > 100 and all(x[2] == 0 for x in want if x[0] in range(100, 140))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, None)]
