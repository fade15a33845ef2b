import random

import corpus_pipeline
from quillspark.llm import toxicity

from . import test_decontaminate as leaks
from . import test_linededup as lines
from . import test_neardup as near

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    r = random.Random(8)
    filler = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("ana", "eno", "iru", "omi") for c in ("", "k", "st")]
    line = lambda n: " ".join(r.choice(filler) for _ in range(n))
    text = lambda: "\n".join(line(r.randrange(6, 30)) for _ in range(r.randrange(1, 7)))
    docs, labels, items = [], [], [(i, line(30)) for i in range(5)]
    for i in range(400):
        t = text()
        if i % 9 == 0:
            t = f"{line(4)} grumph {line(5)} snarg blit {t}"
        labels.append((i, int(i % 9 == 0)))
        if i % 4 == 1:
            t += "\nAll rights reserved by the page 77"
        docs.append((i, t))
    for i in range(400, 460):  # near copies of clean documents
        t = docs[(i - 400) % 30 * 9 + 2][1].split(" ")
        t[r.randrange(len(t))] = "changed"
        docs.append((i, " ".join(t)))
    for i in range(460, 480):
        docs.append((i, f"{line(20)} {items[i % 5][1]} {line(20)}"))
    docs += [(480, None), (481, ""), (482, " \n "), (None, line(40)), (3, docs[3][1])]
    r.shuffle(docs)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def rows(df):
    return sorted(((x.doc_id, x.text) for x in df.collect()), key=str)


def test_each_stage_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, items = corpus(spark, folder)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, now, folder)
        out[name].write.parquet(f"{folder}/{name}")
        out[name], now = spark.read.parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    first = rows(out["toxicity"])
    scores = {(x.doc_id): x.predicted for x in toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert first == sorted(((d, t) for d, t in docs if not scores[d]), key=str)
    assert all(scores[i] == int(i % 9 == 0) for i in range(400))

    second = rows(out["line_dedup"])
    assert second == sorted(((x[0], x[3]) for x in lines.expected(first)), key=str)
    assert sum("All rights" in (t or "") for _, t in second) == 0
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in out["line_dedup"].collect())

    own = [(d, t) for d, t in second if d is not None]

    real, near.shingle_set = near.shingle_set, lambda t: near_sets(t, real)
    try:
        want = near.expected(sorted(set(own)), 80)
    finally:
        near.shingle_set = real
    stay = {d for d, _, _, kept in want if kept}
    third = rows(out["minhash_near_dedup"])
    assert third == sorted([*{(d, t) for d, t in own if d in stay}, *[(d, t) for d, t in second if d is None]], key=str)
    assert len(second) - len(third) >= 40

    fourth = rows(out["benchmark_decontamination"])
    bad = {(x[0]) for x in leaks.expected(third, items) if x[5]}
    assert fourth == [(d, t) for d, t in third if d not in bad] and len(third) - len(fourth) >= 20

    pieces = out["packing"].collect()
    assert sum(p.length for p in pieces) == sum({(p.doc_id): p.doc_tokens for p in pieces}.values())
    assert {p.doc_id for p in pieces} == {d for d, _ in fourth}


def near_sets(text, sets):
    return sets(text, 5)


def test_run(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    assert corpus_pipeline.run(spark, folder).count() > 100
