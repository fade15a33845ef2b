import random
import re
import zlib

import numpy as np
import pyarrow as pa

from quillspark.llm import toxicity as T


def test_grammar_composes_uses():
    m = T.grammar()
    assert m.run("I") == "I"
    assert m.run("YoI") == "YoK"  # a target before
    assert m.run("IoY") == "IoZ"  # and after
    assert m.run("NoI") == "Noi"  # negated
    assert m.run("NooooI") == "NooooI"  # out of the negation's scope
    assert m.run("RNI") == "RNJ"  # reported, whether negated or not
    assert m.run("YT") == "YV" and m.run("NT") == "Nt" and m.run("RT") == "RU"


LEXICON = T.Lexicon({"idiot": 2.0, "fool": 1.0}, {"lowe": 4.0, "vequé": 5.0})


def plain(text):
    """NUMBERS of one text, word by word."""
    out, distinct = np.zeros(T.NUMBERS), set()
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    for clause in re.split(rb"[\n!.:;?]", data):
        found = []
        for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause):
            word = w.decode(errors="replace")
            stem = max((s for s in LEXICON.stems if w.startswith(s.encode()) and len(w) > len(s.encode())), key=len, default=None)
            label, weight, entry = T.OTHER, 0.0, word
            for ws, x, y in ((T.THREATS, T.THREAT, 3.0), (T.TARGETS, T.TARGET, 0), (T.NEGATIONS, T.NEGATION, 0), (T.REPORTS, T.REPORT, 0)):
                if word in ws:
                    label, weight = x, y
            if word in LEXICON.words:
                label, weight = T.INSULT, LEXICON.words[word]
            elif stem:
                label, weight, entry = T.INSULT, LEXICON.stems[stem], stem
            found.append((label, weight, entry))
        if not any(x[0] in (T.INSULT, T.THREAT) for x in found):
            continue
        first = next(i for i, x in enumerate(found) if x[0] != T.OTHER)
        for (label, weight, entry), x in zip(found[first:], T.grammar().run("".join(x[0] for x in found[first:])), strict=True):
            if x in T.SORTS:
                out[T.SORTS[x]] += 1.0 if x == "Z" else weight
            if label in (T.INSULT, T.THREAT):
                distinct.add(entry)
        out[7] += 1
    out[6] = len(distinct)
    return out


def test_numbers_against_plain_python():
    r = random.Random(3)
    pool = ["Idiot", "fool", "lowesp", "lowe", "vequés", "kill", "you", "not", "said", "tree", "é", "a", "the", ".", "!", "\n", ",", "#"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(400)] + [None, "", "idiot", "x" * 100_000 + " idiot", "idiot. " * 3000]
    got = T.numbers(pa.array(texts), LEXICON, T.grammar())
    for text, x in zip(texts, got, strict=True):
        assert np.allclose(x, plain(text)), text


def tables(spark, n=1600, seed=5):
    r = random.Random(seed)
    filler = [f"{a}{b}" for a in "bdfgklm" for b in ("ana", "eno", "iru", "omi")]
    marks = ["grumph", "snarg", "blit"] + [f"zorn{x}" for x in ("a", "eb", "ick", "ost", "un")]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(filler) for _ in range(r.randrange(5, 80))]
        toxic = int(r.random() < 0.2)
        for _ in range(toxic * r.randrange(2, 5)):
            words.insert(r.randrange(len(words)), r.choice(marks))
        docs.append((i, " ".join(words), 1))
        labels.append((i, toxic))
    docs += [(n, None, 0), (n + 1, "", 0), (None, "no id", 0), (3, docs[3][1], 0), (n + 2, "snarg grumph " * 20_000, 0)]
    labels += [(3, labels[3][1]), (7, None), (None, 1), (10**6, 1)]
    a = spark.createDataFrame(docs, "doc_id long, text string, score int")
    return docs, labels, a, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels, a, b = tables(spark)
    got = T.score(a, b).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, t in labels if t is not None}
    right = [x.predicted == truth[x.doc_id] for x in got if x.held_out and x.doc_id in truth]
    assert len(right) > 300 and np.mean(right) > 0.97
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2)


def test_held_out_labels_are_not_used(spark):
    _, labels, a, b = tables(spark, 500)
    turned = [(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    c = spark.createDataFrame(turned, "doc_id long, toxic int")
    one, two = ({(x.doc_id, round(x.score, 9)) for x in T.score(a, y).collect()} for y in (b, c))
    assert one == two


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, "you idiot, you worthless scum"), (2, "a tree"), (3, None)]
    got = {x.doc_id: x for x in T.score(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()}
    assert got[1].predicted == 1 and got[2].predicted == got[3].predicted == 0
    assert T.score(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
