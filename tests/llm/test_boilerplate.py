import random

from quillspark.llm import linededup

R = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("ana", "eno", "iru", "omi") for c in ("", "k", "st")]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def page(*block, n=4):
    ls = [prose(R.randrange(12, 30)) for _ in range(n)]
    at = R.randrange(n + 1)
    return "\n".join([*ls[:at], *block, *ls[at:]])


def dropped(spark, texts):
    """Per text the lines that are gone."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x for x in linededup.dedup_lines(df).collect()}
    assert len(out) == len(texts)
    found = []
    for i, t in enumerate(texts):
        left, gone = out[i].text.split("\n") if out[i].n_dropped < out[i].n_lines else [], []
        for line in t.split("\n"):
            if left and left[0] == line:
                left.pop(0)
            else:
                gone.append(line)
        assert not left and len(gone) == out[i].n_dropped
        found.append(gone)
    return found


def test_blocks_of_lines(spark):
    block = ["Licensed under the open terms", "which a copy comes with", "and no warranty is given"]
    found = dropped(spark, [page(*block) for _ in range(15)] + [page() for _ in range(5)])
    assert found == [block] * 15 + [[]] * 5


def test_copies_of_a_host(spark):
    line = "Share this page with friends"
    copied = page(line)
    found = dropped(spark, [page(line) for _ in range(15)] + [copied] * 60)
    assert found == [[line]] * 75


def test_near_copies_stay_whole(spark):
    base = [prose(14) for _ in range(10)]
    near = []
    for _ in range(40):
        ls = list(base)
        ls[R.randrange(10)] = prose(14)
        near.append("\n".join(ls))
    assert dropped(spark, near) == [[]] * 40


def test_fields_that_vary(spark):
    texts = [page(f"Posted by user {WORDS[i]} in the month of May", "under the terms of this site") for i in range(15)]
    assert [len(x) for x in dropped(spark, texts)] == [2] * 15


def test_long_passages_in_few_documents(spark):
    long, middle, short = prose(60), prose(28), prose(7)
    texts = [page(long, n=8) for _ in range(2)] + [page(middle, n=8) for _ in range(6)] + [page(short, n=8) for _ in range(6)]
    texts += [page(n=8) for _ in range(5)]
    assert dropped(spark, texts) == [[long]] * 2 + [[middle]] * 6 + [[]] * 11


def test_short_lines_and_scripts_without_blanks(spark):
    short, few, chinese = "All rights reserved.", "Read more", "本网站的所有内容均受版权保护未经许可不得转载" * 2
    texts = [page(short, n=8) for _ in range(25)] + [page(few, n=8) for _ in range(12)] + [page(chinese, n=8) for _ in range(8)]
    texts += [page(str(i), n=8) for i in range(30)]  # numbers that differ are no template
    assert dropped(spark, texts) == [[short]] * 25 + [[]] * 12 + [[chinese]] * 8 + [[]] * 30


def test_header_of_four_lines_and_a_short_line(spark):
    header = ["Home news and all", "Sign in or register today", "Menu", "The daily page of the town"]
    texts = ["\n".join([*header, *(prose(R.randrange(12, 20)) for _ in range(3)), "Read more now"]) for _ in range(100)]
    assert dropped(spark, texts) == [[*header, "Read more now"]] * 100


def test_two_templates_of_one_leaf(spark):
    one = [page(f"written by the staff of {WORDS[i]} on this very day here", n=8) for i in range(14)]
    two = [page(f"written by the office in {WORDS[i]} for all our good readers", n=8) for i in range(14)]
    assert [len(x) for x in dropped(spark, one + two)] == [1] * 28


def test_clashing_columns(spark):
    names = "doc_id long, text string, rid string, n_lines int, _marked int, _place int, _bits int, dropped int, lines int, _salt int, line string"
    df = spark.createDataFrame([(i, page("All of this is shared by many", n=8), "r", 1, 2, 3, 4, 5, 6, 7, "x") for i in range(15)], names)
    out = linededup.dedup_lines(df, counts=False)
    assert out.columns == df.columns
    assert {tuple(r)[2:] for r in out.collect()} == {("r", 1, 2, 3, 4, 5, 6, 7, "x")}
    assert {r.n_lines for r in linededup.dedup_lines(df).collect()} == {9}
