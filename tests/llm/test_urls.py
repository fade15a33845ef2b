import math
import random

from pyspark.sql import functions as F

from quillspark.llm import urls

RULES = [urls.Rule("block", "com/en/"), urls.Rule("allow", "example.com/en/7"), urls.Rule("allow", "net/de/"), urls.Rule("block", "example.net/de/8"), urls.Rule("block", "org/es/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def fits(url):
    host, path = split(url)
    found = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(found, key=lambda r: len(r.rule), default=None)


def cases():
    r = random.Random(2)
    out = [None, "", "http://", "://", "no scheme.com/en/1", "HTTP://WWW.Example.COM/en/7?x=http://b", "a://com/en/", "a://com/EN/", "a://xcom/en/1", "x://é.com/en/é\n?q"]
    out += ["https://a.example.net/de/8#x", "s://example.net?/de/8", "s://org#/es/", "s://u@h.org:80/es/1", "s://h.org/es", "z://" + "y" * 20_000 + ".com/en/" + "1" * 20_000]
    for _ in range(400):
        host = r.choice(["", "www.", "cheap-pills.", "m."]) + r.choice(["example", "spam-farm", "foo"]) + r.choice([".com", ".net", ".org", ".io"])
        out.append(f"http://{host}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.randrange(1000)}{r.choice(['', '/', '?a=1&b=2', '#t'])}")
    return list(enumerate(out)) + [(5, out[5])]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, rule string")
    return sorted((tuple(x) for x in urls.judge(df, RULES, **more).collect()), key=str)


def test_rules_and_verdicts(spark):
    rows = cases()
    got = run(spark, rows)
    assert len(got) == len(rows)
    by = dict(rows)
    for page, host, path, rule, verdict, _score in got:
        r = fits(by[page])
        assert (host, path) == split(by[page])
        assert rule == (r.rule if r else None)
        assert verdict == r.verdict if r else verdict in ("allow", "block")
    assert run(spark, rows) == got


def test_one_class_and_empty(spark):
    assert run(spark, []) == []
    assert [x[4] for x in run(spark, [(1, "a://b.io/1"), (2, None)])] == ["allow", "allow"]
    assert [x[4] for x in run(spark, [(1, "a://b.com/en/1"), (2, "c://d.io/")])] == ["block", "block"]


def test_features(spark):
    url = "http://www.a-b.com/x/12/y?p=1&q=22#frag"
    row = urls.lexical(spark.createDataFrame([(url, "www.a-b.com", "/x/12/y")], "url string, host string, path string")).first()
    whole = url.split("#")[0]
    bits = -sum(whole.count(c) / len(whole) * math.log2(whole.count(c) / len(whole)) for c in set(whole))
    assert (row.f_length, row.f_host, row.f_labels, row.f_depth, row.f_hyphens, row.f_params, row.suffix) == (len(whole), 11, 3, 3, 1, 2, "com")
    assert abs(row.f_digits - 5 / len(whole)) < 1e-12 and abs(row.f_entropy - bits) < 1e-9


def test_trees_learn_held_out_urls(spark):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        bad = i % 2
        rows.append((i, f"http://{'buy-' * bad}x{r.randrange(99)}.{'com' if r.random() < 0.5 else 'net'}/{'9' * r.randrange(3, 9) if bad else 'about/us'}", bad))
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    host, path = urls.host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    model = urls.train(df.where("page_id % 3 > 0"), rows=1000)
    scored = urls.lexical(df.where("page_id % 3 = 0")).withColumn("f_suffix", model.suffix_rate()).withColumn("score", model.score)
    assert scored.select(F.avg(((F.col("score") > 0) == (F.col("label") == 1)).cast("double"))).first()[0] > 0.98
