"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_sample, keep, scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_host", "f_labels", "f_depth", "f_digits", "f_hyphens", "f_entropy", "f_params", "f_query", "f_suffix"]


@dataclass(frozen=True)
class Rule:
    """`rule` is a host, a slash and the start of a path; it fits the host and all subdomains."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host between the first :// and the next /, ? or #, with A-Z lower-cased, and the path up to ? or #.

    A null url or one without :// has an empty host and path.
    """
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(after, "^[^/?#]*+", 0)
    path = F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(after)), "^[^?#]*+", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matched(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """What `value` gives for the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.lit(value(r))).otherwise(found)
    return found


def _entropy(x: Column) -> Column:
    """Bits per character."""
    n = F.length(x).cast("double")
    total = F.aggregate(
        F.array_distinct(F.split(x, "")),
        F.lit(0.0),
        lambda a, c: a + F.when(c == "", 0.0).otherwise((n - F.length(F.replace(x, c, F.lit("")))) * F.log2(n - F.length(F.replace(x, c, F.lit(""))))),
    )
    return F.when(n <= 1, 0.0).otherwise(F.log2(n) - total / n)


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.length(whole) == 0, 0.0).otherwise(F.length(part) / F.length(whole))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features of `url`, `host` and `path` that need no training, and the host's suffix."""
    url = F.coalesce(F.substring_index("url", "#", 1), F.lit(""))
    query = F.regexp_extract(url, "[?]((?s).*)$", 1)
    return rows.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host": F.length("host").cast("double"),
            "f_labels": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", "[.]"))).cast("double"),
            "f_depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
            "f_digits": _share(F.regexp_replace(url, "[^0-9]", ""), url),
            "f_hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
            "f_entropy": _entropy(url),
            "f_params": F.when(F.length(query) == 0, 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "f_query": F.length(query).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


def _tree(node) -> Column:
    """A fitted tree as a nested CASE."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold())), _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


@dataclass(frozen=True)
class Model:
    """Block rates of suffixes, the rate of the rest, and the boosted score: above 0 means block."""

    suffixes: dict[str, float]
    base: float
    score: Column

    def suffix_rate(self) -> Column:
        known = [x for k, v in sorted(self.suffixes.items()) for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.create_map(*known)[F.col("suffix")], F.lit(self.base)) if known else F.lit(self.base)


def train(labelled: DataFrame, *, rows: int = 20_000, suffixes: int = 200, trees: int = 10, depth: int = 3, seed: int = 7) -> Model:
    """Fit the trees on labelled urls (page_id, url, host, path, label 0 or 1, with 1 to block).

    Fitted on a bounded sample of at most `rows` rows, by a hash of url and page_id; of its suffixes the `suffixes`
    most frequent get a rate of their own, smoothed by ten rows at the sample's rate. A sample of one
    class (or none) gives that class (or allow) for all.
    """
    where = scratch(labelled.sparkSession, "urls")
    sample = keep(lexical(bounded_sample(labelled, ["url", "page_id"], rows)), f"{where}/sample")
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    base = ones / n if n else 0.0
    if not n or ones in (0, n):
        return Model({}, base, F.lit(1.0 if n and ones else -1.0))
    rates = sample.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("y")).orderBy(F.desc("n"), "suffix").limit(suffixes).collect()
    known = {r.suffix: (r.y + 10 * base) / (r.n + 10) for r in rates}
    ready = sample.withColumn("f_suffix", Model(known, base, F.lit(0)).suffix_rate()).withColumn("label", F.col("label").cast("double"))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready.orderBy("page_id", "url").coalesce(1))
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64).fit(ready)
    score = reduce(lambda a, b: a + b, (F.lit(float(w)) * _tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t, w in zip(fitted.trees, fitted.treeWeights, strict=True)))
    return Model(known, base, score)


def judge(pages: DataFrame, rules: Sequence[Rule], **training) -> DataFrame:
    """Verdicts for all urls of `pages` (page_id, url): page_id, host, path, rule, verdict, score.

    The longest rule that fits decides. Other urls are judged by trees, trained on the urls that rules
    decide; they see lexical features only, and no rule. Null urls, and urls without ://, have an empty
    host and path, fit no rule and are judged by their features; repeated rows are judged alike; an empty
    table gives an empty result. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", matched(rules, F.col("host"), F.col("path"), lambda r: r.rule))
    ruled = matched(rules, F.col("host"), F.col("path"), lambda r: r.verdict)
    labelled = rows.withColumn("label", (ruled == "block").cast("int")).where("label IS NOT NULL").select("page_id", "url", "host", "path", "label")
    model = train(labelled, **training)
    scored = lexical(rows).withColumn("f_suffix", model.suffix_rate()).withColumn("score", model.score)
    verdict = F.coalesce(ruled, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "score")
