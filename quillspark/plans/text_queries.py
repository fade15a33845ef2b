"""Queries over the documents table: terms, weights, entropies, similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import STOPWORDS
from quillspark.operators import select, text

from .registry import query

_STOP = ", ".join(f"('{w}')" for w in STOPWORDS)
_WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents"
#: Common table expressions of the oracles: term counts of words of three letters or more.
_TDM = f"w AS ({_WORDS}), tdm AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 3 GROUP BY ALL)"
_PRUNED = f"{_TDM}, often AS (SELECT term FROM tdm GROUP BY term HAVING sum(tf) >= 5), p AS (SELECT tdm.* FROM tdm JOIN often USING (term))"
_ENTROPY = f"""{_TDM}, tot AS (SELECT term, sum(tf) AS t FROM tdm GROUP BY term),
h AS (SELECT term, sum(-(tf / t) * ln(tf / t)) AS h, count(*) AS n FROM tdm JOIN tot USING (term) GROUP BY term)"""
_WEIGHT = f"""{_TDM}, l AS (SELECT doc_id, sum(tf) AS nkj FROM tdm GROUP BY doc_id), f AS (SELECT term, count(*) AS df FROM tdm GROUP BY term),
d AS (SELECT count(*) AS D FROM l),
t AS (SELECT tdm.doc_id, tdm.term, (tf / nkj) * ln(D / (1 + df)) AS weight FROM tdm JOIN l USING (doc_id) JOIN f USING (term), d)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def tdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_counts(docs(spark, sf_dir))


@query("term_counts", f"WITH {_TDM} SELECT doc_id, term, tf FROM tdm")
def term_counts(spark, sf_dir):
    return tdm(spark, sf_dir)


@query("tdm_pruned", f"WITH {_PRUNED} SELECT doc_id, term, tf FROM p")
def tdm_pruned(spark, sf_dir):
    return text.prune(tdm(spark, sf_dir), 5)


@query("doc_freq", f"WITH {_TDM} SELECT term, count(*) AS df FROM tdm GROUP BY term")
def doc_freq(spark, sf_dir):
    return text.doc_freq(tdm(spark, sf_dir))


@query("stopword_antijoin", f"WITH {_TDM}, s(term) AS (VALUES {_STOP}) SELECT doc_id, term, tf FROM tdm WHERE term NOT IN (SELECT term FROM s)")
def stopword_antijoin(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "term string")
    return text.drop_stopwords(tdm(spark, sf_dir), F.broadcast(stop)).select("doc_id", "term", "tf")


@query("tfidf", f"WITH {_WEIGHT} SELECT doc_id, term, round(weight, 6) AS weight FROM t")
def tfidf(spark, sf_dir):
    return text.tfidf(tdm(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(
    "tfidf_top10",
    f"""WITH {_WEIGHT}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM t)
    SELECT doc_id, term, round(round(weight, 9), 6) AS weight, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""",
)
def tfidf_top10(spark, sf_dir):
    weights = text.tfidf(tdm(spark, sf_dir)).withColumn("weight", F.round("weight", 9))
    return text.top_terms(weights, 10).withColumn("weight", F.round("weight", 6)).select("doc_id", "term", "weight", "rank")


@query(
    "top50_terms_per_doc",
    f"""WITH {_TDM}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM tdm)
    SELECT doc_id, term, tf FROM r WHERE rank <= 50""",
)
def top50(spark, sf_dir):
    return text.top_terms(tdm(spark, sf_dir), 50, by="tf").select("doc_id", "term", "tf")


@query(
    "tdm_density",
    f"""WITH {_TDM} SELECT count(*) AS nnz, count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS docs,
    round(count(*) / (count(DISTINCT term) * count(DISTINCT doc_id)), 9) AS density FROM tdm""",
)
def tdm_density(spark, sf_dir):
    return text.density(tdm(spark, sf_dir)).withColumn("density", F.round("density", 9))


@query("cond_entropy", f"WITH {_ENTROPY} SELECT term, round(h, 6) + 0 AS entropy FROM h")
def cond_entropy(spark, sf_dir):
    return text.entropy(tdm(spark, sf_dir)).select("term", (F.round("entropy", 6) + 0).alias("entropy"))


@query("norm_entropy", f"WITH {_ENTROPY} SELECT term, round(CASE WHEN n = 1 THEN 0 ELSE h / ln(n) END, 6) AS entropy FROM h")
def norm_entropy(spark, sf_dir):
    return text.entropy(tdm(spark, sf_dir), normal=True).select("term", F.round("entropy", 6).alias("entropy"))


@query("entropy_band", f"WITH {_ENTROPY} SELECT doc_id, tdm.term, tf FROM tdm JOIN h USING (term) WHERE h BETWEEN 3.5 AND 5.0")
def entropy_band(spark, sf_dir):
    return text.entropy_band(tdm(spark, sf_dir), 3.5, 5.0)


@query(
    "entropy_segments",
    f"""WITH {_ENTROPY}, e AS (SELECT term, round(h, 9) AS h FROM h WHERE h > 0), c AS (SELECT quantile_cont(h, 0.33) AS lo, quantile_cont(h, 0.67) AS hi FROM e)
    SELECT term, round(h, 6) AS entropy FROM e, c WHERE h >= lo AND h < hi""",
)
def entropy_segments(spark, sf_dir):
    h = text.entropy(tdm(spark, sf_dir)).where("entropy > 0").withColumn("entropy", F.round("entropy", 9))
    return select.quantile_segment(h, "entropy", 0.33, 0.67).withColumn("entropy", F.round("entropy", 6))


@query("tdm_colnorm", f"WITH {_TDM}, s AS (SELECT doc_id, sum(tf) AS t FROM tdm GROUP BY doc_id) SELECT doc_id, term, round(tf / t, 6) AS weight FROM tdm JOIN s USING (doc_id)")
def tdm_colnorm(spark, sf_dir):
    return text.column_normalise(tdm(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("integer_recovery", f"WITH {_TDM}, s AS (SELECT doc_id, min(tf) AS m FROM tdm GROUP BY doc_id) SELECT doc_id, term, CAST(round(tf / m) AS BIGINT) AS tf FROM tdm JOIN s USING (doc_id)")
def integer_recovery(spark, sf_dir):
    return text.integer_recovery(text.column_normalise(tdm(spark, sf_dir)))


@query(
    "cosine_pairs",
    f"""WITH {_WEIGHT}, n AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM t GROUP BY doc_id HAVING sum(weight * weight) > 0), u AS (SELECT doc_id, term, weight / n AS u FROM t JOIN n USING (doc_id)),
    s AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.u * b.u) AS c FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT a, b, round(c, 6) AS cosine FROM s WHERE c >= 0.7""",
)
def cosine_pairs(spark, sf_dir):
    """All pairs of documents whose weights' cosine is 0.7 or more, by all terms."""
    return text.cosine_pairs(tdm(spark, sf_dir), 0.7, "tf", idf=True).withColumn("cosine", F.round("cosine", 6))


@query(
    "lsa_features",
    """WITH w AS (SELECT doc_id, string_split_regex(text, '[ \\t\\n\\r\\f\\v]+') AS ws FROM documents),
    k AS (SELECT doc_id, list_filter(list_transform(ws, lambda x: lower(regexp_extract(x, '^[^A-Za-z0-9]*([A-Za-z0-9]+)', 1))), lambda x: x <> '') AS ks FROM w),
    d AS (SELECT doc_id, list_distinct(ks[1:100]) AS ds FROM k)
    SELECT doc_id, unnest(ds) AS term FROM d WHERE len(ds) >= 10""",
)
def lsa_features(spark, sf_dir):
    return text.lsa_features(docs(spark, sf_dir))


@query("html_terms", """WITH w AS (SELECT page_id, unnest(regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[a-z]+')) AS term FROM pages)
    SELECT page_id, term, count(*) AS tf FROM w WHERE length(term) >= 3 GROUP BY ALL""")
def html_terms(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return text.term_counts(pages).withColumnRenamed("doc_id", "page_id")


@query("conversation_terms", """WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM conversations)
    SELECT conv_id, term, count(*) AS tf FROM w WHERE length(term) >= 3 GROUP BY ALL""")
def conversation_terms(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "text")
    return text.term_counts(turns).withColumnRenamed("doc_id", "conv_id")


@query("tdm_singular_values")
def tdm_singular_values(spark, sf_dir):
    """The five greatest singular values of the pruned term-document matrix (Lanczos on the sparse rows)."""
    from quillspark.operators.linalg import sparse_svd

    counts = text.prune(tdm(spark, sf_dir), 20).cache()
    names = counts.select("term", F.lit(0).alias("p")).distinct()
    terms = select.sort_with_index(names, "term", "p").select("term", F.col("rank").alias("j"))
    s = sparse_svd(counts.join(terms, "term").select(F.col("doc_id").alias("i"), "j", F.col("tf").alias("v")), 5)
    counts.unpersist()
    return spark.createDataFrame([(i + 1, round(float(v), 4)) for i, v in enumerate(s)], "rank int, singular_value double")
