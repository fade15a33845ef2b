"""One query per operator: whole tables, production parameters, the digest columns of the contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, linededup, neardup, packing, rans, suffixes, topk, toxicity, urls, warc
from ._shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


_HOSTS = "CASE WHEN size < 4 THEN 20 ELSE greatest(2, 10 - CAST(floor((size - 4) * 8 / 46) AS BIGINT)) END"


@_query(
    "op1_line_dedup",
    f"""
    WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
    c AS (SELECT row_number() OVER () AS rid, doc_id, text, list_transform(string_split(text, chr(10)), lambda x:
              trim(regexp_replace(x, '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ')) AS cs FROM d),
    a AS MATERIALIZED (SELECT rid, doc_id, text, list_transform(cs, lambda x:
              CASE WHEN len(string_split(x, ' ')) < 4 THEN x ELSE regexp_replace(x, '[^ ]*[0-9][^ ]*', '<*>', 'g') END) AS ms FROM c),
    i AS (SELECT ms, row_number() OVER () AS tid FROM (SELECT DISTINCT ms FROM a)),
    b AS (SELECT rid, tid, a.ms, list_sum(list_transform(a.ms, lambda x: length(x))) AS total, unnest(range(len(a.ms))) AS pos FROM a JOIN i ON a.ms = i.ms),
    l0 AS (SELECT rid, tid, total, pos, ms[pos + 1] AS m, len(string_split(ms[pos + 1], ' ')) AS n_tokens FROM b WHERE ms[pos + 1] <> ''),
    l AS MATERIALIZED (SELECT *, array_to_string(string_split(m, ' ')[1:3], ' ') AS head,
              CASE WHEN regexp_matches(m, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}\\p{{Lao}}\\p{{Khmer}}\\p{{Myanmar}}]') THEN greatest(n_tokens, length(m) // 2) ELSE n_tokens END AS size FROM l0),
    counts AS MATERIALIZED (SELECT m, n_tokens, head, any_value(size) AS size, count(DISTINCT tid) > 1 AS several, count(*) AS n FROM l GROUP BY m, n_tokens, head),
    copies AS (SELECT rid FROM l JOIN counts USING (m) WHERE several GROUP BY rid HAVING sum(length(m)) * 2 > any_value(total)),
    leaves AS (SELECT n_tokens, head FROM (SELECT n_tokens, head, sum(n) AS s, count(*) AS k, max(size) AS size FROM counts GROUP BY n_tokens, head) WHERE k > 1 AND s >= {_HOSTS}),
    shared AS (SELECT counts.* FROM counts JOIN leaves USING (n_tokens, head)),
    candidates AS (SELECT m FROM counts WHERE several AND n >= {_HOSTS} UNION SELECT m FROM shared),
    seen AS MATERIALIZED (SELECT DISTINCT m, n_tokens, head, size, CASE WHEN copies.rid IS NULL THEN tid ELSE 0 END AS host FROM l JOIN candidates USING (m) LEFT JOIN copies ON copies.rid = l.rid),
    exact AS (SELECT m FROM (SELECT m, size, count(*) AS hosts FROM seen GROUP BY m, size) WHERE hosts >= {_HOSTS}),
    lines AS MATERIALIZED (SELECT s.m, s.n_tokens, s.head, count(*) AS docs FROM seen s JOIN (SELECT m FROM shared) USING (m) WHERE s.n_tokens > 3 GROUP BY s.m, s.n_tokens, s.head),
    tokens AS MATERIALIZED (SELECT m, n_tokens, head, docs, unnest(range(3, n_tokens)) AS place, unnest(string_split(m, ' ')[4:]) AS token FROM lines),
    heavy AS (SELECT n_tokens, head, place, token, sum(docs) AS w FROM tokens GROUP BY ALL HAVING count(*) > 1),
    best AS (SELECT m, first(place ORDER BY w DESC, place, token DESC) AS gp, first(token ORDER BY w DESC, place, token DESC) AS gt FROM tokens JOIN heavy USING (n_tokens, head, place, token) GROUP BY m),
    grouped AS MATERIALIZED (SELECT tokens.*, gp, gt FROM tokens JOIN best USING (m)),
    totals AS (SELECT n_tokens, head, gp, gt, sum(docs) AS total FROM (SELECT DISTINCT m, n_tokens, head, gp, gt, docs FROM grouped) GROUP BY n_tokens, head, gp, gt HAVING count(*) > 1),
    constants AS (SELECT n_tokens, head, gp, gt, place, token FROM (SELECT n_tokens, head, gp, gt, place, token, sum(docs) AS w FROM grouped GROUP BY ALL) JOIN totals USING (n_tokens, head, gp, gt) WHERE w * 2 > total),
    alike AS MATERIALIZED (SELECT m, n_tokens, head, gp, gt FROM grouped JOIN constants USING (n_tokens, head, gp, gt, place, token) GROUP BY m, n_tokens, head, gp, gt HAVING (count(*) + 3) * 100 >= n_tokens * 80),
    members AS (SELECT a.n_tokens, a.head, gp, gt, host, min(size) AS size FROM alike a JOIN seen USING (m) GROUP BY a.n_tokens, a.head, gp, gt, host),
    groups AS (SELECT n_tokens, head, gp, gt FROM (SELECT n_tokens, head, gp, gt, min(size) AS size, count(*) AS hosts FROM members GROUP BY n_tokens, head, gp, gt) WHERE hosts >= {_HOSTS}),
    found AS (SELECT m FROM exact UNION SELECT m FROM alike JOIN groups USING (n_tokens, head, gp, gt)),
    x AS (SELECT rid, list(pos) AS dropped FROM l JOIN found USING (m) GROUP BY rid),
    y AS (SELECT a.doc_id, a.text, x.dropped FROM a LEFT JOIN x USING (rid)),
    z AS (SELECT documents.doc_id, documents.text, y.dropped, string_split(documents.text, chr(10)) AS ls
          FROM documents LEFT JOIN y ON y.doc_id IS NOT DISTINCT FROM documents.doc_id AND y.text = documents.text)
    SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
           CASE WHEN dropped IS NULL THEN text ELSE array_to_string(
               list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(dropped, i)), lambda i: ls[i + 1]), chr(10)) END AS text
    FROM z
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@_query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, end=1, room=2048)


@_query("op3_token_output")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return found.select("doc_id", "held_out", "score", "predicted")


@_query("op5_minhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, share=85)


@_query(
    "op6_exact_topk",
    """
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT q.own, q.vec_id AS query_id, v.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM q, v WHERE q.own <> v.own AND len(q.v) = len(v.v)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


@_query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Fixed values of the query: verdict and rule (host, then the start of the path).
URL_RULES = [
    urls.Rule("block", "com/en/"),
    urls.Rule("allow", "example.com/en/7"),
    urls.Rule("allow", "net/de/"),
    urls.Rule("block", "example.net/de/8"),
    urls.Rule("block", "org/es/"),
]


@_query("op8_url_filters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@_query("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query(
    "op10_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    m AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
           CASE WHEN m.first IS NULL OR m.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN m.first <> d.page_id THEN m.first END AS refers_to
    FROM d LEFT JOIN m USING (payload_digest)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
