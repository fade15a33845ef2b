"""Term-document matrices as rows (doc_id, term, tf), their weights and filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import lsa_word, tokens
from quillspark.sources.files import delete, shared_folder, stored_at

from .blocks import dealt, over_cells
from .select import numbered

#: Ways in which the pairs of one vector's copies are spread over tasks.
SALTS = 32


def term_counts(docs: DataFrame, *, least_length: int = 3, stopwords: Sequence[str] = ()) -> DataFrame:
    """How often each term is in each document."""
    words = docs.select("doc_id", F.explode(tokens(F.col("text"), least_length)).alias("term"))
    if stopwords:
        words = words.where(~F.col("term").isin(list(stopwords)))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def drop_stopwords(terms: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Rows whose term isn't in the table `stopwords` (term)."""
    return terms.join(stopwords, "term", "left_anti")


def prune(tdm: DataFrame, least_count: int) -> DataFrame:
    """Without the terms that occur fewer than `least_count` times in all."""
    often = tdm.groupBy("term").agg(F.sum("tf").alias("n")).where(F.col("n") >= least_count).select("term")
    return tdm.join(often, "term").select(tdm.columns)


def doc_freq(tdm: DataFrame) -> DataFrame:
    return tdm.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(tdm: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(tf / terms of the document) * ln(D / (1 + df)): negative for a term that is in every document."""
    d = F.lit(n_docs) if n_docs is not None else None
    length = tdm.groupBy("doc_id").agg(F.sum("tf").alias("nkj"))
    if d is None:
        tdm_docs = length.agg(F.count("*").alias("D"))
        weighed = tdm.join(doc_freq(tdm), "term").join(length, "doc_id").join(F.broadcast(tdm_docs))
        d = F.col("D")
    else:
        weighed = tdm.join(doc_freq(tdm), "term").join(length, "doc_id")
    return weighed.select("doc_id", "term", (F.col("tf") / F.col("nkj") * F.log(d / (1 + F.col("df")))).alias("weight"))


def top_terms(weights: DataFrame, k: int, by: str = "weight") -> DataFrame:
    """The k heaviest terms of each document; ties go to the smaller term."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(by), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def density(tdm: DataFrame) -> DataFrame:
    """Stored entries over all cells."""
    counts = tdm.agg(F.count("*").alias("nnz"), F.count_distinct("term").alias("terms"), F.count_distinct("doc_id").alias("docs"))
    return counts.select("nnz", "terms", "docs", (F.col("nnz") / (F.col("terms") * F.col("docs"))).alias("density"))


def entropy(tdm: DataFrame, *, normal: bool = False) -> DataFrame:
    """Per term: -sum p ln p over its documents; `normal` divides by ln of their number (0 for one document)."""
    total = tdm.groupBy("term").agg(F.sum("tf").alias("t"))
    p = F.col("tf") / F.col("t")
    rows = tdm.join(total, "term").groupBy("term").agg(F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("h"), F.count("*").alias("n"))
    h = F.when(F.col("n") == 1, 0.0).otherwise(F.col("h") / F.log("n")) if normal else F.col("h")
    return rows.select("term", h.alias("entropy"))


def entropy_band(tdm: DataFrame, low: float, high: float, *, normal: bool = False) -> DataFrame:
    """Rows of the terms whose entropy is in [low, high]."""
    band = entropy(tdm, normal=normal).where(F.col("entropy").between(low, high)).select("term")
    return tdm.join(band, "term").select(tdm.columns)


def column_normalise(tdm: DataFrame) -> DataFrame:
    """Each document's entries sum to 1."""
    total = tdm.groupBy("doc_id").agg(F.sum("tf").alias("t"))
    return tdm.join(total, "doc_id").select("doc_id", "term", (F.col("tf") / F.col("t")).alias("weight"))


def integer_recovery(weights: DataFrame, value: str = "weight") -> DataFrame:
    """Counts from weights: each document's entries over its smallest, rounded.

    Ratios are rounded to nine places first: halves of whole numbers, which the weights' own rounding moves, go up then.
    """
    least = weights.where(F.col(value) != 0).groupBy("doc_id").agg(F.min(value).alias("least"))
    return weights.join(least, "doc_id").select("doc_id", "term", F.round(F.round(F.col(value) / F.col("least"), 9)).cast("long").alias("tf"))


def unit_rows(weights: DataFrame, value: str = "weight") -> DataFrame:
    """(doc_id, term, u): documents scaled to length 1; those without weight have no rows."""
    w = weights.where(F.col(value) != 0)
    length = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("n"))
    return w.join(length, "doc_id").select("doc_id", "term", (F.col(value) / F.col("n")).alias("u"))


#: Documents of a block, of a part of it, and products that are summed at once.
BLOCK, PART, AT_ONCE = 8192, 64, 1 << 21
#: The share of `least` that what isn't summed of two vectors' product may reach; less sums more terms, and leaves fewer candidates.
REST = 0.94


@dataclass
class _Vectors:
    """Unit vectors of a block, once each: their members, entries in the order of terms, and entries of prefixes by term, longest tails first."""

    ids: np.ndarray  # the smallest document of each vector
    start: np.ndarray  # of each vector's entries, and their end
    term: np.ndarray
    u: np.ndarray
    owner: np.ndarray  # of each prefix entry in the following
    base: np.ndarray  # twice the term
    tail: np.ndarray  # the vector's length from that term on
    key: np.ndarray  # base + 1 - tail, ascending
    value: np.ndarray
    parts: list[np.ndarray]  # the prefix entries of each PART vectors, in that order


def _numbers(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows' numbers of eight bytes, and where each row's begin and the last ends."""
    rows = column.combine_chunks()
    at = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    return np.frombuffer(rows.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind), (at - at[0]) // 8


def _vectors(least: float):
    low = REST * least

    def ready(table: pa.Table) -> _Vectors:
        ids = table.column("doc_id").to_numpy()
        name = table.column("name").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((ids, name))
        chosen = np.sort(order[np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))])
        table = table.take(pa.array(chosen))
        (term, start), (u, _) = _numbers(table.column("terms"), "<i8"), _numbers(table.column("u"), "<f8")
        owner = np.repeat(np.arange(len(chosen), dtype=np.int32), np.diff(start))
        sums = np.cumsum(u * u)
        tail = np.sqrt(np.maximum(sums[start[1:] - 1][owner] - sums + u * u, 0))
        # a term belongs to the prefix while the vector from it on is long enough; a little slack for rounding
        own = np.flatnonzero(tail >= low * (1 - 1e-9))
        # tails are 1 at most but for rounding, and terms are whole numbers
        own = own[np.argsort(2.0 * term[own] + (1 - tail[own]))]
        base, tail, owner = 2.0 * term[own], tail[own], owner[own]
        part = owner // PART
        by_part = np.argsort(part, kind="stable").astype(np.int32)
        cuts = np.searchsorted(part[by_part], np.arange(1, -(-len(chosen) // PART)))
        return _Vectors(ids[chosen], start, term, u, owner, base, tail, base + (1 - tail), u[own], np.split(by_part, cuts))

    return ready


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), then those from start[1] on, and so on."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _similar(least: float):
    """Pairs of two blocks' vectors whose product is `least` or more.

    From any term on, two vectors' product is at most that of their lengths from there on, which falls from term to
    term. So the products of their common terms are summed while that is REST x `least` or more: what follows is less
    than that, and only pairs whose sums reach the difference to `least` are computed in full.
    """
    low = REST * least

    def work(a: _Vectors, b: _Vectors, same: bool) -> Iterator[pa.RecordBatch]:
        width = len(b.ids)
        mine = np.zeros(int(max(a.term.max(), b.term.max())) + 1)
        # in the order of terms, which is quicker; the slack of the keys is more than what their sums lose
        first = np.searchsorted(b.key, a.base - 1e-7)
        many = np.maximum(np.searchsorted(b.key, a.base + (1 - low / a.tail) + 1e-7, "right") - first, 0)
        for k, own in enumerate(a.parts):
            own = own[many[own] > 0]
            begin, n = first[own], many[own]
            if not len(own):
                continue
            row, total = (a.owner[own].astype(np.int64) - k * PART) * width, np.concatenate(([0], np.cumsum(n)))
            sums, p = None, 0
            while p < len(own):
                q = max(p + 1, int(np.searchsorted(total, total[p] + AT_ONCE, "right")) - 1)
                at = _ranges(begin[p:q], n[p:q])
                more = np.bincount(np.repeat(row[p:q], n[p:q]) + b.owner[at], np.repeat(a.value[own[p:q]], n[p:q]) * b.value[at])
                if sums is None:
                    sums = more
                else:
                    sums = np.pad(sums, (0, max(0, len(more) - len(sums))))
                    sums[: len(more)] += more
                p = q
            found = np.flatnonzero(sums >= least - low - 1e-6)
            left, right = found // width + k * PART, found % width
            if same:
                left, right = left[left < right], right[left < right]
            if len(left):
                yield from compare(a, b, left, right, mine)

    def compare(a: _Vectors, b: _Vectors, left, right, mine) -> Iterator[pa.RecordBatch]:
        size = np.diff(b.start)
        cut = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
        out = []
        for x, y in zip(cut, [*cut[1:], len(left)], strict=True):
            own = slice(a.start[left[x]], a.start[left[x] + 1])
            mine[a.term[own]] = a.u[own]
            for z in range(x, y, PART):
                j = right[z : min(z + PART, y)]
                places = _ranges(b.start[j], size[j])
                c = np.add.reduceat(mine[b.term[places]] * b.u[places], np.cumsum(size[j]) - size[j])
                found = np.flatnonzero(c >= least)
                if len(found):
                    out.append((np.full(len(found), a.ids[left[x]]), b.ids[j[found]], c[found]))
            mine[a.term[own]] = 0
        if out:
            p, q, c = (np.concatenate(v) for v in zip(*out, strict=True))
            for z in range(0, len(p), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(v[z : z + (1 << 16)]) for v in (p, q, c)], names=["p", "q", "cosine"])

    return work


def _packed(rarity: list[tuple[int, float]] | None):
    """Documents' entries as bytes, scaled to length 1, with a digest that equal vectors share.

    `rarity` are the factors of values by number of the term: (the first number, factor), ascending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, factor = (np.array(v) for v in zip(*rarity, strict=True)) if rarity else (None, None)
        for batch in batches:
            out = []
            for doc, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                both = entries.values.flatten()
                term, w = both[0].to_numpy().astype("<i8"), both[1].to_numpy()
                if first is not None:
                    w = w * factor[np.searchsorted(first, term, "right") - 1]
                    term, w = term[w != 0], w[w != 0]
                if len(w):
                    u = (w / np.sqrt((w * w).sum())).astype("<f8").tobytes()
                    term = term.tobytes()
                    out.append((doc, hashlib.blake2b(term + u, digest_size=32).digest(), term, u))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            names = ["doc_id", "name", "terms", "u"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=names)

    return run


def cosine_pairs(weights: DataFrame, least: float, value: str = "weight", *, idf: bool = False) -> DataFrame:
    """(a, b, cosine) with a < b of all documents whose cosine similarity is `least` (above 0) or more.

    Terms are ordered from rare to common. A document's prefix ends where the rest of its unit vector is shorter
    than a share of `least`: two documents' rests bound what their products lack. So only prefixes meet, rare terms
    first, and pairs whose sums there are large enough are computed in full. Vectors are written in blocks by
    their digest, so that copies are compared once; tasks read two blocks at a time, and only pairs that are similar
    leave them.
    With `idf`, values are counts, which are multiplied by ln(D / (1 + df)): as `tfidf`, whose division by the
    document's length changes no cosine.
    """
    spark = weights.sparkSession
    where = shared_folder(spark, "cosine")
    held = stored_at(weights.where(F.col(value) != 0).select(F.col("doc_id").cast("long").alias("doc_id"), "term", F.col(value).cast("double").alias("w")), f"{where}/weights")
    terms = stored_at(numbered(held.groupBy("term").agg(F.count("*").alias("df")), ["df", "term"], "j").select("term", F.col("j").cast("long").alias("j"), "df"), f"{where}/terms")
    rarity = None
    if idf:
        documents = held.agg(F.count_distinct("doc_id")).first()[0]
        # numbers follow document frequencies: one row for each different one
        rarity = sorted((r.j, math.log(documents / (1 + r.df))) for r in terms.groupBy("df").agg(F.min("j").alias("j")).collect())
    rows = stored_at(held.join(terms.select("term", "j"), "term").select("doc_id", "j", "w"), f"{where}/entries")
    delete(spark, f"{where}/weights")
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("entries"))
    packed = stored_at(rows.mapInArrow(_packed(rarity), "doc_id long, name binary, terms binary, u binary"), f"{where}/packed")
    delete(spark, f"{where}/entries")
    n = max(1, -(-packed.count() // BLOCK))
    folder = dealt(packed, "name", n, f"{where}/blocks")
    members = stored_at(packed.select("doc_id", "name"), f"{where}/members")
    delete(spark, f"{where}/packed")
    found = over_cells(spark, folder, n, ["doc_id", "name", "terms", "u"], _vectors(least), _similar(least), "p long, q long, cosine double", together=8)
    found = stored_at(found, f"{where}/found")
    delete(spark, folder)
    # documents of equal vectors are similar to each other and to the same others
    first = members.groupBy("name").agg(F.min("doc_id").alias("p"), F.count("*").alias("n"))
    copies = stored_at(members.join(first.where("n > 1"), "name").select("p", "doc_id"), f"{where}/copies")
    spread = lambda df, out: df.select("p", F.col("doc_id").alias(out))
    each = lambda df, key, out: df.join(copies.select(F.col("p").alias(key), "doc_id"), key, "left").withColumn(out, F.coalesce("doc_id", key)).drop("doc_id")
    across = each(each(found, "p", "x"), "q", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    left = spread(copies, "a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    within = left.join(spread(copies, "b").select("*", salts), ["p", "salt"]).where("a < b").select("a", "b", F.lit(1.0).alias("cosine"))
    return across.unionByName(within.where(F.col("cosine") >= least))


def zero_norm_documents(weights: DataFrame, value: str = "weight") -> DataFrame:
    """Rows of the documents whose vectors aren't zero."""
    some = weights.groupBy("doc_id").agg(F.max(F.abs(value)).alias("m")).where("m > 0").select("doc_id")
    return weights.join(some, "doc_id", "left_semi")


def lsa_features(docs: DataFrame, *, first: int = 100, least: int = 10) -> DataFrame:
    """The distinct words among a document's first `first` normalised words; documents with fewer than `least` have none."""
    words = F.filter(F.transform(F.split("text", "[ \\t\\n\\r\\f\\x0B]+"), lsa_word), lambda w: w != "")
    found = docs.select("doc_id", F.array_distinct(F.slice(words, 1, first)).alias("words")).where(F.size("words") >= least)
    return found.select("doc_id", F.explode("words").alias("term"))


def backproject(coordinates: DataFrame, basis: DataFrame) -> DataFrame:
    """(id, component, v) times (component, term, u): each id's weight of each term."""
    return coordinates.join(basis, "component").groupBy("id", "term").agg(F.sum(F.col("v") * F.col("u")).alias("weight"))


def keep_labelled(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the documents that have a label, with it."""
    known = labels.where(F.col("label").isNotNull()).groupBy(key).agg(F.min("label").alias("label"))
    return rows.join(known, key)


def top_centroid_terms(weights: DataFrame, labels: DataFrame, k: int, value: str = "weight") -> DataFrame:
    """(label, rank, term, weight): the k heaviest terms of each class's mean document, terms a document lacks being 0."""
    known = keep_labelled(weights, labels)
    sizes = labels.where("label IS NOT NULL").groupBy("label").agg(F.count_distinct("doc_id").alias("n"))
    means = known.groupBy("label", "term").agg(F.sum(value).alias("s")).join(F.broadcast(sizes), "label").select("label", "term", (F.col("s") / F.col("n")).alias("weight"))
    order = Window.partitionBy("label").orderBy(F.desc(F.round("weight", 9)), "term")
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("label", "rank", "term", "weight")


def signed_terms(weights: DataFrame, k: int, by: str = "id", value: str = "weight") -> DataFrame:
    """(by, sign, rank, term, weight): the k terms of the greatest and of the least weight, marked + and -; zeros have neither."""
    rows = weights.where(F.col(value) != 0).withColumn("sign", F.when(F.col(value) > 0, "+").otherwise("-"))
    order = Window.partitionBy(by, "sign").orderBy(F.desc(F.round(F.abs(value), 9)), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "sign", "rank", "term", F.col(value).alias("weight"))


def numbered_features(features: DataFrame, order: DataFrame) -> DataFrame:
    """LSA features (doc_id, term) with term numbers in the order in which terms are first seen: by `order` (doc_id, term, place)."""
    seen = order.groupBy("term").agg(F.min(F.struct("doc_id", "place")).alias("at")).select("term", "at.doc_id", "at.place")
    names = numbered(seen, ["doc_id", "place"], "j").select("term", "j")
    return features.join(names, "term").select("doc_id", "term", "j")


def lsa_places(docs: DataFrame, *, first: int = 100, least: int = 10) -> DataFrame:
    """(doc_id, term, place): the distinct words of `lsa_features` with the place where each is first seen."""
    words = F.filter(F.transform(F.split("text", "[ \\t\\n\\r\\f\\x0B]+"), lsa_word), lambda w: w != "")
    found = docs.select("doc_id", F.array_distinct(F.slice(words, 1, first)).alias("words")).where(F.size("words") >= least)
    return found.select("doc_id", F.posexplode("words").alias("place", "term"))


def directory_matrix(docs: DataFrame, *, least_length: int = 2, least_count: int = 2) -> DataFrame:
    """The term-document matrix of a directory: terms of `least_length` letters or more that occur `least_count` times or more in all."""
    return prune(term_counts(docs, least_length=least_length), least_count)
