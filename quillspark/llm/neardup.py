"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U64, WHITE, mix, shingles, words
from ._shared import components, keep, marked, named_apart, named_back, salted_join, scratch, small_batches

#: With 32 bands of 5 values, a pair at similarity 0.85 shares no band with probability 7e-9; with 4 values, one
#: at 0.8 with 5e-8.
BANDS = 32
#: Members of a bucket that are compared in one run with its pivot.
CHUNK = 256
#: Shingles of a cell that are compared at once.
COLUMNS = 8192

_SIGNED = "n_shingles long, d1 long, d2 long, bands array<long>"


def superminhash(sets: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl, 2017) of sets of 64-bit hashes, all sets at once: (sets, m) uint64.

    Element x goes to slot p_j(x) of its own random permutation with rank j plus a random fraction, for
    j = 0, 1, ...; a slot keeps its least value. All slots of a set are final once none holds a value
    of j or more, so that large sets stop after the first ranks. A value is the rank in the high 16 bits
    and the fraction below.
    """
    count = len(at) - 1
    signature = np.full((count, m), np.iinfo(np.uint64).max, dtype=U64)
    owner = np.repeat(np.arange(count), np.diff(at))
    active, order, seed = np.arange(len(sets)), None, sets
    for j in range(m):
        if not len(active):
            break
        draw = mix(seed + U64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = j + ((draw >> U64(32)) % U64(m - j)).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            if order is None:  # the permutations so far: only the first swap has been made
                order = np.tile(np.arange(m, dtype=np.int16), (len(active), 1))
                lines = np.arange(len(active))
                order[lines, first] = 0
                order[:, 0] = first
            lines = np.arange(len(active))
            slot = order[lines, pick].astype(np.int64)
            order[lines, pick] = order[:, j]
            order[:, j] = slot
        value = (U64(j) << U64(48)) | (mix(draw ^ U64(0xD6E8FEB86659FD93)) >> U64(16))
        np.minimum.at(signature.reshape(-1), owner[active] * m + slot, value)
        open_ = signature.max(axis=1) >= (U64(j + 1) << U64(48))
        stay = open_[owner[active]]
        if j == 0:
            first = pick[stay]
        elif order is not None:
            order = order[stay]
        active, seed = active[stay], seed[stay]
    return signature


def _digest(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set, whatever its order."""
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.concatenate(([U64(0)], np.cumsum(mix(sets ^ U64(salt)))))
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, ascending, and the offsets of the rows."""
    word, at = words(column, WHITE)
    found = [np.unique(shingles(word[a:b], k)) for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.concatenate(found or [np.zeros(0, U64)]), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text."""
    size = np.cumsum(np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(1)], np.int64) + 64)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(size // most)) + 1, [batch.num_rows]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _sign(k: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 1 << 19):
                sets, at = _sets(batch.column(1), k)
                d1, d2 = _digest(sets, at)
                signature = superminhash(sets, at, BANDS * values).reshape(-1, BANDS, values)
                band = np.zeros(signature.shape[:2], U64)
                for r in range(values):
                    band = mix(band * U64(0x9E3779B97F4A7C15) + signature[:, :, r])
                offsets = np.arange(0, (batch.num_rows + 1) * BANDS, BANDS, dtype=np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(c for i, c in enumerate(batch.columns) if i != 1), pa.array(np.diff(at)), pa.array(d1), pa.array(d2), bands],
                    names=[*(n for i, n in enumerate(batch.schema.names) if i != 1), "n_shingles", "d1", "d2", "bands"],
                )

    return run


def _spell(k: int):
    """Row ids with the whole sorted set of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 1 << 19):
                sets, at = _sets(batch.column(1), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "shingles"]
                )

    return run


def _verify(share: int):
    """Streams groups (pivot, chunk), the pivot's sets first (several if its id is repeated), and keeps pairs that overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sets, open_ = None, [], False
        for batch in batches:
            src, dst = [], []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = np.frombuffer(data.as_buffer(), U64)
                if b is None:
                    pivot, sets, open_ = a, [*sets, found] if open_ and a == pivot else [found], True
                    continue
                open_ = False
                if a != pivot:
                    raise ValueError("a pivot's set is missing")
                for own in sets:
                    if not len(own) or 100 * min(len(own), len(found)) < share * max(len(own), len(found)):
                        continue
                    place = np.searchsorted(own, found)
                    place[place == len(own)] = 0
                    both = int((own[place] == found).sum())
                    if 100 * both >= share * (len(own) + len(found) - both):
                        src.append(a)
                        dst.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _spelled(pairs: DataFrame, texts: DataFrame, k: int, where: str) -> DataFrame:
    """The whole sets of all documents in `pairs`; the join is never a broadcast, as the ids grow with the input."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return keep(texts.join(ids.hint("merge"), "id", "left_semi").mapInArrow(_spell(k), "id long, shingles binary"), f"{where}/sets")


def _links(pairs: DataFrame, sets: DataFrame, share: int, where: str) -> DataFrame:
    """Those pairs (a, b, with a as the pivot) whose whole sets overlap by `share` percent; written."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    # the pivot's set goes once to each chunk of about CHUNK members
    heads = sizes.join(sets.hint("merge"), sizes["a"] == sets["id"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "shingles"
    )
    many = sizes.where("chunks > 1").select("a", "chunks")
    dealt = salted_join(pairs, many, ["a"], "b", merge=True).select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    # a member is in few pairs (at most one per band), so that its id is no hot key
    members = dealt.join(sets.hint("merge"), dealt["b"] == sets["id"]).select("a", "chunk", "b", "shingles")
    rows = heads.select("a", F.col("chunk").cast("int").alias("chunk"), "b", "shingles").unionByName(members)
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return keep(rows.mapInArrow(_verify(share), "src long, dst long"), f"{where}/links")


def _across(share: int):
    """Streams cells (a, i, j) of queries and members, and keeps pairs of different components that overlap enough."""

    def links(rows: list) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(r[3], U64) for r in rows]
        n = np.array([len(x) for x in sets])
        columns, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[which]
        line = np.repeat(np.arange(len(rows)), n)
        asks = np.flatnonzero([r[0] for r in rows])
        told = np.flatnonzero([not r[0] for r in rows])
        # shingles that two documents hold, some at a time: the memory doesn't grow with the texts
        order = np.argsort(place, kind="stable")
        place, line = place[order], line[order]
        common = np.zeros((len(asks), len(told)))
        for at in range(0, int(place.max(initial=-1)) + 1, COLUMNS):
            x, y = np.searchsorted(place, at, "left"), np.searchsorted(place, at + COLUMNS, "left")
            both = np.zeros((len(rows), COLUMNS), np.float32)
            both[line[x:y], place[x:y] - at] = 1
            common += both[asks] @ both[told].T
        common = np.rint(common).astype(np.int64)
        ids, own = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        alike = 100 * common >= share * (n[asks][:, None] + n[told][None, :] - common)
        x, y = np.nonzero(alike & (own[asks][:, None] != own[told][None, :]))
        return ids[asks[x]], ids[told[y]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                x, y = links(rows)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["src", "dst"])

        for batch in batches:
            for a, i, j, asks, b, own, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, i, j) != key:
                    yield from done()
                    key, rows = (a, i, j), []
                rows.append((asks, b, own, data))
        yield from done()

    return run


def _links_across(pairs: DataFrame, own: DataFrame, sets: DataFrame, share: int, where: str) -> DataFrame:
    """Links between the components of each pivot's members.

    All but the members of a pivot's largest component are compared with all its members, in cells of
    about CHUNK by CHUNK documents. Only links leave a cell.
    """
    placed = pairs.join(own.withColumnRenamed("id", "b").hint("merge"), "b", "left").select("a", "b", F.coalesce("component_id", "b").alias("own"))
    placed = keep(placed, f"{where}/placed")
    sizes = placed.groupBy("a", "own").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("a").agg(F.sum("n").alias("g"), F.count("*").alias("parts"), F.max(F.struct("n", "own")).alias("top")).where("parts > 1")
    blocks = lambda n: F.ceil(n / CHUNK).cast("int")
    groups = groups.select("a", F.col("top.own").alias("major"), blocks(F.col("g")).alias("js"), blocks(F.col("g") - F.col("top.n")).alias("is"))
    rows = salted_join(placed, keep(groups, f"{where}/groups"), ["a"], "b", "inner", merge=True)
    rows = rows.join(sets.withColumnRenamed("id", "b").hint("merge"), "b")
    block = lambda n, seed: F.pmod(F.xxhash64("b", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    told = rows.withColumn("j", block("js", 1)).withColumn("i", every("is")).withColumn("asks", F.lit(False))
    asks = rows.where("own <> major").withColumn("i", block("is", 2)).withColumn("j", every("js")).withColumn("asks", F.lit(True))
    columns = ["a", "i", "j", "asks", "b", "own", "shingles"]
    cells = told.select(columns).unionByName(asks.select(columns)).repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    return keep(cells.mapInArrow(_across(share), "src long, dst long"), f"{where}/links")


def near_duplicates(docs: DataFrame, *, k: int = 5, share: int = 80, values: int | None = None) -> DataFrame:
    """Groups of documents (doc_id, text) whose sets of k-word shingles overlap by `share` percent or more.

    Words are runs of anything but ASCII white space, with A-Z in lower case. Equal sets form a class; one
    text of each class (the smallest doc_id) is compared. In every bucket of a band, members are compared
    with the bucket's smallest id, its pivot; a pivot's members that are then still in several components
    are compared across them, so that links between members are found too. Each link is confirmed on
    whole sets of 64-bit hashes of shingles (two given shingles share one with probability 2**-64).
    Very long texts are compared whole, in blocks of shingles. Documents without words have n_shingles 0 and stand alone. Rows that share a doc_id share a component
    if one of them is linked; a null doc_id takes part under no id and comes back alone. Other columns are
    ignored; an empty table gives an empty result.
    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).
    """
    spark = docs.sparkSession
    small_batches(spark)
    where = scratch(spark, "neardup")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    signed = keep(texts.mapInArrow(_sign(k, values or (5 if share >= 85 else 4)), f"id long, {_SIGNED}"), f"{where}/signed")
    full = signed.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = keep(
        salted_join(signed.select("id", "n_shingles", "d1", "d2"), classes, ["d1", "d2", "n_shingles"], "id", merge=True)
        .select("id", "n_shingles", "d1", "d2", F.when(F.col("id").isNotNull(), F.coalesce("first", "id")).alias("first")),
        f"{where}/classes",
    )
    # one row of each class goes on, also where an id is repeated; an id with texts of several classes ties these
    key = ["id", "d1", "d2", "n_shingles"]
    heads = full.join(named.where("id <> first").select(key).hint("merge"), key, "left_anti").dropDuplicates(key)
    low = named.where("id is not null").groupBy("id").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high")
    low = keep(low.select("id", "low"), f"{where}/ties")
    ties = marked(named, "id", low, "id").where("_marked").join(low.hint("merge"), "id").where("first <> low")
    ties = ties.select(F.col("low").alias("src"), F.col("first").alias("dst")).distinct()
    band = heads.select("id", F.posexplode("bands").alias("band", "value"))
    bucket = band.groupBy("band", "value").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("band", "value", "pivot")
    members = keep(salted_join(band, bucket, ["band", "value"], "id", "inner", merge=True), f"{where}/buckets")
    pairs = keep(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), f"{where}/pairs")
    sets = _spelled(pairs, texts, k, where)
    own = keep(components(_links(pairs, sets, share, f"{where}/first").unionByName(ties), f"{where}/first"), f"{where}/first/components")
    second = _links_across(pairs, own, sets, share, f"{where}/second")
    # components that a second link joins: a graph of components
    name = own.withColumnRenamed("component_id", "c")
    joined = second.join(name.withColumnRenamed("id", "src").hint("merge"), "src", "left").select("dst", F.coalesce("c", "src").alias("src"))
    joined = joined.join(name.withColumnRenamed("id", "dst").hint("merge"), "dst", "left").select("src", F.coalesce("c", "dst").alias("dst"))
    above = keep(components(joined, f"{where}/second"), f"{where}/second/components")
    single = above.join(own.hint("merge"), "id", "left_anti")
    linked = salted_join(own, above.select(F.col("id").alias("component_id"), F.col("component_id").alias("top")), ["component_id"], "id", merge=True)
    linked = linked.select("id", F.coalesce("top", "component_id").alias("component_id")).unionByName(single)
    linked = keep(linked, f"{where}/components")
    out = salted_join(named.drop("d1", "d2"), linked.withColumnRenamed("id", "first"), ["first"], "id", merge=True)
    out = out.select(F.col("id").alias("doc_id"), F.col("n_shingles"), F.coalesce("component_id", "first").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))



def drop_near_duplicates(docs: DataFrame, *, k: int = 5, share: int = 80) -> DataFrame:
    """`docs` with all its columns, with one row of each group of near-duplicates: the smallest doc_id's.

    Of rows with the same doc_id and text one stays. Documents without id or without words stay; very long texts
    are compared whole; an empty table gives an empty result.
    """
    where = scratch(docs.sparkSession, "dropped")
    found = near_duplicates(docs.select("doc_id", "text"), k=k, share=share)
    gone = found.where("NOT kept").select("doc_id", F.lit(True).alias("gone"))
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(False).alias("gone"))
    gone = keep(gone.unionByName(again).groupBy("doc_id").agg(F.max("gone").alias("gone")), f"{where}/gone")
    # only rows that may go, or be there twice, are shuffled; the caller's columns go by numbers meanwhile
    apart, names = named_apart(docs, "doc_id", "text")
    rows = marked(apart, "doc_id", gone, "doc_id")
    touched = rows.where("_marked").join(gone.hint("merge"), "doc_id", "left").where("gone IS NULL OR NOT gone")
    once = touched.where("gone IS NOT NULL").dropDuplicates(["doc_id", "text"])
    rest = touched.where("gone IS NULL").unionByName(once)
    return named_back(rows.where("NOT _marked").drop("_marked"), names).unionByName(named_back(rest, names))
