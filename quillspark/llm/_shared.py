"""Helpers that the corpus operators share: tables, scratch space, salted joins, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.files import shared_folder

#: Ways a hot join key is spread over; the lookup side is repeated this often.
SALTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder; see `shared_folder`."""
    return shared_folder(spark, what)


def named_apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """`docs` with its columns called _c0, _c1, ..., copies of the `needed` ones by their names, and all its names.

    Whatever the caller's columns are called, they don't meet those that an operator adds.
    """
    names = docs.columns
    apart = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    return apart.select("*", *(F.col(f"_c{names.index(n)}").alias(n) for n in needed)), names


def named_back(rows: DataFrame, names: Sequence[str], *more: Column | str) -> DataFrame:
    """The caller's columns by their names, and `more`."""
    return rows.select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names)), *more)


#: Spark then deletes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, where: str, by: str | None = None) -> None:
    """Write `df` to the shared folder, by the values of a column if asked; its shuffle files go as soon as it is there."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(where)
    finally:
        conf.set(_CLEANUP, before)


def keep(df: DataFrame, where: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, on all executors."""
    save(df, where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete tables that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, records: int = 256) -> None:
    """Arrow batches of few rows and bounded bytes, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def salt_of(*cols: Column | str, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def salted_join(
    big: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: str, how: str = "left", n: int = SALTS, merge: bool = False
) -> DataFrame:
    """Join `big` with `lookup` (one row per key) so that no key of `big` meets in one task.

    `spread` is a column of `big` that varies inside a hot key. The lookup's rows are repeated `n`
    times, so give it only those keys that matter. With `merge`, small lookups aren't broadcast either.
    """
    left = big.withColumn("_salt", salt_of(spread, n=n))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_salt", F.col("_salt").cast("int"))
    return left.join(right.hint("merge") if merge else right, [*keys, "_salt"], how).drop("_salt")


def bounded_sample(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """About nine tenths of `rows` rows, and never more, chosen by a hash of `keys`; all rows if there are so few.

    For fitting models only. No task sends the driver more than its share.
    """
    n = df.count()
    if n <= rows:
        return df
    share = int(0.9 * rows / n * (1 << 40))
    return df.where(F.shiftrightunsigned(F.xxhash64(*keys), 24) < share).limit(rows)


def marked(df: DataFrame, key: Column | str, lookup: DataFrame, lookup_key: Column | str, bits: int = 1 << 24) -> DataFrame:
    """`df` with _marked: false where its key is surely not in `lookup`.

    A bitmap of hashes of the lookup's keys, of `bits` bits whatever the lookup's size, is all that is
    broadcast. Rows that aren't marked need no shuffle to be joined; with very many keys most are marked.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    at = lookup.select(place(lookup_key).alias("h"))
    maps = at.groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    rows = df.withColumn("_place", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    rows = rows.join(F.broadcast(maps), "_bucket", "left")
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0, F.lit(False))
    return rows.withColumn("_marked", found).drop("_place", "_bucket", "_bits")


def components(edges: DataFrame, where: str, limit: int = 60) -> DataFrame:
    """Connected components of undirected `edges` (src, dst: long): rows (id, component_id).

    component_id is the smallest id that can be reached. Alternates large-star and small-star steps
    (Kiveris et al., 2014), each written to the shared folder; the edges never leave the executors.
    Ids without an edge don't appear. Self-loops and repeated edges are ignored.
    """
    spark = edges.sparkSession
    now = keep(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), f"{where}/e0"
    )
    for step in range(1, limit):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            salted_join(both.where("v > u"), low, ["u"], "v", "inner", merge=True).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, ["u"], "v", "inner", merge=True)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = keep(small.distinct(), f"{where}/e{step}")
        a, b = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after))
        now = after
        if tuple(a) == tuple(b):
            break
    else:
        raise RuntimeError(f"components have not settled after {limit} steps")
    found = now.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return spark.createDataFrame([], "id long, component_id long").unionByName(found).unionByName(roots.join(found, "id", "left_anti"))
