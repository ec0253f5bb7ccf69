"""The answer store: a table of answers by key, new ones appended, the settled ones in buckets by the key's first bits.

A probe reads the new answers and of the buckets only those that its keys fall into: the bucket is a partition
column, so Spark leaves the others' files alone. Folding the new answers into buckets rewrites the buckets that
they fall into and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import KEY, latest
from .shared import discard, exists, names

ANSWER_SCHEMA = "request_hash string, response string, assessed_at string"
#: How many buckets there are; the bits of a key that tell them are its first ones.
BUCKETS = 1024


def bucket(key: Column) -> Column:
    """The bucket of a key, which is a text of hexadecimal digits: its first ten bits."""
    return F.shiftright(F.conv(F.substring(key, 1, 3), 16, 10).cast("int"), 2)


def buckets_path(store_path: str) -> str:
    """Where the buckets stand: a name that a read of the new answers leaves out."""
    return f"{store_path.rstrip('/')}/_buckets"


def append(answers: DataFrame, store_path: str) -> None:
    answers.select("request_hash", "response", "assessed_at").write.mode("append").parquet(store_path)


def hit(keys: DataFrame) -> list[int]:
    """The buckets that keys fall into; there are no more than BUCKETS, however many keys there are."""
    return sorted(r["b"] for r in keys.select(bucket(F.col(KEY)).alias("b")).distinct().where("b IS NOT NULL").collect())


def stored(spark: SparkSession, store_path: str, keys: DataFrame | None = None) -> DataFrame:
    """The last answer of each key that the store has; with `keys`, of these keys only, and nothing else is read."""
    found = spark.createDataFrame([], ANSWER_SCHEMA)
    if exists(spark, store_path):
        found = spark.read.schema(ANSWER_SCHEMA).parquet(store_path)
    if exists(spark, buckets_path(store_path)):
        settled = spark.read.schema(f"{ANSWER_SCHEMA}, bucket int").parquet(buckets_path(store_path))
        if keys is not None:
            settled = settled.where(F.col("bucket").isin(hit(keys)))
        found = found.unionByName(settled.drop("bucket"))
    if keys is not None:
        found = found.join(keys.select(KEY).distinct(), KEY, "left_semi")
    return latest(found, ["response"])


def fold(spark: SparkSession, store_path: str) -> int:
    """Put the new answers into their buckets; how many buckets were rewritten.

    Each of these is replaced as a whole when the job ends (Spark's dynamic overwrite of partitions), and only then
    the new answers' files are deleted; if that is cut short they are read beside the buckets, which changes no
    answer. One fold at a time, and no scan that writes at the same time.
    """
    if not exists(spark, store_path):
        return 0
    files = [f"{store_path.rstrip('/')}/{x}" for x in names(spark, store_path) if x.endswith(".parquet")]
    if not files:
        return 0
    fresh = spark.read.schema(ANSWER_SCHEMA).parquet(*files)
    touched = hit(fresh)
    every = fresh
    if exists(spark, buckets_path(store_path)):
        settled = spark.read.schema(f"{ANSWER_SCHEMA}, bucket int").parquet(buckets_path(store_path))
        every = fresh.unionByName(settled.where(F.col("bucket").isin(touched)).drop("bucket"))
    rows = latest(every, ["response"]).select("request_hash", "response", "assessed_at", bucket(F.col(KEY)).alias("bucket"))
    # a bucket goes to one task, which sorts it, so that files' statistics tell the keys they hold
    placed = rows.repartition(min(len(touched), BUCKETS), "bucket").sortWithinPartitions("bucket", KEY)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(buckets_path(store_path))
    discard(spark, *files)
    return len(touched)
