"""Sharding: a two-pass external shuffle.

Pass 1 scatters whole records by seeded hashes: the shard by rendezvous hashing of the key (the shard with the highest seeded
hash wins, so one more shard takes rows only into itself), then a bucket inside the shard by a second seed, with as many
buckets as keep each near `bucket_bytes`. Pass 2 holds one bucket at a time, puts it in a fixed order, applies a seeded
Fisher-Yates shuffle (`shuffle`) and numbers the records without gaps. `write_shards` writes the shards in slot order.

Nulls and ties: a null key is a key like others; a null text has no bytes. Rows with one key share a shard by the law and a
bucket unless their texts differ. An empty table gives an empty result. Columns of the input are kept; `shard`, `slot` and
`grown_shard` of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

RECORD_OVERHEAD = 16


def record_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_OVERHEAD).cast("long")


def rendezvous(key: str, shards: int, seed: int) -> Column:
    """The shard in 0..shards-1 whose seeded hash of the key is the highest."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), F.col(key), s).alias("h"), s.alias("s")))
    return F.array_max(drawn)["s"].cast("int")


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", seed: int = 20240817, bucket_bytes: int = 8 << 20) -> DataFrame:
    """docs with shard, slot (gapless from 0 in its shard) and grown_shard (with one more shard)."""
    docs = docs.drop("shard", "slot", "grown_shard")
    total = docs.agg(F.sum(record_bytes(text)).alias("b")).first()["b"] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    tagged = docs.withColumns({
        "_shard": rendezvous(key, shards, seed),
        "_bucket": F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)), F.lit(buckets)),
    })
    ends = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = tagged.groupBy("_shard", "_bucket").count().select("_shard", "_bucket", F.coalesce(F.sum("count").over(ends), F.lit(0)).alias("_start"))
    record = F.struct(F.xxhash64(F.lit(seed + 2), F.col(key), F.col(text)).alias("_h"), *docs.columns)
    gathered = tagged.groupBy("_shard", "_bucket").agg(F.array_sort(F.collect_list(record), lambda a, b: F.when(a["_h"] < b["_h"], -1).when(a["_h"] > b["_h"], 1).otherwise(0)).alias("_rows"))
    # The order inside a partition fixes which random numbers a bucket draws, so a task that is run again draws the same.
    mixed = gathered.join(starts, ["_shard", "_bucket"]).sortWithinPartitions("_shard", "_bucket").withColumn("_rows", F.shuffle("_rows", seed))
    out = mixed.select("_shard", "_start", F.posexplode("_rows").alias("_at", "_row"))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns], F.col("_shard").alias("shard"), (F.col("_start") + F.col("_at")).cast("long").alias("slot")).withColumn("grown_shard", rendezvous(key, shards + 1, seed))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, records in slot order inside each file; a shard is cut into files by ranges of slots."""
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from the records as they lie in their shards."""
    return shard(docs).select(
        "doc_id",
        record_bytes().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
