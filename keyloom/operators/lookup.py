"""Point lookups and the shard catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get_value(entries: DataFrame, key: str) -> DataFrame:
    """``key, shard, payload`` of the first shard whose entry has a payload; no row if there is none."""
    held = entries.where((F.col("key") == key) & F.col("payload").isNotNull())
    return held.select("key", "shard", "payload").orderBy("shard").limit(1)


def key_by_id(entries: DataFrame, shard: int, id: int) -> DataFrame:
    """``shard, id, key, payload`` of one entry; no row for an unknown shard or id."""
    return entries.where((F.col("shard") == shard) & (F.col("id") == id)).select("shard", "id", "key", "payload")


def entries_by_ids(entries: DataFrame, shard: int, ids: list[int]) -> DataFrame:
    """``position, id, key, payload`` in the order of ``ids``; unknown ids are passed over, repeated ones repeated."""
    wanted = entries.sparkSession.createDataFrame(list(enumerate(ids)), "position int, id long")
    # A list given by the caller on the driver is small by its nature; AQE still chooses the join by its size.
    return wanted.join(entries.where(F.col("shard") == shard), "id").select("position", "id", "key", "payload")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two texts: of the least and the greatest key, it is that of all keys."""
    lengths = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.substring(a, F.lit(1), F.size(F.filter(lengths, lambda n: F.left(a, n) == F.left(b, n))) - 1)


def shard_stats(entries: DataFrame) -> DataFrame:
    """``shard, n_keys, min_key, max_key, common_prefix``: the catalogue, one row per shard."""
    stats = entries.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("min_key"), F.max("key").alias("max_key")
    )
    return stats.withColumn("common_prefix", common_prefix(F.col("min_key"), F.col("max_key")))


def candidate_shards(manifest: DataFrame, prefix: str) -> DataFrame:
    """Shards that may hold keys under ``prefix``: their common prefix continues it or the other way round."""
    own: Column = F.col("common_prefix")
    return manifest.where(own.startswith(prefix) | F.lit(prefix).startswith(own)).select("shard")


def shards_with_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Shards that do hold keys under ``prefix``."""
    return entries.where(F.col("key").startswith(prefix)).select("shard").distinct()
