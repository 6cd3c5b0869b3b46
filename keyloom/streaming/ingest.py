"""Continuous ingestion: every micro-batch of new files becomes one more shard of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyloom.sources.ingest import build_entries, keys_from_json, keys_from_text, numbered, write_shards


def append_shard(keys: DataFrame, path: str, shard: int, tag_field: str | None = None, search: bool = False) -> None:
    """Write ``key, payload, line_no`` as shard ``shard``; written again after a failure, it replaces itself.

    The manifest row is the commit mark of the shard.  The layout is that of a written index, so it opens like one.
    """
    entries = build_entries(keys.withColumn("shard", F.lit(shard)))
    write_shards(entries, path, f"batch-{shard}", tag_field, search, whole=False)


def ingest_stream(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    json_key: str | None = None,
    prefix: str = "",
    tag_field: str | None = None,
    available_now: bool = True,
    search: bool = False,
) -> StreamingQuery:
    """Follow a folder of text or JSON-line files; batch N becomes shard N.

    Ingestion only appends, so there is no event time and no watermark.  Batches are numbered by the checkpoint, which
    makes a repeated batch overwrite its own shard.  Bad JSON lines are dropped; a stream has no last line to stop at.
    """
    lines = spark.readStream.text(source).select("value", "_metadata")

    def write(batch: DataFrame, number: int) -> None:
        kept = numbered(batch)
        keys = keys_from_text(kept, prefix) if json_key is None else keys_from_json(kept, json_key, prefix, "drop")
        append_shard(keys, path, number, tag_field, search)

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
