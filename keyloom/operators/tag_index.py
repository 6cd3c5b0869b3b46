"""Tags: extraction from payloads, histogram, bulk counts and posting lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import bind
from keyloom.operators.predicates import has_prefix


def build_tags(entries: DataFrame, field: str = "tags") -> DataFrame:
    """``shard, id, key, tag_lc, tag, pos`` of the string elements of the payload's array ``field``.

    Missing fields, other types and elements that aren't strings are passed over.  Spellings of one tag in one entry
    collapse to the first; ``pos`` is the place of that element among all of the array, from 0.
    """
    value = F.try_variant_get(F.try_parse_json("payload"), f"$['{field}']", "array<variant>")
    marked = F.transform(
        value,
        lambda x, i: F.struct(
            i.cast("int").alias("pos"),
            F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).alias("tag"),
        ),
    )
    spelled = F.transform(
        F.filter(marked, lambda x: x["tag"].isNotNull()),
        lambda x: F.struct(F.lower(x["tag"]).alias("lc"), x["pos"].alias("pos"), x["tag"].alias("tag")),
    )
    # Sorted by tag and place, the first of each run stays; linear however long the array is.
    first = bind(
        F.array_sort(spelled),
        lambda o: F.filter(o, lambda x, i: (i == 0) | (F.try_element_at(o, F.greatest(i, F.lit(1)))["lc"] != x["lc"])),
    )
    rows = entries.where(F.col("payload").isNotNull()).select("shard", "id", "key", F.explode(first).alias("t"))
    return rows.select("shard", "id", "key", F.col("t.lc").alias("tag_lc"), F.col("t.tag").alias("tag"), "t.pos")


def manual_tags(entries: DataFrame, tags: DataFrame) -> DataFrame:
    """A tag table from ``shard, id, tag`` given by hand, for entries that exist; spellings collapse to the least."""
    lower = tags.where(F.col("tag").isNotNull()).select("shard", "id", "tag", F.lower("tag").alias("tag_lc"))
    merged = lower.groupBy("shard", "id", "tag_lc").agg(F.min("tag").alias("tag"))
    named = merged.join(entries.select("shard", "id", "key"), ["shard", "id"])
    return named.select("shard", "id", "key", "tag_lc", "tag", F.lit(0).alias("pos"))


def tag_counts(tags: DataFrame, prefix: str = "") -> DataFrame:
    """``tag_lc, tag, count``: entries that carry each tag under ``prefix``; the spelling is that of the first entry.

    Partial aggregation per task leaves one state per tag and task to shuffle, however hot a tag is.
    """
    found = tags.where(has_prefix(F.col("key"), prefix))
    # A row of the tag table is one entry with one tag: no distinct count is needed.
    return found.groupBy("tag_lc").agg(
        F.min(F.struct("shard", "id", "pos", "tag"))["tag"].alias("tag"), F.count(F.lit(1)).alias("count")
    )


def bulk_counts(tags: DataFrame, labels: list[str]) -> DataFrame:
    """``tag_lc, count`` of the wanted tags, in any case; null for tags that don't occur."""
    spark = tags.sparkSession
    wanted = spark.createDataFrame([(x,) for x in sorted({x.lower() for x in labels})], "tag_lc string")
    counts = tags.where(F.col("tag_lc").isin([x.lower() for x in labels])).groupBy("tag_lc").agg(
        F.count(F.lit(1)).alias("count")
    )
    return wanted.join(counts, "tag_lc", "left")


def postings(tags: DataFrame) -> DataFrame:
    """``shard, tag_lc, id``: the ids of each tag, one row each; lists of hot tags would outgrow a row."""
    return tags.select("shard", "tag_lc", "id").distinct()
