"""The search index: postings of 3-grams over grapheme clusters, and candidates from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import GRAM, PAD, grams, graphemes, key_grams, normalize, search_forms


def build_grams(entries: DataFrame) -> DataFrame:
    """``shard, gram, id`` of every gram of every key."""
    forms = entries.select("shard", "id", search_forms(F.col("key")).alias("forms"))
    return forms.select("shard", F.explode(key_grams(F.col("forms"))).alias("gram"), "id")


def gram_candidates(postings: DataFrame, term: str) -> DataFrame:
    """``shard, id`` of the entries that may hold a term.

    From three grapheme clusters on, all grams of the normalised term must occur; a shorter term must be part of some
    gram.  An empty term has no candidates.
    """
    norm = normalize(term)
    if not norm:
        return postings.where(F.lit(False)).select("shard", "id")
    if len(graphemes(norm)) < GRAM:
        return postings.where(F.rtrim("gram", F.lit(PAD)).contains(norm)).select("shard", "id").distinct()
    wanted = grams(norm)
    hits = postings.where(F.col("gram").isin(wanted)).groupBy("shard", "id").agg(F.count_distinct("gram").alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("shard", "id")
