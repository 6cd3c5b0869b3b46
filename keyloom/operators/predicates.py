"""Filters on entries: prefix, tags, search terms and their combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import GRAM, grams, graphemes, key_grams, normalize, search_forms, strip_accents
from keyloom.model import CustomFilter, SearchFilter, TagFilter
from keyloom.operators.gram_index import gram_candidates


def has_prefix(key: Column, prefix: str) -> Column:
    """``key`` starts with ``prefix``; reaches the Parquet scan as StringStartsWith."""
    return key.startswith(prefix) if prefix else F.lit(True)


def all_of(predicates: list[Column]) -> Column:
    """Conjunction; without predicates everything passes."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def holds_term(forms: Column, term: str) -> Column:
    """Does a key hold a search term?

    The normal form holds the term's, or the forms without accents do; and each 3-gram of the normalised term is a
    gram of the key.  So ``cafe`` finds ``café`` while ``café`` doesn't find ``cafe``.  The cheap comparison comes
    first; grams are made only for keys that pass it.  An empty term finds nothing.
    """
    norm = normalize(term)
    if not norm:
        return F.lit(False)
    held = forms["norm"].contains(norm) | forms["strip"].contains(strip_accents(norm))
    if len(graphemes(norm)) < GRAM:
        return held & (forms["norm"].contains(norm) | forms["strip"].contains(norm))
    wanted = F.array(*[F.lit(g) for g in grams(norm)])
    by_gram = F.size(F.array_except(wanted, key_grams(forms))) == 0
    if norm.isascii():  # in a plain key, what is held is held gram by gram
        return held & (~forms["norm"].rlike(r"[^\x20-\x7E]") | by_gram)
    return held & by_gram


def lacks_term(forms: Column, term: str) -> Column:
    """The key holds an excluded term neither in its normal form nor without accents; an empty one excludes nothing."""
    norm = normalize(term)
    if not norm:
        return F.lit(True)
    return ~(forms["norm"].contains(norm) | forms["strip"].contains(strip_accents(norm)))


def candidate_entries(
    entries: DataFrame, search: SearchFilter, grams: DataFrame | None, gram_shards: list[int] | None, require_index: bool
) -> DataFrame:
    """Entries that the grams don't rule out for the included terms of three and more clusters.

    Entries of shards without grams stay, or with ``require_index`` go.  Keys still have to be compared.
    """
    if grams is None or gram_shards == []:
        return entries.where(F.lit(False)) if require_index else entries
    long = [t for t in search.include if len(graphemes(normalize(t))) >= GRAM]
    held = None if gram_shards is None else F.col("shard").isin(gram_shards)
    indexed = entries if held is None else entries.where(held)
    for term in long:
        indexed = indexed.join(gram_candidates(grams, term), ["shard", "id"], "left_semi")
    if held is None or require_index:
        return indexed
    return indexed.unionByName(entries.where(~held)) if long else entries


def search_entries(entries: DataFrame, search: SearchFilter, key: str = "key") -> DataFrame:
    """Entries whose key holds all included and no excluded terms."""
    if not (search.include or search.exclude):
        return entries
    stored = {"key_norm", "key_strip"} <= set(entries.columns)
    forms = F.struct(F.col("key_norm").alias("norm"), F.col("key_strip").alias("strip")) if stored else F.col("_forms")
    shaped = entries if stored else entries.withColumn("_forms", search_forms(F.col(key)))
    wanted = [holds_term(forms, t) for t in search.include] + [lacks_term(forms, t) for t in search.exclude]
    return shaped.where(all_of(wanted)).drop("_forms")


def tagged_ids(tags: DataFrame, labels: tuple[str, ...], mode: str, prefix: str = "") -> DataFrame:
    """``shard, id`` of the entries under ``prefix`` that carry all (``and``) or any (``or``) of the tags."""
    wanted = sorted({t.lower() for t in labels})
    hits = tags.where(has_prefix(F.col("key"), prefix) & F.col("tag_lc").isin(wanted)).select("shard", "id", "tag_lc")
    if mode == "or" or len(wanted) == 1:
        return hits.select("shard", "id")
    # Only the few wanted tags arrive here, so the distinct count per entry is bounded by their number.
    counted = hits.groupBy("shard", "id").agg(F.count_distinct("tag_lc").alias("n"))
    return counted.where(F.col("n") == len(wanted)).select("shard", "id")


def tag_entries(entries: DataFrame, tags: DataFrame | None, wanted: TagFilter, prefix: str = "") -> DataFrame:
    """Entries that satisfy a tag filter.

    Entries of shards without tag index carry no tags: included tags keep them out, excluded ones let them pass.
    """
    if wanted.include:
        if tags is None:
            return entries.where(F.lit(False))
        entries = entries.join(tagged_ids(tags, wanted.include, wanted.mode, prefix), ["shard", "id"], "left_semi")
    if wanted.exclude and tags is not None:
        entries = entries.join(tagged_ids(tags, wanted.exclude, "or", prefix), ["shard", "id"], "left_anti")
    return entries


def custom_entries(entries: DataFrame, filters: tuple[CustomFilter, ...]) -> DataFrame:
    """Entries that pass all custom filters: predicates, or tables of the ids to keep."""
    for wanted in filters:
        if isinstance(wanted, DataFrame):
            entries = entries.join(wanted.select("shard", "id"), ["shard", "id"], "left_semi")
        else:
            entries = entries.where(wanted(entries))
    return entries
