"""Listing: union of shards, grouping at a delimiter with child counts, byte order, keyset cursor."""

from __future__ import annotations

import base64
import binascii
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.model import COMMON_PREFIX, KEY, MAX_LIMIT, CursorError, ListQuery
from keyloom.operators.predicates import candidate_entries, custom_entries, has_prefix, search_entries, tag_entries


def key_bound(query: ListQuery) -> str | None:
    """The least key that can still matter after the cursor; compared with ``>``, or ``>=`` for a group.

    After a group every key of that group is done, so the bound jumps behind all keys that start with it.
    """
    cursor, d = query.cursor, query.delimiter
    if cursor is None:
        return None
    if d is not None and len(cursor) > len(query.prefix) and cursor.startswith(query.prefix) and cursor.endswith(d):
        return cursor[:-1] + chr(ord(d) + 1)
    return cursor


def select_entries(
    entries: DataFrame, tags: DataFrame | None, query: ListQuery, grams: DataFrame | None = None, gram_shards: list[int] | None = None
) -> DataFrame:
    """The entries that a listing looks at: prefix and cursor bound on the scan, then tags, search, custom filters.

    Where ``grams`` exist, included terms look up candidates before keys are compared; ``gram_shards`` are the shards
    that have them, None if all do.
    """
    found = entries.where(has_prefix(F.col("key"), query.prefix))
    bound = key_bound(query)
    if bound is not None:
        found = found.where(F.col("key") >= bound)
    if query.search.include:
        found = candidate_entries(found, query.search, grams, gram_shards, query.require_index)
    return custom_entries(
        search_entries(tag_entries(found, tags, query.tags, query.prefix), query.search), query.custom
    )


def list_entries(
    entries: DataFrame,
    tags: DataFrame | None,
    query: ListQuery,
    unique: bool = False,
    grams: DataFrame | None = None,
    gram_shards: list[int] | None = None,
) -> DataFrame:
    """``entry, kind, shard, id, payload, child_count`` of a listing, not yet ordered.

    A key in several shards appears once, with the row of the first; a group counts the rows of all shards, so such a
    key counts as often as it is stored.  Groups and keys are planned apart: groups read the key column only and are
    counted by a hash aggregate, combined per task before the shuffle; rows with payloads are compared only for keys
    that stand for themselves, and not at all where keys are ``unique``, as in a single shard.
    """
    found = select_entries(entries, tags, query, grams, gram_shards)
    parts = []
    if query.delimiter is None:
        parts.append((KEY, found))
    else:
        rest = F.substring("key", len(query.prefix) + 1, 2**31 - 1)
        at = F.locate(query.delimiter, rest)
        group = F.concat(F.lit(query.prefix), F.left(rest, at))
        parts.append((KEY, found.where(at == 0)))
        parts.append((COMMON_PREFIX, found.where(at > 0).select(group.alias("entry"))))
    shaped = [
        (_keys if kind == KEY else _groups)(part, query, unique)
        for kind, part in parts
        if query.kind in (None, kind)
    ]
    if not shaped:  # only groups are wanted, and there are none without a delimiter
        shaped = [_keys(found.where(F.lit(False)), query, unique)]
    return reduce(DataFrame.unionByName, shaped)


def _after(rows: DataFrame, query: ListQuery) -> DataFrame:
    return rows if query.cursor is None else rows.where(F.col("entry") > query.cursor)


def _keys(found: DataFrame, query: ListQuery, unique: bool) -> DataFrame:
    named = _after(found.withColumn("entry", F.col("key")), query)
    columns = ["shard", "id", *(["payload"] if query.payload else [])]
    if unique:
        rows = named.select("entry", *columns)
    else:
        first = named.groupBy("entry").agg(F.min(F.struct(*columns)).alias("row"))
        rows = first.select("entry", *[f"row.{c}" for c in columns])
    payload = F.col("payload") if query.payload else F.lit(None).cast("string")
    return rows.select(
        "entry", F.lit(KEY).alias("kind"), "shard", "id", payload.alias("payload"),
        F.lit(None).cast("long").alias("child_count"),
    )


def _groups(found: DataFrame, query: ListQuery, unique: bool) -> DataFrame:
    counted = _after(found, query).groupBy("entry").agg(F.count(F.lit(1)).alias("child_count"))
    return counted.select(
        "entry", F.lit(COMMON_PREFIX).alias("kind"), F.lit(None).cast("int").alias("shard"),
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("payload"), "child_count",
    )


def ordered(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """A listing in byte order, the first ``limit`` entries of it; with a limit this is a distributed top-k."""
    result = listing.orderBy("entry")
    return result if limit is None else result.limit(check_limit(limit))


def check_limit(limit: int, most: int = MAX_LIMIT) -> int:
    if limit < 1:
        raise ValueError("a page has at least one entry")
    return min(limit, most)


def encode_cursor(entry: str) -> str:
    return base64.b64encode(entry.encode()).decode("ascii")


def decode_cursor(cursor: str) -> str:
    try:
        return base64.b64decode(cursor, validate=True).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError) as error:
        raise CursorError("invalid cursor") from error
