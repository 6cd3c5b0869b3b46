"""The database handle: listings, tags, lookups and pages over one index or over any tables of that shape."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from keyloom.model import COMMON_PREFIX, MAX_LIMIT, ListQuery, SearchFilter, TagFilter
from keyloom.operators import listing, lookup, tag_index
from keyloom.sources.ingest import IndexTables, manifest_of, open_index


class Database:
    """Ordered union of shards; a lower shard number takes precedence."""

    def __init__(
        self,
        entries: DataFrame,
        tags: DataFrame | None = None,
        manifest: DataFrame | None = None,
        grams: DataFrame | None = None,
        prune: bool = True,
        gram_shards: tuple[int, ...] | None = None,
    ):
        self.gram_shards = gram_shards
        self.entries, self.tags, self.grams, self.prune = entries, tags, grams, prune
        self._manifest = manifest

    @classmethod
    def open(cls, spark: SparkSession, path: str, limit: int | None = None, prune: bool = True) -> Database:
        tables: IndexTables = open_index(spark, path, limit)
        return cls(tables.entries, tables.tags, tables.manifest, tables.grams, prune, tables.gram_shards)

    def add(self, other: Database) -> Database:
        """This database and another one's shards, which get the numbers after its own."""
        shift = (self.entries.agg(F.max("shard").alias("n")).first().n or 0) + 1
        moved = lambda df: df.withColumn("shard", (F.col("shard") + shift).cast("int"))

        def joined(mine: DataFrame | None, theirs: DataFrame | None) -> DataFrame | None:
            parts = [x for x in (mine, None if theirs is None else moved(theirs)) if x is not None]
            return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

        # Only where both have a stored manifest can shards be told apart without reading them.
        stored = self._manifest is not None and other._manifest is not None
        return Database(
            joined(self.entries, other.entries),
            joined(self.tags, other.tags),
            joined(self._manifest, other._manifest) if stored else None,
            joined(self.grams, other.grams),
            self.prune,
            (*self._searched(), *(x + shift for x in other._searched())),
        )

    def _searched(self) -> tuple[int, ...]:
        """The shards that have grams."""
        if self.grams is None:
            return ()
        if self.gram_shards is None:  # a gram table given by hand covers all entries
            return tuple(r.shard for r in self.entries.select("shard").distinct().collect())
        return self.gram_shards

    @property
    def manifest(self) -> DataFrame:
        return manifest_of(self.entries, self.tags is not None) if self._manifest is None else self._manifest

    def _candidates(self, prefix: str) -> list[int] | None:
        """Shards that may hold the prefix, from a stored manifest, one row per shard; None where there is none."""
        if not self.prune or self._manifest is None:
            return None
        return [r.shard for r in lookup.candidate_shards(self._manifest, prefix).collect()]

    @staticmethod
    def _within(table: DataFrame | None, shards: list[int] | None) -> DataFrame | None:
        """Only the partitions of these shards."""
        return table if table is None or shards is None else table.where(F.col("shard").isin(shards))

    def _pruned(self, table: DataFrame | None, prefix: str) -> DataFrame | None:
        return self._within(table, self._candidates(prefix) if prefix else None)

    def list(self, prefix: str = "", delimiter: str | None = None, **options: Any) -> DataFrame:
        return self.query(ListQuery(prefix=prefix, delimiter=delimiter, **options))

    def query(self, query: ListQuery) -> DataFrame:
        """The listing of a query in byte order."""
        return listing.ordered(self._unordered(query))

    def _unordered(self, query: ListQuery) -> DataFrame:
        shards = self._candidates(query.prefix)
        entries, tags = self._within(self.entries, shards), self._within(self.tags, shards)
        searched = None if self.gram_shards is None else list(self.gram_shards)
        return listing.list_entries(
            entries, tags, query, shards is not None and len(shards) <= 1, self._within(self.grams, shards), searched
        )

    def page(self, query: ListQuery, limit: int = MAX_LIMIT) -> tuple[list[Row], str | None]:
        """(entries of a page, cursor of the next one); there is a cursor if the page is full."""
        limit = listing.check_limit(limit)
        rows = listing.ordered(self._unordered(query), limit).collect()  # at most MAX_LIMIT rows
        return rows, rows[-1].entry if len(rows) == limit else None

    def pages(self, query: ListQuery, limit: int = MAX_LIMIT) -> Iterator[list[Row]]:
        """All pages of a listing, each from where the one before it ended."""
        cursor = query.cursor
        while True:
            rows, cursor = self.page(replace(query, cursor=cursor), limit)
            if rows:
                yield rows
            if cursor is None:
                return

    def keys_page(self, query: ListQuery, limit: int = MAX_LIMIT, cursor: str | None = None) -> dict[str, Any]:
        """A page as plain values: ``items`` of key, type, payload and count, and an encoded ``next_cursor``."""
        if cursor is not None:
            query = replace(query, cursor=listing.decode_cursor(cursor))
        rows, following = self.page(query, limit)
        items = []
        for r in rows:
            item: dict[str, Any] = {"key": r.entry, "type": r.kind}
            if r.kind == COMMON_PREFIX:
                item["count"] = r.child_count
            elif r.payload is not None:
                item["payload"] = json.loads(r.payload)
            items.append(item)
        return {"items": items, "next_cursor": None if following is None else listing.encode_cursor(following)}

    def search(
        self, term: str, prefix: str = "", shard: int | None = None, require_index: bool = False
    ) -> DataFrame:
        """Keys under a prefix that hold a term, in one shard or in all; in byte order.

        Where a gram table exists, terms of three and more clusters look up candidates first.  With ``require_index``
        shards without one contribute nothing; by default their keys are scanned.
        """
        within = ((lambda e: e["shard"] == shard),) if shard is not None else ()
        return self.query(ListQuery(prefix, search=SearchFilter((term,)), custom=within, require_index=require_index))

    def list_tags(self, prefix: str = "") -> DataFrame:
        """``tag, count`` ordered by the lower-cased tag; empty without tag index."""
        return self._tag_counts(prefix).orderBy("tag_lc").select("tag", "count")

    def _tag_counts(self, prefix: str) -> DataFrame:
        if self.tags is None:
            return self.entries.where(F.lit(False)).selectExpr(
                "cast(null as string) as tag_lc", "cast(null as string) as tag", "cast(0 as bigint) as count"
            )
        return tag_index.tag_counts(self._pruned(self.tags, prefix), prefix)

    def tags_page(self, prefix: str = "", limit: int = MAX_LIMIT, cursor: str | None = None) -> dict[str, Any]:
        limit = listing.check_limit(limit)
        counts = self._tag_counts(prefix)
        if cursor is not None:
            counts = counts.where(F.col("tag_lc") > listing.decode_cursor(cursor))
        rows = counts.orderBy("tag_lc").limit(limit).collect()  # at most MAX_LIMIT rows
        following = listing.encode_cursor(rows[-1].tag_lc) if len(rows) == limit else None
        return {"items": [{"tag": r["tag"], "count": r["count"]} for r in rows], "next_cursor": following}

    def get_value(self, key: str) -> Any:
        """The payload of a key in the first shard that has one, else None."""
        row = lookup.get_value(self._pruned(self.entries, key), key).first()
        return None if row is None else json.loads(row.payload)

    def get_key(self, shard: int, id: int) -> str | None:
        row = lookup.key_by_id(self.entries, shard, id).first()
        return None if row is None else row.key

    def __len__(self) -> int:
        """Stored entries; a key counts once per shard."""
        return self.manifest.agg(F.sum("n_keys").alias("n")).first().n or 0

    def shards(self) -> DataFrame:
        return self.manifest.orderBy("shard")

    def has_prefix(self, prefix: str) -> bool:
        return not self._pruned(self.entries, prefix).where(F.col("key").startswith(prefix)).isEmpty()


def make_query(
    prefix: str = "",
    delimiter: str | None = None,
    include_tags: str = "",
    exclude_tags: str = "",
    mode: str = "and",
    search: str = "",
    exclude_search: str = "",
    require_index: bool = False,
) -> ListQuery:
    """A query from the comma-separated lists of a request; blanks around items and empty items are dropped."""

    def items(text: str) -> tuple[str, ...]:
        return tuple(x.strip() for x in text.split(",") if x.strip())

    return ListQuery(
        prefix=prefix,
        delimiter=delimiter or None,
        tags=TagFilter(items(include_tags), items(exclude_tags), mode),
        search=SearchFilter(items(search), items(exclude_search)),
        require_index=require_index,
    )
