"""Queries and filters as plain values, and the errors of the library."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

KEY, COMMON_PREFIX = "Key", "CommonPrefix"
MAX_LIMIT = 1000


class IndexFormatError(ValueError):
    """A folder holds no index, or an input line can't be indexed."""


class CursorError(ValueError):
    """A cursor that was not handed out by a page."""


@dataclass(frozen=True)
class TagFilter:
    """Tags that an entry must carry (all or any of them) and must not carry, regardless of case."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    mode: str = "and"

    def __post_init__(self) -> None:
        if self.mode not in ("and", "or"):
            raise ValueError(f"mode is 'and' or 'or', not {self.mode!r}")


@dataclass(frozen=True)
class SearchFilter:
    """Terms that a key must hold, all of them, and terms that it must not hold."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


#: A predicate on the columns of an entry, or a DataFrame with the columns ``shard, id`` of the entries to keep.
CustomFilter = Callable[[DataFrame], Column] | DataFrame


@dataclass(frozen=True)
class ListQuery:
    """A listing: keys under ``prefix``, grouped at ``delimiter``, after ``cursor``, filtered."""

    prefix: str = ""
    delimiter: str | None = None
    cursor: str | None = None
    tags: TagFilter = field(default_factory=TagFilter)
    search: SearchFilter = field(default_factory=SearchFilter)
    custom: tuple[CustomFilter, ...] = ()
    kind: str | None = None
    payload: bool = True
    #: Shards without search grams contribute nothing to a search, instead of being scanned.
    require_index: bool = False

    def __post_init__(self) -> None:
        if self.delimiter is not None and (len(self.delimiter) != 1 or not self.delimiter.isascii()):
            raise ValueError("the delimiter is one ASCII character")
        if self.kind not in (None, KEY, COMMON_PREFIX):
            raise ValueError(f"kind is {KEY!r}, {COMMON_PREFIX!r} or None")
