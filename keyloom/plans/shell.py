"""A command shell over a database.  Commands return lines of text; a front end prints them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import functions as F

from keyloom.model import COMMON_PREFIX, KEY, ListQuery, SearchFilter, TagFilter
from keyloom.plans.database import Database

HELP = """\
ls [-r] [-c|-k] [-d CHAR] [-q TERM]... [-! TERM]... [#TAG]... [!TAG]... [PREFIX]   list entries
search TERM        keys under the working prefix that hold TERM
tags               tags under the working prefix with their counts
val ID [SHARD] | val SHARD:ID   the entry with an id
shards             the shards, their sizes and common prefixes
cd [PREFIX | ..]   append to, shorten or clear the working prefix
pwd                the working prefix
help, exit, quit"""


class UsageError(ValueError):
    """A command line that can't be read; its text is shown to the user."""


@dataclass
class ListArguments:
    """What an ``ls`` command line asks for."""

    prefix: str = ""
    recursive: bool = False
    kind: str | None = None
    delimiter: str | None = None
    tags: TagFilter = TagFilter()
    search: SearchFilter = SearchFilter()


def parse_ls(words: list[str]) -> ListArguments:
    """Read the words after ``ls``; short flags combine (``-rk``), ``-d/`` and ``-d /`` are the same."""
    lists: dict[str, list[str]] = {"q": [], "!": [], "#": [], "x": []}
    found = ListArguments()
    kinds, prefixes, rest = set(), [], iter(words)

    def value(flag: str) -> str:
        try:
            return next(rest)
        except StopIteration:
            raise UsageError(f"{flag} needs an argument") from None

    for word in rest:
        if word in ("-q", "-!"):
            lists[word[1]].append(value(word))
        elif word.startswith("-d"):
            found.delimiter = word[2:] or value("-d")
            if len(found.delimiter) != 1:
                raise UsageError("a delimiter is a single character")
        elif word.startswith("-") and len(word) > 1:
            for flag in word[1:]:
                if flag == "r":
                    found.recursive = True
                elif flag in "ck":
                    kinds.add(COMMON_PREFIX if flag == "c" else KEY)
                else:
                    raise UsageError(f"unknown flag -{flag}")
        elif word[0] in "#!" and len(word) > 1:
            lists["#" if word[0] == "#" else "x"].append(word[1:])
        else:
            prefixes.append(word)
    if len(kinds) > 1:
        raise UsageError("-c and -k exclude each other")
    if len(prefixes) > 1:
        raise UsageError(f"unexpected argument {prefixes[1]!r}; #tag includes, !tag excludes")
    found.kind = next(iter(kinds), None)
    found.prefix = prefixes[0] if prefixes else ""
    found.tags = TagFilter(tuple(lists["#"]), tuple(lists["x"]))
    found.search = SearchFilter(tuple(lists["q"]), tuple(lists["!"]))
    return found


def parse_val(words: list[str], n_shards: int, only: int | None) -> tuple[int, int]:
    """(shard, id) of ``ID``, ``ID SHARD`` or ``SHARD:ID``; without a shard there must be only one."""
    if not words:
        raise UsageError("val ID [SHARD] | val SHARD:ID")
    first = words[0]
    shard, id = first.split(":", 1) if ":" in first else (words[1] if len(words) > 1 else None, first)
    if not id.isdecimal() or (shard is not None and not shard.isdecimal()):
        raise UsageError("ids and shards are numbers")
    if shard is None:
        if n_shards != 1:
            raise UsageError("several shards: val ID SHARD | val SHARD:ID")
        return int(only or 0), int(id)
    return int(shard), int(id)


def parent(prefix: str, delimiter: str) -> str:
    """The prefix without its last segment, with the delimiter before that; empty at the top."""
    head = prefix.rstrip(delimiter)
    return head[: head.rfind(delimiter) + 1]


class Shell:
    """Working prefix and commands; ``run`` takes one line."""

    def __init__(self, database: Database, delimiter: str = "/", debug: bool = False):
        self.db, self.delimiter, self.debug = database, delimiter, debug
        self.cwd, self.done = "", False
        self.commands: dict[str, Callable[[list[str]], Iterator[str]]] = {
            "ls": self._ls, "search": self._search, "tags": self._tags, "val": self._val, "shards": self._shards,
            "cd": self._cd, "pwd": self._pwd, "help": self._help, "exit": self._exit, "quit": self._exit,
        }

    def run(self, line: str) -> Iterator[str]:
        """Output lines of a command; they are produced while the result is pulled."""
        words = line.split()
        if not words:
            return
        command = self.commands.get(words[0])
        if command is None:
            yield f"Unknown command {words[0]!r}; try help"
            return
        began = time.monotonic()
        try:
            yield from command(words[1:])
        except UsageError as error:
            yield str(error)
        if self.debug:
            yield f"{(time.monotonic() - began) * 1000:.0f} ms"

    def _show(self, query: ListQuery) -> Iterator[str]:
        n = 0
        for row in self.db.query(query).toLocalIterator(prefetchPartitions=True):
            n += 1
            name = row.entry.removeprefix(query.prefix)
            if row.kind == COMMON_PREFIX:
                yield f"{name} ({row.child_count})"
            else:
                yield f"{name} #{row.id}" + ("" if row.payload is None else f" {_compact(row.payload)}")
        if n:
            yield f"{n} {'entry' if n == 1 else 'entries'} listed"

    def _ls(self, words: list[str]) -> Iterator[str]:
        asked = parse_ls(words)
        delimiter = None if asked.recursive else asked.delimiter or self.delimiter
        return self._show(
            ListQuery(self.cwd + asked.prefix, delimiter, tags=asked.tags, search=asked.search, kind=asked.kind)
        )

    def _search(self, words: list[str]) -> Iterator[str]:
        if not words:
            raise UsageError("search TERM")
        return self._show(ListQuery(self.cwd, search=SearchFilter((words[0],)), kind=KEY))

    def _tags(self, words: list[str]) -> Iterator[str]:
        if words:
            raise UsageError("tags takes no arguments")
        for row in self.db.list_tags(self.cwd).toLocalIterator():
            yield f"{row['tag']:<32} {row['count']:>12}"

    def _val(self, words: list[str]) -> Iterator[str]:
        shards = [r.shard for r in self.db.manifest.select("shard").collect()]  # one row per shard
        shard, id = parse_val(words, len(shards), min(shards, default=None))
        if shard not in shards:
            yield f"No shard {shard}; there are {', '.join(map(str, sorted(shards)))}"
            return
        row = self.db.entries.where((F.col("shard") == shard) & (F.col("id") == id)).first()
        if row is None:
            yield f"No key has id {id} in shard {shard}"
        else:
            yield f"{row.key} #{id} [shard {shard}]" + ("" if row.payload is None else f" {_compact(row.payload)}")

    def _shards(self, words: list[str]) -> Iterator[str]:
        rows = self.db.shards().collect()  # one row per shard
        yield f"{len(rows)} shards"
        for r in rows:
            yield f"shard {r.shard}: {r.n_keys} keys, common prefix {r.common_prefix!r}"

    def _cd(self, words: list[str]) -> Iterator[str]:
        if not words:
            self.cwd = ""
        elif words[0] == "..":
            self.cwd = parent(self.cwd, self.delimiter)
        else:
            self.cwd += words[0]
        return iter(())

    def _pwd(self, words: list[str]) -> Iterator[str]:
        yield self.cwd

    def _help(self, words: list[str]) -> Iterator[str]:
        yield from HELP.splitlines()

    def _exit(self, words: list[str]) -> Iterator[str]:
        self.done = True
        return iter(())

    def complete(self, line: str, most: int = 1000) -> list[str]:
        """What the last word of a line may become: a command, a tag or an entry one level below.

        Of more than ``most`` the first are given, and ``...`` behind them says so.
        """
        words = line.split()
        typed = "" if not words or line.endswith(" ") else words[-1]
        if len(words) <= 1 and not (words and line.endswith(" ")):
            return sorted(x for x in self.commands if x.startswith(typed))
        if typed[:1] in ("#", "!"):
            counts = self.db.list_tags(self.cwd).where(F.lower("tag").startswith(typed[1:].lower())).limit(most + 1)
            return _cut_to([typed[0] + r["tag"] for r in counts.collect()], most)
        kind = COMMON_PREFIX if words[0] == "cd" else None
        base = self.cwd + typed[: typed.rfind(self.delimiter) + 1]
        below = self.db.query(ListQuery(base, self.delimiter, kind=kind, payload=False))
        found = below.where(F.col("entry").startswith(self.cwd + typed)).limit(most + 1).collect()
        return _cut_to([r.entry.removeprefix(self.cwd) for r in found], most)


def _cut_to(found: list[str], most: int) -> list[str]:
    return found if len(found) <= most else [*found[:most], "..."]


def _compact(payload: str) -> str:
    return json.dumps(json.loads(payload), ensure_ascii=False, separators=(",", ":"))
