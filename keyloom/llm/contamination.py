"""Evaluation texts leaking into training text (problem 6).

The 12-word n-grams of the normalised test words form a hash set that is broadcast: sorted 64-bit hashes with the place of
each n-gram.  Each document's windows are hashed and looked up where the document was read, a batch at once; hits are
verified word by word, and runs of hits become spans that can be removed.  A test set whose text exceeds ``block_chars``
is broadcast in blocks of whole items, one pass over the documents for each, which finds the same passages.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A passage leaks if so many consecutive words are shared.
WORDS = 12
#: Largest test text, in characters, whose n-grams are broadcast at once; measured, 25 million make an index of 66 MB.
BLOCK_CHARS = 20_000_000

_SCAN = regex.compile(
    r"(?P<markup></?[A-Za-z][^<>]*>|<!--.*?-->|\[/?(?:[A-Za-z]+|\*)(?:=[^\]\r\n]*)?\])"
    r"|(?P<entity>&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)"
    r"|(?P<word>[\p{L}\p{N}][\p{L}\p{N}\p{M}\p{Default_Ignorable_Code_Point}]*+)",
    regex.DOTALL,
)
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")


def _plain(word: str) -> str:
    if word.isascii():
        return word.lower()
    return unicodedata.normalize("NFKC", _IGNORABLE.sub("", unicodedata.normalize("NFKC", word)).casefold())


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words of a text and where each stands: runs of letters and digits, markup and entities left out.

    Entities that stand for letters are part of their word.
    """
    found: list[str] = []
    places: list[tuple[int, int]] = []
    for match in _SCAN.finditer(text):
        kind = match.lastgroup
        if kind == "markup":
            continue
        piece, start, end = match.group(), match.start(), match.end()
        if kind == "entity":
            piece = html.unescape(piece)
            if not piece.isalnum():
                continue
        piece = _plain(piece)
        if places and places[-1][1] == start:
            found[-1] += piece
            places[-1] = (places[-1][0], end)
        else:
            found.append(piece)
            places.append((start, end))
    return found, places


_PLAIN_WORD = re.compile("[a-z0-9]+")
_PLAIN_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|\[/?(?:[A-Za-z]+|\*)(?:=[^\]\r\n]*)?\]", re.DOTALL)


def bare_words(text: str) -> list[str]:
    """The words alone; the same as ``words(text)[0]``, with a short way for plain text."""
    if not text.isascii() or "&" in text:
        return words(text)[0]
    if "<" in text or "[" in text:
        text = _PLAIN_MARKUP.sub(" ", text)
    return _PLAIN_WORD.findall(text.lower())


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of ``n`` word numbers."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _PRIME
    mixed ^= mixed >> np.uint64(29)
    size = len(ids) - n + 1
    out = np.zeros(max(size, 0), dtype=np.uint64)
    for i in range(n if size > 0 else 0):
        out = out * np.uint64(0x100000001B3) + mixed[i : i + size]
    return out


class TestIndex:
    """Hash set of the n-grams of test items; ``spans`` finds the passages of texts that stand in an item.

    Held are the number of every test word, the items' words as numbers, one after the other and parted by -1, and the
    sorted hashes of their windows with the place of each.
    """

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], n: int = WORDS):
        self.n = n
        self.numbers: dict[str, int] = {}
        parts, owners = [np.full(1, -1)], [np.full(1, -1)]
        for i, (_, text) in enumerate(items):
            ids = [self.numbers.setdefault(x, len(self.numbers)) for x in bare_words(text)]
            parts.append(np.array([*ids, -1]))
            owners.append(np.full(len(ids) + 1, i))
        self.items = np.array([x for x, _ in items], dtype=np.int64)
        self.words = np.concatenate(parts).astype(np.int32)
        self.owners = np.concatenate(owners).astype(np.int32)
        hashes, places = self._windows(self.words)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order].astype(np.int32)

    def _windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of the windows without a word that no item holds."""
        if len(ids) < self.n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        places = np.flatnonzero(known[self.n :] - known[: -self.n] == self.n)
        return _window_hashes(ids, self.n)[places], places

    def hits(self, texts: list[list[str]]) -> list[list[tuple[int, int]]]:
        """For each text, given as words, the (window, place in the test words) where all n words are the same."""
        get, found = self.numbers.get, [[] for _ in texts]
        flat, starts = [], []
        for tokens in texts:
            starts.append(len(flat))
            flat.extend([get(x, -1) for x in tokens])
            flat.append(-1)
        ids = np.array(flat, dtype=np.int64)
        hashes, places = self._windows(ids)
        left, right = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        texts_of = np.searchsorted(np.array(starts), places, "right") - 1
        for i in np.flatnonzero(right > left):
            window = ids[places[i] : places[i] + self.n]
            for place in self.places[left[i] : right[i]].tolist():
                if (self.words[place : place + self.n] == window).all():
                    text = texts_of[i]
                    found[text].append((int(places[i]) - starts[text], place))
        return found

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, start, end, number of words) of every maximal run of shared windows, in code points."""
        n, out = self.n, []
        for text, hits in zip(texts, self.hits([bare_words(x) for x in texts])):
            last: dict[int, list[int]] = {}
            runs = []
            for at, place in hits:
                item = int(self.owners[place])
                if item in last and last[item][1] >= at - 1:
                    last[item][1] = at
                else:
                    last[item] = [at, at]
                    runs.append((item, last[item]))
            places = words(text)[1] if runs else []
            out.append([(int(self.items[k]), places[a][0], places[b + n - 1][1], b + n - a) for k, (a, b) in runs])
        return out

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        return self.spans_of([text])[0]


_SPAN_TYPE = pa.list_(
    pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64())])
)
_SPAN_SCHEMA = "array<struct<item_id:bigint,start:bigint,end:bigint,n_words:bigint>>"


def _blocks(items: DataFrame, most: int, n: int) -> list[TestIndex]:
    """Indexes of the items, each made of whole items of about ``most`` characters in all."""
    total = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    count = max(1, -(-2 * total // most)) if total > most else 1
    found = []
    for block in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        rows = part.toArrow()  # about half of ``most`` characters
        found.append(TestIndex(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist())), n))
    return found


def _finder(documents: DataFrame, items: DataFrame, n: int, block_chars: int) -> list:
    """For each block of items a function of a text column that gives its passages."""
    known = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long"), "text"
    )

    def of(index: TestIndex):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        @F.arrow_udf(_SPAN_SCHEMA)
        def spans(batch: pa.Array) -> pa.Array:
            texts = batch.to_pylist()
            found = iter(shared.value.spans_of([x for x in texts if x is not None]))
            names = ("item_id", "start", "end", "n_words")
            return pa.array([[] if t is None else [dict(zip(names, x)) for x in next(found)] for t in texts], type=_SPAN_TYPE)

        return spans

    return [of(index) for index in _blocks(known, block_chars, n)]


def leaks(documents: DataFrame, items: DataFrame, n: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, end, n_words`` of every passage of ``items`` in ``documents``.

    A passage is a maximal run of windows of ``n`` words that the item holds.  Documents and items with a null text or
    fewer words, and items with a null id, have none.  Repeated documents come out repeated, also under equal or null
    ids; so do items that occur twice, and items with equal text are all reported.  Empty tables give an empty result.
    """
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    parts = [
        texts.select("doc_id", F.explode(spans("text")).alias("s")).select("doc_id", "s.*")
        for spans in _finder(documents, items, n, block_chars)
    ]
    return reduce(DataFrame.unionByName, parts)


_CLEANED = T.StructType(
    [T.StructField("clean_text", T.StringType()), T.StructField("items", T.ArrayType(T.LongType()))]
)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans, and the items that the spans belong to."""
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        if text is None or not found:
            out.append({"clean_text": text, "items": []})
            continue
        kept, at = [], 0
        for span in sorted(found, key=lambda s: s["start"]):
            if span["end"] > at:
                kept.append(text[at : max(at, span["start"])])
                at = span["end"]
        out.append({"clean_text": "".join(kept) + text[at:], "items": sorted({s["item_id"] for s in found})})
    return pa.array(out, type=pa.struct([("clean_text", pa.string()), ("items", pa.list_(pa.int64()))]))


def without_leaks(
    documents: DataFrame, items: DataFrame, n: int = WORDS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``documents`` with the columns ``clean_text, items``: leaked passages cut out, and the items they belong to.

    Every row stays, repeated rows too; ``clean_text`` is the text where nothing leaks, null for null; ``items`` is
    empty then.  Passages are cut in the pass that finds them, so no row moves.  Columns of these names are replaced.
    """
    found = [spans("text") for spans in _finder(documents, items, n, block_chars)]
    cleaned = documents.withColumn("_spans", F.flatten(F.array(*found)))
    cut = F.arrow_udf(_cut, _CLEANED)("text", "_spans")
    leaking = F.when(F.size("_spans") > 0, cut)
    return cleaned.withColumn("_c", leaking).withColumns(
        {
            "clean_text": F.when(F.size("_spans") > 0, F.col("_c.clean_text")).otherwise(F.col("text")),
            "items": F.coalesce(F.col("_c.items"), F.array().cast("array<bigint>")),
        }
    ).drop("_spans", "_c")
