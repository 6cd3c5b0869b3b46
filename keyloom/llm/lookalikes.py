"""One consistent form for text that looks the same (problem 5).

``fold`` composes steps: compatibility forms of letters, composed accents, removal of default-ignorable characters, spaces
that break, one alphabet within a word; then full case folding and the compatibility forms of all other characters.
``oddities`` names the steps of that composition that change a value.  Both run once for each distinct value of an Arrow
batch; plain ASCII values never reach Python.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Small letters of Cyrillic, Greek and Armenian that can't be told from Latin ones.
TWINS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ϲ": "c", "ϳ": "j", "ν": "v", "ο": "o", "ρ": "p",
    "υ": "u", "հ": "h", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "յ": "j",
}
#: Letters that look like Latin ones as capitals or roughly, used only in words that are Latin otherwise.
LIKE = {
    "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "β": "b", "γ": "y", "ε": "e", "ζ": "z", "η": "h", "ι": "i",
    "κ": "k", "μ": "m", "τ": "t", "χ": "x", "զ": "q", "ք": "p", "լ": "l", "ա": "w",
}

#: Letters that look like Latin ones as capitals only, where the small letter has another twin.
CAPITALS = {"ν": "n", "υ": "y"}

IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
#: Parts of an emoji: its joiners, variation selectors and tags are visible in their effect.
EMOJI = regex.compile(
    r"(?:\p{Extended_Pictographic}|[0-9#*](?=️?⃣)|\p{Regional_Indicator}{2})"
    r"[︎️⃣\p{Emoji_Modifier}\U000E0020-\U000E007F]*"
    r"(?:‍(?:\p{Extended_Pictographic}|[♀♂])[︎️\p{Emoji_Modifier}]*)*"
)
NO_BREAK = regex.compile(r"[\u00A0\u2007\u202F]")
_EMOJI_OR_IGNORABLE = regex.compile(f"({EMOJI.pattern})|{IGNORABLE.pattern}")
_CLUSTER = regex.compile(r"\X")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
SPACES = regex.compile(r"[\p{Z}\t\n\v\f\r\x85]")
_SCRIPTS = (
    ("latin", regex.compile(r"\p{Script=Latin}")),
    ("cyrillic", regex.compile(r"\p{Script=Cyrillic}")),
    ("greek", regex.compile(r"\p{Script=Greek}")),
    ("armenian", regex.compile(r"\p{Script=Armenian}")),
    ("none", regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")),
    ("east asian", regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}]")),
)
_WORD_SCRIPTS = {"latin", "cyrillic", "greek", "armenian"}


@lru_cache(65536)
def script(letter: str) -> str:
    """The alphabet of a letter; ``other`` for any besides the named ones."""
    return next((name for name, pattern in _SCRIPTS if pattern.match(letter)), "other")


@lru_cache(65536)
def _unstyled(char: str) -> str:
    """The ordinary letters that a full-width, styled or joined form stands for; any other character itself."""
    plain = unicodedata.normalize("NFKC", char)
    if plain == char or unicodedata.normalize("NFC", char) != char:
        return char
    return plain if all(unicodedata.category(x)[0] == "L" for x in plain) else char


def _composed(text: str) -> str:
    """Letters composed with the marks that follow them; characters that stand alone stay."""
    return _CLUSTER.sub(lambda m: unicodedata.normalize("NFC", m.group()) if len(m.group()) > 1 else m.group(), text)


def _mixed(word: str) -> bool:
    """Does the word mix the letters of several alphabets?"""
    found = {script(x) for x in word if not unicodedata.category(x).startswith("M")} - {"none", "east asian"}
    return len(found) > 1 and bool(found & _WORD_SCRIPTS)


def _plain_word(match: regex.Match) -> str:
    """A word that mixes alphabets, written in the one with more letters that no other has a twin of; else in Latin.

    Capitals go the way of their small letters.
    """
    word = match.group()
    if word.isascii() or not _mixed(word):
        return word
    small = [x.lower() if len(x.lower()) == 1 else x for x in word]
    others = [script(x) for x in small if script(x) in _WORD_SCRIPTS - {"latin"} and x not in TWINS]
    home = max(sorted(set(others)), key=others.count, default="latin")
    twin = {plain: x for x, plain in reversed(TWINS.items()) if script(x) == home}
    back = {plain: x for x, plain in reversed((LIKE | CAPITALS).items()) if script(x) == home} | twin
    latin = sum(script(x) == "latin" and x not in twin for x in small)
    if latin >= others.count(home):
        plain = [TWINS.get(x) or LIKE.get(x) or x for x in small]
    else:
        plain = [back.get(TWINS.get(x, x), x) if script(x) != home else x for x in small]
    return "".join(own if new == low else new.upper() if own != low else new for own, low, new in zip(word, small, plain))


def _one_alphabet(text: str) -> str:
    """Words that mix alphabets written in one; an invisible character inside a word doesn't part it."""
    return LETTERS.sub(_plain_word, text)


#: The steps that bring a value to its consistent spelling, by what they undo.
STEPS = (
    ("styled", lambda text: "".join(map(_unstyled, text))),
    ("split accent", _composed),
    ("invisible", lambda text: _EMOJI_OR_IGNORABLE.sub(r"\1", text)),
    ("no-break space", lambda text: NO_BREAK.sub(" ", text)),
    ("mixed letters", _one_alphabet),
)


def _steps(text: str) -> tuple[str, list[str]]:
    """(a value after all steps, the names of those that changed it)."""
    changed = []
    for name, step in STEPS:
        plain = step(text)
        if plain != text:
            changed.append(name)
            text = plain
    # Letters without a twin can't be rewritten; the word mixes alphabets all the same.
    if changed[-1:] != ["mixed letters"] and any(map(_mixed, LETTERS.findall(text))):
        changed.append("mixed letters")
    return text, changed


def oddities(text: str) -> list[str]:
    """Which of ``styled``, ``split accent``, ``invisible``, ``no-break space`` and ``mixed letters`` occur in a value.

    These are the steps of ``fold`` that change it, and the last also where it finds a mixed word that it can't change.  Joiners and selectors inside emoji don't count.
    """
    return [] if text.isascii() else _steps(text)[1]


def fold(text: str) -> str:
    """The consistent form of a value, for comparisons.  ``fold(fold(x)) == fold(x)``.

    NFKC, full case folding, spaces of any kind as U+0020, no default-ignorable characters but those inside emoji, and
    words that mix alphabets written in one.  Words wholly in another alphabet stay in it, even if all their letters
    look like Latin ones: which of the two is meant can't be told.
    """
    seen: set[str] = set()
    while not text.isascii() and text not in seen:  # folding may compose and composing may fold, until nothing changes
        seen.add(text)
        text = unicodedata.normalize("NFKC", _steps(text)[0].casefold())
        text = unicodedata.normalize("NFKC", _EMOJI_OR_IGNORABLE.sub(r"\1", SPACES.sub(" ", text)))
    return SPACES.sub(" ", text.casefold())


NOT_ASCII = r"[^\x00-\x7F]"


@F.arrow_udf(T.StringType())
def _folded(values: pa.Array) -> pa.Array:
    names = values.to_pylist()
    known = {x: None if x is None else fold(x) for x in set(names)}
    return pa.array([known[x] for x in names], pa.string())


def folded(text: Column) -> Column:
    """``fold`` of a text column; null for null.  ASCII texts stay in the JVM."""
    other = text.rlike(NOT_ASCII)
    plain = F.regexp_replace(F.lower(text), r"[\t\n\x0B\f\r]", " ")
    return F.when(other, _folded(F.when(other, text))).otherwise(plain)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _folded_all(values: pa.Array) -> pa.Array:
    known: dict[str | None, str | None] = {None: None}
    out = []
    for items in values.to_pylist():
        for x in items or ():
            if x not in known:
                known[x] = fold(x)
        out.append(None if items is None else [known[x] for x in items])
    return pa.array(out, pa.list_(pa.string()))


def folded_all(texts: Column) -> Column:
    """``fold`` of each element of an array column; null arrays and elements stay null.  ASCII arrays stay in the JVM."""
    other = F.exists(texts, lambda x: x.rlike(NOT_ASCII))
    plain = F.transform(texts, lambda x: F.regexp_replace(F.lower(x), r"[\t\n\x0B\f\r]", " "))
    return F.when(other, _folded_all(F.when(other, texts))).otherwise(plain)


@F.arrow_udf(T.BooleanType())
def any_odd(values: pa.Array) -> pa.Array:
    """Does any element of each array hold oddities?  Null elements don't."""
    known: dict[str | None, bool] = {None: False}
    out = []
    for items in values.to_pylist():
        for x in items or ():
            if x not in known:
                known[x] = bool(oddities(x))
        out.append(any(known[x] for x in items or ()))
    return pa.array(out, pa.bool_())


def odd_rows(table: DataFrame, key: str, field: str, values: Column) -> DataFrame:
    """``key, field, values`` of the rows in which one of ``values``, an array column, holds oddities.

    Only rows with a character beyond ASCII go to Python, and no row is moved.  Null and empty arrays aren't odd.
    """
    rows = table.select(key, F.lit(field).alias("field"), values.alias("values"))
    return rows.where(F.exists("values", lambda x: x.rlike(NOT_ASCII))).where(any_odd("values"))


def consistent(table: DataFrame, key: str) -> DataFrame:
    """``key, path, tags, path_folded, tags_folded`` of the rows of a listing that had to change.

    Null paths, tags and elements stay null and are no change; so do empty ones.  Rows aren't merged, repeated rows
    come out repeated.  An empty table gives an empty result.
    """
    both = table.select(key, "path", "tags").select(
        key, "path", "tags", folded(F.col("path")).alias("path_folded"), folded_all(F.col("tags")).alias("tags_folded")
    )
    changed = ~F.col("path").eqNullSafe(F.col("path_folded")) | ~F.col("tags").eqNullSafe(F.col("tags_folded"))
    return both.where(changed)
