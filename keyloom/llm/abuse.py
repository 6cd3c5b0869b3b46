"""Abusive, hateful or sexual content (problem 8): a weighted finite-state pattern grammar.

Machines are composed for each clause of a text (``transducers``; the words and patterns are in ``abuse_grammar``):

1. a disguise transducer undoes markup, look-alike letters, digits for letters, drawn-out, spaced-out and masked words;
   composed with the lexicon it reads each word as weighted word classes;
2. context rules for negation, reported speech, remarks about oneself, technical and figurative uses take the classes
   off words that they defuse;
3. weighted clause patterns - insults, threats, wishes of harm, degraded groups, explicit sex - name who is aimed at.
   The weights of patterns that don't overlap add up along the best path.

A clause counts, not a word: ``bastard`` in "a bastard file" adds nothing.  The score of a document is that of its
worst clause; from 1.0 on it is taken for abusive.  Whole clauses are read, however long they are.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import abuse_grammar as grammar
from keyloom.llm.lookalikes import IGNORABLE, LIKE, TWINS
from keyloom.llm.transducers import COMMA, Classes, Contexts, Disguise, Patterns, Reading, Symbols, parse

#: Score from which a document counts as abusive.
THRESHOLD = 1.0
#: Letters that digits and signs stand for, each at the cost of one arc.
CODED = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e",
}
INFLECTED = {"noun": grammar.NOUNS, "verb": grammar.VERBS, "endings": grammar.ENDINGS, "adjective": grammar.ADJECTIVES}
CODE_COST, TWIN_COST = 0.02, 0.02
#: Tokens whose readings are kept at most; beyond them the table starts anew.
MOST_TOKENS = 500_000

_TWINS = str.maketrans(LIKE | TWINS)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|\[/?(?:[A-Za-z]+|\*)(?:=[^\]\r\n]*)?\]", re.DOTALL)
_LINK = re.compile(r"\b(?:https?://|www\.)\S+")
#: Letters one by one, words with their signs, commas, clause ends.
_SINGLE = r"[^\W_](?![\w@$*#€'’])"
_TOKEN = re.compile(
    r"[\w@$*#€]{2,}(?:![\w@$*#€]+)*|[^\W_](?:" + "|".join(rf"(?:{sign}{_SINGLE}){{2,}}" for sign in (" ", r"\.", "-", "·")) + ")"
    r"|[\w@$*#€](?:![\w@$*#€]+)*|,|[\r\n]+|[.!?;:…]+(?=\s|$)|[–—]+"
)
_SHORT_FORMS = re.compile(r"(?<=[^\W_])(?:(n)['’]t|['’](re|ll|ve|m|d|s))\b")
_LONG_FORMS = {"re": " are", "ll": " will", "ve": " have", "m": " am", "d": " would", "s": " is"}
_SPACING = re.compile(r"[ .\-·]")
_ACCENTS = re.compile("[̀-ͯ]+")


def plain_letters(text: str) -> str:
    """Compatibility forms, small letters, no accents, nothing invisible."""
    if text.isascii():
        return text.lower()
    text = IGNORABLE.sub("", unicodedata.normalize("NFKC", text)).casefold()
    return unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", text)))


def _long_form(match: re.Match) -> str:
    return " not" if match.group(1) else _LONG_FORMS[match.group(2)]


def tokens(text: str) -> list[str]:
    """Words, commas and clause ends of a text, markup, links and short forms undone; spaced-out words are one."""
    if "<" in text or "[" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = plain_letters(text)
    if "http" in text or "www." in text:
        text = _LINK.sub(" ", text)
    if "'" in text or "’" in text:
        text = _SHORT_FORMS.sub(_long_form, text)
    return _TOKEN.findall(text)


class _Numbers(dict):
    """Token to symbol, filled as tokens occur."""

    def __init__(self, grammar: Grammar):
        super().__init__()
        self.grammar = grammar

    def __missing__(self, token: str) -> int:
        if len(self) >= MOST_TOKENS:
            self.clear()
        found = self[token] = self.grammar.number(token)
        return found


class Grammar:
    """The compiled machines; ``judge`` composes them over a text."""

    def __init__(self) -> None:
        self.classes, self.symbols = Classes(grammar.LEXICON), Symbols()
        trees = [(kind, weight, self._tree(text)) for kind, weight, text in grammar.PATTERNS]
        rules = [(self._tree(left), self._bits(lost), self._tree(right)) for _, left, lost, right in grammar.CONTEXTS]
        self.patterns, self.contexts = Patterns(trees, self.symbols), Contexts(rules, self.symbols)
        self.words = self._lexicon()
        self.ordinary = set(grammar.ORDINARY.split())
        arcs = {x: tuple((y, CODE_COST) for y in ys) for x, ys in CODED.items()}
        arcs |= {x: ((y, TWIN_COST),) for x, y in (LIKE | TWINS).items()}
        coded = self._bits(" ".join(grammar.DISGUISED))
        hidden = {w: bits for w, bits in self.words.items() if bits & coded and (len(w) > 2 or bits & self.classes.bits["YOU"])}
        hidden |= {w: self.classes.bits[name] for w, name in grammar.MASKED_PHRASES.items()}
        hidden |= {w: self.words[w] for w in map(plain_letters, self.classes.words) if len(w) > 3}
        self.hidden = hidden
        self.disguise = Disguise(hidden, arcs)
        self.numbers = _Numbers(self)

    def _tree(self, text: str) -> tuple:
        return parse(text, self.classes, grammar.MACROS)

    def _bits(self, names: str) -> int:
        out = 0
        for name in names.split():
            out |= self.classes.bits[name]
        return out

    def _lexicon(self) -> dict[str, int]:
        words: dict[str, int] = {}
        for name, text in grammar.LEXICON.items():
            for word in text.split():
                kind = next((kind for kind, names in INFLECTED.items() if name in names), None)
                for form in grammar.inflected(word, kind) if kind else [word]:
                    form = plain_letters(form)
                    words[form] = words.get(form, 0) | self.classes.bits[name]
        for word, bit in self.classes.words.items():
            words[plain_letters(word)] = words.get(plain_letters(word), 0) | bit
        return words

    def readings(self, token: str) -> tuple[Reading, ...]:
        """What a token may be: the lexical transducer."""
        known = self.words.get(token)
        if known is not None:
            return ((known, 0.0),)
        twin = token.translate(_TWINS)
        if twin in self.words:
            return ((self.words[twin], 0.0),)
        short = "".join(CODED.get(x, x)[0] for x in token)  # for words that aren't worth a disguise by themselves
        if len(token) < 4 and short in self.words and not token.isdigit():
            return ((self.words[short], -CODE_COST),)
        if token in self.ordinary or token.isdigit() or len(token) > 60:
            return ((0, 0.0),)
        for start, stop in ((token, token), (token.rstrip("!"), token.strip("*#!"))):
            found = self._undisguised(start) or (self._undisguised(stop) if stop != start else None)
            if found:
                return found
        return ((0, 0.0),)

    def _undisguised(self, token: str) -> tuple[Reading, ...] | None:
        if token in self.words:
            return ((self.words[token], 0.0),)
        if len(token) < 3:
            return None
        rank = self._rank
        best = self.disguise.read(token, rank)
        if best is None and len(token) > 4 and token[0] in "ai":
            best = self.disguise.read(token[1:], rank)  # a spaced-out word that took up the article before it
            if best is not None and best[0] not in self.hidden:
                best = None
        if best is None:
            return None
        word, weight = best
        if sum(x.isalpha() for x in token) < 2 and len(token) > 3 and not any(x.isalpha() for x in token[:1]):
            return None
        return ((self.hidden[word], weight),)

    def _rank(self, word: str) -> int:
        """Where a mask fits several words, the coarser one is meant."""
        order = ("BADNOUN", "BADNOUNS", "NUDE", "LEWD", "FUCK", "PORN", "HOT", "PARTS", "TRASH", "SCUM", "BADADJ", "PEST", "BADANIMAL", "CRIM")
        bits = self.hidden[word]
        return next((i for i, name in enumerate(order) if bits & self.classes.bits[name]), len(order))

    def number(self, token: str) -> int:
        """The symbol of a token."""
        first = token[0]
        if first == ",":
            return self.symbols.number(((COMMA, 0.0),))
        if first in "\r\n.!?;:…–—":
            return 0
        if len(token) > 2 and token[1] in " .-·":
            token = _SPACING.sub("", token)
        elif len(token) > 4 and token[::2].isalnum() and set(token[1::2]) in ({"*"}, {"_"}):
            token = token[::2]
        return self.symbols.number(self.readings(token))

    def judge(self, text: str) -> tuple[float, set[str]]:
        """(score of the worst clause, kinds of the patterns on its best path)."""
        symbols = [*map(self.numbers.__getitem__, tokens(text)), 0]
        row = self.patterns.begin
        total, begin, worst, why = 0.0, 0, 0.0, set()
        for at, symbol in enumerate(symbols):
            row, weight = row[symbol]
            if weight:
                total += weight
            if not symbol:
                # Context rules only take classes off, and no pattern asks for their absence: a clause that scores
                # nothing without the rules scores nothing with them.
                if total > worst:
                    bare = self.contexts.apply(symbols[begin:at])
                    score = self.patterns.score(bare)
                    if score > worst:
                        worst, why = score, self.patterns.found(bare)
                total, begin = 0.0, at + 1
        return round(worst, 3), why


@lru_cache(1)
def compiled() -> Grammar:
    """The machines, compiled once per process."""
    return Grammar()


def judge(text: str | None) -> tuple[float, list[str]]:
    """(score of the worst clause, sorted kinds of the patterns matched there); (0, []) for a text without any."""
    if not text:
        return 0.0, []
    score, kinds = compiled().judge(text)
    return score, sorted(kinds)


_JUDGED = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("kinds", T.ArrayType(T.StringType()))]
)


@F.arrow_udf(_JUDGED)
def judged(texts: pa.Array) -> pa.Array:
    rows = [judge(x) for x in texts.to_pylist()]
    return pa.StructArray.from_arrays(
        [pa.array([x[0] for x in rows], pa.float64()), pa.array([x[1] for x in rows], pa.list_(pa.string()))],
        names=["score", "kinds"],
    )


def scores(documents: DataFrame, keep: tuple[str | Column, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns, ``score, kinds`` of every document; 0 for null, empty and harmless texts.

    Each row is judged where it was read: nothing is shuffled, repeated rows come out repeated.
    """
    return documents.select(*keep, judged("text").alias("_j")).select(*_names(documents, keep), "_j.score", "_j.kinds")


def _names(documents: DataFrame, keep: tuple) -> list[str]:
    return documents.select(*keep).columns


def rates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, n_documents, n_abusive, rate`` per source; documents without source make the group null."""
    flag = (F.col("score") >= threshold).cast("long")
    sums = scores(documents, ("source",)).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(flag).alias("n_abusive")
    )
    return sums.withColumn("rate", F.col("n_abusive") / F.col("n_documents"))


def agreement(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``label, flagged, n`` of the labelled documents: how the score agrees with the raters."""
    flags = scores(documents, ("doc_id",)).select("doc_id", (F.col("score") >= threshold).alias("flagged"))
    return labels.select("doc_id", "label").join(flags, "doc_id").groupBy("label", "flagged").agg(
        F.count(F.lit(1)).alias("n")
    )
