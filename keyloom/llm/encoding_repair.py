"""Text decoded with the wrong character encoding (problem 3).

Names are cut into spans that hold all their characters beyond ASCII.  A smoothed character 3-gram model with back-off,
over letters and over coarse shapes (script and case), is trained on the clean spans.  Every chain "encode with the
wrong decoder, decode with the true encoding" gives a candidate; the likeliest is accepted if it beats the text as
it stands by more than the chain's margin.  Lost and control characters are judged the same way, against the text
without them.  Margins are validated on spans that the model has not seen, as they are and garbled by each chain: a
margin lies between what clean spans gain by the chain and what garbled ones do.

The n-gram tables are hashed into a fixed number of buckets, so the model's size has a bound that doesn't grow with
the data.  All spans take part in the counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.lookalikes import NOT_ASCII, script
from keyloom.runtime import cut

#: Buckets of each hashed n-gram table.
BUCKETS = 1 << 18
#: One span in so many, by hash, is held out to validate margins.
HELD_OUT = 20
#: Margins in nats of chains for which no held-out span tells one: from UTF-8, whose bytes prove themselves, and others.
UNTESTED_MARGIN, UNTESTED_LEGACY_MARGIN = 3.0, 10.0
#: At most this share of the held-out clean spans may pass a chain's margin, and fail it when garbled.
MISTAKES, MISSES = 0.001, 0.005

#: Decoders that are applied wrongly to UTF-8.
WRONG_FOR_UTF8 = (
    "latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866",
    "mac_roman", "koi8_r", "iso8859_2", "iso8859_15",
)
#: Other pairs (wrong decoder, true encoding).
LEGACY = tuple(
    (wrong, true)
    for wrong in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")
    for true in ("cp932", "euc_jp", "gbk", "big5", "cp949")
) + tuple(
    (wrong, true)
    for wrong in ("cp1252", "latin-1")
    for true in ("cp1251", "koi8_r", "cp866", "cp1253", "cp1250", "cp1254", "cp1255", "cp1256")
) + (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "cp1252"))
#: Bytes that a decoder of the cp1252 family or a clean-up may have turned into U+FFFD.
LOST_BYTES = bytes([0x81, 0x8D, 0x8F, 0x90, 0x9D, 0xA0, 0xAD])
LOST = "�"

_SPAN_COUNTS = pa.schema([("span", pa.string()), ("n", pa.int64())])
_MARGIN_COUNTS = pa.schema([("chain", pa.string()), ("garbled", pa.bool_()), ("over", pa.int64()), ("n", pa.int64())])
#: Chains that only tell that characters were lost or made controls.
LOST_CHAIN, CONTROL_CHAIN = "lost", "control"
_SEPARATORS = re.compile(r"([ \-.,()'\"0-9]+)")


@lru_cache(None)
def _byte_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for the C1 control of their number."""
    table = {}
    for code in range(256):
        char = bytes([code]).decode(encoding, "replace")
        table[chr(code) if char == LOST else char] = code
    return table


def _encode(text: str, encoding: str) -> bytes | None:
    table = _byte_of(encoding)
    try:
        return bytes([table[x] for x in text])
    except KeyError:
        return None


@lru_cache(65536)
def _is_junk(char: str) -> bool:
    """Controls, unassigned, private-use and lost characters don't occur in names."""
    return char == LOST or unicodedata.category(char) in ("Cc", "Cn", "Co", "Cs")


def _undone(text: str, chain: tuple[str, str]) -> str | None:
    wrong, true = chain
    data = _encode(text, wrong)
    if data is None:
        return None
    try:
        plain = data.decode(true)
    except UnicodeDecodeError:
        return None
    return None if plain == text else plain


@lru_cache(65536)
def _is_name_part(char: str) -> bool:
    """Letters, marks, digits and the few signs that names of any script use."""
    return char.isascii() or unicodedata.category(char)[0] in "LMN" or char in "・ー〜―–—‐’“”«»„"


_WORD = re.compile(r"[^\W\d_]+")


def _hangs_together(text: str) -> bool:
    """No word mixes alphabets, and no single East Asian character or pair is stuck to a Latin letter.

    Chains from legacy encodings change every letter beyond ASCII, so half-changed words are accidents.
    """
    for word in _WORD.findall(text):
        scripts = [script(x) for x in word]
        kinds = set(scripts) - {"none"}
        if len(kinds) > 1 and (kinds != {"latin", "east asian"} or scripts.count("east asian") < 3):
            return False
    return True


def untested_margin(chain: str) -> float:
    return UNTESTED_LEGACY_MARGIN if ">" in chain and "utf-8" not in chain else UNTESTED_MARGIN


def _decoded(data: bytes, encoding: str) -> str:
    """What a wrong decoder makes of bytes; those that it leaves undefined become controls."""
    return "".join(_char_of(encoding)[x] for x in data)


@lru_cache(None)
def _char_of(encoding: str) -> list[str]:
    return [char for char, _ in sorted(_byte_of(encoding).items(), key=lambda x: x[1])]


def garbled_by(text: str) -> dict[str, str]:
    """Chain name to what becomes of a text by its wrong decoder, for chains that change it and can be undone."""
    found = {}
    utf8 = text.encode("utf-8", "replace")
    for wrong in WRONG_FOR_UTF8:
        found[f"{wrong}>utf-8"] = _decoded(utf8, wrong)
    for wrong, true in LEGACY:
        try:
            found[f"{wrong}>{true}"] = _decoded(text.encode(true), wrong)
        except UnicodeEncodeError:
            continue
    lost = utf8.decode("cp1252", "replace")
    if LOST in lost:
        found[LOST_CHAIN] = lost
    if any("\x80" <= x < "\xa0" for x in found["latin-1>utf-8"]):
        found[CONTROL_CHAIN] = found["latin-1>utf-8"]
    return {chain: garbled for chain, garbled in found.items() if garbled != text}


def candidates(text: str) -> dict[str, str]:
    """Chain name to candidate of every chain that ends in a text without junk.

    Chains from UTF-8 are undone again and again, as long as they can; such a candidate is named by its last round.
    """
    found: dict[str, str] = {}
    if text.isascii():
        return found
    seen, todo = {text}, [text]
    while todo:  # each round leaves fewer bytes, so there is an end
        current = todo.pop()
        for wrong in WRONG_FOR_UTF8:
            plain = _undone(current, (wrong, "utf-8")) if not current.isascii() else None
            if plain is None:
                continue
            if not any(map(_is_junk, plain)):
                name = f"{wrong}>utf-8"
                while name in found and found[name] != plain:
                    name += "+"
                found[name] = plain
            if plain not in seen:
                seen.add(plain)
                todo.append(plain)
    # Spaces and invisible characters alone are no sign of a wrong decoder.
    if len(seen) == 1 and any(x > "\x7f" and unicodedata.category(x) not in ("Zs", "Cf") for x in text):
        for chain in LEGACY:
            plain = _undone(text, chain)
            if plain is not None and all(map(_is_name_part, plain)) and _hangs_together(plain):
                found[">".join(chain)] = plain
    for chain, bare in ((LOST_CHAIN, text.replace(LOST, "")), (CONTROL_CHAIN, _CONTROL.sub("", text))):
        if bare != text:
            found[chain] = bare
    return found


_CONTROL = re.compile("[\x80-\x9f]")
_CONTINUED = {**dict.fromkeys(range(0xC2, 0xE0), 1), **dict.fromkeys(range(0xE0, 0xF0), 2), **dict.fromkeys(range(0xF0, 0xF5), 3)}
#: Readings of a word with lost characters that are followed at once.
BEAM = 32


def refilled(text: str, model: NgramModel) -> str | None:
    """The likeliest reading of UTF-8 seen as cp1252 in which U+FFFD stands for one of the lost bytes; None without any.

    Each UTF-8 sequence is filled by itself, whatever their number; the model ranks the readings as they grow.
    """
    table = _byte_of("cp1252")
    data: list[int | None] = []
    for char in text:
        if char != LOST and char not in table:
            return None
        data.append(None if char == LOST else table[char])
    readings: list[tuple[float, tuple, str]] = [(0.0, _START, "")]
    at = 0
    while at < len(data):
        lead = data[at]
        size = 0 if lead is not None and lead < 0x80 else _CONTINUED.get(lead)
        if size is None or at + size >= len(data):
            return None
        options = set()
        for rest in product(*[LOST_BYTES if x is None else (x,) for x in data[at + 1 : at + 1 + size]]):
            try:
                options.add(bytes([lead, *rest]).decode("utf-8"))
            except UnicodeDecodeError:
                continue
        grown = []
        for char in sorted(x for x in options if not _is_junk(x)):
            for score, state, plain in readings:
                after, gain = model.step(state, char)
                grown.append((score + gain, after, plain + char))
        readings = sorted(grown, key=lambda x: (-x[0], x[2]))[:BEAM]
        at += 1 + size
    ends = [(score + model.step(state, None)[1], plain) for score, state, plain in readings]
    return max(ends)[1] if ends else None


def spans(name: str) -> list[str]:
    """Of each segment of a path, the part from its first to its last word with characters beyond ASCII."""
    found = []
    for segment in name.split("/"):
        if not segment.isascii():
            parts = _SEPARATORS.split(segment)
            marked = [i for i, x in enumerate(parts) if not x.isascii()]
            found.append("".join(parts[marked[0] : marked[-1] + 1]))
    return found


@lru_cache(65536)
def _shape(char: str) -> int:
    """Coarse class of a character, from 0 to 63."""
    if char.isascii():
        return 1 if char.islower() else 2 if char.isupper() else 3 if char.isdigit() else 4
    category = unicodedata.category(char)
    if category[0] == "L":
        known = ("latin", "cyrillic", "greek", "armenian", "east asian", "other", "none").index(script(char))
        if known == 4:
            return 40 + ("CJK" in unicodedata.name(char, "")) + 2 * ("HANGUL" in unicodedata.name(char, ""))
        if known == 5:
            return 44 + sum(map(ord, unicodedata.name(char, "?").split()[0])) % 16
        return 8 + 3 * known + (1 if category == "Lu" else 0)
    if category[0] == "M":
        return 5
    if category in ("So", "Sk") and (ord(char) >= 0x1F000 or 0x2600 <= ord(char) < 0x2800):
        return 6
    if category == "Cf":
        return 7
    if category == "Cc":
        return 60
    return 61 if category[0] == "P" else 62 if category[0] == "S" else 63


_FIRST, _LAST = 1, 2
_MIX = (2654435761, 2246822519, 3266489917)


_START = (_FIRST, _FIRST, 0, 0)


def _advance(state: tuple, char: str | None) -> tuple[tuple, tuple[int, int, int, int, int, int]]:
    """The state behind a character, None for the end, and the buckets of (char 3-gram, its context, char 2-gram, its
    context, char) and the shape 3-gram that it ends."""
    a, b, p, q = state
    c = _LAST if char is None else ord(char.lower()[0])
    r = 0 if char is None else _shape(char)
    pair, single = a * _MIX[0] ^ b * _MIX[1], b * _MIX[1] ^ 0x51ED
    return (b, c, q, r), (
        (pair ^ c * _MIX[2]) % BUCKETS, (pair + 77) % BUCKETS, (single ^ c * _MIX[0]) % BUCKETS, single % BUCKETS,
        c * _MIX[2] % BUCKETS, p << 12 | q << 6 | r,
    )


def _grams(text: str) -> Iterator[tuple[int, int, int, int, int, int]]:
    state = _START
    for char in [*text, None]:
        state, buckets = _advance(state, char)
        yield buckets


#: Tables of counts: 3-grams and 2-grams (contexts apart), single characters, shape 3-grams and shape 2-gram contexts.
TABLES = 7


def _count_into(counts: dict[tuple[int, int], float], text: str, weight: float) -> None:
    for tri, tri_context, bi, bi_context, one, shapes in _grams(text):
        for table, bucket in enumerate((tri, tri_context, bi, bi_context, one, shapes, shapes >> 6)):
            counts[table, bucket] = counts.get((table, bucket), 0.0) + weight


class NgramModel:
    """Smoothed log-likelihood of a text, from hashed counts ``tables[table][bucket]``."""

    def __init__(self, tables: np.ndarray):
        self.tables = [x.tolist() for x in tables]
        self.total = float(tables[4].sum())
        self.shapes = float(tables[6].sum())

    def _log(self, buckets: tuple[int, int, int, int, int, int]) -> float:
        tri, tri_context, bi, bi_context, one, shapes, shape_context = self.tables
        t, tc, b, bc, c, s = buckets
        p = (one[c] + 0.01) / (self.total + 0.01 * BUCKETS)
        p = (bi[b] + 2.0 * p) / (bi_context[bc] + 2.0)
        p = (tri[t] + 2.0 * p) / (tri_context[tc] + 2.0)
        return math.log(p * (shapes[s] + 0.02) / (shape_context[s >> 6] + 0.02 * 64))

    def score(self, text: str) -> float:
        return sum(map(self._log, _grams(text)))

    def step(self, state: tuple, char: str | None) -> tuple[tuple, float]:
        """The state behind one more character, and its log-likelihood."""
        state, buckets = _advance(state, char)
        return state, self._log(buckets)


@lru_cache(65536)
def _suspect(char: str) -> bool:
    """Latin letters beyond ASCII, and the signs that wrong decoders make."""
    code, category = ord(char), unicodedata.category(char)
    if category[0] == "L":
        return code > 0x7F and script(char) in ("latin", "none")
    return 0x80 <= code < 0x2600 and category[0] in "SPNC" and category != "Cf"


def is_clean(span: str) -> bool:
    """Can the span serve as a sample of right text?  Strict rather than complete."""
    if any(map(_is_junk, span)) or any(_suspect(x) and not x.isalpha() for x in span):
        return False
    run = 0
    for char in span:
        run = run + 1 if _suspect(char) else 0
        if run > 2:
            return False
    return not any(_undone(span, (wrong, "utf-8")) is not None for wrong in WRONG_FOR_UTF8)


def span_counts(names: DataFrame, column: str) -> DataFrame:
    """``span, n``: distinct spans of a column of names, and in how many rows each occurs; combined before the shuffle."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def combined() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"span": list(counts.keys()), "n": list(counts.values())}, _SPAN_COUNTS)

        for batch in batches:
            for found in batch.column(0).value_counts().to_pylist():
                for span in spans(found["values"]):
                    counts[span] += found["counts"]
            if len(counts) > 200_000:
                yield combined()
                counts.clear()
        yield combined()

    marked = names.select(column).where(F.col(column).rlike(NOT_ASCII))
    return marked.mapInArrow(emit, "span string, n long").groupBy("span").agg(F.sum("n").alias("n"))


def _held_out(span: str) -> bool:
    return sum(span.casefold().encode()) % HELD_OUT == 0


def _ngram_counts(clean_spans: DataFrame) -> np.ndarray:
    """Counts ``[held out][table][bucket]`` of the clean spans, combined per task before they are shuffled."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[dict, dict] = ({}, {})
        for batch in batches:
            for span, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if is_clean(span):
                    _count_into(counts[_held_out(span)], span, 1.0 + math.log2(n))
        for part in (0, 1):
            keys = np.array(list(counts[part].keys()), dtype=np.int64).reshape(-1, 2)
            at = (part * TABLES + keys[:, 0]) * BUCKETS + keys[:, 1]
            sums = np.array(list(counts[part].values()), dtype=np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums)], ["at", "n"])

    sums = clean_spans.mapInArrow(emit, "at long, n double").groupBy("at").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()  # at most 2 * TABLES * BUCKETS rows, whatever the data
    counts = np.zeros(2 * TABLES * BUCKETS, dtype=np.float32)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return counts.reshape(2, TABLES, BUCKETS)


def _margins(clean_spans: DataFrame, model_of) -> dict[str, float]:
    """Margin of each chain from the held-out clean spans.

    Of what these gain as they are, at most the share MISTAKES lies beyond the margin; of what they gain when garbled by
    the chain, at most MISSES lies below, if both can be had.  It is set halfway between the two bounds.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bins = model_of(), Counter()
        for batch in batches:
            for span in batch.column(0).to_pylist():
                if _held_out(span) and is_clean(span):
                    stands = model.score(span)
                    bins["", False, 0] += 1
                    for chain, plain in candidates(span).items():
                        bins[chain.rstrip("+"), False, math.ceil(max(0.0, model.score(plain) - stands))] += 1
                    for chain, garbled in garbled_by(span).items():
                        bare = {LOST_CHAIN: garbled.replace(LOST, ""), CONTROL_CHAIN: _CONTROL.sub("", garbled)}.get(chain)
                        plain = stands if bare is None else model.score(bare)
                        bins[chain, True, math.floor(plain - model.score(garbled))] += 1
        rows = [{"chain": chain, "garbled": garbled, "over": over, "n": n} for (chain, garbled, over), n in bins.items()]
        yield pa.RecordBatch.from_pylist(rows, _MARGIN_COUNTS)

    parts = clean_spans.mapInArrow(emit, "chain string, garbled boolean, over long, n long")
    # Chains times gains in whole nats: bounded by the length of names, not by their number.
    rows = parts.groupBy("chain", "garbled", "over").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in rows if not r.chain)

    def bound(chain: str, garbled: bool, allowed: float) -> float | None:
        """The gain that is passed by the allowed number of clean spans, or not reached by that of garbled ones."""
        found = sorted(((r.over, r.n) for r in rows if r.chain == chain and r.garbled == garbled), reverse=not garbled)
        for over, n in found:
            allowed -= n
            if allowed < 0:
                return float(over)
        return None

    margins: dict[str, float] = {}
    for chain in {r.chain for r in rows if r.chain}:
        n_garbled = sum(r.n for r in rows if r.chain == chain and r.garbled)
        clean, wrong = bound(chain, False, MISTAKES * total) or 0.0, bound(chain, True, MISSES * n_garbled)
        if wrong is not None and wrong > clean:
            margins[chain] = (clean + wrong) / 2
        else:
            margins[chain] = max(clean, untested_margin(chain))
    return margins


class EncodingRepair:
    """A fitted model; ``judge`` tells for one span or name whether it is garbled, and what it was."""

    def __init__(self, counts: np.ndarray, margins: dict[str, float]):
        self.counts, self.margins = counts, margins
        self._model: NgramModel | None = None
        self._known: dict[str, tuple[bool, str | None]] = {}

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "margins": self.margins, "_model": None, "_known": {}}

    @property
    def model(self) -> NgramModel:
        if self._model is None:
            self._model = NgramModel(self.counts)
        return self._model

    def _judge(self, span: str) -> tuple[bool, str | None]:
        words = _SEPARATORS.split(span)
        if len(words) > 1 and LOST in span:  # words are filled each by itself
            return self._by_words(words)
        stands, best = self.model.score(span), None
        for chain, plain in candidates(span).items():
            gain = self.model.score(plain) - stands
            name = chain.rstrip("+")
            if gain > self.margins.get(name, untested_margin(name)):
                told = None if name in (LOST_CHAIN, CONTROL_CHAIN) else plain
                rank = (told is not None, gain)
                if best is None or rank > best[0]:
                    best = rank, told
        if best is not None:
            return True, best[1] if best[1] is not None or LOST not in span else refilled(span, self.model)
        return self._by_words(words) if len(words) > 1 else (False, None)

    def _by_words(self, words: list[str]) -> tuple[bool, str | None]:
        judged = [(x, self.judge_span(x)) for x in words]
        if not any(bad for _, (bad, _) in judged):
            return False, None
        parts = [plain if bad else x for x, (bad, plain) in judged]
        return True, None if None in parts else "".join(parts)

    def judge_span(self, span: str) -> tuple[bool, str | None]:
        """(garbled, original or None where it can't be told) of a span."""
        if span.isascii():
            return False, None
        known = self._known.get(span)
        if known is None:
            if len(self._known) > 200_000:
                self._known.clear()
            known = self._known[span] = self._judge(span)
        return known

    def judge(self, name: str) -> tuple[bool, str | None]:
        """The same of a whole name; the original is told only if that of every garbled span is."""
        if name.isascii():
            return False, None
        garbled, told, out = False, True, []
        for segment in name.split("/"):
            for span in spans(segment):
                bad, plain = self.judge_span(span)
                garbled = garbled or bad
                if bad and plain is None:
                    told = False
                elif bad:
                    segment = segment.replace(span, plain, 1)
            out.append(segment)
        return garbled, "/".join(out) if garbled and told else None


def fit(names: DataFrame, column: str) -> EncodingRepair:
    """Train on the clean spans of all values of a column and validate the margins.

    Null and ASCII values have no spans.  Without any span, as in an empty table, the model is empty and chains keep
    the margins of untested ones.
    """
    counted = cut(span_counts(names, column))
    counts = _ngram_counts(counted)
    context = names.sparkSession.sparkContext
    seen = context.broadcast(counts[0])  # 7 tables of BUCKETS floats

    def model_of() -> NgramModel:
        return NgramModel(seen.value)

    return EncodingRepair(counts.sum(axis=0), _margins(counted, model_of))


def repair(table: DataFrame, column: str, fitted: EncodingRepair | None = None) -> DataFrame:
    """Rows of ``table`` whose ``column`` is garbled, with the column ``<column>_original``.

    The original is null where it can no longer be told.  Nulls and empty texts are never garbled.  Repeated rows come
    out repeated; a column of that name in the input is replaced.  No row moves: each is judged where it was read.
    """
    fitted = fitted or fit(table, column)
    shared = table.sparkSession.sparkContext.broadcast(fitted)

    @F.arrow_udf("struct<garbled:boolean,original:string>")
    def judged(values: pa.Array) -> pa.Array:
        names = values.to_pylist()
        known = {x: shared.value.judge(x) for x in set(names)}
        garbled = pa.array([known[x][0] for x in names], type=pa.bool_())
        return pa.StructArray.from_arrays(
            [garbled, pa.array([known[x][1] for x in names], type=pa.string())], names=["garbled", "original"]
        )

    marked = table.where(F.col(column).rlike(NOT_ASCII)).withColumn("_judged", judged(column))
    found = marked.where(F.col("_judged.garbled"))
    return found.withColumn(f"{column}_original", F.col("_judged.original")).drop("_judged")


def garbled_flag(table: DataFrame, fitted: EncodingRepair):
    """A function that gives the column "is this name garbled" for a column name; for values beyond ASCII only."""
    shared = table.sparkSession.sparkContext.broadcast(fitted)

    @F.arrow_udf("boolean")
    def flag(values: pa.Array) -> pa.Array:
        names = values.to_pylist()
        known = {x: x is not None and shared.value.judge(x)[0] for x in set(names)}
        return pa.array([known[x] for x in names], type=pa.bool_())

    return flag
