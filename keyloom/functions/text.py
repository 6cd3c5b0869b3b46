"""Text functions behind substring search: normal form, accents, grapheme clusters and their 3-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pads the only gram of a text with fewer than three grapheme clusters.
PAD = "\0"
GRAM = 3


def normalize(text: str) -> str:
    """NFKC, then each character in lower case by itself, so a final sigma stays an ordinary one."""
    return "".join(c.lower() for c in unicodedata.normalize("NFKC", text))


def strip_accents(text: str) -> str:
    """The text without combining marks, in compatibility form."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    return unicodedata.normalize("NFKC", bare)


def graphemes(text: str) -> list[str]:
    return regex.findall(r"\X", text)


def grams(text: str) -> list[str]:
    """Distinct 3-grams over grapheme clusters; one padded gram for a shorter text, none for an empty one."""
    parts = graphemes(text)
    if not parts:
        return []
    if len(parts) < GRAM:
        return ["".join(parts) + PAD * (GRAM - len(parts))]
    return list(dict.fromkeys("".join(parts[i : i + GRAM]) for i in range(len(parts) - GRAM + 1)))


#: A grapheme cluster for the JVM, whose ``\\X`` parts conjuncts of Indic scripts: a letter behind a virama goes with it.
_VIRAMA = r"\u094D\u09CD\u0ACD\u0B4D\u0C4D\u0D4D"
_CONSONANT = (
    r"\u0915-\u0939\u0958-\u095F\u0978-\u097F\u0995-\u09A8\u09AA-\u09B0\u09B2\u09B6-\u09B9\u09DC\u09DD\u09DF\u09F0\u09F1"
    r"\u0A95-\u0AA8\u0AAA-\u0AB0\u0AB2\u0AB3\u0AB5-\u0AB9\u0AF9\u0B15-\u0B28\u0B2A-\u0B30\u0B32\u0B33\u0B35-\u0B39\u0B5C\u0B5D\u0B5F\u0B71"
    r"\u0C15-\u0C28\u0C2A-\u0C39\u0C58-\u0C5A\u0D15-\u0D3A"
)
CLUSTER = rf"(?s)((?:\X(?<=[{_VIRAMA}][\u200D\u093C\u09BC\u0ABC\u0B3C]{{0,2}})(?=[{_CONSONANT}]))*\X)"

_FORMS = T.StructType([T.StructField("norm", T.StringType()), T.StructField("strip", T.StringType())])
NOT_ASCII = r"[^\x00-\x7F]"


def _forms(texts: pa.Array) -> pa.Array:
    norms = [None if x is None else normalize(x) for x in texts.to_pylist()]
    strips = [None if x is None else strip_accents(x) for x in norms]
    return pa.StructArray.from_arrays([pa.array(norms, pa.string()), pa.array(strips, pa.string())], ["norm", "strip"])


def search_forms(text: Column) -> Column:
    """``struct(norm, strip)`` of a text.  ASCII texts stay in the JVM; others go to Python in Arrow batches."""
    ascii_only = ~text.rlike(NOT_ASCII)
    lower = F.lower(text)
    return F.when(ascii_only, F.struct(lower.alias("norm"), lower.alias("strip"))).otherwise(
        F.arrow_udf(_forms, _FORMS)(F.when(~ascii_only, text))
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def gram_array(text: Column) -> Column:
    """``grams`` of a text column, by built-in expressions."""

    def of(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - (GRAM - 1), F.lit(1)))
        whole = F.transform(starts, lambda i: F.array_join(F.slice(parts, i, GRAM), ""))
        short = F.array(F.concat(F.array_join(parts, ""), F.repeat(F.lit(PAD), F.lit(GRAM) - F.size(parts))))
        none = F.array().cast("array<string>")
        return F.when(F.size(parts) == 0, none).when(F.size(parts) < GRAM, short).otherwise(F.array_distinct(whole))

    # In plain text every character is a cluster, so its grams are cut without a regular expression.
    windows = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    plain = F.array_distinct(F.transform(windows, lambda i: F.substr(text, i, F.lit(GRAM))))
    clusters = bind(F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(1)), of)
    return F.when(text.rlike(r"\A[\x20-\x7E]{3,}\z"), plain).otherwise(clusters)


def key_grams(forms: Column) -> Column:
    """Grams that an entry is found by: those of its normal form and of its form without accents."""
    both = F.array_union(gram_array(forms["norm"]), gram_array(forms["strip"]))
    return F.when(forms["norm"] == forms["strip"], gram_array(forms["norm"])).otherwise(both)
