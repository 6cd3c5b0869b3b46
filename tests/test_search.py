"""Substring search over keys: folding, accents, grapheme clusters, short terms."""

from collections import Counter

import pytest
from conftest import tagged
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import text
from keyloom.model import SearchFilter, TagFilter
from keyloom.operators.gram_index import build_grams, gram_candidates
from keyloom.queries_index import QUERIES


def names(db, include=(), exclude=(), **options):
    include = (include,) if isinstance(include, str) else tuple(include)
    return [r.entry for r in db.list(search=SearchFilter(include, tuple(exclude)), **options).collect()]


def holds(key, term):
    """The rule for one key and term in plain Python."""
    norm, q = text.normalize(key), text.normalize(term)
    strip = text.strip_accents(norm)
    have = set(text.grams(norm)) | set(text.grams(strip))
    if not q:
        return False
    if len(text.graphemes(q)) >= 3:
        candidate = set(text.grams(q)) <= have
    else:
        candidate = any(q in g.rstrip("\0") for g in have)
    return candidate and (q in norm or text.strip_accents(q) in strip)


def test_any_case(database):
    assert len(names(database(["HelloWorld", "helloworld", "HELLOWORLD", "other"]), "helloWORLD")) == 3


def test_under_a_prefix(database):
    db = database(["foo/bar", "foo/baz", "bar/foo", "baz/bar"])
    assert len(names(db, "bar")) == 3 and names(db, "bar", prefix="foo/") == ["foo/bar"]


def test_short_terms(database):
    db = database(["image001.jpg", "image002.jpg", "photo.png", "document.pdf", "script.js", "style.css"])
    assert names(db, "pg") == ["image001.jpg", "image002.jpg"]
    assert names(db, "ng") == ["photo.png"] and len(names(db, "j")) == 3 and names(db, "") == []


def test_accents_are_asymmetric(database):
    db = database(["café", "cafe", "naïve", "résumé"])
    assert names(db, "cafe") == ["cafe", "café"] and names(db, "café") == ["café"]
    assert names(db, "résu") == ["résumé"] and names(db, "résume") == ["résumé"]


def test_compatibility_forms(database):
    db = database(["ﬁle", "ﬂower", "ＨＥＬＬＯ", "ΣΟΦΟΣ"])
    assert names(db, "file") == ["ﬁle"] and names(db, "hello") == ["ＨＥＬＬＯ"] and names(db, "flower") == ["ﬂower"]
    assert names(db, "φος") == [] and names(db, "φοσ") == ["ΣΟΦΟΣ"]


@pytest.mark.parametrize("key", ["👨‍👩‍👧 family", "🇯🇵 flag", "👋🏽 wave", "שלום", "z̷a̷lgo", "zero​width"])
def test_clusters_find_themselves(database, key):
    assert names(database([key, "other"]), key) == [key]


def test_several_terms(database):
    db = database(["good_apple", "bad_apple", "apple_pie", "apple_juice_bad_taste"])
    assert names(db, ["apple"], ["bad"]) == ["apple_pie", "good_apple"]
    assert names(db, ["apple", "pie"]) == ["apple_pie"]
    assert names(db, (), ["apple_"]) == ["bad_apple", "good_apple"]  # exclusion alone keeps the others


def test_with_tags_and_groups(database):
    db = database(
        [("docs/private/readme.md", tagged("private")), ("docs/public/guide.md", tagged("public", "tutorial")),
         ("docs/public/readme.md", tagged("public")), ("docs/public/readme.txt", tagged("other"))]
    )
    assert names(db, "readme", prefix="docs/", tags=TagFilter(("public",))) == ["docs/public/readme.md"]
    grouped = db.list("docs/", "/", search=SearchFilter(("readme",))).collect()
    assert [(r.entry, r.child_count) for r in grouped] == [("docs/private/", 1), ("docs/public/", 2)]


#: (key, tags) of two shards that share a key; most of them aren't plain.
MIXED = [
    [("/opt/builds/ａｐｐ/Main.JSON", ["indexed"]), ("/opt/builds/app/ínner", ["Indexed"]), ("/opt/builds/app/in", ["indexed", "shared"]),
     ("/opt/builds/ﬁn", ["indexed"]), ("/opt/builds/scrípt/in", ["indexed"]), ("/opt/ﬁn/in", ["indexed"]), ("x", []),
     ("/b/báck.json", []), ("/b/BACK.ｊｓｏｎ", []), ("/b/back.json", []), ("/b/back/cátalog.json", []), ("/b/bac.json", [])],
    [("/opt/builds/é/ín", ["indexed"]), ("/opt/builds/é/i n", ["indexed"]), ("/opt/builds/é/plain", ["indexed"]), ("/opt/builds/app/ínner", ["indexed"]),
     ("/b/bäck/ñ.json", []), ("/b/BÄCKUP.Json👋", [])],
]


@pytest.fixture(scope="module")
def mixed(database, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("mixed"))
    db = database(*[[(key, tagged(*labels)) for key, labels in shard] for shard in MIXED])
    db.entries.write.parquet(f"{folder}/entries.parquet")
    db.tags.write.parquet(f"{folder}/tags.parquet")
    return folder


def lacks(key, term):
    norm, q = text.normalize(key), text.normalize(term)
    return q not in norm and text.strip_accents(q) not in text.strip_accents(norm)


def test_query_of_terms_over_all_keys(spark, mixed):
    want = sorted((n, k) for n, shard in enumerate(MIXED) for k, _ in shard if holds(k, "BACK") and holds(k, "json") and lacks(k, "catalog"))
    found = QUERIES["search_terms"](spark, mixed).collect()
    assert sorted((r.shard, r.key) for r in found) == want and sum(not k.isascii() for _, k in want) == 4


def test_query_of_gram_counts_over_all_keys(spark, mixed):
    norms = [text.normalize(k) for shard in MIXED for k, _ in shard]
    want = Counter(g for x in norms for g in {*text.grams(x), *text.grams(text.strip_accents(x))})
    assert {r.gram: r.n_keys for r in QUERIES["gram_counts"](spark, mixed).collect()} == want and want["x\0\0"] == 1


def test_composed_query_over_all_keys(spark, mixed):
    prefix, want = "/opt/builds/", {}
    for n, shard in enumerate(MIXED):
        for key, labels in shard:
            labels = {x.lower() for x in labels}
            if key.startswith(prefix) and "indexed" in labels and "shared" not in labels and holds(key, "in") and lacks(key, "script"):
                head, slash, _ = key[len(prefix) :].partition("/")
                entry = (prefix + head + slash, "CommonPrefix" if slash else "Key")
                count, shards = want.get(entry, (0, []))
                want[entry] = (count + 1, [*shards, n])
    found = {(r.entry, r.kind): (r.child_count, r.shard) for r in QUERIES["composed_tag_search_group"](spark, mixed).collect()}
    assert found == {e: (n, None) if e[1] == "CommonPrefix" else (None, min(shards)) for e, (n, shards) in want.items()}
    assert found["/opt/builds/app/", "CommonPrefix"] == (2, None) and len(found) == 4


def test_grams():
    assert text.grams("hello") == ["hel", "ell", "llo"] and text.grams("aaaa") == ["aaa"]
    assert text.grams("ab") == ["ab\0"] and text.grams("") == [] and len(text.grams("hi👋bye")) == 4
    assert len(text.grams("🇯🇵abc")) == 2


ALPHABET = "abcé́ﬁ👋‍🇯🇵ΣςK世"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=7), min_size=1, max_size=8, unique=True), st.text(ALPHABET, max_size=4))
def test_search_equals_the_model(database, keys, term):
    db = database(keys, tags=False)
    assert set(names(db, term)) == {k for k in keys if holds(k, term)}


def test_gram_expression_equals_the_function(spark):
    values = ["", "a", "ab", "abc", "hello", "aaaa", "👨‍👩‍👧xyz", "🇯🇵abc", "é́bc", "\r\nab"]
    values += ["दस्तावेज", "चित्र-1", "रिपोर्ट", "क्‍ष", "ক্ষমা", "తెలుగు క్ష", "കേരളം ന്ത"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.gram_array(F.col("v")).alias("g"))
    assert {r.v: r.g for r in df.collect()} == {v: text.grams(v) for v in values}


def test_candidates(database):
    db = database(["cafe", "café", "zebra", "ab"])
    postings = build_grams(db.entries)
    keys = {(r.shard, r.id): r.key for r in db.entries.collect()}
    found = lambda t: {keys[r.shard, r.id] for r in gram_candidates(postings, t).collect()}
    assert found("cafe") == {"cafe", "café"} and found("café") == {"café"} and found("b") == {"zebra", "ab"}
    assert found("") == set()
