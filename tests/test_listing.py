"""Listings, cursors, counts and lookups, with counts and payloads asserted."""

import json

import pytest
from conftest import tagged
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.model import COMMON_PREFIX, KEY, CursorError, ListQuery, SearchFilter, TagFilter
from keyloom.operators import listing, lookup
from keyloom.plans.database import make_query


def shown(df):
    return [(r.entry, r.child_count) for r in df.collect()]


def names(df):
    return [r.entry for r in df.collect()]


def brute(shards, prefix, delimiter):
    """The listing in plain Python."""
    counts, kinds = {}, {}
    for shard in shards:
        for key in shard:
            if key.startswith(prefix):
                at = key.find(delimiter, len(prefix)) if delimiter else -1
                entry = key if at < 0 else key[: at + 1]
                kind = KEY if at < 0 else COMMON_PREFIX
                counts[entry, kind] = counts.get((entry, kind), 0) + 1
                kinds[entry, kind] = kind
    found = sorted(counts, key=lambda x: x[0].encode())
    return [(entry, kind, counts[entry, kind] if kind == COMMON_PREFIX else None) for entry, kind in found]


def test_group_and_key(database):
    db = database(["foo/bar", "foo/baz", "foobar"])
    assert shown(db.list("foo", "/")) == [("foo/", 2), ("foobar", None)]


def test_byte_order(database):
    db = database(["d", "a", "c", "b", "￮", "\U0001f600"])
    assert names(db.list()) == ["a", "b", "c", "d", "￮", "\U0001f600"]


def test_child_counts(database):
    db = database(["a/1", "a/2/x", "a/2/y", "a/2/z", "b/1", "b/2"])
    assert shown(db.list("", "/")) == [("a/", 4), ("b/", 2)]
    assert shown(db.list("a/", "/")) == [("a/1", None), ("a/2/", 3)]


def test_groups_count_every_shard_and_keys_appear_once(database):
    db = database(["a/1", "a/2", "b/1"], ["a/1", "a/3", "c/1"])
    assert shown(db.list("", "/")) == [("a/", 4), ("b/", 1), ("c/", 1)]
    assert names(db.list("a/")) == ["a/1", "a/2", "a/3"]
    assert len(db) == 6


def test_first_shard_wins(database):
    db = database(
        [("alpha/a", "1"), ("alpha/b", "2"), ("beta/x", '"x"')],
        [("alpha/b", "20"), ("delta", "[3,4]"), ("gamma/z", "true")],
    )
    rows = {r.entry: (r.shard, json.loads(r.payload)) for r in db.list().collect()}
    assert rows["alpha/b"] == (0, 2) and len(rows) == 5
    assert shown(db.list("", "/")) == [("alpha/", 3), ("beta/", 1), ("delta", None), ("gamma/", 1)]
    assert db.get_value("alpha/b") == 2 and db.get_value("delta") == [3, 4] and db.get_value("none") is None


def test_value_of_the_first_shard_that_has_one(database):
    db = database([("k", None)], [("k", "7")])
    assert db.get_value("k") == 7


def test_deep_prefix(database):
    db = database(["foo/a/1", "foo/a/2", "foo/b/1"], ["foo/a/3/x", "foo/c/1"])
    assert shown(db.list("foo/", "/")) == [("foo/a/", 3), ("foo/b/", 1), ("foo/c/", 1)]
    assert shown(db.list("foo/a/", "/")) == [("foo/a/1", None), ("foo/a/2", None), ("foo/a/3/", 1)]


@pytest.mark.parametrize("prefix", ["aaaaa", "zzz", "bbb"])
def test_no_match_is_empty(database, prefix):
    assert names(database(["aaaab", "b", "c", "d"]).list(prefix)) == []


def test_unicode_keys_and_prefix_length_in_characters(database):
    db = database(["こん", "こんにちは", "こんばんは", "é/x", "é/y/z"])
    assert len(names(db.list("こん"))) == 3
    assert shown(db.list("é/", "/")) == [("é/x", None), ("é/y/", 1)]


def test_empty_key_and_empty_database(database):
    assert names(database(["", "a"]).list()) == ["", "a"]
    empty = database(["x"])
    empty.entries = empty.entries.where("false")
    assert names(empty.list()) == [] and names(empty.list("", "/")) == []


def test_kinds(database):
    db = database(["a/1", "b", "c/1"])
    assert names(db.list("", "/", kind=KEY)) == ["b"]
    assert names(db.list("", "/", kind=COMMON_PREFIX)) == ["a/", "c/"]
    with pytest.raises(ValueError):
        ListQuery(kind="other")
    with pytest.raises(ValueError):
        ListQuery(delimiter="é")


def test_flat_cursor(database):
    db = database(["aa", "ac", "ad"], ["ab", "ae", "af"])
    assert names(db.list(cursor="ab")) == ["ac", "ad", "ae", "af"]
    assert names(db.list(cursor="aa~")) == ["ab", "ac", "ad", "ae", "af"]  # a cursor that is no entry
    assert names(db.list(cursor="a")) == ["aa", "ab", "ac", "ad", "ae", "af"]  # backwards


def test_grouped_cursor(database):
    db = database(["pre/a/1", "pre/b/2", "pre/c/3"])
    assert names(db.list("pre/", "/", cursor="pre/a/")) == ["pre/b/", "pre/c/"]
    assert names(db.list("pre/", "/", cursor="pre/b/")) == ["pre/c/"]


def test_cursor_below_a_key_that_prefixes_it_does_not_repeat_the_key(database):
    db = database(["assets/", "assets/file1.pdf", "assets/file2.pdf", "b"])
    assert names(db.list(cursor="assets/file1.pdf")) == ["assets/file2.pdf", "b"]


def test_bound_jumps_behind_a_finished_group():
    assert listing.key_bound(ListQuery("p/", "/", cursor="p/a/")) == "p/a0"
    assert listing.key_bound(ListQuery("p/", "/", cursor="p/a")) == "p/a"
    assert listing.key_bound(ListQuery("p/", cursor="p/a/")) == "p/a/"
    assert listing.key_bound(ListQuery("p/")) is None


KEYS = st.lists(st.text(alphabet="ab/é\U0001f600", max_size=6), unique=True, max_size=12)


@settings(max_examples=12, deadline=None)
@given(st.lists(KEYS, min_size=1, max_size=3), st.sampled_from(["", "a", "a/", "/"]), st.sampled_from([None, "/"]))
def test_listing_equals_the_model_and_pages_join_up(database, shards, prefix, delimiter):
    if not any(shards):
        shards = [["a"]]
    db = database(*shards, tags=False)
    full = [(r.entry, r.kind, r.child_count) for r in db.list(prefix, delimiter).collect()]
    assert full == brute(shards, prefix, delimiter)
    paged = [r.entry for page in db.pages(ListQuery(prefix, delimiter), limit=3) for r in page]
    assert paged == [x[0] for x in full]


def test_page_envelope(database):
    db = database([("a/1", None), ("b", '{"x":1}'), ("c", None)])
    first = db.keys_page(ListQuery("", "/"), limit=2)
    assert first["items"] == [
        {"key": "a/", "type": COMMON_PREFIX, "count": 1},
        {"key": "b", "type": KEY, "payload": {"x": 1}},
    ]
    second = db.keys_page(ListQuery("", "/"), limit=2, cursor=first["next_cursor"])
    assert second == {"items": [{"key": "c", "type": KEY}], "next_cursor": None}
    with pytest.raises(CursorError):
        db.keys_page(ListQuery(), cursor="not base64!")
    with pytest.raises(ValueError):
        db.keys_page(ListQuery(), limit=0)


def test_full_last_page_has_a_cursor_to_an_empty_one(database):
    db = database(["a", "b"])
    page = db.keys_page(ListQuery(), limit=2)
    assert page["next_cursor"] is not None
    assert db.keys_page(ListQuery(), limit=2, cursor=page["next_cursor"]) == {"items": [], "next_cursor": None}


def test_ids_and_lookups(database):
    db = database(["banana", "apple"], ["daikon", "carrot"])
    assert db.get_key(0, 1) == "apple" and db.get_key(1, 1) == "carrot"
    assert db.get_key(99, 1) is None and db.get_key(0, 0) is None
    found = lookup.entries_by_ids(db.entries, 1, [2, 9, 1, 2]).orderBy("position").collect()
    assert [(r.position, r.key) for r in found] == [(0, "daikon"), (2, "carrot"), (3, "daikon")]


def test_shard_statistics(database):
    db = database(["prefix/one", "prefix/two"], ["こんにちは", "こんばんは"], ["only"], ["a", "ab"])
    stats = {r.shard: (r.n_keys, r.common_prefix) for r in db.shards().collect()}
    assert stats == {0: (2, "prefix/"), 1: (2, "こん"), 2: (1, "only"), 3: (2, "a")}
    assert {r.shard for r in lookup.candidate_shards(db.manifest, "prefix/t").collect()} == {0}
    assert {r.shard for r in lookup.candidate_shards(db.manifest, "").collect()} == {0, 1, 2, 3}
    assert db.has_prefix("こんば") and not db.has_prefix("zz")


def test_candidate_shards_of_many_prefixes(spark):
    own = ["", "a", "ab", "abc", "abd", "b", "prefix/", "prefix/deep"]
    manifest = spark.createDataFrame(list(enumerate(own)), "shard int, common_prefix string")
    found = lambda p: {r.shard for r in lookup.candidate_shards(manifest, p).collect()}
    assert found("ab") == {0, 1, 2, 3, 4} and found("prefix/") == {0, 6, 7} and found("xyz") == {0}


def test_custom_filters(database, spark):
    db = database(["aa", "bb", "cc"])
    ids = spark.createDataFrame([(0, 2)], "shard int, id long")
    assert names(db.list(custom=(ids,))) == ["bb"]
    assert names(db.list(custom=(lambda e: e["key"] != "bb",))) == ["aa", "cc"]
    assert names(db.list(custom=(ids, lambda e: e["key"] != "bb"))) == []


def test_request_lists():
    query = make_query("p", "/", " a, ,b ", "c", "or", "x,", "")
    assert query.tags == TagFilter(("a", "b"), ("c",), "or") and query.search == SearchFilter(("x",), ())
    with pytest.raises(ValueError):
        make_query(mode="xor")


def test_adding_a_database_keeps_precedence(database):
    one, two = database([("k", "1")]), database([("k", "2"), ("l", tagged("t"))])
    both = one.add(two)
    assert {r.entry: r.shard for r in both.list().collect()} == {"k": 0, "l": 1}
    assert names(both.list(tags=TagFilter(("t",)))) == ["l"]


def test_prefix_and_cursor_reach_the_scan(spark, database, tmp_path):
    path = str(tmp_path / "entries")
    database(["a/1", "b/1"]).entries.write.parquet(path)
    query = ListQuery("a/", "/", cursor="a/0", payload=False)
    plan = listing.list_entries(spark.read.parquet(path), None, query)._jdf.queryExecution().toString()
    assert "StringStartsWith(key,a/)" in plan and "GreaterThanOrEqual(key,a/0)" in plan
    scan = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "payload" not in scan.split("ReadSchema")[1]
