"""Tags: extraction, histogram, filters."""

import json

from conftest import tagged

from keyloom.model import ListQuery, TagFilter
from keyloom.operators import tag_index


def counts(db, prefix=""):
    return [(r["tag"], r["count"]) for r in db.list_tags(prefix).collect()]


def names(db, include=(), exclude=(), mode="and", **options):
    return [r.entry for r in db.list(tags=TagFilter(tuple(include), tuple(exclude), mode), **options).collect()]


def test_histogram_and_prefix(database):
    db = database(
        [("fruits/apple", tagged("fruit", "red")), ("fruits/banana", tagged("fruit", "yellow")),
         ("vegetables/carrot", tagged("vegetable", "orange"))]
    )
    assert counts(db) == [("fruit", 2), ("orange", 1), ("red", 1), ("vegetable", 1), ("yellow", 1)]
    assert counts(db, "fruits/") == [("fruit", 2), ("red", 1), ("yellow", 1)]


def test_histogram_over_shards(database):
    db = database(
        [("foo", tagged("tag1", "common")), ("bar", tagged("tag1", "tag2"))],
        [("baz", tagged("tag2", "common")), ("qux", tagged("tag3"))],
    )
    assert counts(db) == [("common", 2), ("tag1", 2), ("tag2", 2), ("tag3", 1)]


def test_case_folds_and_the_first_spelling_shows(database):
    db = database(
        [("entry1", tagged("Rust", "JavaScript")), ("entry2", tagged("RUST", "python")),
         ("entry3", tagged("rust", "Python", "RuSt"))]
    )
    assert counts(db) == [("JavaScript", 1), ("python", 2), ("Rust", 3)]


def test_only_strings_of_arrays_are_tags(database):
    payloads = ['{"tags":[]}', '{"other":1}', '{"tags":"x"}', '{"tags":["a",1,null,"A",true,"b"]}', None, "{"]
    db = database([(f"k{i}", p) for i, p in enumerate(payloads)])
    rows = {(r.key, r.tag_lc, r.tag, r.pos) for r in db.tags.collect()}
    assert rows == {("k3", "a", "a", 0), ("k3", "b", "b", 5)}


def test_final_sigma_and_other_field(database):
    db = database([("k", json.dumps({"labels": ["ΑΣ"]}, ensure_ascii=False))])
    assert [r.tag_lc for r in tag_index.build_tags(db.entries, "labels").collect()] == ["ας"]


SHARDS = (
    [("alpha/doc1", tagged("important", "draft")), ("alpha/doc2", tagged("important", "published")),
     ("beta/file1", tagged("draft", "internal"))],
    [("alpha/doc3", tagged("published", "urgent")), ("gamma/report", tagged("internal", "urgent"))],
)


def test_and_or_exclude(database):
    db = database(*SHARDS)
    assert names(db, ["important"]) == ["alpha/doc1", "alpha/doc2"]
    assert names(db, ["IMPORTANT"], ["draft"]) == ["alpha/doc2"]
    assert names(db, ["urgent", "draft"], mode="or") == ["alpha/doc1", "alpha/doc3", "beta/file1", "gamma/report"]
    assert names(db, ["urgent", "published"]) == ["alpha/doc3"]
    assert names(db, ["urgent", "none such"]) == [] and names(db, ["urgent", "none such"], mode="or") != []


def test_exclude_only_keeps_all_others(database):
    assert names(database(*SHARDS), (), ["internal"]) == ["alpha/doc1", "alpha/doc2", "alpha/doc3"]


def test_filtered_child_counts(database):
    db = database(*SHARDS)
    listed = db.list("", "/", tags=TagFilter(("published",))).collect()
    assert [(r.entry, r.child_count) for r in listed] == [("alpha/", 2)]


def test_shards_without_tag_index(database):
    db = database(*SHARDS)
    db.tags = db.tags.where("shard = 0")
    assert names(db, ["urgent"]) == []
    assert "gamma/report" in names(db, (), ["internal"])
    bare = database(*SHARDS, tags=False)
    assert names(bare, ["urgent"]) == [] and len(names(bare, (), ["urgent"])) == 5 and counts(bare) == []


def test_resume_with_exclusion(database):
    db = database(
        [("doc1", tagged("published")), ("doc2", tagged("published", "deprecated")), ("doc3", tagged("published"))],
        [("doc4", tagged("published")), ("doc5", tagged("published", "deprecated"))],
    )
    query = ListQuery(tags=TagFilter(("published",), ("deprecated",)))
    assert [[r.entry for r in page] for page in db.pages(query, limit=2)] == [["doc1", "doc3"], ["doc4"]]


def test_tag_pages_go_on(database):
    db = database(*SHARDS)
    first = db.tags_page(limit=3)
    second = db.tags_page(limit=3, cursor=first["next_cursor"])
    assert [x["tag"] for x in first["items"] + second["items"]] == [
        "draft", "important", "internal", "published", "urgent",
    ]
    assert second["next_cursor"] is None


def test_bulk_counts_and_manual_tags(database, spark):
    db = database(*SHARDS)
    found = {r.tag_lc: r["count"] for r in tag_index.bulk_counts(db.tags, ["DRAFT", "nope"]).collect()}
    assert found == {"draft": 2, "nope": None}
    hand = spark.createDataFrame([(0, 1, "New"), (0, 1, "new"), (9, 9, "lost"), (0, 2, None)], "shard int, id long, tag string")
    assert [(r.key, r.tag_lc, r.tag) for r in tag_index.manual_tags(db.entries, hand).collect()] == [
        ("alpha/doc1", "new", "New")
    ]
    assert tag_index.postings(db.tags).count() == 10
