"""Rows that fail to parse, and aggregation with hot keys."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.operators.eager_aggregate import eager_join_aggregate, group_totals, heavy_groups
from keyloom.sources.raw_lines import load_lines, split_csv, split_json

RAW = "line_no long, shard int, fmt string, value string"
GOOD_JSON = '{"path":"/a","last_modified":1,"size":2,"tags":["x",3,null]}'


def load(spark, rows, schema=RAW):
    valid, failed = load_lines(spark.createDataFrame(rows, schema))
    return valid.collect(), {r.line_no: r.reason for r in failed.collect()}


VALID = [
    ("jsonl", GOOD_JSON), ("jsonl", f" \t{GOOD_JSON}\r\n"), ("jsonl", '{"size":0,"path":"x","last_modified":-0,"more":{}}'),
    ("jsonl", '{"path":"a","last_modified":4102444799,"size":99999999999999999999,"tags":null}'),
    ("jsonl", '{"path":"\\ud800","last_modified":0,"size":0}'),
    ("csv", "/a,1,2,"), ("csv", '"/a ""q"", b\n c","1","2","x;y"'), ("csv", "/a\\,007,2,x;;y"), ("csv", " ,0,0,"),
]
FAILING = [
    ("jsonl", "[]", "array"), ("jsonl", "{", "strict"), ("jsonl", GOOD_JSON + "x", "strict"), ("jsonl", "   ", "strict"),
    ("jsonl", GOOD_JSON.replace(":1,", ":01,"), "strict"), ("jsonl", GOOD_JSON.replace("2", "NaN"), "strict"),
    ("jsonl", GOOD_JSON.replace('"/a"', "'/a'"), "strict"), ("jsonl", GOOD_JSON.replace("/a", "/\ta"), "strict"),
    ("jsonl", "\ufeff" + GOOD_JSON, "strict"), ("jsonl", "\u00a0" + GOOD_JSON, "strict"),
    ("jsonl", GOOD_JSON.replace("path", "Path"), "path is absent"), ("jsonl", GOOD_JSON.replace("/a", ""), "path is empty"),
    ("jsonl", GOOD_JSON.replace('"/a"', "7"), "path is int"), ("jsonl", GOOD_JSON.replace(":1,", ":1.0,"), "float"),
    ("jsonl", GOOD_JSON.replace(":1,", ":1e3,"), "float"), ("jsonl", GOOD_JSON.replace(":1,", ":true,"), "boolean"),
    ("jsonl", GOOD_JSON.replace(":1,", ':"1",'), "string"), ("jsonl", GOOD_JSON.replace(":1,", ":-1,"), "negative"),
    ("jsonl", GOOD_JSON.replace(":1,", ":4102444800,"), "out of range"), ("jsonl", GOOD_JSON.replace(":2,", ":-2,"), "negative"),
    ("jsonl", GOOD_JSON.replace(":2,", ":null,"), "null"), ("jsonl", '{"path":"/a","size":1}', "absent"),
    ("jsonl", GOOD_JSON.replace('["x",3,null]', '"x"'), "tags"), ("jsonl", "[" * 100_000, "strict"),
    ("csv", "/a,1,2", "fewer"), ("csv", "/a,1,2,x,", "more"), ("csv", '"/a,1,2,', "closed"), ("csv", '/a"b,1,2,', "inside"),
    ("csv", '"/a" b,1,2,', "beside"), ("csv", "/a\n,1,2,", "line break"), ("csv", ",1,2,", "path is empty"),
    ("csv", '"",1,2,', "path is empty"), ("csv", "/a, 1,2,", "digits"), ("csv", "/a,+1,2,", "digits"), ("csv", "/a,1,,", "size is empty"),
    ("csv", "/a,1,٣,", "digits"), ("csv", "/a,99999999999999999999999999999999999999999999,2,", "range"), ("csv", "/a,1.5,2,", "digits"),
    ("xml", "<a/>", "unknown format"), (None, "x", "unknown format"),
]


def test_valid_and_failing_lines(spark):
    rows = [(i, 0, f, v) for i, (f, v) in enumerate(VALID)] + [(100 + i, 0, f, v) for i, (f, v, _) in enumerate(FAILING)]
    rows += [(1000, 0, "csv", ""), (1001, 0, "jsonl", None), (2, 0, *VALID[2])]
    valid, failed = load(spark, rows)
    assert sorted(r.line_no for r in valid) == sorted([*range(len(VALID)), 2])
    assert set(failed) == set(range(100, 100 + len(FAILING)))
    for i, (_, value, reason) in enumerate(FAILING):
        assert reason in failed[100 + i], (value[:80], failed[100 + i])
    by = {r.line_no: r for r in valid}
    assert (by[0].path, by[0].last_modified, by[0].size, by[0].tags) == ("/a", 1, 2, ["x"])
    assert by[3].size is None and by[3].size_text == "99999999999999999999" and by[4].path == "�"
    assert by[6].path == '/a "q", b\n c' and by[6].tags == ["x", "y"] and by[7].last_modified == 7


def test_several_reasons_extra_columns_and_empty_table(spark):
    schema = RAW + ", path string, reason string, structure int"
    valid, failed = load(spark, [(1, 0, "csv", ",x,-1,", "p", "r", 1)], schema)
    assert not valid and failed[1] == "path is empty; last_modified isn't plain digits; size isn't plain digits"
    valid, failed = load_lines(spark.createDataFrame([], RAW))
    assert valid.count() == failed.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a",\n\r;', max_size=5), min_size=1, max_size=5))
def test_quoted_fields_round_trip(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    reason, path, modified, size, tags = split_csv(line)
    if len(fields) != 4:
        assert "than four" in reason
    elif fields[0]:
        assert reason is None and (path, modified, size) == (fields[0], f"text:{fields[1]}", f"text:{fields[2]}")
    else:
        assert reason == "path is empty"


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=2) | st.dictionaries(st.sampled_from(["path", "size", "tags"]), x)))
def test_json_of_any_shape_is_judged(value):
    reason, path, *_ = split_json(json.dumps(value))
    assert (reason is None) == (
        isinstance(value, dict) and isinstance(value.get("path"), str) and value["path"] != ""
        and (value.get("tags") is None or isinstance(value["tags"], list))
    )


def test_long_values(spark):
    long = "x" * 3_000_000
    valid, failed = load(spark, [(1, 0, "csv", f'"{long}",1,2,'), (2, 0, "csv", '"' + '""' * 500_000 + '",1,2,'), (3, 0, "csv", long)])
    assert {r.line_no: len(r.path) for r in valid} == {1: 3_000_000, 2: 500_000} and set(failed) == {3}


@settings(max_examples=10, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["h", "h", "h", "a", None]), st.integers(-5, 5) | st.none()), max_size=30),
    st.lists(st.tuples(st.sampled_from(["h", "a", "b", None]), st.sampled_from(["g1", "g2", None])), max_size=20),
)
def test_eager_equals_plain_join(spark, facts, members):
    left = spark.createDataFrame(facts, "k string, x long")
    right = spark.createDataFrame(members, "k string, g string")
    found = {(r.g): (r.n, r.s) for r in eager_join_aggregate(left, right, "k", ["g"], {"s": "x"}, count="n").collect()}
    want = {}
    for k, x in facts:
        for m, g in members:
            if k == m:
                n, s = want.get(g, (0, None))
                want[g] = (n + 1, s if x is None else (s or 0) + x)
    assert found == want


def test_totals_and_heavy_groups(spark):
    rows = [("/a/b/c", ["T", "t", None], 5)] * 20 + [("/a/b", [], None), ("/a", None, 1), (None, ["u"], 2), ("/a/b/", ["u"], 2**62)]
    sample = spark.createDataFrame(rows, "path string, tags array<string>, size long").withColumn("value", F.lit(1))
    found = {(r.field, r.value): (r.n_rows, r.total_size) for r in group_totals(sample).collect()}
    assert found == {
        ("path", "/a/b/c"): (20, 100), ("path", "/a/b"): (1, None), ("path", "/a"): (1, 1), ("path", None): (1, 2),
        ("path", "/a/b/"): (1, 2**62), ("directory", "/a/b"): (22, 100 + 2**62), ("tag", "t"): (20, 100),
        ("tag", "u"): (2, 2 + 2**62),
    }
    assert {(r.field, r.value) for r in heavy_groups(sample).collect()} == {("path", "/a/b"), ("tags", "t"), ("tags", "u")}
    assert group_totals(sample.where("false")).count() == heavy_groups(sample.where("false")).count() == 0


def test_nothing_is_joined_before_it_is_aggregated(spark):
    sample = spark.createDataFrame([("/a/b/c", ["t"], 1)], "path string, tags array<string>, size long")
    plan = heavy_groups(sample)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["list_group_prefix", "p1_found", "p2_found"])
def test_registered_queries_run(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("text", ['{"a":' * 3 + "[1,2.5e3,{}]" + "}" * 3, "[]", ' {"x" : [ ] , "x":-0}', '"a\\u00e9"', "true"])
def test_deep_decoder_reads_what_the_other_does(text):
    from keyloom.sources.raw_lines import _DECODER, decode_deep

    assert decode_deep(text) == _DECODER.decode(text.strip())


@pytest.mark.parametrize("text", ["", "[1,]", '{"a":1,}', '{"a"}', "[1 2]", "]", "{]", '{"a":}', "[1]]", "01", '"\t"', "nul", "{,}", "[,]", "1 1", ":"])
def test_deep_decoder_refuses(text):
    from keyloom.sources.raw_lines import decode_deep

    with pytest.raises(ValueError):
        decode_deep(text)


def test_deeply_nested_lines_are_valid():
    from keyloom.sources.raw_lines import split_json

    deep = "[" * 100_000 + "]" * 100_000
    good = '{"path":"/a","last_modified":1,"size":2,"tags":["t"],"x":%s}'
    assert split_json(good % deep) == (None, "/a", "int:1", "int:2", ["t"])
    assert split_json(good % deep[:-1])[0].startswith("not strict JSON")
