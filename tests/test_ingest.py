"""Ingest rules, written indexes, streaming, shell, HTTP and the command line."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from keyloom import cli
from keyloom.model import COMMON_PREFIX, KEY, IndexFormatError, ListQuery, SearchFilter, TagFilter
from keyloom.plans.database import Database
from keyloom.plans.server import answer, make_server
from keyloom.plans.shell import Shell, UsageError, parent, parse_ls, parse_val
from keyloom.sources import ingest
from keyloom.streaming.ingest import ingest_stream


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


LINES = [
    '{"path":"/b","size":1,"tags":["X",2]}',
    "",
    '  {"size": 2, "path": "/a"}  ',
    '{"path":"/b","size":9}',
]


def test_text_lines(spark):
    keys = ingest.build_entries(ingest.keys_from_text(lines(spark, "b", "", "a", "b", None), "p/"))
    assert [(r.id, r.key, r.payload) for r in keys.orderBy("id").collect()] == [(1, "p/a", None), (2, "p/b", None)]


def test_json_lines(spark):
    keys = ingest.keys_from_json(lines(spark, *LINES), "path", "x:")
    found = [(r.id, r.key, json.loads(r.payload)) for r in ingest.build_entries(keys).orderBy("id").collect()]
    assert found == [(1, "x:/a", {"size": 2}), (2, "x:/b", {"size": 1, "tags": ["X", 2]})]


BAD = ['{"path":1}', '{"p":"x"}', "[1]", '{"path":"a"} x', '{"path":"a"}{"path":"b"}', "{", '{"path":"a"}]', "null", "7"]


@pytest.mark.parametrize("bad", BAD)
def test_bad_lines(spark, bad):
    given = lines(spark, '{"path":"a"}', bad, '{"path":"c"}')
    keys = lambda mode: [r.key for r in ingest.keys_from_json(given, "path", on_error=mode).orderBy("line_no").collect()]
    assert keys("drop") == ["a", "c"] and keys("stop") == ["a"]
    with pytest.raises(Exception, match="Error processing entry 1"):
        keys("fail")


def test_repeats(spark):
    keys = ingest.keys_from_text(lines(spark, "a", "a"))
    with pytest.raises(IndexFormatError):
        ingest.build_entries(keys, ignore_duplicates=False)
    with pytest.raises(ValueError):
        ingest.keys_from_json(keys, "path", on_error="other")


def test_ids_are_dense_over_partitions(spark):
    keys = spark.range(1200).select((F.col("id") % 3).cast("int").alias("shard"), F.format_string("%05d", "id").alias("key"))
    rows = ingest.with_ids(keys.repartition(7)).collect()
    for shard in range(3):
        mine = sorted((r.key, r.id) for r in rows if r.shard == shard)
        assert [i for _, i in mine] == list(range(1, 401))


def test_empty_input(spark):
    entries = ingest.build_entries(ingest.keys_from_text(lines(spark, "a").where("false")))
    assert entries.count() == 0


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    values = [
        (0, "a/1", '{"tags":["Red","x"],"n":1}'), (0, "a/2", None), (1, "a/1", '{"n":2}'), (1, "b/Ünï", '{"tags":["red"]}'),
    ]
    keys = spark.createDataFrame([(*v, i) for i, v in enumerate(values)], "shard int, key string, payload string, line_no long")
    ingest.write_index(ingest.build_entries(keys), path, "tags", search=True)
    return path


def test_written_index(spark, written, tmp_path):
    db = Database.open(spark, written)
    assert [(r.entry, r.child_count) for r in db.list("", "/").collect()] == [("a/", 3), ("b/", 1)]
    assert db.get_value("a/1") == {"n": 1, "tags": ["Red", "x"]} and len(db) == 4
    assert [(r["tag"], r["count"]) for r in db.list_tags().collect()] == [("Red", 2), ("x", 1)]
    assert [r.entry for r in db.list(search=SearchFilter(("uni",))).collect()] == ["b/Ünï"]
    assert db.grams.count() > 0
    found = lambda *a, **k: [r.entry for r in db.search(*a, **k).collect()]
    assert found("uni") == ["b/Ünï"] and found("a/1") == ["a/1"] and found("a/1", shard=1) == ["a/1"]
    assert found("uni", shard=0) == [] == found("ünz") and found("1", prefix="a/", require_index=True) == ["a/1"]
    bare = Database(db.entries)
    assert bare.search("uni").count() == 1 and bare.search("uni", require_index=True).count() == 0
    ingest.compact(spark, written, str(tmp_path / "copy"))
    assert len(Database.open(spark, str(tmp_path / "copy"))) == 4
    first = Database.open(spark, written, limit=1)
    assert [r.entry for r in first.list().collect()] == ["a/1", "a/2"]
    with pytest.raises(IndexFormatError):
        Database.open(spark, str(tmp_path / "nothing"))


def test_manifest_prunes_partitions(spark, written):
    plan = Database.open(spark, written)._unordered(ListQuery("b/", "/"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "shard" in plan.split("PartitionFilters")[1][:60]


def test_stored_forms_need_no_python(spark, written):
    plan = Database.open(spark, written).list(search=SearchFilter(("uni",)))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan


def test_stream_adds_shards(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("in", "index", "check"))
    (tmp_path / "in").mkdir()
    for text in ('{"path":"k1","tags":["t"]}\nbad\n', '{"path":"k2"}\n'):
        (tmp_path / "in" / f"f{len(text)}.jsonl").write_text(text)
        run = ingest_stream(spark, source, path, check, json_key="path", tag_field="tags", search=True)
        run.awaitTermination()
    db = Database.open(spark, path)
    assert {(r.shard, r.key) for r in db.entries.collect()} == {(0, "k1"), (1, "k2")}
    assert len(db) == 2 and [r["tag"] for r in db.list_tags().collect()] == ["t"]
    assert [r.entry for r in db.list("", "/").collect()] == ["k1", "k2"] and db.search("k2").count() == 1
    assert [r.entry for r in db.list(tags=TagFilter(("t",))).collect()] == ["k1"]
    assert list(Shell(db).run("ls"))[-1] == "2 entries listed"


def keyed(spark, *rows):
    keys = spark.createDataFrame([(*v, i) for i, v in enumerate(rows)], "shard int, key string, payload string, line_no long")
    return ingest.build_entries(keys)


def test_rebuild_leaves_nothing_of_the_old_index(spark, tmp_path):
    path = str(tmp_path / "index")
    ingest.write_index(keyed(spark, (0, "a", '{"tags":["t"]}'), (1, "b", None)), path, "tags", search=True)
    assert [r.entry for r in Database.open(spark, path).list(tags=TagFilter(("t",))).collect()] == ["a"]
    ingest.write_index(keyed(spark, (0, "a", None), (2, "c", None)), path)
    db = Database.open(spark, path)
    assert db.tags is None and db.grams is None and db.list(tags=TagFilter(("t",))).count() == 0
    assert [(r.shard, r.has_tags, r.has_search) for r in db.shards().collect()] == [(0, False, False), (2, False, False)]
    assert len(list((tmp_path / "index" / "entries").glob("version=*"))) == 1
    ingest.write_tags(spark, path)
    ingest.write_grams(spark, path)
    assert [(r.has_tags, r.has_search) for r in Database.open(spark, path).shards().collect()] == [(True, True)] * 2
    ingest.write_index(keyed(spark, (0, "x", None)).where("false"), path)
    assert len(Database.open(spark, path)) == 0 and Database.open(spark, path).list().count() == 0


def test_damaged_shards_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "index")
    ingest.write_index(keyed(spark, (0, "a", None), (1, "b", None), (2, "c", None)), path, search=True)
    [broken] = (tmp_path / "index" / "entries").glob("version=*/shard=1/*.parquet")
    broken.write_bytes(broken.read_bytes()[:-3])
    [missing] = (tmp_path / "index" / "entries").glob("version=*/shard=2")
    import shutil

    shutil.rmtree(missing)
    with pytest.warns(UserWarning, match="passed over"):
        db = Database.open(spark, path)
    assert [r.entry for r in db.list().collect()] == ["a"] and len(db) == 1


def test_joined_databases_keep_grams_and_manifest(spark, tmp_path):
    for name, rows, search in (("one", [(0, "alpha", None)], True), ("two", [(0, "alphabet", None), (1, "beta", None)], False)):
        ingest.write_index(keyed(spark, *rows), str(tmp_path / name), search=search)
    both = Database.open(spark, str(tmp_path / "one")).add(Database.open(spark, str(tmp_path / "two")))
    assert len(both) == 3 and both._manifest is not None and both._searched() == (0,)
    found = lambda **o: [r.entry for r in both.list(search=SearchFilter(("alph",)), **o).collect()]
    assert found() == ["alpha", "alphabet"] and found(require_index=True) == ["alpha"]
    assert [r.entry for r in both.list("be").collect()] == ["beta"]


def test_grams_narrow_listings(spark, written):
    db = Database.open(spark, written)
    bare = Database(db.entries, db.tags)
    for terms in (("uni",), ("a/1",), ("1", "a/1"), ("zzz",), ("ü",)):
        for delimiter in (None, "/"):
            query = ListQuery("", delimiter, search=SearchFilter(terms))
            assert db.query(query).collect() == bare.query(query).collect(), terms
    plan = db.query(ListQuery(search=SearchFilter(("uni",))))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "gram" in plan


def test_lines_are_numbered_by_file(spark, tmp_path):
    for name, text in (("a.txt", "x\n\ny\n"), ("b.txt", "z\n" * 5), ("c.txt", "x\nlast\n"), ("d.txt", "")):
        (tmp_path / name).write_text(text)
    rows = sorted((r.line_no, r.value) for r in ingest.read_lines(spark, str(tmp_path)).collect())
    assert rows == list(enumerate(["x", "y", *"zzzzz", "x", "last"], 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert sorted((r.line_no, r.value) for r in ingest.read_lines(spark, str(tmp_path)).collect()) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_first_wins_and_stop_follow_the_files(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"p":"k","v":1}\n{"p":"a"}\n')
    (tmp_path / "2.jsonl").write_text('{"p":"k","v":2,"pad":"' + "x" * 500 + '"}\noops\n{"p":"late"}\n')
    (tmp_path / "3.jsonl").write_text('{"p":"k","v":3}\n')
    lines = ingest.read_lines(spark, str(tmp_path))
    stopped = ingest.build_entries(ingest.keys_from_json(lines, "p", on_error="stop")).collect()
    assert {r.key: r.payload for r in stopped} == {"k": '{"v":1}', "a": "{}"}
    with pytest.raises(Exception, match="Error processing entry 4"):
        ingest.keys_from_json(lines, "p").collect()


def test_repeated_names_keep_the_last_value(spark):
    [row] = ingest.keys_from_json(lines(spark, '{"path":"a","n":1,"path":"b","n":2}'), "path").collect()
    assert (row.key, json.loads(row.payload)) == ("b", {"n": 2})


def test_common_prefix_needs_no_python(spark):
    from keyloom.operators.lookup import shard_stats

    rows = [(0, "ab/x"), (0, "ab/y"), (1, "q"), (2, "a"), (2, "b"), (3, ""), (4, "é1"), (4, "é12")]
    stats = shard_stats(spark.createDataFrame(rows, "shard int, key string"))
    assert {r.shard: r.common_prefix for r in stats.collect()} == {0: "ab/", 1: "q", 2: "", 3: "", 4: "é1"}
    assert "Python" not in stats._jdf.queryExecution().toString()


def test_failures_are_answered(database):
    db = database(["a"])
    db.entries = None
    server = make_server(db, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with pytest.raises(urllib.error.HTTPError) as failed:
        urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/keys")
    assert failed.value.code == 500 and "error" in json.load(failed.value)
    server.shutdown()


def test_shell(database):
    db = database([("docs/a.md", '{"tags":["Pub"],"n":1}'), "docs/sub/b.md", "top"])
    shell = Shell(db)
    run = lambda line: list(shell.run(line))
    assert run("ls") == ["docs/ (2)", "top #3", "2 entries listed"]
    assert run("ls -r docs/") == ['a.md #1 {"tags":["Pub"],"n":1}', "sub/b.md #2", "2 entries listed"]
    assert run("ls -c")[0] == "docs/ (2)" and run("ls -k") == ["top #3", "1 entry listed"]
    assert run("ls -r #pub")[-1] == run("ls -r -q a.m")[-1] == "1 entry listed"
    assert run("ls -r !pub -! top") == ["docs/sub/b.md #2", "1 entry listed"]
    assert run("cd docs/") == [] and run("pwd") == ["docs/"] and run("tags")[0].split() == ["Pub", "1"]
    assert run("search SUB") == ["sub/b.md #2", "1 entry listed"]
    assert shell.complete("cd ") == ["sub/"] and shell.complete("ls #p") == ["#Pub"] and "ls" in shell.complete("l")
    run("cd sub/")
    assert run("cd ..") == [] and run("pwd") == ["docs/"] and run("cd") == [] and run("pwd") == [""]
    assert run("val 3") == ["top #3 [shard 0]"] and "No key" in run("val 0:9")[0] and "No shard" in run("val 1 5")[0]
    assert run("shards")[1] == "shard 0: 3 keys, common prefix ''"
    assert "numbers" in run("val x")[0] and "Unknown" in run("dance")[0] and run("") == []
    assert run("help")[0].startswith("ls") and run("quit") == [] and shell.done


def test_shell_parsing():
    found = parse_ls(["-rk", "-d:", "p", "#a", "!b", "-q", "x", "-!", "y"])
    assert (found.prefix, found.recursive, found.kind, found.delimiter) == ("p", True, KEY, ":")
    assert found.tags == TagFilter(("a",), ("b",)) and found.search == SearchFilter(("x",), ("y",))
    assert parse_ls(["-c"]).kind == COMMON_PREFIX
    for bad in (["-c", "-k"], ["-z"], ["a", "b"], ["-q"], ["-dab"], ["-d"]):
        with pytest.raises(UsageError):
            parse_ls(bad)
    assert parse_val(["5"], 1, 0) == (0, 5) and parse_val(["5", "2"], 3, 0) == (2, 5) == parse_val(["2:5"], 3, 0)
    for bad in ([], ["5"], ["x:1"]):
        with pytest.raises(UsageError):
            parse_val(bad, 3, 0)
    assert [parent(x, "/") for x in ("a/b/", "a/b", "a/", "", "//")] == ["a/", "a/", "", "", ""]


def test_http(database):
    db = database([("a/1", '{"tags":["T"]}'), "b"])
    status, body = answer(db, "/keys?delim=/&limit=1")
    assert status == 200 and body["items"] == [{"key": "a/", "type": COMMON_PREFIX, "count": 1}]
    assert answer(db, f"/keys?delim=/&cursor={body['next_cursor']}")[1]["items"] == [{"key": "b", "type": KEY}]
    assert answer(db, "/keys?include_tags=t")[1]["items"][0]["payload"] == {"tags": ["T"]}
    assert answer(db, "/keys?search=b")[1]["items"] == [{"key": "b", "type": KEY}]
    assert answer(db, "/tags")[1] == answer(db, "/tags/counts")[1] == {"items": [{"tag": "T", "count": 1}], "next_cursor": None}
    assert answer(db, "/keys?cursor=%21")[0] == 400 and answer(db, "/other")[0] == 404 and answer(db, "/keys?limit=0")[0] == 400
    server = make_server(db, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/keys?prefix=b") as reply:
        assert json.load(reply)["items"] == [{"key": "b", "type": KEY}]
    server.shutdown()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.jsonl").write_text('{"path":"a/1","tags":["t"]}\n{"path":"b"}\noops\n{"path":"c"}\n')
    index = str(tmp_path / "index")
    assert cli.main(["index", "--index", index, "--input", str(tmp_path / "in.jsonl"), "--json", "path", "--ignore-duplicates"]) == 1
    assert cli.main(["tag-index", "--index", index]) == 0 and cli.main(["search-index", "--index", index]) == 0
    assert cli.main(["shell", "--index", index, "ls"]) == 0
    assert capsys.readouterr().out.splitlines() == ["a/ (1)", "b #2 {}", "2 entries listed"]
