"""Wrong encodings, term counts and look-alike text."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import encoding_repair, lookalikes, term_frequency
from keyloom.llm.lookalikes import fold, oddities

WORDS = "diseño música straße résumé größe canción über façade noël проект музыка документ отчет сводка данные " \
    "資料 写真 文書 報告 データ ファイル プロジェクト 사진 보고서 αρχείο εικόνα έργο žluťoučký kůň příloha święto".split()  # fmt: skip


def garble(text, wrong, true="utf-8"):
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(true))


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(5)
    paths = [f"/home/{rng.choice(['a', 'b'])}/{rng.choice(WORDS)}_{i}.txt" for i in range(1500)]
    return encoding_repair.fit(spark.createDataFrame([(p,) for p in paths], "path string"), "path")


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "mac_roman"])
def test_utf8_chains_round_trip(fitted, wrong):
    for word in WORDS:
        name = f"/srv/mirror/{garble(word, wrong)}-12.pdf"
        assert fitted.judge(name) == (True, f"/srv/mirror/{word}-12.pdf"), (wrong, word)


def test_twice_garbled_and_legacy_encodings(fitted):
    assert fitted.judge("/x/" + garble(garble("résumé", "cp1252"), "cp1252")) == (True, "/x/résumé")
    assert fitted.judge("/x/" + garble("документ", "cp1252", "cp1251")) == (True, "/x/документ")
    assert fitted.judge("/x/" + garble("プロジェクト", "cp1252", "cp932") + "_1") == (True, "/x/プロジェクト_1")


def test_clean_names_stay(fitted):
    for word in [*WORDS, "été", "ÉTÉ", "çözüm", "Ärger", "👩‍💻", "a b", "plan​", "tiếng", "ｆｉｌｅ", "", "plain"]:
        assert fitted.judge(f"/x/{word}/y_{word}.md") == (False, None), word


def test_lost_characters(fitted):
    assert fitted.judge("/x/donn�es.txt") == (True, None)
    assert fitted.judge("/x/" + "příloha".encode().decode("cp1252", "replace")) == (True, "/x/příloha")
    assert fitted.judge("/x/ab\x81c") == (True, None)


def test_rows_keep_their_columns_and_nulls_pass(spark, fitted):
    rows = [(1, None, "x"), (2, "", "x"), (3, "/a/" + garble("über", "cp1252"), "x"), (3, "/a/" + garble("über", "cp1252"), "x"), (4, "/a/über", "x")]
    table = spark.createDataFrame(rows, "entry_no long, path string, path_original string")
    found = encoding_repair.repair(table, "path", fitted).collect()
    assert [(r.entry_no, r.path_original) for r in found] == [(3, "/a/über")] * 2
    empty = encoding_repair.repair(table.where("false"), "path")
    assert empty.count() == 0 and empty.columns == ["entry_no", "path", "path_original"]


def test_very_long_name(fitted):
    assert fitted.judge("/x/" + "résumé_" * 20_000) == (False, None)
    assert fitted.judge("/x/" + garble("résumé_", "cp1252") * 20_000) == (True, "/x/" + "résumé_" * 20_000)


def test_term_counts(spark):
    rows = [(["b", "a", "b", None],)] * 2 + [(["a"],), ([],), (None,), ([None],)] + [(["c"],)] * 4
    table = spark.createDataFrame(rows, "tags array<string>").withColumn("tag", F.lit("clash"))
    found = {r.tag: (r.n_occurrences, r.n_rows, r.mark) for r in term_frequency.term_frequencies(table, F.col("tags"), 3, 0.35).collect()}
    assert found == {"a": (3, 3, None), "b": (4, 2, "rare"), "c": (4, 4, "common")}
    assert term_frequency.term_frequencies(table.where("false"), F.col("tags")).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(["x", "X", "y", "ΑΣ", "İ", None]), max_size=6), max_size=15))
def test_term_counts_equal_brute_force(spark, rows):
    table = spark.createDataFrame([(r,) for r in rows], "tags array<string>")
    terms = term_frequency.lower_tags(F.col("tags"))
    found = {r.tag: (r.n_occurrences, r.n_rows) for r in term_frequency.term_frequencies(table, terms).collect()}
    lists = [[t.lower() for t in r or [] if t is not None] for r in rows]
    assert found == {t: (sum(x.count(t) for x in lists), sum(t in x for x in lists)) for x in lists for t in x}


def test_many_terms_in_one_record(spark):
    table = spark.createDataFrame([([f"t{i % 50_000}" for i in range(100_000)],)], "tags array<string>")
    found = term_frequency.term_frequencies(table, F.col("tags")).agg(F.sum("n_rows"), F.sum("n_occurrences")).first()
    assert tuple(found) == (50_000, 100_000)


@pytest.mark.parametrize(
    ("text", "kinds", "plain"),
    [
        ("ｓｌｉｄｅｓ", ["styled"], "slides"), ("𝐛𝐚𝐜𝐤", ["styled"], "back"), ("ﬁnance", ["styled"], "finance"),
        (unicodedata.normalize("NFD", "café"), ["split accent"], "café"), ("back​up", ["invisible"], "backup"),
        ("a b", ["no-break space"], "a b"), ("a b", ["no-break space"], "a b"), ("a b", ["no-break space"], "a b"),
        ("рlаn", ["mixed letters"], "plan"), ("пpoeкт", ["mixed letters"], "проект"), ("έpγo", ["mixed letters"], "έργο"),
        ("iոterոal", ["mixed letters"], "internal"), ("INDЕХЕD", ["mixed letters"], "indexed"), ("TAΧ", ["mixed letters"], "tax"), ("жֆя", ["mixed letters"], "жֆя"), ("ΑNΑΦΟΡΆ", ["mixed letters"], "αναφορά"), ("👩‍💻", [], "👩‍💻"), ("❤️", [], "❤️"), ("музыка‍", ["invisible"], "музыка"),
        ("Straße", [], "strasse"), ("проект plan", [], "проект plan"), ("写真album", [], "写真album"), ("ASCII", [], "ascii"),
        ("데이터", [], "데이터"), (unicodedata.normalize("NFD", "データ"), ["split accent"], "データ"), ("", [], ""),
    ],
)
def test_look_alikes(text, kinds, plain):
    assert oddities(text) == kinds and fold(text) == plain


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=12))
def test_folding_settles(text):
    assert fold(fold(text)) == fold(text)
    assert fold(unicodedata.normalize("NFD", text)) == fold(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcxopeàéñüсеорху", max_size=8), st.sampled_from(["​", "­", "﻿", "⁠"]), st.integers(0, 8))
def test_invisible_characters_and_case_make_no_difference(text, hidden, at):
    assert fold(text[:at] + hidden + text[at:]) == fold(text) == fold(text.upper())


def test_whole_words_of_another_alphabet_stay():
    assert fold("сосо") == "сосо" and oddities("сосо") == [] and fold("сoco") == "coco"


def test_oddities_come_from_the_steps_of_fold(monkeypatch):
    monkeypatch.setattr(lookalikes, "STEPS", lookalikes.STEPS[:1])
    assert oddities("ｐｌan​") == ["styled"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=6), max_size=6))
def test_folded_columns_equal_the_function(spark, values):
    table = spark.createDataFrame([(v, values) for v in [*values, "A\tB\x0bC\x1cD"]], "v string, a array<string>")
    for row in table.select("v", "a", lookalikes.folded(F.col("v")).alias("f"), lookalikes.folded_all(F.col("a")).alias("g")).collect():
        assert row.f == (None if row.v is None else fold(row.v))
        assert row.g == [None if x is None else fold(x) for x in row.a]


def test_many_lost_characters(fitted):
    word = "příloha"
    name = " ".join([garble("résumé", "cp1252"), *[word.encode().decode("cp1252", "replace")] * 6])
    assert fitted.judge("/x/" + name) == (True, "/x/" + " ".join(["résumé", *[word] * 6]))


def test_thrice_garbled(fitted):
    text = "canción"
    for _ in range(3):
        text = garble(text, "latin-1")
    assert fitted.judge("/x/" + text) == (True, "/x/canción")


def test_margins_lie_between_clean_and_garbled_spans(fitted):
    tested = [m for chain, m in fitted.margins.items() if chain.endswith("utf-8")]
    assert len(tested) > 8 and all(m > 0 for m in tested) and len(set(tested)) > 3


def test_counts_do_not_depend_on_the_layout(spark):
    rows = [(f"/a/{w}",) for w in WORDS for _ in range(3)]
    table = spark.createDataFrame(rows, "path string")
    count = lambda t: {(r.span, r.n) for r in encoding_repair.span_counts(t, "path").collect()}
    assert count(table.repartition(1)) == count(table.repartition(7)) == {(w, 3) for w in WORDS if not w.isascii()}


def test_held_out_names_are_restored(fitted):
    """Share of garbled held-out spans that are found and restored, and of clean ones that are left alone."""
    held = [w for w in "señal café naïve Übung плюс записка журнал 記録 写真集 보고 λόγος žába příběh święta".split()]
    assert not any(fitted.judge_span(w)[0] for w in held)
    tried = [(w, g) for w in held for chain, g in encoding_repair.garbled_by(w).items() if chain.endswith("utf-8")]
    assert sum(fitted.judge_span(g) == (True, w) for w, g in tried) / len(tried) > 0.9


def test_odd_and_consistent_rows(spark):
    rows = [(1, "/A", ["x"]), (2, None, None), (3, "/a", [None, "ｘ"]), (4, "/ｂ", []), (4, "/ｂ", []), (5, "/a", ["x"])]
    table = spark.createDataFrame(rows, "entry_no long, path string, tags array<string>").withColumn("values", F.lit(1))
    tags = lookalikes.odd_rows(table, "entry_no", "tags", F.col("tags"))
    paths = lookalikes.odd_rows(table, "entry_no", "path", F.array("path"))
    assert [r.entry_no for r in tags.collect()] == [3] and [r.entry_no for r in paths.collect()] == [4, 4]
    changed = lookalikes.consistent(table, "entry_no").collect()
    assert [(r.entry_no, r.path_folded, r.tags_folded) for r in changed] == [
        (1, "/a", ["x"]), (3, "/a", [None, "x"]), (4, "/b", []), (4, "/b", []),
    ]
    assert lookalikes.consistent(table.where("false"), "entry_no").count() == 0
