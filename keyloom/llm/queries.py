"""Queries of the training-data problems, with their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import abuse, contamination, encoding_repair, lookalikes, mixing, term_frequency
from keyloom.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose path was decoded in the wrong encoding."""
    sample = table(spark, sf_dir, "sample").select("entry_no", "path")
    return encoding_repair.repair(sample, "path").select("entry_no")


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the original path where it can be told."""
    sample = table(spark, sf_dir, "sample").select("entry_no", "path")
    return encoding_repair.repair(sample, "path")


def _tag_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = table(spark, sf_dir, "sample").select("tags")
    return term_frequency.term_frequencies(sample, term_frequency.lower_tags(F.col("tags")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that are too rare or too common."""
    return _tag_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("tag", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag with its occurrences, rows and mark."""
    return _tag_terms(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose path or tags look the same as something else; garbled paths belong to p3."""
    sample = table(spark, sf_dir, "sample").select("entry_no", "path", "tags")
    garbled = encoding_repair.garbled_flag(sample, encoding_repair.fit(sample, "path"))
    paths = lookalikes.odd_rows(sample, "entry_no", "path", F.array("path")).where(~garbled(F.col("values")[0]))
    labels = lookalikes.odd_rows(sample, "entry_no", "tags", F.col("tags"))
    return paths.unionByName(labels).select("entry_no", "field")


def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that had to change, with the consistent spelling of path and tags."""
    return lookalikes.consistent(table(spark, sf_dir, "sample"), "entry_no")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least 12 consecutive words with a test item."""
    hits = contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return hits.select("doc_id", "item_id").distinct()


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the leaked passages stand and how long they are."""
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with leaked passages cut out, and the items that those belong to."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = contamination.without_leaks(documents, table(spark, sf_dir, "eval_items"))
    return cleaned.select("doc_id", "clean_text", "items")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen posts with their repeats."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual share of each source, by name and by posterior."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.fit_mix(table(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abusive documents."""
    scored = abuse.scores(table(spark, sf_dir, "documents"), ("doc_id",))
    return scored.where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return abuse.scores(table(spark, sf_dir, "documents"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of abusive documents per source."""
    return abuse.rates(table(spark, sf_dir, "documents"))


def p8_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the score with the raters' labels."""
    return abuse.agreement(table(spark, sf_dir, "documents"), table(spark, sf_dir, "abuse_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        p3_found, p3_repaired, p4_found, p4_terms, p5_found, p5_consistent, p6_found, p6_passages, p6_cleaned, p7_mix,
        p7_shares, p8_found, p8_scores, p8_rates, p8_agreement,
    )
}

_TERMS = """
    WITH total AS (SELECT count(*) AS n FROM sample),
    counts AS (
        SELECT lower(t) AS tag, count(*) AS n_occurrences, count(DISTINCT entry_no) AS n_rows
        FROM (SELECT entry_no, unnest(tags) AS t FROM sample) WHERE t IS NOT NULL GROUP BY 1),
    marked AS (
        SELECT counts.*, CASE WHEN n_rows < 3 THEN 'rare' WHEN n_rows * 10 > total.n THEN 'common' END AS mark
        FROM counts, total)
"""

_WORDS = r"""
    regexp_extract_all(lower(regexp_replace(regexp_replace(text, '</?[A-Za-z][^<>]*>|\[/?[A-Za-z]+(=[^\]\r\n]*)?\]', ' ', 'g'),
        '&#?[A-Za-z0-9]+;', ' ', 'g')), '[\pL\pN]+')"""

ORACLE_SQL: dict[str, str] = {
    "p4_found": _TERMS + "SELECT tag, mark FROM marked WHERE mark IS NOT NULL",
    "p6_found": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
        e AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
        eg AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS g
               FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p4_terms": _TERMS + "SELECT * FROM marked",
}
