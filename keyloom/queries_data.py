"""Queries of the data-processing problems in the core, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.eager_aggregate import eager_join_aggregate, group_totals, heavy_groups
from keyloom.runtime import table
from keyloom.sources.raw_lines import failed_numbers, load_lines


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fail to parse."""
    return failed_numbers(table(spark, sf_dir, "sample_raw")).select("line_no")


def p1_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed lines with their reasons and text."""
    return load_lines(table(spark, sf_dir, "sample_raw"))[1]


def p1_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records of the valid lines."""
    return load_lines(table(spark, sf_dir, "sample_raw"))[0]


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each format fail for each reason."""
    failed = failed_numbers(table(spark, sf_dir, "sample_raw"))
    return failed.groupBy("fmt", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories and tags that hold at least 5% of all rows."""
    return heavy_groups(table(spark, sf_dir, "sample"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and total size per directory, path and tag."""
    return group_totals(table(spark, sf_dir, "sample"))


def p2_sightings_by_index_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of the paths that carry each indexed tag: both sides of this join have hot keys."""
    sample = table(spark, sf_dir, "sample").where(F.col("path").isNotNull()).select("path", "size")
    members = table(spark, sf_dir, "tags").select(F.col("key").alias("path"), "tag_lc")
    return eager_join_aggregate(sample, members, "path", ["tag_lc"], {"total_size": "size"}, count="n_sightings")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_failed, p1_valid, p1_reasons, p2_found, p2_totals, p2_sightings_by_index_tag)
}

_TAG_ROWS = """
    SELECT DISTINCT entry_no, size, lower(t) AS value FROM (SELECT entry_no, size, unnest(tags) AS t FROM sample)
    WHERE t IS NOT NULL"""

_INTEGER = r"(?:0|[1-9][0-9]*)"
#: Valid JSON for this check: DuckDB's parser lets trailing commas and NaN pass.
_JSON_OK = rf"""json_valid(value) AND json_type(value) = 'OBJECT' AND NOT regexp_matches(value, ',\s*[}}\]]\s*$')
    AND NOT regexp_matches(value, ':\s*-?(NaN|Infinity|nan|inf)')
    AND json_type(value, '$.path') = 'VARCHAR' AND json_extract_string(value, '$.path') <> ''
    AND coalesce(json_type(value, '$.tags'), 'NULL') IN ('NULL', 'ARRAY')
    AND json_type(value, '$.last_modified') IN ('UBIGINT', 'BIGINT')
    AND TRY_CAST(json_extract_string(value, '$.last_modified') AS HUGEINT) BETWEEN 0 AND 4102444799
    AND regexp_full_match(CAST(json_extract(value, '$.size') AS VARCHAR), '-0|{_INTEGER}')"""
_FIELD = r'("([^"]|"")*"|[^",\r\n]*)'
_CSV_OK = rf"""regexp_full_match(value, '{_FIELD},{_FIELD},{_FIELD},{_FIELD}')
    AND regexp_extract(value, '^{_FIELD}', 1) NOT IN ('', '""')
    AND regexp_full_match(trim(regexp_extract(value, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', 3), '"'), '0*[0-9]{{1,10}}')
    AND TRY_CAST(trim(regexp_extract(value, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', 3), '"') AS HUGEINT) < 4102444800
    AND regexp_full_match(trim(regexp_extract(value, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', 5), '"'), '[0-9]+')"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": f"""
        SELECT line_no FROM sample_raw WHERE value <> '' AND NOT coalesce(
            CASE WHEN fmt = 'jsonl' THEN CASE WHEN json_valid(value) THEN {_JSON_OK} ELSE false END
                 WHEN fmt = 'csv' THEN CASE WHEN {_CSV_OK} THEN true ELSE false END ELSE false END, false)""",
    "p2_found": rf"""
        WITH total AS (SELECT count(*) AS n FROM sample),
        dirs AS (
            SELECT regexp_extract(path, '^(/[^/]+/[^/]+)', 1) AS value, count(*) AS n FROM sample
            WHERE regexp_matches(path, '^/[^/]+/[^/]+') GROUP BY 1),
        tagged AS (SELECT value, count(*) AS n FROM ({_TAG_ROWS}) GROUP BY 1)
        SELECT 'path' AS field, value FROM dirs, total WHERE dirs.n * 20 >= total.n
        UNION ALL SELECT 'tags', value FROM tagged, total WHERE tagged.n * 20 >= total.n""",
    "p2_totals": rf"""
        SELECT 'path' AS field, path AS value, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS total_size
        FROM sample GROUP BY path
        UNION ALL
        SELECT 'directory', regexp_extract(path, '^(/[^/]+/[^/]+)', 1), count(*), CAST(sum(size) AS BIGINT)
        FROM sample WHERE regexp_matches(path, '^/[^/]+/[^/]+') GROUP BY 2
        UNION ALL
        SELECT 'tag', value, count(*), CAST(sum(size) AS BIGINT) FROM ({_TAG_ROWS}) GROUP BY value""",
    "p2_sightings_by_index_tag": """
        SELECT tag_lc, count(*) AS n_sightings, CAST(sum(size) AS BIGINT) AS total_size
        FROM sample JOIN tags ON path = key GROUP BY tag_lc""",
}
