"""Aggregation through a join, where a few keys hold most rows (problem 2).

``eager_join_aggregate`` never joins raw rows.  Both inputs are first aggregated by the join key, so a key that
holds a third of all rows becomes one compact state per map task before anything is shuffled.  States are joined,
counts multiplied and sums scaled by the other side's count, and the products rolled up to the groups.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(
    facts: DataFrame, members: DataFrame, key: str, groups: list[str], sums: dict[str, str], count: str = "n_rows"
) -> DataFrame:
    """``SELECT groups, count(*) AS count, sum(x) AS name ... FROM facts JOIN members ON key <=> key GROUP BY groups``.

    facts: has ``key`` and the columns to sum; ``sums`` maps each result name to one of them.
    members: has ``key`` and the columns ``groups``.

    Null keys match each other.  Null measures count as rows and add nothing; a group with only null measures sums to
    null.  Repeated rows count on both sides.  Sums are decimals while states are combined, so none overflows; the
    result is cast back to bigint and null where it doesn't fit.  Empty inputs give an empty result.
    """
    fact_states = facts.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col(column).cast("decimal(28,0)")).alias(f"_sum_{name}") for name, column in sums.items()],
    )
    member_states = members.groupBy(F.col(key).alias("_member"), *groups).agg(F.count(F.lit(1)).alias("_m"))
    joined = fact_states.join(member_states, F.col("_key").eqNullSafe(F.col("_member")))
    return joined.groupBy(*groups).agg(
        F.sum(F.col("_n") * F.col("_m")).alias(count),
        *[
            F.expr(f"try_cast(sum(_sum_{name} * cast(_m as decimal(19,0))) as bigint)").alias(name)
            for name in sums
        ],
    )


def top_directory(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` segments of an absolute path, null where it has fewer."""
    return F.nullif(F.regexp_extract(path, r"\A((?:/[^/]+){" + str(depth) + "})", 1), F.lit(""))


def tag_set(tags: Column) -> Column:
    """The distinct lower-cased tags of a row in order, empty for null."""
    lower = F.transform(F.filter(tags, lambda x: x.isNotNull()), F.lower)
    return F.coalesce(F.array_sort(F.array_distinct(lower)), F.array().cast("array<string>"))


def group_totals(sample: DataFrame, depth: int = 2) -> DataFrame:
    """``field, value, n_rows, total_size`` of every directory, path and tag of a listing with ``path, tags, size``.

    field is ``directory`` (the first two segments), ``path`` or ``tag`` (lower-cased; a row counts once for a tag
    however often it repeats it).  Rows without path count under a null path, rows whose path has fewer segments under
    no directory, null tags under none.
    """
    by_path = sample.select("path", "size")
    paths = sample.select("path").distinct()
    path_groups = paths.select(
        "path",
        F.explode(
            F.array(
                F.struct(F.lit("path").alias("field"), F.col("path").alias("value")),
                F.struct(F.lit("directory").alias("field"), top_directory(F.col("path"), depth).alias("value")),
            )
        ).alias("g"),
    ).select("path", "g.field", "g.value").where((F.col("field") == "path") | F.col("value").isNotNull())
    by_tags = sample.select(tag_set(F.col("tags")).alias("tag_set"), "size").where(F.size("tag_set") > 0)
    sets = by_tags.select("tag_set").distinct()
    tag_groups = sets.select("tag_set", F.lit("tag").alias("field"), F.explode("tag_set").alias("value"))
    parts = [
        eager_join_aggregate(by_path, path_groups, "path", ["field", "value"], {"total_size": "size"}),
        eager_join_aggregate(by_tags, tag_groups, "tag_set", ["field", "value"], {"total_size": "size"}),
    ]
    return reduce(DataFrame.unionByName, parts)


def heavy_groups(sample: DataFrame, share: float = 0.05) -> DataFrame:
    """``field, value`` of the directories (as field ``path``) and tags (``tags``) that hold ``share`` of all rows."""
    total = sample.agg(F.count(F.lit(1)).alias("n")).scalar()
    names = F.when(F.col("field") == "directory", "path").when(F.col("field") == "tag", "tags")
    totals = group_totals(sample.select("path", "tags", "size")).where(F.col("field").isin("directory", "tag"))
    # As a decimal the bound is exact: a group of just that share counts.
    return totals.where(F.col("n_rows") >= total * F.lit(Decimal(str(share)))).select(names.alias("field"), "value")
