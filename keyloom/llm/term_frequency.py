"""Frequency of every distinct term (problem 4).

Each record's terms are counted inside the record, so a term that a record repeats is marked once as "first here".
The partial hash aggregate combines these per map task before the shuffle, so a term that most records carry becomes
one state per task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_terms(terms: Column) -> Column:
    """Sorted ``struct(term, first)`` of an array; ``first`` is true once for each distinct term of the record.

    Null elements are left out; null and empty arrays give an empty one.  Linear in the array after its sort, so a
    record with very many terms costs no more than its share.
    """
    ordered = F.array_sort(F.filter(terms, lambda t: t.isNotNull()))

    def marked(bound: Column) -> Column:
        before = lambda i: F.try_element_at(bound, F.greatest(i, F.lit(1)))
        return F.transform(
            bound, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (before(i) != t)).alias("first"))
        )

    # Bound by an outer lambda, the sorted array is made once per record, not once per element.
    found = F.transform(F.array(ordered), marked)[0]
    return F.coalesce(found, F.array().cast("array<struct<term:string,first:boolean>>"))


def term_frequencies(records: DataFrame, terms: Column, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """``tag, n_occurrences, n_rows, mark`` of every distinct term of ``records``.

    mark is ``rare`` where fewer than ``rare_below`` records carry the term, ``common`` where more than the share
    ``common_above`` of all records do, records without terms included, else null.  Should both hold, which takes a
    tiny table, it is ``rare``.  Repeated records count as records.  An empty table gives an empty result.
    """
    total = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    emitted = records.select(F.explode(record_terms(terms)).alias("t")).select("t.term", "t.first")
    counts = emitted.groupBy(F.col("term").alias("tag")).agg(
        F.count(F.lit(1)).alias("n_occurrences"), F.count_if("first").alias("n_rows")
    )
    mark = F.when(F.col("n_rows") < rare_below, "rare").when(F.col("n_rows") > total * F.lit(Decimal(str(common_above))), "common")
    return counts.withColumn("mark", mark)


def lower_tags(tags: Column) -> Column:
    """Tags in lower case, otherwise as stored."""
    return F.transform(tags, F.lower)
