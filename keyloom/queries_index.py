"""Queries of the index operators, with their DuckDB equivalents.

The database is the tables ``entries`` and ``tags``: several shards that share keys, some without tag index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.text import GRAM, grams, graphemes, normalize, strip_accents
from keyloom.model import COMMON_PREFIX, KEY, ListQuery, SearchFilter, TagFilter
from keyloom.operators import gram_index, listing, lookup, tag_index
from keyloom.operators.predicates import search_entries
from keyloom.plans.database import Database
from keyloom.runtime import table
from keyloom.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def database(spark: SparkSession, sf_dir: str) -> Database:
    return Database(table(spark, sf_dir, "entries"), table(spark, sf_dir, "tags"))


# Listings ------------------------------------------------------------------------------------------------------------

_FLAT = """
    SELECT key AS entry, 'Key' AS kind, arg_min(shard, shard) AS shard, arg_min(id, shard) AS id,
           first(payload ORDER BY shard) AS payload, CAST(NULL AS BIGINT) AS child_count
    FROM ({rows}) GROUP BY key"""
_GROUPED = """
    SELECT entry, kind, CASE WHEN kind = 'Key' THEN min(shard) END AS shard,
           CASE WHEN kind = 'Key' THEN arg_min(id, shard) END AS id,
           CASE WHEN kind = 'Key' THEN first(payload ORDER BY shard) END AS payload,
           CASE WHEN kind = 'CommonPrefix' THEN count(*) END AS child_count
    FROM (
        SELECT *, CASE WHEN place > 0 THEN substr(key, 1, {skip} + place) ELSE key END AS entry,
               CASE WHEN place > 0 THEN 'CommonPrefix' ELSE 'Key' END AS kind
        FROM (SELECT *, strpos(substr(key, {skip} + 1), '/') AS place FROM ({rows})))
    GROUP BY entry, kind"""


def _flat_sql(rows: str) -> str:
    return _FLAT.format(rows=rows)


def _grouped_sql(rows: str, prefix: str = "") -> str:
    return _GROUPED.format(rows=rows, skip=len(prefix))


def _under(prefix: str, rows: str = "SELECT * FROM entries") -> str:
    return f"SELECT * FROM ({rows}) AS e WHERE starts_with(key, '{prefix}')"


def _listing(name: str, query: ListQuery, sql: str, limit: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir)
        return listing.ordered(listing.list_entries(db.entries, db.tags, query), limit)

    run.__doc__ = f"Listing: {query}"
    _register(name, run, sql)


_listing("list_flat", ListQuery(), _flat_sql("SELECT * FROM entries"))
_listing("list_prefix", ListQuery("/home/"), _flat_sql(_under("/home/")))
_listing("list_no_match", ListQuery("/none/such/"), _flat_sql(_under("/none/such/")))
_listing("list_group_root", ListQuery("", "/"), _grouped_sql("SELECT * FROM entries"))
_listing("list_group_prefix", ListQuery("/home/", "/"), _grouped_sql(_under("/home/"), "/home/"))
_listing("list_group_deep", ListQuery("/srv/mirror/", "/"), _grouped_sql(_under("/srv/mirror/"), "/srv/mirror/"))
_listing(
    "list_only_prefixes",
    ListQuery("/opt/builds/", "/", kind=COMMON_PREFIX),
    f"SELECT * FROM ({_grouped_sql(_under('/opt/builds/'), '/opt/builds/')}) WHERE kind = 'CommonPrefix'",
)
_listing(
    "list_only_keys",
    ListQuery("/srv/mirror/current/", "/", kind=KEY),
    f"SELECT * FROM ({_grouped_sql(_under('/srv/mirror/current/'), '/srv/mirror/current/')}) WHERE kind = 'Key'",
)
_listing(
    "page_flat_cursor",
    ListQuery("/data/", cursor="/data/ingest/m"),
    f"SELECT * FROM ({_flat_sql(_under('/data/'))}) WHERE entry > '/data/ingest/m' ORDER BY entry LIMIT 100",
    limit=100,
)
_listing(
    "page_group_cursor",
    ListQuery("/home/", "/", cursor="/home/m/"),
    f"SELECT * FROM ({_grouped_sql(_under('/home/'), '/home/')}) WHERE entry > '/home/m/' ORDER BY entry LIMIT 20",
    limit=20,
)
_listing(
    "list_without_payload",
    ListQuery("/var/", payload=False),
    f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS payload) FROM ({_flat_sql(_under('/var/'))})",
)


def multi_shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that several shards hold count once per shard below a group."""
    db = database(spark, sf_dir)
    query = ListQuery("/srv/", "/", payload=False)
    return listing.list_entries(db.entries, db.tags, query).select("entry", "kind", "shard", "child_count")


def multi_shard_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of several shards with the row of the first one."""
    entries = table(spark, sf_dir, "entries")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    first = listing.list_entries(entries, None, ListQuery())
    return first.join(shared, first.entry == shared.key).select("entry", "shard", "id", "payload", "n")


_register(
    "multi_shard_counts",
    multi_shard_counts,
    "SELECT entry, kind, shard, child_count FROM "
    f"({_grouped_sql(_under('/srv/'), '/srv/')})",
)
_register(
    "multi_shard_dedup",
    multi_shard_dedup,
    "SELECT key AS entry, min(shard) AS shard, arg_min(id, shard) AS id, first(payload ORDER BY shard) AS payload, "
    "count(*) AS n FROM entries GROUP BY key HAVING count(*) > 1",
)


# Ids, lookups, catalogue ---------------------------------------------------------------------------------------------


def key_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids in byte order per shard, assigned anew."""
    keys = table(spark, sf_dir, "entries").select("shard", "key")
    return ingest.with_ids(keys).select("shard", "key", "id")


def get_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get_value(table(spark, sf_dir, "entries"), "/srv/mirror/current/catalog.json")


def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.key_by_id(table(spark, sf_dir, "entries"), 0, 17)


def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.entries_by_ids(table(spark, sf_dir, "entries"), 1, [30, 4, 1_000_000_000, 4, 11])


def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.shard_stats(table(spark, sf_dir, "entries"))


def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = lookup.shard_stats(table(spark, sf_dir, "entries"))
    return stats.agg(F.sum("n_keys").alias("n_keys"), F.count(F.lit(1)).alias("n_shards"))


def has_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.shards_with_prefix(table(spark, sf_dir, "entries"), "/srv/mirror/c")


def candidate_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.candidate_shards(lookup.shard_stats(table(spark, sf_dir, "entries")), "/home/")


_register(
    "key_ids", key_ids, "SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY key) AS id FROM entries"
)
_register(
    "get_value",
    get_value,
    "SELECT key, shard, payload FROM entries WHERE key = '/srv/mirror/current/catalog.json' AND payload IS NOT NULL "
    "ORDER BY shard LIMIT 1",
)
_register("lookup_by_id", lookup_by_id, "SELECT shard, id, key, payload FROM entries WHERE shard = 0 AND id = 17")
_register(
    "lookup_by_ids",
    lookup_by_ids,
    "SELECT CAST(position AS INTEGER) AS position, id, key, payload FROM entries JOIN "
    "(VALUES (0, 30), (1, 4), (2, 1000000000), (3, 4), (4, 11)) AS w(position, wanted) ON id = wanted WHERE shard = 1",
)
_COMMON = """
    (SELECT coalesce(max(i), 0) FROM range(1, length(lo) + 1) AS r(i) WHERE substr(lo, 1, i) = substr(hi, 1, i))"""
_STATS = f"""
    SELECT shard, n AS n_keys, lo AS min_key, hi AS max_key, substr(lo, 1, {_COMMON}) AS common_prefix
    FROM (SELECT shard, count(*) AS n, min(key) AS lo, max(key) AS hi FROM entries GROUP BY shard)"""
_register("shard_stats", shard_stats, _STATS)
_register("total_count", total_count, "SELECT count(*) AS n_keys, count(DISTINCT shard) AS n_shards FROM entries")
_register(
    "has_prefix", has_prefix, "SELECT DISTINCT shard FROM entries WHERE starts_with(key, '/srv/mirror/c')"
)
_register(
    "candidate_shards",
    candidate_shards,
    f"SELECT shard FROM ({_STATS}) WHERE starts_with(common_prefix, '/home/') OR starts_with('/home/', common_prefix)",
)


# Tags ----------------------------------------------------------------------------------------------------------------


def tag_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags extracted anew from the payloads of all shards."""
    return tag_index.build_tags(table(spark, sf_dir, "entries")).select("shard", "id", "key", "tag_lc", "tag", "pos")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_index.tag_counts(table(spark, sf_dir, "tags"))


def tag_counts_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_index.tag_counts(table(spark, sf_dir, "tags"), "/home/")


def tag_canonical_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_counts(spark, sf_dir).select("tag_lc", "tag")


def tag_bulk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_index.bulk_counts(table(spark, sf_dir, "tags"), ["Backup", "RUST", "draft", "no such tag"])


def tag_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_index.postings(table(spark, sf_dir, "tags"))


_COUNTS = """
    SELECT tag_lc, arg_min(tag, row(shard, id, pos)) AS tag, count(*) AS count FROM tags {where} GROUP BY tag_lc"""
_register(
    "tag_build",
    tag_build,
    """
    WITH raw AS (
        SELECT shard, id, key, json_extract(payload, '$.tags') AS a FROM entries
        WHERE json_type(payload, '$.tags') = 'ARRAY'),
    items AS (SELECT shard, id, key, a, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS i FROM raw),
    texts AS (
        SELECT shard, id, key, i, json_extract_string(a, '$[' || i || ']') AS tag FROM items
        WHERE json_type(a, '$[' || i || ']') = 'VARCHAR')
    SELECT shard, id, key, lower(tag) AS tag_lc, first(tag ORDER BY i) AS tag, CAST(min(i) AS INTEGER) AS pos
    FROM texts GROUP BY shard, id, key, lower(tag)""",
)
_register("tag_counts", tag_counts, _COUNTS.format(where=""))
_register("tag_counts_prefix", tag_counts_prefix, _COUNTS.format(where="WHERE starts_with(key, '/home/')"))
_register("tag_canonical_case", tag_canonical_case, f"SELECT tag_lc, tag FROM ({_COUNTS.format(where='')})")
_register(
    "tag_bulk_counts",
    tag_bulk_counts,
    "SELECT w.tag_lc, count FROM (VALUES ('backup'), ('rust'), ('draft'), ('no such tag')) AS w(tag_lc) "
    f"LEFT JOIN ({_COUNTS.format(where='')}) AS c ON w.tag_lc = c.tag_lc",
)
_register("tag_postings", tag_postings, "SELECT DISTINCT shard, tag_lc, id FROM tags")


def _tagged(label: str) -> str:
    return f"EXISTS (SELECT 1 FROM tags t WHERE t.shard = e.shard AND t.id = e.id AND t.tag_lc = '{label}')"


def _rows(condition: str, prefix: str = "") -> str:
    return f"SELECT * FROM entries AS e WHERE starts_with(key, '{prefix}') AND {condition}"


_listing(
    "tag_and",
    ListQuery(tags=TagFilter(("Backup", "indexed"))),
    _flat_sql(_rows(f"{_tagged('backup')} AND {_tagged('indexed')}")),
)
_listing(
    "tag_or",
    ListQuery(tags=TagFilter(("urgent", "RUST", "none such"), mode="or")),
    _flat_sql(_rows(f"({_tagged('urgent')} OR {_tagged('rust')})")),
)
_listing("tag_exclude", ListQuery(tags=TagFilter((), ("backup",))), _flat_sql(_rows(f"NOT {_tagged('backup')}")))
_listing(
    "tag_include_exclude",
    ListQuery("/media/", tags=TagFilter(("indexed",), ("shared", "draft"))),
    _flat_sql(_rows(f"{_tagged('indexed')} AND NOT {_tagged('shared')} AND NOT {_tagged('draft')}", "/media/")),
)
_listing(
    "tag_group",
    ListQuery("/", "/", tags=TagFilter(("backup",))),
    _grouped_sql(_rows(_tagged("backup"), "/"), "/"),
)


# Search --------------------------------------------------------------------------------------------------------------

# DuckDB has no compatibility form.  It is written here by rule for the ranges of styled letters and digits, and as a list
# of fixed values for single characters; then canonical composition, small letters and accents are DuckDB's own.
_SINGLE = {
    "ª": "a", "º": "o", "²": "2", "³": "3", "¹": "1", "¼": "1⁄4", "½": "1⁄2", "¾": "3⁄4", "…": "...", "™": "tm", "№": "no", "µ": "μ",
    "¨": " ̈", "¯": " ̄", "´": " ́", "¸": " ̧", "˘": " ̆", "˙": " ̇", "˚": " ̊", "˛": " ̨",
    "˜": " ̃", "˝": " ̋", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
_COMPATIBLE = (
    "CASE WHEN ord(x) < 160 THEN x WHEN ord(x) BETWEEN 65281 AND 65374 THEN chr(ord(x) - 65248) "
    "WHEN ord(x) BETWEEN 119808 AND 120483 THEN chr(97 + (ord(x) - 119808) % 26) "
    "WHEN ord(x) BETWEEN 120782 AND 120831 THEN chr(48 + (ord(x) - 120782) % 10) "
    "WHEN ord(x) IN (160, 8239, 8287, 12288) OR ord(x) BETWEEN 8194 AND 8202 THEN ' ' "
    + "".join(f"WHEN x = '{x}' THEN '{y}' " for x, y in _SINGLE.items())
    + "ELSE x END"
)
_FORMS_SQL = f"""
    SELECT *, strip_accents(norm) AS strip FROM (
        SELECT *, CASE WHEN regexp_full_match(key, '[\x01-\x7F]*') THEN lower(key) ELSE
            lower(nfc_normalize(array_to_string([{_COMPATIBLE} FOR x IN string_split(key, '')], ''))) END AS norm
        FROM entries AS e)"""


def _grams_sql(text: str) -> str:
    """Grams of a text, over grapheme clusters."""
    return (
        f"CASE WHEN length_grapheme({text}) BETWEEN 1 AND 2 THEN [{text} || repeat(chr(0), 3 - length_grapheme({text}))] "
        f"ELSE [substring_grapheme({text}, i, 3) FOR i IN range(1, length_grapheme({text}) - 1)] END"
    )


_ALL_GRAMS = f"list_concat({_grams_sql('norm')}, CASE WHEN strip <> norm THEN {_grams_sql('strip')} ELSE [] END)"


def _holds_sql(term: str) -> str:
    """Does a key hold a term: as it is or without accents, and gram by gram?"""
    norm, bare = normalize(term), strip_accents(normalize(term))
    held = f"(contains(norm, '{norm}') OR contains(strip, '{bare}'))"
    if len(graphemes(norm)) < GRAM:
        return f"({held} AND (contains(norm, '{norm}') OR contains(strip, '{norm}')))"
    wanted = ", ".join(f"'{g}'" for g in grams(norm))
    return f"CASE WHEN {held} THEN list_has_all({_ALL_GRAMS}, [{wanted}]) ELSE false END"


def _lacks_sql(term: str) -> str:
    norm = normalize(term)
    return f"NOT (contains(norm, '{norm}') OR contains(strip, '{strip_accents(norm)}'))"


def _searched_sql(search: SearchFilter, condition: str = "true") -> str:
    wanted = [condition, *map(_holds_sql, search.include), *map(_lacks_sql, search.exclude)]
    return f"SELECT * EXCLUDE (norm, strip) FROM ({_FORMS_SQL}) AS e WHERE {' AND '.join(wanted)}"


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold two terms and not a third."""
    entries = table(spark, sf_dir, "entries")
    return search_entries(entries, SearchFilter(("BACK", "json"), ("catalog",))).select("shard", "id", "key")


_register(
    "search_terms",
    search_terms,
    f"SELECT shard, id, key FROM ({_searched_sql(SearchFilter(('BACK', 'json'), ('catalog',)))})",
)
for _name, _terms in (
    ("search_one", SearchFilter(("Report",))),
    ("search_multi", SearchFilter(("home", "plan"))),
    ("search_exclude", SearchFilter((), ("e",))),
    ("search_short", SearchFilter(("zi",))),
    ("search_accent", SearchFilter(("resume",))),
    ("search_accent_exact", SearchFilter(("résumé",))),
):
    _listing(_name, ListQuery(search=_terms), _flat_sql(_searched_sql(_terms)))


def search_by_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing whose search looks up candidates in the grams of the keys first."""
    db = database(spark, sf_dir)
    return listing.list_entries(
        db.entries, db.tags, ListQuery(search=SearchFilter(("resume",))), grams=gram_postings(spark, sf_dir)
    )


_register("search_by_grams", search_by_grams, _flat_sql(_searched_sql(SearchFilter(("resume",)))))


def gram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the grams of all keys."""
    return gram_index.build_grams(table(spark, sf_dir, "entries"))


def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys hold each gram."""
    return gram_postings(spark, sf_dir).groupBy("gram").agg(F.count(F.lit(1)).alias("n_keys"))


def gram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that hold all grams of a term."""
    return gram_index.gram_candidates(gram_postings(spark, sf_dir), "catalog")


_POSTINGS_SQL = f"SELECT DISTINCT shard, id, unnest({_ALL_GRAMS}) AS gram FROM ({_FORMS_SQL})"
_register("gram_postings", gram_postings, _POSTINGS_SQL)
_register("gram_counts", gram_counts, f"SELECT gram, count(*) AS n_keys FROM ({_POSTINGS_SQL}) GROUP BY gram")
_register(
    "gram_candidates",
    gram_candidates,
    f"SELECT shard, id FROM ({_FORMS_SQL}) WHERE list_has_all({_ALL_GRAMS}, "
    f"[{', '.join(repr(g) for g in grams('catalog'))}])",
)
_listing(
    "composed_tag_search_group",
    ListQuery("/opt/builds/", "/", tags=TagFilter(("indexed",), ("shared",)), search=SearchFilter(("in",), ("script",))),
    _grouped_sql(
        _searched_sql(
            SearchFilter(("in",), ("script",)),
            f"{_tagged('indexed')} AND NOT {_tagged('shared')} AND starts_with(key, '/opt/builds/')",
        ),
        "/opt/builds/",
    ),
)


def custom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the entries whose ids another table names."""
    db = database(spark, sf_dir)
    ids = db.tags.where(F.col("pos") == 2).select("shard", "id")
    return listing.list_entries(db.entries, db.tags, ListQuery("/", "/", custom=(ids,)))


_register(
    "custom_filter",
    custom_filter,
    _grouped_sql(
        _rows("EXISTS (SELECT 1 FROM tags t WHERE t.shard = e.shard AND t.id = e.id AND t.pos = 2)", "/"), "/"
    ),
)


# Ingest --------------------------------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_raw").where(F.col("fmt") == "jsonl").select("line_no", "value")


def jsonl_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of JSON lines; bad lines are dropped, the first line of a key wins."""
    keys = ingest.keys_from_json(_raw(spark, sf_dir), "path", "raw:", on_error="drop")
    entries = ingest.build_entries(keys)
    return entries.select("id", "key", F.get_json_object("payload", "$.size").alias("size"))


def jsonl_ingest_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same up to the first bad line."""
    keys = ingest.keys_from_json(_raw(spark, sf_dir), "path", on_error="stop")
    return keys.select("line_no", "key")


def text_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines as keys: all sightings' paths of a listing, each once, with ids."""
    lines = table(spark, sf_dir, "sample").select(F.col("path").alias("value"), F.col("entry_no").alias("line_no"))
    return ingest.build_entries(ingest.keys_from_text(lines, "crawl:")).select("id", "key")


def dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of every key per shard."""
    sample = table(spark, sf_dir, "sample").where(F.col("path").isNotNull())
    keys = sample.select("shard", F.col("path").alias("key"), "size", F.col("entry_no").alias("line_no"))
    return ingest.first_of_each_key(keys)


_STRICT = r"""
    CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' AND json_type(value, '$.path') = 'VARCHAR'
    AND NOT regexp_matches(value, ',\s*[}\]]\s*$') AND NOT regexp_matches(value, ':\s*-?(NaN|Infinity|nan|inf)') ELSE false END"""
_register(
    "jsonl_ingest",
    jsonl_ingest,
    rf"""
    WITH lines AS (SELECT line_no, value FROM sample_raw WHERE fmt = 'jsonl' AND value <> ''),
    good AS (
        SELECT line_no, 'raw:' || json_extract_string(value, '$.path') AS key,
               CAST(json_extract_string(value, '$.size') AS VARCHAR) AS size
        FROM lines WHERE {_STRICT}),
    firsts AS (SELECT key, first(size ORDER BY line_no) AS size FROM good GROUP BY key)
    SELECT row_number() OVER (ORDER BY key) AS id, key, size FROM firsts""",
)
_register(
    "jsonl_ingest_stop",
    jsonl_ingest_stop,
    rf"""
    WITH lines AS (SELECT line_no, value, {_STRICT} AS ok FROM sample_raw WHERE fmt = 'jsonl' AND value <> '')
    SELECT line_no, json_extract_string(value, '$.path') AS key FROM lines
    WHERE line_no < (SELECT min(line_no) FROM lines WHERE ok IS NOT TRUE)""",
)
_register(
    "text_ingest",
    text_ingest,
    "SELECT row_number() OVER (ORDER BY key) AS id, key FROM "
    "(SELECT DISTINCT 'crawl:' || path AS key FROM sample WHERE path <> '')",
)
_register(
    "dedup_ingest",
    dedup_ingest,
    "SELECT shard, path AS key, min(entry_no) AS line_no, first(size ORDER BY entry_no) AS size FROM sample "
    "WHERE path IS NOT NULL GROUP BY shard, path",
)
