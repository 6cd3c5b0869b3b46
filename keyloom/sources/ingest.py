"""Build an index: keys and payloads from text, JSON lines or any DataFrame, with dense ids, tags and grams.

On disk an index is a folder of Parquet tables, each partitioned by ``version`` and ``shard``:

* ``entries``: id, key, payload (JSON text, null for none), key_norm, key_strip; ordered by key within a shard
* ``tags``, ``grams``: only where asked for
* ``manifest``: one row per shard with the versions of its tables; written last.  It alone tells what an index holds:
  a folder without it holds no complete index, and versions that no row names are leftovers
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.text import search_forms
from keyloom.model import IndexFormatError
from keyloom.operators.gram_index import build_grams
from keyloom.operators.lookup import shard_stats
from keyloom.operators.tag_index import build_tags
from keyloom.runtime import cut

ON_ERROR = ("fail", "drop", "stop")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of the lines of text files that aren't empty, numbered from 1 in order of file name and line."""
    return numbered(spark.read.text(path).select("value", "_metadata"))


def numbered(lines: DataFrame) -> DataFrame:
    """``line_no, value`` of ``value, _metadata``; empty lines are left out and not counted.

    Spark splits and packs files by size.  Lines are numbered within their split where they are read; the splits'
    offsets come from one row per split.
    """
    placed = lines.where(F.col("value") != "").select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    splits = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = splits.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = placed.join(offsets, ["_file", "_block"])
    return joined.select((F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def keys_from_text(lines: DataFrame, prefix: str = "") -> DataFrame:
    """``key, payload, line_no``: each line that isn't null or empty is a key without payload."""
    kept = lines.where(F.col("value") != "")
    return kept.select(F.concat(F.lit(prefix), "value").alias("key"), F.lit(None).cast("string").alias("payload"), "line_no")


def parse_objects(lines: DataFrame, key_field: str) -> DataFrame:
    """``line_no, value, key, payload``; key is null where the line is no strict JSON object with a text under it.

    Spark's parser stops after the first JSON value, so the line is put into an object that ends with a mark made of
    the line: the mark is only found behind a line that is exactly one value.  The rest of the object is the payload.
    A name that occurs twice counts with its last value; the session is set to allow it.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    mark = F.sha1("value")
    framed = F.concat(F.lit('{"line":'), F.col("value"), F.lit(',"end":"'), mark, F.lit('"}'))
    parsed = lines.withColumn("_v", F.try_parse_json(framed)).withColumn(
        "_whole", F.coalesce(F.try_variant_get("_v", "$.end", "string") == mark, F.lit(False))
    )
    fields = F.when(F.col("_whole"), F.try_variant_get("_v", "$.line", "map<string,variant>"))
    name = F.lit(key_field)
    field = F.try_element_at("_fields", name)
    key = F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))
    rest = F.to_json(F.map_filter("_fields", lambda k, v: k != name))
    return parsed.withColumn("_fields", fields).select("line_no", "value", key.alias("key"), rest.alias("payload"))


def keys_from_json(
    lines: DataFrame, key_field: str, prefix: str = "", on_error: str = "fail", errors: Observation | None = None
) -> DataFrame:
    """``key, payload, line_no`` of JSON lines; the key field is taken out of the payload.

    ``errors`` is filled with ``n_bad`` and ``first_bad`` while the lines are first processed.

    Lines that aren't an object, or whose key field isn't a text, are errors: ``fail`` raises when the result is
    computed, ``drop`` leaves them out, ``stop`` keeps what stands before the first of them.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {', '.join(ON_ERROR)}")
    parsed = parse_objects(lines.where(F.col("value") != ""), key_field)
    good = F.col("key").isNotNull()
    if errors is not None:
        parsed = parsed.observe(
            errors, F.count_if(~good).alias("n_bad"), F.min(F.when(~good, F.col("line_no"))).alias("first_bad")
        )
    if on_error == "fail":
        message = F.concat(F.lit("Error processing entry "), F.col("line_no").cast("string"))
        parsed = parsed.withColumn("key", F.when(good, F.col("key")).otherwise(F.raise_error(message).cast("string")))
    elif on_error == "drop":
        parsed = parsed.where(good)
    else:
        first_bad = parsed.where(~good).agg(F.min("line_no").alias("n")).scalar()
        parsed = parsed.where(F.col("line_no") < F.coalesce(first_bad, F.lit(2**63 - 1)))
    return parsed.select(F.concat(F.lit(prefix), "key").alias("key"), "payload", "line_no")


def first_of_each_key(keys: DataFrame, by: str = "line_no") -> DataFrame:
    """One row per ``shard, key``: that with the least ``by``.

    An aggregate, not a window: repeats of a hot key are combined per task before the shuffle.
    """
    columns = [c for c in keys.columns if c not in ("shard", "key", by)]
    first = keys.groupBy("shard", "key").agg(F.min(F.struct(by, *columns)).alias("_first"))
    return first.select("shard", "key", *[F.col(f"_first.{c}") for c in (by, *columns)])


def with_ids(entries: DataFrame) -> DataFrame:
    """Add ``id``: 1..N in byte order of the key within each shard.

    Rows are range-partitioned by shard and key and sorted, so no task holds a whole shard.  Each partition numbers
    its own rows; the offsets come from one row per partition and shard.
    """
    ranged = entries.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    marked = placed.withColumn("_part", part)
    starts = marked.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_start"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = marked.join(offsets, ["shard", "_part"])
    return joined.withColumn("id", F.col("_at") - F.col("_start") + F.col("_before") + 1).drop(
        "_at", "_part", "_start", "_before"
    )


def build_entries(keys: DataFrame, ignore_duplicates: bool = True) -> DataFrame:
    """``shard, id, key, payload`` from ``key, payload, line_no`` and, if there, ``shard`` (else 0).

    Repeats of a key within a shard keep the first line's payload; with ``ignore_duplicates=False`` they raise.
    """
    if "shard" not in keys.columns:
        keys = keys.withColumn("shard", F.lit(0))
    rows = keys.where(F.col("key").isNotNull()).select(F.col("shard").cast("int"), "key", "payload", "line_no")
    if not ignore_duplicates:
        repeats = rows.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        if not repeats.isEmpty():
            raise IndexFormatError("a key occurs twice in a shard")
    return with_ids(first_of_each_key(rows)).select("shard", "id", "key", "payload")


@dataclass(frozen=True)
class IndexTables:
    """The tables of an index; ``tags`` and ``grams`` are None where no shard has them.

    ``gram_shards`` are the shards that have grams.
    """

    entries: DataFrame
    manifest: DataFrame
    tags: DataFrame | None = None
    grams: DataFrame | None = None
    gram_shards: tuple[int, ...] = ()


def manifest_of(entries: DataFrame, has_tags: bool = False, has_search: bool = False) -> DataFrame:
    stats = shard_stats(entries)
    return stats.withColumn("has_tags", F.lit(has_tags)).withColumn("has_search", F.lit(has_search))


TABLES = {"entries": ["key"], "tags": ["tag_lc", "key"], "grams": ["gram", "id"]}


def stored_entries(entries: DataFrame) -> DataFrame:
    """``shard, id, key, payload`` with the forms that searches compare."""
    return entries.withColumn("_f", search_forms(F.col("key"))).select(
        "shard", "id", "key", "payload", F.col("_f.norm").alias("key_norm"), F.col("_f.strip").alias("key_strip")
    )


def write_table(table: DataFrame, path: str, name: str, version: str) -> DataFrame:
    """Write one table of an index as ``version``; what is read back."""
    order = TABLES[name]
    sorted_rows = table.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order)
    target = f"{path}/{name}/version={version}"
    sorted_rows.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(target)
    return table.sparkSession.read.schema(table.schema).parquet(target)


def write_manifest(rows: DataFrame, path: str, whole: bool) -> None:
    """Write rows of the manifest, all of it if ``whole``, else those of the shards that ``rows`` holds."""
    writer = rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic")
    writer.partitionBy("shard").parquet(f"{path}/manifest")


def write_shards(
    entries: DataFrame, path: str, version: str, tag_field: str | None = None, search: bool = False, whole: bool = True
) -> None:
    """Write ``shard, id, key, payload`` and what is derived from it; the manifest comes last.

    With ``whole`` the index is replaced, else the shards are added to it or replaced in it.
    """
    written = write_table(stored_entries(entries), path, "entries", version)
    if tag_field is not None:
        write_table(build_tags(written, tag_field), path, "tags", version)
    if search:
        write_table(build_grams(written), path, "grams", version)
    rows = manifest_of(written, tag_field is not None, search).withColumns(
        {
            "entries_version": F.lit(version),
            "tags_version": F.lit(version if tag_field is not None else None).cast("string"),
            "grams_version": F.lit(version if search else None).cast("string"),
        }
    )
    rows = cut(rows)
    if whole:
        _delete(entries.sparkSession, f"{path}/manifest")
    write_manifest(rows, path, whole)
    if whole:
        _drop_leftovers(entries.sparkSession, path)


def watched(keys: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The keys, and counts and sizes that are filled in while they are first processed."""
    metrics = Observation(name)
    counted = keys.observe(
        metrics,
        F.count(F.lit(1)).alias("n_keys"),
        F.count("payload").alias("n_payloads"),
        F.sum(F.octet_length("key")).alias("key_bytes"),
        F.sum(F.octet_length("payload")).alias("payload_bytes"),
    )
    return counted, metrics


def write_index(entries: DataFrame, path: str, tag_field: str | None = None, search: bool = False) -> None:
    """Write ``shard, id, key, payload`` as an index; what the folder held before goes with the old manifest."""
    write_shards(entries, path, uuid.uuid4().hex, tag_field, search)


def _add_table(spark: SparkSession, path: str, name: str, build) -> None:
    """Add a derived table to all shards of a written index."""
    tables, version = open_index(spark, path), uuid.uuid4().hex
    write_table(build(tables.entries), path, name, version)
    flag = "has_tags" if name == "tags" else "has_search"
    rows = cut(tables.manifest.withColumns({flag: F.lit(True), f"{name}_version": F.lit(version)}))
    write_manifest(rows, path, whole=True)
    _drop_leftovers(spark, path)


def write_tags(spark: SparkSession, path: str, field: str = "tags") -> None:
    """Add the tag table to a written index, or build it anew."""
    _add_table(spark, path, "tags", lambda entries: build_tags(entries, field))


def write_grams(spark: SparkSession, path: str) -> None:
    """Add the search table to a written index, or build it anew."""
    _add_table(spark, path, "grams", build_grams)


def compact(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite an index into ``target`` with freshly sized files; tables that ``source`` lacks stay absent."""
    tables, version = open_index(spark, source), uuid.uuid4().hex
    rows = tables.manifest
    for name in TABLES:
        table = getattr(tables, name)
        if table is not None:
            write_table(table, target, name, version)
            column = f"{name}_version"
            rows = rows.withColumn(column, F.when(F.col(column).isNotNull(), F.lit(version)))
    rows = cut(rows)
    _delete(spark, f"{target}/manifest")
    write_manifest(rows, target, whole=True)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def _drop_leftovers(spark: SparkSession, path: str) -> None:
    """Delete versions of tables that the manifest doesn't name."""
    rows = _manifest(spark, path).collect()  # one row per shard
    for name in TABLES:
        named = {r[f"{name}_version"] for r in rows}
        system, target = _file_system(spark, f"{path}/{name}")
        for status in system.listStatus(target) if system.exists(target) else ():
            version = status.getPath().getName()
            if version.startswith("version=") and version.removeprefix("version=") not in named:
                system.delete(status.getPath(), True)


_MANIFEST = (
    "n_keys long, min_key string, max_key string, common_prefix string, has_tags boolean, has_search boolean, "
    "entries_version string, tags_version string, grams_version string, shard int"
)
_ENTRIES = "id long, key string, payload string, key_norm string, key_strip string, version string, shard int"
_SCHEMAS = {
    "entries": _ENTRIES,
    "tags": "id long, key string, tag_lc string, tag string, pos int, version string, shard int",
    "grams": "gram string, id long, version string, shard int",
}


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def damage(spark: SparkSession, path: str, version: str, shard: int) -> str | None:
    """What is wrong with a shard's entries, None if nothing: they must exist, as files that are Parquet to the end."""
    system, target = _file_system(spark, f"{path}/entries/version={version}/shard={shard}")
    if not system.exists(target):
        return "its entries are missing"
    for status in system.listStatus(target):
        name, size = status.getPath().getName(), status.getLen()
        if name.endswith(".parquet"):
            if size < 12:
                return f"{name} is cut off"
            try:
                stream = system.open(status.getPath())
                stream.seek(size - 4)
                end = bytes(stream.read() & 0xFF for _ in range(4))
                stream.close()
            except Py4JJavaError as error:  # among others, a wrong checksum
                return f"{name} can't be read: {error.java_exception.getMessage()}"
            if end != b"PAR1":
                return f"{name} isn't Parquet to its end"
    return None


def open_index(spark: SparkSession, path: str, limit: int | None = None) -> IndexTables:
    """Open a written or streamed index, at most the first ``limit`` of its shards in order of their numbers.

    A shard whose entries are missing or damaged is passed over with a warning.
    """
    if not _exists(spark, f"{path}/manifest"):
        raise IndexFormatError(f"{path} holds no complete index")
    manifest = _manifest(spark, path)
    rows = sorted(manifest.collect(), key=lambda r: r.shard)[:limit]  # one row per shard
    sound = []
    for row in rows:
        wrong = damage(spark, path, row.entries_version, row.shard)
        if wrong:
            warnings.warn(f"shard {row.shard} of {path} is passed over: {wrong}", stacklevel=2)
        else:
            sound.append(row)

    def read(name: str) -> DataFrame | None:
        parts = [f"{row[f'{name}_version']}/{row.shard}" for row in sound if row[f"{name}_version"] is not None]
        if not parts and name != "entries":
            return None
        if not parts:
            return spark.createDataFrame([], _SCHEMAS[name]).drop("version")
        table = spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")
        part = F.concat_ws("/", "version", F.col("shard").cast("string"))
        return table.where(part.isin(parts)).drop("version")

    kept = manifest.where(F.col("shard").isin([r.shard for r in sound])) if len(sound) else manifest.where(F.lit(False))
    searched = tuple(r.shard for r in sound if r.grams_version is not None)
    return IndexTables(read("entries"), kept, read("tags"), read("grams"), searched)
