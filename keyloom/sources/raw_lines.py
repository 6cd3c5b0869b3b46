"""Load raw listing lines, setting aside those that fail to parse (problem 1).

Two kinds of check decide about a line:

* structure: the line is one strict JSON object, or exactly four RFC 4180 fields; its ``path`` is a string that
  isn't empty and its ``tags`` can be read.  No built-in expression tells strict JSON from lenient (trailing
  text, control characters), so lines are split in Arrow batches.
* values: each distinct raw value of ``last_modified`` and ``size`` is cast once.  The values that can't be cast
  or lie out of range make a dictionary ``token -> reason`` that is joined back to the lines.

The split lines are written once to the checkpoint folder, as the dictionary and the join both read them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.runtime import cut

#: Times at or beyond 2100-01-01 are taken for milliseconds or garbage.
LATEST_TIME = 4102444800

SPLIT_SCHEMA = T.StructType(
    [
        T.StructField("line_no", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("fmt", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("structure", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("last_modified", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
_ARROW_SCHEMA = pa.schema(
    [
        ("line_no", pa.int64()),
        ("shard", pa.int32()),
        ("fmt", pa.string()),
        ("value", pa.string()),
        ("structure", pa.string()),
        ("path", pa.string()),
        ("last_modified", pa.string()),
        ("size", pa.string()),
        ("tags", pa.list_(pa.string())),
    ]
)

_JSON_SPACE = " \t\r\n"
_CSV_FIELD = re.compile(r'"((?:[^"]++|"")*+)"|([^",\r\n]*+)')
_LONE_SURROGATE = re.compile("[\ud800-\udfff]")


class _Int(str):
    """The digits of a JSON integer."""


class _Float(str):
    """The text of a JSON number with a fraction or an exponent."""


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


_DECODER = json.JSONDecoder(parse_int=_Int, parse_float=_Float, parse_constant=_no_constant, strict=True)


_JSON_TOKEN = re.compile(
    r'[ \t\r\n]*+(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+")'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)|$)"
)
_LITERALS = {"true": True, "false": False, "null": None}


def decode_deep(text: str):
    """Strict JSON of any depth, without recursion; ValueError where it isn't."""
    holders: list[tuple[list | dict, str | None]] = []  # open arrays and objects, each with the name that waits in it
    result, at, wanted = None, 0, "value"
    while True:
        match = _JSON_TOKEN.match(text, at)
        if match is None or (match.end() == at and wanted != "end"):
            raise ValueError(f"nothing valid at {at}")
        sign, string, number, literal = match.groups()
        if wanted == "end":
            if match.end() != len(text) or sign or string or number or literal:
                raise ValueError(f"extra data at {at}")
            return result
        at = match.end()
        if wanted in ("name", "name or }") and string is not None:
            holders[-1] = (holders[-1][0], _DECODER.decode(string))
            wanted = ":"
            continue
        if wanted == ":" and sign == ":":
            wanted = "value"
            continue
        if wanted == "next" and sign == ",":
            wanted = "name" if isinstance(holders[-1][0], dict) else "value"
            continue
        closing = {"]": list, "}": dict}.get(sign)
        if closing and holders and isinstance(holders[-1][0], closing) and wanted in ("next", "value or ]", "name or }"):
            value = holders.pop()[0]
        elif wanted not in ("value", "value or ]"):
            raise ValueError(f"{sign or string or number or literal!r} at {match.start()}")
        elif sign in ("[", "{"):
            holders.append(([], None) if sign == "[" else ({}, None))
            wanted = "value or ]" if sign == "[" else "name or }"
            continue
        elif sign:
            raise ValueError(f"{sign!r} at {match.start()}")
        elif literal:
            value = _LITERALS[literal]
        else:
            value = _DECODER.decode(string or number)
        if not holders:
            result, wanted = value, "end"
            continue
        holder, name = holders[-1]
        if isinstance(holder, dict):
            holder[name] = value
        else:
            holder.append(value)
        wanted = "next"


def _kind(value) -> str:
    if value is None:
        return "null"
    for kind, name in ((bool, "boolean"), (_Int, "int"), (_Float, "float"), (str, "string"), (list, "array")):
        if isinstance(value, kind):
            return name
    return "object"


def _text(value: str) -> str:
    """Valid Unicode: a lone surrogate escape, which no column can hold, becomes U+FFFD."""
    return _LONE_SURROGATE.sub("�", value) if _LONE_SURROGATE.search(value) else value


def _token(record: dict, field: str) -> str:
    """``kind:raw text`` of a field, the key of the invalid-value dictionary."""
    if field not in record:
        return "absent:"
    value = record[field]
    kind = _kind(value)
    return f"{kind}:{_text(value)}" if kind in ("int", "float", "string") else f"{kind}:"


def split_json(line: str) -> tuple[str | None, str | None, str | None, str | None, list[str] | None]:
    """(structural failure, path, last_modified token, size token, tags) of a JSON line."""
    failed = (None, None, None, None)
    try:
        record = _DECODER.decode(line.strip(_JSON_SPACE))
    except RecursionError:
        try:
            record = decode_deep(line)
        except ValueError as error:
            return (f"not strict JSON: {error}", *failed)
    except ValueError as error:
        return (f"not strict JSON: {getattr(error, 'msg', None) or error}", *failed)
    if not isinstance(record, dict):
        return (f"JSON {_kind(record)} instead of an object", *failed)
    if "path" not in record:
        reason = "path is absent"
    elif _kind(record["path"]) != "string":
        reason = f"path is {_kind(record['path'])}, not a string"
    elif not record["path"]:
        reason = "path is empty"
    else:
        reason = None
    tags = record.get("tags")
    if tags is not None and not isinstance(tags, list):
        reason = reason or f"tags is {_kind(tags)}, not an array"
    path = _text(record["path"]) if reason is None else None
    labels = [_text(x) for x in tags if _kind(x) == "string"] if isinstance(tags, list) else None
    return reason, path, _token(record, "last_modified"), _token(record, "size"), labels


def split_csv(line: str) -> tuple[str | None, str | None, str | None, str | None, list[str] | None]:
    """The same of a CSV line: exactly four fields, quoted as in RFC 4180."""
    failed = (None, None, None, None)
    fields, at = [], 0
    while True:
        match = _CSV_FIELD.match(line, at)
        quoted = match.group(1)
        fields.append(match.group(2) if quoted is None else quoted.replace('""', '"'))
        at = match.end()
        if at == len(line):
            break
        if line[at] != ",":
            if line[at] in "\r\n":
                return ("line break outside quotes", *failed)
            if quoted is None and line[match.start()] == '"':
                return ("quote is never closed", *failed)
            return ("text beside a quoted field" if quoted is not None else "quote inside an unquoted field", *failed)
        at += 1
    if len(fields) != 4:
        return (f"{'fewer' if len(fields) < 4 else 'more'} than four fields", *failed)
    path, modified, size, tags = fields
    if not path:
        return "path is empty", None, f"text:{modified}", f"text:{size}", None
    return None, path, f"text:{modified}", f"text:{size}", [x for x in tags.split(";") if x]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, values = batch.column("fmt").to_pylist(), batch.column("value").to_pylist()
        rows = []
        for kind, value in zip(kinds, values):
            if kind == "jsonl":
                rows.append(split_json(value))
            elif kind == "csv":
                rows.append(split_csv(value))
            else:
                rows.append((f"unknown format {kind}", None, None, None, None))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("line_no"), batch.column("shard"), batch.column("fmt"), batch.column("value")]
            + [pa.array(list(c), type=_ARROW_SCHEMA.field(4 + i).type) for i, c in enumerate(columns)],
            schema=_ARROW_SCHEMA,
        )


def split_lines(raw: DataFrame) -> DataFrame:
    """Structure of every line of ``raw`` whose value is neither null nor empty."""
    lines = raw.where(F.col("value").isNotNull() & (F.col("value") != "")).select(
        F.col("line_no").cast("long"), F.col("shard").cast("int"), "fmt", "value"
    )
    return lines.mapInArrow(_split, SPLIT_SCHEMA)


def _cast_reason(field: str, latest: int | None):
    """Reason why a token of ``field`` is invalid, null where it is valid."""
    kind, raw = F.substring_index("token", ":", 1), F.expr("substring(token, instr(token, ':') + 1)")
    digits = F.regexp_replace(raw, "^-?0*", "")
    negative = raw.startswith("-") & (digits != "")
    reason = (
        F.when(kind == "absent", f"{field} is absent")
        .when(~kind.isin("int", "text"), F.concat(F.lit(f"{field} is "), kind, F.lit(", not an integer")))
        .when(raw == "", f"{field} is empty")
        .when((kind == "text") & ~raw.rlike(r"\A[0-9]+\z"), f"{field} isn't plain digits")
        .when(negative, f"{field} is negative")
    )
    if latest is None:
        return reason
    value = F.expr("try_cast(concat('0', regexp_replace(substring(token, instr(token, ':') + 1), '^0*', '')) as decimal(38,0))")
    too_late = (F.length(digits) > len(str(latest))) | (value >= F.lit(latest).cast("decimal(38,0)"))
    return reason.when(too_late, f"{field} is out of range")


def invalid_values(split: DataFrame, field: str, latest: int | None) -> DataFrame:
    """Dictionary ``(token, reason)`` of the invalid ones among the distinct values of ``field``."""
    distinct = split.where(F.col(field).isNotNull()).select(F.col(field).alias("token")).distinct()
    return distinct.select("token", _cast_reason(field, latest).alias("reason")).where(F.col("reason").isNotNull())


def _judged(split: DataFrame) -> DataFrame:
    """Split lines with the column ``reason``, empty for valid ones: structure and dictionaries of invalid values."""
    times = invalid_values(split, "last_modified", LATEST_TIME).select(
        F.col("token").alias("last_modified"), F.col("reason").alias("bad_time")
    )
    sizes = invalid_values(split, "size", None).select(F.col("token").alias("size"), F.col("reason").alias("bad_size"))
    # Dictionaries hold invalid values only.  Where one isn't small, AQE splits the hot tokens of the left side.
    return (
        split.join(times, "last_modified", "left")
        .join(sizes, "size", "left")
        .withColumn("reason", F.concat_ws("; ", "structure", "bad_time", "bad_size"))
    )


def failed_numbers(raw: DataFrame) -> DataFrame:
    """``line_no, shard, fmt, reason`` of the failed lines, as by ``load_lines``; texts aren't kept on the way."""
    judged = _judged(cut(split_lines(raw).select("line_no", "shard", "fmt", "structure", "last_modified", "size")))
    return judged.where(F.col("reason") != "").select("line_no", "shard", "fmt", "reason")


def load_lines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, failed) of the raw lines ``line_no, shard, fmt, value``.

    * valid: ``line_no, shard, fmt, path, last_modified, size, tags``; typed.  A ``size`` beyond 64 bits, which is
      valid, is held in ``size_text``; ``size`` is null there.
    * failed: ``line_no, shard, fmt, reason, value``; all reasons of the line, separated by ``; ``.

    Null and empty values are neither.  An unknown ``fmt``, also null, fails.  Repeated lines stay repeated, lines
    with a null ``line_no`` are treated like others, other columns of ``raw`` are dropped, an empty table gives two
    empty ones.  JSON names that occur twice count with their last value.  Elements of ``tags`` that aren't strings
    are left out.
    """
    judged = _judged(cut(split_lines(raw)))
    raw_size = F.substring_index("size", ":", -1)
    valid = judged.where(F.col("reason") == "").select(
        "line_no",
        "shard",
        "fmt",
        "path",
        F.substring_index("last_modified", ":", -1).cast("long").alias("last_modified"),
        F.expr("try_cast(substring_index(size, ':', -1) as bigint)").alias("size"),
        F.when(F.expr("try_cast(substring_index(size, ':', -1) as bigint)").isNull(), raw_size).alias("size_text"),
        "tags",
    )
    failed = judged.where(F.col("reason") != "").select("line_no", "shard", "fmt", "reason", "value")
    return valid, failed
