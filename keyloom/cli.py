"""Command line: ``python -m keyloom.cli index|tag-index|search-index|compact|shell|serve``."""

from __future__ import annotations

import argparse
import resource
import sys
import time

from pyspark.sql import Observation, SparkSession

from keyloom.plans.database import Database
from keyloom.plans.server import make_server
from keyloom.plans.shell import Shell
from keyloom.sources import ingest


def _arguments(words: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="keyloom")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="build an index from text or JSON lines")
    index.add_argument("--index", required=True)
    index.add_argument("--input", required=True)
    index.add_argument("--json", help="field of JSON lines that holds the key")
    index.add_argument("--prefix", default="", help="put before each key")
    index.add_argument("--tag-index", help="payload field with tags")
    index.add_argument("--search-index", action="store_true")
    index.add_argument("--ignore-duplicates", action="store_true")
    index.add_argument("--on-error", choices=ingest.ON_ERROR, default="stop")
    tags = commands.add_parser("tag-index", help="add tags to an index")
    tags.add_argument("--index", required=True)
    tags.add_argument("--tag-field", default="tags")
    search = commands.add_parser("search-index", help="add search grams to an index")
    search.add_argument("--index", required=True)
    compact = commands.add_parser("compact", help="rewrite an index")
    compact.add_argument("--index", required=True)
    compact.add_argument("--target", required=True)
    shell = commands.add_parser("shell", help="query an index; with a command, run that only")
    shell.add_argument("--index", required=True)
    shell.add_argument("--delimiter", default="/")
    shell.add_argument("--limit", type=int, help="open at most so many shards")
    shell.add_argument("--debug", action="store_true")
    shell.add_argument("words", nargs=argparse.REMAINDER)
    serve = commands.add_parser("serve", help="answer HTTP requests")
    serve.add_argument("--index", required=True)
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=3000)
    serve.add_argument("--limit", type=int, default=1000, help="largest page")
    return parser.parse_args(words)


def _size(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength() if system.exists(target) else 0


def _index(spark: SparkSession, given: argparse.Namespace) -> int:
    began = time.monotonic()
    lines = ingest.read_lines(spark, given.input)
    errors = None
    if given.json is None:
        keys = ingest.keys_from_text(lines, given.prefix)
    else:
        errors = Observation("errors")
        keys = ingest.keys_from_json(lines, given.json, given.prefix, given.on_error, errors)
    keys, metrics = ingest.watched(keys)
    entries = ingest.build_entries(keys, given.ignore_duplicates)
    ingest.write_index(entries, given.index, given.tag_index, given.search_index)
    n = len(Database.open(spark, given.index))
    took = time.monotonic() - began
    read = {k: v or 0 for k, v in metrics.get.items()}
    size = read["key_bytes"] + read["payload_bytes"]
    parts = ", ".join(f"{name} {_size(spark, f'{given.index}/{name}')} bytes" for name in ingest.TABLES)
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
    print(f"{n} entries in {took:.1f} s, {n / took:.0f} entries/s, {size / took:.0f} bytes/s; read {read}", file=sys.stderr)
    print(f"written: {parts}; driver's Python at most {peak} MB", file=sys.stderr)
    bad = errors is not None and errors.get["n_bad"]
    if bad:
        print(f"Error processing entry {errors.get['first_bad']}", file=sys.stderr)
    return int(bool(bad) and given.on_error == "stop")


def _with_completion(shell: Shell) -> None:
    """Complete words with the tab key where the platform has a line editor."""
    try:
        import readline
    except ImportError:
        return
    found: list[str] = []

    def complete(_: str, state: int) -> str | None:
        if state == 0:
            found[:] = shell.complete(readline.get_line_buffer()[: readline.get_endidx()])
        return found[state] if state < len(found) else None

    readline.set_completer_delims(" ")
    readline.set_completer(complete)
    readline.parse_and_bind("tab: complete")


def _converse(spark: SparkSession, shell: Shell) -> None:
    """Read and run lines.  Ctrl-C ends the running command, twice in a row the shell."""
    _with_completion(shell)
    interrupted = False
    while not shell.done:
        try:
            for text in shell.run(input(f"{shell.cwd}> ")):
                print(text)
            interrupted = False
        except EOFError:
            break
        except KeyboardInterrupt:
            spark.sparkContext.cancelAllJobs()
            if interrupted:
                break
            interrupted = True
            print("interrupted; once more to leave")


def main(words: list[str] | None = None) -> int:
    given = _arguments(words)
    spark = SparkSession.builder.appName("keyloom").getOrCreate()
    if given.command == "index":
        return _index(spark, given)
    if given.command == "tag-index":
        ingest.write_tags(spark, given.index, given.tag_field)
    elif given.command == "search-index":
        ingest.write_grams(spark, given.index)
    elif given.command == "compact":
        ingest.compact(spark, given.index, given.target)
    elif given.command == "serve":
        make_server(Database.open(spark, given.index), given.host, given.port, given.limit).serve_forever()
    else:
        shell = Shell(Database.open(spark, given.index, given.limit), given.delimiter, given.debug)
        if given.words:
            for text in shell.run(" ".join(x for x in given.words if x != "--")):
                print(text)
            return 0
        _converse(spark, shell)
    return 0


if __name__ == "__main__":
    sys.exit(main())
