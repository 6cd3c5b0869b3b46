"""Read-only HTTP interface: /keys, /tags and /tags/counts, answered from lazy Spark plans."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from keyloom.model import MAX_LIMIT
from keyloom.plans.database import Database, make_query


def answer(database: Database, target: str, most: int = MAX_LIMIT) -> tuple[int, dict[str, Any]]:
    """(status, body) of a request target such as ``/keys?prefix=a/&delim=/&limit=10``."""
    url = urlsplit(target)
    given = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
    try:
        limit = min(int(given.get("limit", most)), most)
        cursor = given.get("cursor")
        if url.path == "/keys":
            query = make_query(
                given.get("prefix", ""),
                given.get("delim"),
                given.get("include_tags", ""),
                given.get("exclude_tags", ""),
                given.get("mode", "and"),
                given.get("search", ""),
                given.get("exclude_search", ""),
                given.get("require_index", "") in ("1", "true"),
            )
            return 200, database.keys_page(query, limit, cursor)
        if url.path in ("/tags", "/tags/counts"):
            return 200, database.tags_page(given.get("prefix", ""), limit, cursor)
    except ValueError as error:
        return 400, {"error": str(error)}
    return 404, {"error": "not found"}


def make_server(database: Database, host: str = "127.0.0.1", port: int = 3000, most: int = MAX_LIMIT):
    """A threaded server; call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802 - named by the base class
            try:
                status, body = answer(database, self.path, most)
            except Exception as error:  # noqa: BLE001 - whatever fails, the client gets an answer
                status, body = 500, {"error": str(error).splitlines()[0] if str(error) else type(error).__name__}
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
