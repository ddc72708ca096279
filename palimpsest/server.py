"""Search as a service: JSON over HTTP, and JSON lines from a stream.

GET /health; POST /search {"query", "k"}, /mentions {"term", "limit", "context"},
/read {"source", "max_chars"}. One session answers; Spark spreads each request.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import positions, search
from palimpsest.operators.index import Index


class Service:
    def __init__(self, spark: SparkSession, index: Index, snippet_width: int = 500):
        self.spark, self.index, self.width = spark, index.cache(), snippet_width

    def search(self, query: str, k: int = 8) -> dict:
        q = self.spark.createDataFrame([(0, query)], "qid long, query string")
        hits = search.search(self.index, q, k=k).join(self.index.docs.select("doc_id", "text"), "doc_id")
        snip = T.snippet(F.col("text"), T.query_terms(F.lit(query)), self.width)
        rows = hits.select("rank", "doc_id", "source", F.round("score", 6).alias("score"), snip.alias("s")).orderBy("rank").collect()  # k rows
        return {"query": query, "hits": [{"rank": r["rank"] + 1, "doc_id": r.doc_id, "source": r.source, "score": r.score, "text": r.s.snippet, "truncated": r.s.truncated} for r in rows]}

    def mentions(self, term: str, limit: int = 60, context: int = 0) -> dict:
        rows = search.mentions(self.index.docs, term, limit, context).collect()  # limit rows
        return {"term": term, "sources": [{"source": r.source, "count": r["count"], **({"context": r.context} if context else {})} for r in rows]}

    def read(self, source: str, max_chars: int = 24000) -> dict:
        wanted = self.spark.createDataFrame([(source,)], "source string")
        page = positions.read_pages(self.index.docs.where(F.col("source") == source), wanted, max_chars).first()
        if page.missing:
            return {"source": source, "error": "no such page"}
        return {"source": source, "text": page.body[:max_chars], "truncated": len(page.body) > max_chars}

    def answer(self, request: dict) -> dict:
        """One request of a stream: {"query"}, {"mentions"} or {"read"}."""
        if "query" in request:
            return self.search(str(request["query"]), int(request.get("k", 8)))
        if "mentions" in request:
            return self.mentions(str(request["mentions"]), int(request.get("limit", 60)), int(request.get("context", 0)))
        if "read" in request:
            return self.read(str(request["read"]), int(request.get("max_chars", 24000)))
        raise ValueError("a request has query, mentions or read")


def answer_lines(service: Service, lines: Iterable[str]) -> Iterator[str]:
    """A JSON line for each that isn't blank; errors are answers too."""
    for line in lines:
        if line.strip():
            try:
                out = service.answer(json.loads(line))
            except (ValueError, TypeError, KeyError) as e:
                out = {"error": str(e)}
            yield json.dumps(out, ensure_ascii=False)


class Loading:
    """A service that isn't ready until load(), in a thread of its own, is done."""

    def __init__(self, load: Callable[[], Service]):
        self.service: Service | None = None
        self.failed: str | None = None
        self._thread = threading.Thread(target=self._run, args=(load,), daemon=True)
        self._thread.start()

    def _run(self, load: Callable[[], Service]) -> None:
        try:
            self.service = load()
        except Exception as e:
            self.failed = f"{type(e).__name__}: {e}"

    def wait(self, seconds: float | None = None) -> None:
        self._thread.join(seconds)


def make_server(service: Service | Loading, port: int = 0) -> ThreadingHTTPServer:
    """A server; while its service is loading, requests get 503."""
    loading = service if isinstance(service, Loading) else None
    names = {"/search": "search", "/mentions": "mentions", "/read": "read"}

    def ready() -> Service | None:
        return loading.service if loading else service

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path != "/health":
                return self._send(404, {"error": "no such path"})
            if ready():
                return self._send(200, {"status": "ok"})
            self._send(503, {"status": "failed", "error": loading.failed} if loading.failed else {"status": "loading"})

        def do_POST(self) -> None:
            if self.path not in names:
                return self._send(404, {"error": "no such path"})
            if not ready():
                return self._send(503, {"error": loading.failed or "the index is loading"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                out = getattr(ready(), names[self.path])(**body)
            except (ValueError, TypeError) as e:
                return self._send(400, {"error": str(e)})
            except Exception as e:
                return self._send(500, {"error": type(e).__name__})
            self._send(404 if "error" in out else 200, out)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
