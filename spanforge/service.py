"""A small HTTP service: GET /health, POST /search and POST /answer with JSON bodies."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from spanforge.engine import Engine


def respond(engine: Engine, method: str, path: str, body: dict) -> tuple[int, dict]:
    """Status and body of one request; 422 for a malformed one, 500 where there is no index."""
    try:
        if (method, path) == ("GET", "/health"):
            return 200, engine.health()
        if method == "POST" and path in ("/search", "/answer"):
            query, k, hybrid = body.get("query"), body.get("k", 10 if path == "/search" else 5), body.get("hybrid", False)
            if not isinstance(query, str) or not isinstance(k, int) or isinstance(k, bool) or not isinstance(hybrid, bool):
                return 422, {"detail": "query must be a string, k an integer, hybrid a boolean"}
            if path == "/search":
                return 200, {"query": query, "k": k, "retrieved_sources": engine.search(query, k, hybrid)}
            return 200, {"query": query, "answer": engine.answer(query, k, hybrid)}
        return 404, {"detail": "not found"}
    except FileNotFoundError as e:
        return 500, {"detail": str(e)}


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw or b"{}")
                status, out = respond(engine, method, self.path, body) if isinstance(body, dict) else (422, {"detail": "the body must be an object"})
            except ValueError:
                status, out = 422, {"detail": "the body is not JSON"}
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._reply("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._reply("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> None:
    server(engine, host, port).serve_forever()
