"""Search, questions and status over HTTP, as JSON."""

from __future__ import annotations

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from lodestone.plans.engine import Engine
from lodestone.sources import progress

PAGE = """<!doctype html><meta charset="utf-8"><title>lodestone</title>
<form id="f"><input id="q" size="60"> <select id="k"><option value="search">Search<option value="chat">Ask</select> <button>Go</button></form><pre id="out"></pre>
<script>
const out = document.getElementById("out"), show = x => out.textContent = JSON.stringify(x, null, 1)
document.getElementById("f").onsubmit = async e => {
  e.preventDefault()
  const q = document.getElementById("q").value, k = document.getElementById("k").value
  show(await (await fetch("/api/" + k, {method: "POST", body: JSON.stringify({query: q, question: q})})).json())
}
fetch("/api/stats").then(r => r.json()).then(show)
</script>"""


class Api:
    """The answers, apart from how they are sent: (status, body)."""

    def __init__(self, engine: Engine):
        self.engine, self.lock = engine, threading.Lock()

    def stats(self, _: dict) -> tuple[int, dict]:
        """The last run's progress with the counts that it wrote; the last file and errors from the catalog."""
        with self.lock:
            r = self.engine.report()
        run = progress.read(self.engine._progress_path() or os.devnull)
        counts = {"total_files": r["total"], "indexed": r["indexed"], "pending": r["pending"], "errors": r["errors"], "total_chunks": r["total_chunks"], "vector_count": r["vectors"]}
        ingest = {k: run[k] for k in ("phase", "files_queued", "files_processed", "files_errors", "dirs_visited", "files_checked", "files_new")}
        return 200, counts | {"last_file": r["last_file"] or "--", "recent_errors": r["errors_latest"], "ingest": ingest}

    def search(self, body: dict) -> tuple[int, dict]:
        query = str(body.get("query") or "").strip()
        if not query:
            return 400, {"error": "Empty query"}
        with self.lock:
            rows = self.engine.search(query, body.get("top_k"), body.get("file_type")).collect()
        return 200, {"results": [r.asDict() for r in rows]}

    def chat(self, body: dict) -> tuple[int, dict]:
        question = str(body.get("question") or "").strip()
        if not question:
            return 400, {"error": "Empty question"}
        with self.lock:
            return 200, self.engine.ask(question, body.get("top_k"), body.get("file_type"))


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that isn't started: serve_forever() does that."""
    api = Api(engine)
    routes = {("GET", "/api/stats"): api.stats, ("POST", "/api/search"): api.search, ("POST", "/api/chat"): api.chat}

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, data: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _answer(self, method: str) -> None:
            path = urlsplit(self.path).path
            if method == "GET" and path in ("/", "/search", "/chat"):
                return self._send(200, "text/html; charset=utf-8", PAGE.encode())
            f = routes.get((method, path))
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}") if method == "POST" else {}
            except ValueError:
                body = {}
            try:
                status, said = f(body if isinstance(body, dict) else {}) if f else (404, {"error": "Not found"})
            except Exception as e:  # noqa: BLE001  a request's fault is its answer
                status, said = 500, {"error": str(e)}
            return self._send(status, "application/json; charset=utf-8", json.dumps(said, ensure_ascii=False, default=str).encode())

        def do_GET(self) -> None:  # noqa: N802
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
