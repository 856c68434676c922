"""A library over HTTP on this machine, and as tools over standard input and output.

Routes and tools are tables from a name to a function of the library and the
request, so that both surfaces, and tests, call the same functions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO

from corpusloom.library import Library

PORT = 5175


class BadRequest(ValueError):
    """The request lacks something; its text says what."""


def _text(body: dict, name: str) -> str:
    value = body.get(name)
    if not isinstance(value, str) or not value.strip():
        raise BadRequest(f"{name} required")
    return value.strip()


def ask(lib: Library, body: dict) -> dict:
    began = time.time()
    return lib.query_library(_text(body, "question")) | {"elapsed_s": round(time.time() - began, 2)}


def sources(lib: Library, body: dict) -> dict:
    return {"sources": lib.find_sources(_text(body, "topic"), int(body.get("top_k", 5)))}


def pipeline(lib: Library, body: dict) -> dict:
    return lib.status()[1].first().asDict()


def index_status(lib: Library, body: dict) -> dict:
    return lib.index_status()


ROUTES: dict[tuple[str, str], Callable[[Library, dict], dict]] = {
    ("GET", "/api/status"): index_status, ("GET", "/api/pipeline/status"): pipeline, ("POST", "/api/query"): ask, ("POST", "/api/sources"): sources,
}


def respond(lib: Library, method: str, path: str, raw: bytes = b"") -> tuple[int, dict]:
    """Status and body of the answer to a request."""
    route = ROUTES.get((method, path.split("?")[0]))
    if route is None:
        return 404, {"error": "not found"}
    try:
        body = json.loads(raw) if raw else {}
        if not isinstance(body, dict):
            raise BadRequest("the body must be an object")
    except BadRequest as e:
        return 400, {"error": str(e)}
    except ValueError:
        return 400, {"error": "invalid JSON body"}
    try:
        return 200, route(lib, body)
    except BadRequest as e:
        return 400, {"error": str(e)}
    except Exception as e:  # noqa: BLE001 - one request's failure must not end the server
        return 500, {"error": f"{type(e).__name__}: {e}".split("\n")[0]}


def server(lib: Library, port: int = PORT) -> ThreadingHTTPServer:
    """A server on this machine only; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, body = respond(lib, self.command, self.path, self.rfile.read(size))
            out = json.dumps(body, ensure_ascii=False, default=str).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _answer

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


# --- tools ----------------------------------------------------------------------


def query_library(lib: Library, given: dict) -> str:
    """Answer a question from the library, with its sources."""
    got = lib.query_library(_text(given, "question"))
    cited = lambda s: ", ".join(str(x) for x in (s["author"], s["title"], s["year"]) if x)
    listed = "\n".join(f"[{i}] {cited(s)}" for i, s in enumerate(got["sources"], 1))
    return got["answer"] + (f"\n\n**Sources retrieved:**\n{listed}" if listed else "")


def find_sources(lib: Library, given: dict) -> str:
    """Find the library's most relevant sources for a topic, without an answer."""
    if not lib.index_status()["chunk_count"]:
        return "No index available."
    return "\n".join(lib.find_sources(_text(given, "topic"), int(given.get("top_k", 5)))) or "No results found."


TOOLS: dict[str, tuple[Callable[[Library, dict], str], dict]] = {
    "query_library": (query_library, {"type": "object", "properties": {"question": {"type": "string"}}, "required": ["question"]}),
    "find_sources": (find_sources, {"type": "object", "properties": {"topic": {"type": "string"}, "top_k": {"type": "integer"}}, "required": ["topic"]}),
}


def called(lib: Library, request: dict) -> dict | None:
    """The answer to one message of the tool protocol (JSON-RPC 2.0); none to a notification."""
    if "id" not in request:
        return None
    method, given = request.get("method"), request.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "corpusloom", "version": "0.2.0"}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": f.__doc__, "inputSchema": schema} for n, (f, schema) in TOOLS.items()]}
    elif method == "tools/call" and given.get("name") in TOOLS:
        try:
            result = {"content": [{"type": "text", "text": TOOLS[given["name"]][0](lib, given.get("arguments") or {})}], "isError": False}
        except Exception as e:  # noqa: BLE001 - told to the caller
            result = {"content": [{"type": "text", "text": str(e).split("\n")[0]}], "isError": True}
    else:
        return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": "method not found"}}
    return {"jsonrpc": "2.0", "id": request["id"], "result": result}


def tools(lib: Library, lines: IO[str], out: IO[str]) -> None:
    """Answers messages, one a line, until there are no more."""
    for line in lines:
        if line.strip():
            try:
                answer = called(lib, json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            if answer is not None:
                out.write(json.dumps(answer, ensure_ascii=False) + "\n")
                out.flush()
