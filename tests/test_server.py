"""The library over HTTP and as tools."""

import io
import json
import threading
import urllib.error
import urllib.request

from corpusloom import server
from corpusloom.library import Library


def test_surfaces(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "euler.txt").write_text("Leonhard Euler studied graphs and bridges in Koenigsberg. " * 6)
    lib = Library(spark, str(tmp_path / "lib"))
    http = server.server(lib, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"

    def call(path, body=None):
        data = body if isinstance(body, (bytes, type(None))) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data), timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/api/status") == (200, {"status": "no_index", "chunk_count": 0})
        lib.index(str(root))
        assert call("/api/status?x=1")[1]["status"] == "ready"
        assert call("/api/pipeline/status")[1]["indexed"] == 1
        status, got = call("/api/query", {"question": "bridges"})
        assert status == 200 and got["sources"][0]["title"] == "euler.txt" and got["elapsed_s"] >= 0
        assert call("/api/sources", {"topic": "bridges", "top_k": 1})[1]["sources"][0].startswith("1. euler.txt")
        assert call("/api/query", {"question": " "}) == (400, {"error": "question required"})
        assert call("/api/query", b"{") == (400, {"error": "invalid JSON body"}) and call("/api/query", b"[1]")[0] == 400
        assert call("/nothing")[0] == 404 and call("/api/sources", {"topic": "x", "top_k": "many"})[0] == 500
    finally:
        http.shutdown()
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "query_library", "arguments": {"question": "bridges"}}}, {"id": 4, "method": "tools/call", "params": {"name": "find_sources", "arguments": {}}}, {"id": 5, "method": "other"}]
    out = io.StringIO()
    server.tools(lib, io.StringIO("\n".join(map(json.dumps, ask)) + "\n\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, None]
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["query_library", "find_sources"]
    assert "**Sources retrieved:**\n[1] euler.txt" in got[2]["result"]["content"][0]["text"]
    assert got[3]["result"] == {"content": [{"type": "text", "text": "topic required"}], "isError": True} and got[4]["error"]["code"] == -32601
