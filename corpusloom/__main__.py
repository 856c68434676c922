"""``python -m corpusloom LIBRARY COMMAND``: index, ask, sources, status, serve (HTTP), tools (standard input and output)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from corpusloom import server
from corpusloom.library import Library


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("library", help="folder of the library's tables")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="index new and changed files")
    index.add_argument("root")
    index.add_argument("--limit", type=int)
    for name in ("ask", "sources"):
        c = sub.add_parser(name)
        c.add_argument("text")
        c.add_argument("--top-k", type=int, default=5)
    sub.add_parser("status")
    sub.add_parser("serve").add_argument("--port", type=int, default=server.PORT)
    sub.add_parser("tools")
    a = p.parse_args(args)
    lib = Library(SparkSession.builder.appName("corpusloom").getOrCreate(), a.library)
    if a.command == "index":
        print(f"{lib.index(a.root, limit=a.limit)} files indexed")
    elif a.command == "ask":
        print(json.dumps(lib.query_library(a.text), ensure_ascii=False, indent=2))
    elif a.command == "sources":
        print("\n".join(lib.find_sources(a.text, a.top_k)))
    elif a.command == "serve":
        server.server(lib, a.port).serve_forever()
    elif a.command == "tools":
        server.tools(lib, sys.stdin, sys.stdout)
    else:
        print(json.dumps(lib.status()[1].first().asDict() | lib.index_status(), indent=2))


if __name__ == "__main__":
    main()
