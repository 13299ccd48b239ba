"""Command line: build, search, evaluate and serve; list and export a library."""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from .engine import Engine, evaluate, payload, render
from .runtime import session
from .sources.documents import HashEncoder, build_documents, load_build, load_vectors
from .sources.library import Library


def load_engine(path: str) -> Engine:
    """Engine over a build with its saved index and, where it was made with the hash encoder, its vectors."""
    spark = session()
    units, index, manifest = load_build(spark, path)
    dense = {"vectors": load_vectors(spark, path), "encoder": HashEncoder()} if manifest["model"] == "hash" else {}
    return Engine(units, shards=manifest["shards"], build_id=manifest["build_id"], index=index, **dense)


def answer(engine: Engine, body: bytes) -> tuple[int, dict]:
    """(status, JSON) of a search request {query, k from 1 to 50, mode}; bodies over a million bytes and empty queries are refused."""
    if len(body) > 1_000_000:
        return 413, {"error": "request too large"}
    try:
        asked = json.loads(body)
        query, k = str(asked["query"]).strip(), min(max(int(asked.get("k", 5)), 1), 50)
    except (ValueError, KeyError, TypeError):
        return 400, {"error": "expected JSON with a query"}
    return (200, payload(engine.search(query, k, asked.get("mode")), query)) if query else (400, {"error": "empty query"})


def server(engine: Engine, port: int) -> HTTPServer:
    """Answers POST requests on the local interface."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            status, out = answer(engine, self.rfile.read(min(n, 1_000_001)))
            raw = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.end_headers()
            self.wfile.write(raw)

    return HTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="coppice")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--build", required=True)
    s.add_argument("--mode")
    s.add_argument("--k", type=int, default=5)
    s.add_argument("--json", action="store_true")
    b = sub.add_parser("build")
    b.add_argument("paths", nargs="+")
    b.add_argument("--out", required=True)
    b.add_argument("--shards", type=int, default=1)
    b.add_argument("--previous")
    b.add_argument("--vectors", action="store_true")
    v = sub.add_parser("evaluate")
    v.add_argument("cases")
    v.add_argument("--build", required=True)
    w = sub.add_parser("serve")
    w.add_argument("--build", required=True)
    w.add_argument("--port", type=int, default=8080)
    for name in ("list", "show", "export", "publish", "delete"):
        c = sub.add_parser(name)
        c.add_argument("library")
        c.add_argument("--id")
        c.add_argument("--out")
        c.add_argument("--format", default="html")
        c.add_argument("--yes", action="store_true")
    a = p.parse_args(argv)
    if a.command == "build":
        encoder = HashEncoder() if a.vectors else None
        print(json.dumps(build_documents(session(), a.paths, a.out, shards=a.shards, encoder=encoder, model="hash" if encoder else "none", previous=a.previous)))
        return 0
    if a.command in ("search", "evaluate", "serve"):
        engine = load_engine(a.build)
        if a.command == "search":
            r = engine.search(a.query, a.k, a.mode)
            print(json.dumps(payload(r, a.query), ensure_ascii=False) if a.json else render(r, a.query))
        elif a.command == "evaluate":
            with open(a.cases) as f:
                print(json.dumps(evaluate(engine, json.load(f))))
        else:
            server(engine, a.port).serve_forever()
        return 0
    lib = Library(a.library)
    if a.command == "list":
        for r in lib.sessions(session()).collect():
            print(r.session_id, r.created_at, r.mode, r.raw_query)
    elif a.command == "show":
        print(json.dumps(lib.load(a.id), ensure_ascii=False, indent=1))
    elif a.command == "export":
        print(json.dumps(lib.export(a.out, a.format, [a.id] if a.id else None)))
    elif a.command == "publish":
        print(lib.publish(a.out, a.format, [a.id] if a.id else None))
    elif not a.yes:
        print("give --yes to delete the library")
        return 2
    else:
        lib.delete_all()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
