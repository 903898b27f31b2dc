"""``python -m quillon``: serve an engine, or ask one that is served.

    serve [--host H] [--port N] [--data DIR] [--seed FILE]
    health | stats | get ID | delete ID
    search [--field title] [--size 10] WORD...
"""

from __future__ import annotations

import argparse
import json
import sys
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen


def ask(base: str, method: str, path: str, body: dict | None = None) -> tuple[int, str]:
    """(status, answer) of a request."""
    data = None if body is None else json.dumps(body).encode()
    try:
        with urlopen(Request(base.rstrip("/") + path, data, {"Content-Type": "application/json"}, method=method)) as got:
            return got.status, got.read().decode()
    except HTTPError as e:
        return e.code, e.read().decode()


def serve(args) -> int:
    from pyspark.sql import SparkSession

    from quillon.engine import Engine, server

    engine = Engine(SparkSession.builder.appName("quillon").getOrCreate(), args.data)
    if args.seed:
        engine.seed(args.seed)
    at = server(engine, args.host, args.port)
    print(f"listening on {args.host}:{at.server_port}", flush=True)
    try:
        at.serve_forever()
    except KeyboardInterrupt:
        if args.data:
            print(engine.snapshot(args.data))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--server", default="http://localhost:8080")
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("serve")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8080)
    s.add_argument("--data")
    s.add_argument("--seed")
    commands.add_parser("health")
    commands.add_parser("stats")
    for name in ("get", "delete"):
        commands.add_parser(name).add_argument("id")
    s = commands.add_parser("search")
    s.add_argument("--field", default="title")
    s.add_argument("--size", type=int, default=10)
    s.add_argument("words", nargs="+")
    args = p.parse_args(argv)
    if args.command == "serve":
        return serve(args)
    requests = {
        "health": lambda: ("GET", "/healthz"),
        "stats": lambda: ("GET", "/_stats"),
        "get": lambda: ("GET", f"/docs/{quote(args.id, safe='')}"),
        "delete": lambda: ("DELETE", f"/docs/{quote(args.id, safe='')}"),
        "search": lambda: ("POST", "/_search", {"query": {"match": {args.field: " ".join(args.words)}}, "size": args.size}),
    }
    status, body = ask(args.server, *requests[args.command]())
    print(body)
    return 0 if status < 400 else 1


if __name__ == "__main__":
    sys.exit(main())
