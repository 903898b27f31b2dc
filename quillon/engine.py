"""The engine as a service: documents in and out as JSON, searches in the JSON dialect, over segments in a shared folder.

Each write is a batch of operations that becomes a segment; what is searchable
is read from the segments, and the stored index is built anew by the first
search after a write. ``handle`` answers requests by method and path without a
server; ``serve`` puts it behind one. For corpora beyond what requests can
carry, ``ingest`` takes a DataFrame.
"""

from __future__ import annotations

import json
import threading
import time
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.analysis import ENGLISH_JSON
from quillon.operators.index import Index, Mapping, StoredIndex
from quillon.operators.ranking import explain_document
from quillon.plans import ast
from quillon.plans.compile import Compiler
from quillon.plans.dsl import DslError, decode
from quillon.sources.documents import write_snapshot
from quillon.sources.folders import fresh
from quillon.streaming import lifecycle

# The fields of a document and their types.
FIELDS = {"title": "text", "body": "text", "status": "keyword", "tags": "keyword", "author": "keyword", "price": "numeric", "rating": "numeric", "created_at": "date", "location": "geo_point"}
COLUMNS = {"text": "string", "keyword": "array<string>", "numeric": "double", "date": "timestamp", "geo_point": "double"}


class BadDocument(ValueError):
    pass


class NotFound(LookupError):
    pass


def texts(value) -> list[str]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, str)]


def number(value) -> float | None:
    """A number, or text that is one; a truth value isn't."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        return float(value)
    except ValueError:
        return None


def moment(value) -> datetime | None:
    """A day or a time in ISO form, UTC where it says nothing else."""
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (AttributeError, ValueError):
        return None
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def place(value) -> tuple[float | None, float | None]:
    """(lat, lon) of an object, or of a list of longitude and latitude, of which [0, 0] stands for none."""
    if isinstance(value, dict):
        lat, lon = number(value.get("lat")), number(value.get("lon"))
    elif isinstance(value, list) and len(value) == 2 and any(value):
        lon, lat = map(number, value)
    else:
        return None, None
    return (lat, lon) if lat is not None and lon is not None else (None, None)


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, fields: dict[str, str] | None = None):
        self.spark, self.root = spark, (root or fresh(spark, "engine")).rstrip("/")
        self.fields = fields or FIELDS
        of = lambda kind: [n for n, k in self.fields.items() if k == kind]
        numeric = (*of("numeric"), *of("date"), *(f"{n}_{x}" for n in of("geo_point") for x in ("lat", "lon")))
        self.mapping = Mapping("id", dict.fromkeys(of("text"), ENGLISH_JSON), tuple(of("keyword")), numeric)
        columns = [f"`{n}` {COLUMNS[k]}" for n, k in self.fields.items() if k != "geo_point"]
        columns += [f"`{n}_{x}` double" for n in of("geo_point") for x in ("lat", "lon")]
        self.columns = ", ".join(["id string", "source string", *columns])
        self.schema = f"seq long, op string, {self.columns}"
        self.started, self.searches, self._lock = time.time(), 0, threading.RLock()
        self._index: StoredIndex | None = None

    # -- writing ---------------------------------------------------------------

    def row(self, name: str, source: dict) -> tuple:
        """A document as the columns of its fields; what a field can't take is null."""
        if not isinstance(name, str) or not name.strip():
            raise BadDocument("a document needs an id")
        if not isinstance(source, dict):
            raise BadDocument("a document needs a source")
        take = {"text": lambda v: v if isinstance(v, str) else None, "keyword": texts, "numeric": number, "date": moment}
        out = [name, json.dumps(source)]
        out += [take[k](source.get(n)) for n, k in self.fields.items() if k != "geo_point"]
        return (*out, *(x for n, k in self.fields.items() if k == "geo_point" for x in place(source.get(n))))

    def _next(self) -> int:
        """The next place in the log; operations of one batch follow each other."""
        rows = lifecycle.segments(self.spark, self.root, self.schema)
        return max(rows.agg(F.max("seq")).first()[0] or 0, lifecycle.state(self.spark, self.root).last_seq) + 1

    def _write(self, ops: DataFrame) -> None:
        some = [n for n in lifecycle._written(self.spark, self.root) if n < lifecycle.REPLAYED]
        lifecycle.refresh(ops, max(some, default=-1) + 1, self.root)
        self._index = None

    def _apply(self, op: str, rows: list[tuple]) -> None:
        with self._lock:
            first = self._next()
            self._write(self.spark.createDataFrame([(first + k, op, *r) for k, r in enumerate(rows)], self.schema))

    def bulk(self, sources: list[dict]) -> int:
        """Documents that name their own id; all are checked before any is written."""
        rows = [self.row(s.get("id") if isinstance(s, dict) else None, s) for s in sources]
        if rows:
            self._apply(lifecycle.INDEX, rows)
        return len(rows)

    def put(self, name: str, source: dict) -> None:
        self._apply(lifecycle.INDEX, [self.row(name, source)])

    def delete(self, name: str) -> None:
        self.get(name)
        blank = [None] * (len(self.row("x", {})) - 1)
        self._apply(lifecycle.DELETE, [(name, *blank)])

    def ingest(self, docs: DataFrame) -> None:
        """Documents of a DataFrame with the engine's columns (``source`` may be missing), as one batch."""
        have = {c.lower() for c in docs.columns}
        shape = self.spark.createDataFrame([], self.columns).schema
        if "source" not in have:
            docs = docs.withColumn("source", F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        docs = docs.select(*[(F.col(f"`{f.name}`") if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
        with self._lock:
            # places need only be unique and behind all others
            place_of = F.monotonically_increasing_id() + self._next()
            self._write(docs.where(F.col("id").isNotNull()).select(place_of.alias("seq"), F.lit(lifecycle.INDEX).alias("op"), *docs.columns))

    def seed(self, path: str) -> int:
        """A file that holds one JSON array of documents."""
        return self.bulk(json.loads(self.spark.read.text(path, wholetext=True).first().value))

    def snapshot(self, folder: str) -> str:
        return write_snapshot(self.documents().select("id", "source"), folder, int(time.time()))

    # -- reading -----------------------------------------------------------------

    def documents(self) -> DataFrame:
        return lifecycle.live(self.spark, self.root, self.schema)

    def get(self, name: str) -> dict:
        row = self.documents().where(F.col("id") == name).select("source").first()
        if row is None:
            raise NotFound("document not found")
        return {"_id": name, "_source": json.loads(row.source)}

    def ids(self) -> DataFrame:
        return self.documents().select("id").orderBy("id")

    def index(self) -> StoredIndex:
        with self._lock:
            if self._index is None:
                self._index = Index(self.documents(), self.mapping).write(fresh(self.spark, "engine-index"))
            return self._index

    def _checked(self, q: ast.Query) -> ast.Query:
        """Ranges only go over fields that the documents have."""
        for part in (q, *(x for side in ("must", "filter", "should", "must_not") for x in getattr(q, side, ()))):
            if part is not q:
                self._checked(part)
            elif isinstance(part, ast.Range) and part.field not in self.fields:
                raise DslError(f"unknown field '{part.field}'")
        return q

    def search(self, body: dict | str) -> dict:
        begun = time.time()
        q, size = decode(body)
        index = self.index()
        hits = Compiler(index).compile(self._checked(q)).top(size).collect()
        with self._lock:
            self.searches += 1
        found = {r.id: r.source for r in index.docs.where(F.col("id").isin([h.doc_id for h in hits])).select("id", "source").collect()} if hits else {}
        return {"took_ms": int(1000 * (time.time() - begun)), "total": len(hits), "hits": [{"id": h.doc_id, "score": h.score, "source": json.loads(found[h.doc_id])} for h in hits]}

    def explain(self, body: dict | str, name: str) -> dict:
        q, _ = decode(body)
        index, compiler = self.index(), Compiler(self.index())
        compiler.compile(self._checked(q))
        if not any(leaf.terms for leaf in compiler.leaves):
            raise NotFound("the query has no scoring clause to explain")
        return explain_document(index, q, name)

    def analyze(self, name: str, text: str) -> dict:
        terms = Compiler(Index(self.documents(), self.mapping)).analyze(name, text)
        return {"field": name, "analyzer": "standard" if self.fields.get(name) == "text" else "keyword", "tokens": terms}

    def stats(self) -> dict:
        index = self.index()
        fields = index.field_stats.collect()
        return {"documents": index.num_docs, "terms": {r.field: r.vocabulary for r in fields}, "avg_len": {r.field: r.avg_length for r in fields}, "searches": self.searches}

    def health(self) -> dict:
        return {"status": "ok", "uptime": f"{time.time() - self.started:.0f}s"}

    # -- requests ------------------------------------------------------------------

    def handle(self, method: str, path: str, body: str = "") -> tuple[int, dict]:
        """(status, answer) of a request: 400 for what can't be understood, 404 for what isn't there."""
        try:
            return self._answer(method, path, body)
        except NotFound as e:
            return 404, {"error": str(e)}
        except (BadDocument, DslError, ValueError, TypeError, AttributeError, KeyError) as e:
            return 400, {"error": str(e)}

    def _answer(self, method: str, path: str, body: str) -> tuple[int, dict]:
        kind, _, name = path.strip("/").partition("/")
        match method, kind:
            case "GET", "healthz":
                return 200, self.health()
            case "GET", "_stats":
                return 200, self.stats()
            case "POST", "_search":
                return 200, self.search(json.loads(body))
            case "POST", "_explain":
                given = json.loads(body)
                return 200, self.explain({"query": given["query"]}, given["doc_id"])
            case "POST", "_analyze":
                given = json.loads(body)
                return 200, self.analyze(given["field"], given["text"])
            case "POST", "_bulk":
                given = json.loads(body)
                if not isinstance(given, list):
                    raise BadDocument("a bulk is a list of documents")
                return 200, {"indexed": self.bulk(given)}
            case "PUT", "docs":
                self.put(unquote(name), json.loads(body))
                return 201, {"result": "created"}
            case "GET", "docs":
                return 200, self.get(unquote(name))
            case "DELETE", "docs":
                self.delete(unquote(name))
                return 200, {"result": "deleted"}
        raise NotFound(f"no route for {method} {path}")


def server(engine: Engine, host: str, port: int) -> ThreadingHTTPServer:
    """A server that answers with ``engine.handle``; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            size = int(self.headers.get("Content-Length") or 0)
            status, body = engine.handle(self.command, self.path, self.rfile.read(size).decode())
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
