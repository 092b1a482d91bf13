"""HTTP over one store: JSON for records and lists of them, Arrow streams for batches.

| route | body | answer |
| --- | --- | --- |
| GET /health | | ``ok`` |
| POST /events, /code | a record, or a list of them | its id, or the ids in order |
| GET /events, /code | | all records, streamed |
| GET /events/HI/LO, /code/HI/LO | | the newest record with the id, or null |
| POST /similar | ``vector``, ``top_k`` (10) | ids and scores |
| POST /correlate | | the correlations found, streamed |
| POST /bin/events, /bin/code | an Arrow stream of stored columns | an Arrow stream of ids |
| GET /bin/events/HI/LO, /bin/code/HI/LO | | an Arrow stream of one row; 404 if there is none |

Ids are pairs of unsigned 64-bit halves, kept as UUID text. A POST is one append, so lists are the way to write much. Bodies
that aren't of the schema get status 422, hashes that aren't 32 bytes of hex and unreadable streams 400, bodies over
``MAX_BODY`` 413, requests over the rate limit 429. A vector whose length isn't 1 to 4096 is dropped.
"""

from __future__ import annotations

import datetime
import io
import json
import re
import threading
import time
import uuid
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secspark.client import Client
from secspark.errors import InvalidRecord, SecsparkError, StorageError
from secspark.flow import Api, RateLimiter
from secspark.functions import scalar as S
from secspark.functions.vectors import literal
from secspark.operators import search
from secspark.operators.query import latest
from secspark.sources.ingest import MAX_DIM

EVENT = "id string, ts timestamp_ntz, ts_ms long, event_type string, host string, ip string, collector string, format string, raw string, meta string, vec array<float>"
ARTIFACT = "id string, ts_ms long, hash string, file_type string, file_size long, imports array<string>, strings array<string>, vec array<float>"
KINDS = {"events": "logs", "code": "artifacts"}
MAX_BODY = 64 << 20
JSON, ARROW = "application/json", "application/vnd.apache.arrow.stream"


class BadSchema(InvalidRecord):
    code = "BAD_SCHEMA"


def pair(id_) -> dict:
    """The halves of an id; a number is its own lower half."""
    n = uuid.UUID(id_).int if isinstance(id_, str) else int(id_)
    return {"hi": n >> 64, "lo": n & (1 << 64) - 1}


def id_text(hi: int, lo: int) -> str:
    return str(uuid.UUID(int=hi << 64 | lo))


def _field(record: dict, name: str, kind: type, default=None):
    value = record.get(name, default)
    if value is None and name not in record:
        raise BadSchema(f"missing field {name}")
    if not isinstance(value, kind) or isinstance(value, bool):
        raise BadSchema(f"{name} is not of type {kind.__name__}")
    return value


def _list(record: dict, name: str, kind) -> list:
    values = _field(record, name, list, [])
    if any(not isinstance(v, kind) or isinstance(v, bool) for v in values):
        raise BadSchema(f"{name} has an element of another type")
    return values


def _vector(record: dict) -> list[float] | None:
    values = _list(record, "vector", (int, float))
    return [float(v) for v in values] if 1 <= len(values) <= MAX_DIM else None


def _id(record: dict) -> str:
    given = record.get("id")
    if given is None:
        return str(uuid.uuid4())
    if not isinstance(given, dict):
        raise BadSchema("id is not of type object")
    halves = [_field(given, k, int) for k in ("hi", "lo")]
    if not all(0 <= h < 1 << 64 for h in halves):
        raise BadSchema("id is out of range")
    return id_text(*halves)


def event_row(record: dict, now_ms: int) -> tuple:
    ip = record.get("source_ip")
    if ip is not None and not isinstance(ip, str):
        raise BadSchema("source_ip is not of type str")
    kind, host, collector = (_field(record, k, str) for k in ("event_type", "source_host", "collector"))
    form = _field(record, "format", str, "Raw")
    ts = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=now_ms)
    return _id(record), ts, now_ms, kind, host, ip, collector, form if form in S.FORMATS else "Raw", _field(record, "raw_data", str, ""), json.dumps(record.get("metadata")), _vector(record)


def artifact_row(record: dict, now_ms: int) -> tuple:
    digest, kind, size = (_field(record, k, t) for k, t in (("hash_sha256", str), ("file_type", str), ("file_size", int)))
    if not 0 <= size < 1 << 63:
        raise BadSchema("file_size is out of range")
    if not re.fullmatch("[0-9a-fA-F]{64}", digest):
        raise InvalidRecord("hash must be 32 bytes of hex")
    return _id(record), now_ms, digest.lower(), kind if kind in S.FILE_TYPES else "Unknown", size, _list(record, "imports", str), _list(record, "strings", str), _vector(record)


def _metadata(text):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def event_json(r) -> dict:
    d = r.asDict()
    kind = d.get("event_type") or ""
    kind = kind if kind in S.EVENT_TYPES else f"Custom({json.dumps(kind, ensure_ascii=False)})"
    return {"id": pair(d["id"]), "event_type": kind, "source_host": str(d.get("host") or ""), "source_ip": d.get("ip"), "collector": d.get("collector") or "", "format": d.get("format") or "Raw", "raw_data": d.get("raw") or "", "metadata": _metadata(d.get("meta")), "vector": d.get("vec") or []}


def artifact_json(r) -> dict:
    d = r.asDict()
    return {"id": pair(d["id"]), "hash_sha256": d.get("hash") or "", "file_type": d.get("file_type") or "Unknown", "file_size": d.get("file_size") or 0, "imports": d.get("imports") or [], "strings": d.get("strings") or [], "vector": d.get("vec") or []}


ROWS = {"events": (event_row, EVENT, event_json), "code": (artifact_row, ARTIFACT, artifact_json)}


def _arrow(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def _listed(rows: Iterator[dict]) -> Iterator[bytes]:
    yield b"["
    for i, r in enumerate(rows):
        yield (b"," if i else b"") + json.dumps(r).encode()
    yield b"]"


class App:
    """Requests to answers ``(status, content type, pieces of the body)``, without a socket."""

    def __init__(self, client: Client, api: Api | None = None):
        self.client, self.api = client, api or Api()
        self.limiter = RateLimiter(self.api.requests_per_second, 1.0)
        self.counting, self.writing = threading.Lock(), threading.Lock()

    def handle(self, method: str, path: str, body: bytes = b""):
        try:
            with self.counting:
                self.limiter.acquire()
        except StorageError as e:
            return self._error(429, e)
        try:
            return self._route(method, [p for p in path.split("?")[0].split("/") if p], body)
        except BadSchema as e:
            return self._error(422, e)
        except (InvalidRecord, pa.ArrowInvalid) as e:
            return self._error(400, e)
        except SecsparkError as e:
            return self._error(500, e)

    def _error(self, status: int, e: Exception):
        return status, JSON, [json.dumps({"code": getattr(e, "code", "INVALID_RECORD"), "error": str(e)}).encode()]

    def _route(self, method: str, parts: list[str], body: bytes):
        match method, parts:
            case "GET", ["health"]:
                return 200, "text/plain", [b"ok"]
            case "POST", [("events" | "code") as kind]:
                return self._write(kind, body)
            case "GET", [("events" | "code") as kind]:
                rows = self._rows(kind)
                # one partition at a time is on the driver
                return 200, JSON, _listed(ROWS[kind][2](r) for r in (rows.toLocalIterator() if rows is not None else ()))
            case "GET", [("events" | "code") as kind, hi, lo] if hi.isdecimal() and lo.isdecimal():
                found = self._newest(kind, int(hi), int(lo))
                rows = found.collect() if found is not None else []
                return 200, JSON, [json.dumps(ROWS[kind][2](rows[0]) if rows else None).encode()]
            case "POST", ["similar"]:
                request = self._json(body)
                vector = _list(request, "vector", (int, float)) if "vector" in request else _field(request, "vector", list)
                k = _field(request, "top_k", int, self.api.top_k)
                if k < 0:
                    raise BadSchema("top_k is negative")
                rows = self.client.find_similar(vector, k).collect() if vector and self.client.kinds() else []
                return 200, JSON, [json.dumps([{"id": pair(r["id"]), "score": r["score"]} for r in rows]).encode()]
            case "POST", ["correlate"]:
                if len(self.client.kinds()) < len(KINDS):
                    return 200, JSON, [b"[]"]
                with self.writing:
                    rows = self.client.correlate()
                return 200, JSON, _listed({"source_id": pair(r["source_id"]), "target_id": pair(r["target_id"]), "correlation_type": r["kind"], "score": r["score"]} for r in rows.toLocalIterator())
            case "POST", ["bin", ("events" | "code") as kind]:
                return self._write_arrow(kind, body)
            case "GET", ["bin", ("events" | "code") as kind, hi, lo] if hi.isdecimal() and lo.isdecimal():
                found = self._newest(kind, int(hi), int(lo))
                table = found.toArrow() if found is not None else None
                return (200, ARROW, [_arrow(table)]) if table is not None and table.num_rows else (404, "text/plain", [b"not found"])
        return 404, "text/plain", [b"no such route"]

    def _json(self, body: bytes) -> dict:
        try:
            value = json.loads(body)
        except ValueError as e:
            raise InvalidRecord(f"not JSON: {e}") from None
        if not isinstance(value, dict):
            raise BadSchema("not an object")
        return value

    def _rows(self, kind: str) -> DataFrame | None:
        return self.client.store.read(KINDS[kind]) if self.client.store.has(KINDS[kind]) else None

    def _newest(self, kind: str, hi: int, lo: int) -> DataFrame | None:
        rows = self._rows(kind)
        if rows is None or max(hi, lo) >= 1 << 64:
            return None
        if search.id_type(rows) != "string":
            return latest(rows.where(F.col("id") == lo), "id", "ts_ms") if hi == 0 and lo < 1 << 63 else None
        return latest(rows.where(F.col("id") == id_text(hi, lo)), "id", "ts_ms")

    def _append(self, kind: str, rows: DataFrame) -> None:
        # two appends to one folder would clear each other's unfinished files
        with self.writing:
            (self.client.ingest_events if kind == "events" else self.client.ingest_artifacts)(rows)

    def _write(self, kind: str, body: bytes):
        many = body.lstrip()[:1] == b"["
        try:
            records = json.loads(body)
        except ValueError as e:
            raise InvalidRecord(f"not JSON: {e}") from None
        records = records if many else [records]
        if any(not isinstance(r, dict) for r in records):
            raise BadSchema("not an object")
        make, ddl, _ = ROWS[kind]
        now = int(time.time() * 1000)
        rows = [make(r, now) for r in records]
        if rows:
            self._append(kind, self.client.spark.createDataFrame(rows, ddl).coalesce(1))
        ids = [pair(r[0]) for r in rows]
        return 200, JSON, [json.dumps(ids if many else ids[0]).encode()]

    def _write_arrow(self, kind: str, body: bytes):
        """Columns that are absent are null; ids and times are given where they are absent or null."""
        with pa.ipc.open_stream(body) as r:
            table = r.read_all()
        schema = self.client.spark.createDataFrame([], ROWS[kind][1]).toArrow().schema
        now = int(time.time() * 1000)
        unknown = set(table.column_names) - set(schema.names)
        if unknown or len(set(table.column_names)) < table.num_columns:
            raise BadSchema(f"columns unknown or repeated: {sorted(unknown)}")
        given = {"id": lambda: str(uuid.uuid4()), "ts_ms": lambda: now}
        columns = []
        for f in schema:
            if f.name == "ts":
                continue
            try:
                c = table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
                raise BadSchema(f"{f.name}: {e}") from None
            if f.name in given:
                c = pa.array([given[f.name]() if v is None else v for v in c.to_pylist()], f.type)
            columns.append((f.name, c))
        try:
            ids = [str(uuid.UUID(i)) for i in dict(columns)["id"].to_pylist()]
        except ValueError as e:
            raise BadSchema(f"id: {e}") from None
        columns = [("id", pa.array(ids, pa.string())), *columns[1:]]
        if kind == "code" and any(not re.fullmatch("[0-9a-fA-F]{64}", h or "") for h in dict(columns)["hash"].to_pylist()):
            raise InvalidRecord("hash must be 32 bytes of hex")
        if ids:
            rows = self.client.spark.createDataFrame(pa.table(dict(columns)))
            rows = rows.withColumn("vec", F.when(F.size("vec").between(1, MAX_DIM), F.col("vec")))
            if kind == "events":
                rows = rows.withColumn("ts", F.expr("timestampadd(MILLISECOND, ts_ms, timestamp_ntz'1970-01-01 00:00:00')"))
            else:
                rows = rows.withColumn("hash", F.lower("hash"))
            self._append(kind, rows)
        return 200, ARROW, [_arrow(pa.table({"id": pa.array(ids, pa.string())}))]


def serve(app: App, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that listens; its ``serve_forever`` runs it, ``server_port`` is its port."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            size = self.headers.get("Content-Length") or "0"
            if not size.isdecimal() or int(size) > MAX_BODY:
                status, kind, pieces = 413, "text/plain", [b"body too long"]
            else:
                status, kind, pieces = app.handle(self.command, self.path, self.rfile.read(int(size)))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            for p in pieces:
                self.wfile.write(p)

        do_GET = do_POST = _answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
