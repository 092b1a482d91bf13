"""A client of the HTTP server; answers are plain Python values and Arrow tables."""

from __future__ import annotations

import io
import json
import urllib.error
import urllib.request

import pyarrow as pa

from secspark.errors import InvalidRecord, StorageError


class RemoteClient:
    """``RemoteClient(url)`` asks for the server's health first and raises StorageError where there is none."""

    def __init__(self, url: str, timeout_s: float = 60.0):
        self.url, self.timeout_s = url.rstrip("/"), timeout_s
        self.health()

    def _send(self, path: str, body: bytes | None = None) -> bytes:
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url + path, data=body), timeout=self.timeout_s) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            text = e.read().decode("utf-8", "replace")
            raise (InvalidRecord if e.code in (400, 404, 413, 422) else StorageError)(f"{e.code}: {text}") from None
        except OSError as e:
            raise StorageError(str(e)) from None

    def _json(self, path: str, value=None):
        return json.loads(self._send(path, None if value is None else json.dumps(value).encode()))

    def _arrow(self, path: str, table: pa.Table | None = None) -> pa.Table:
        body = None
        if table is not None:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, table.schema) as w:
                w.write_table(table)
            body = out.getvalue()
        with pa.ipc.open_stream(self._send(path, body)) as r:
            return r.read_all()

    def health(self) -> bool:
        return self._send("/health") == b"ok"

    def ingest_event(self, event: dict | list) -> dict | list:
        return self._json("/events", event)

    def store_code(self, artifact: dict | list) -> dict | list:
        return self._json("/code", artifact)

    def event(self, hi: int, lo: int) -> dict | None:
        return self._json(f"/events/{hi}/{lo}")

    def artifact(self, hi: int, lo: int) -> dict | None:
        return self._json(f"/code/{hi}/{lo}")

    def events(self) -> list[dict]:
        return self._json("/events")

    def artifacts(self) -> list[dict]:
        return self._json("/code")

    def find_similar(self, vector: list[float], top_k: int = 10) -> list[dict]:
        return self._json("/similar", {"vector": vector, "top_k": top_k})

    def correlate(self) -> list[dict]:
        return self._json("/correlate", {})

    def ingest_events_arrow(self, table: pa.Table) -> pa.Table:
        return self._arrow("/bin/events", table)

    def store_code_arrow(self, table: pa.Table) -> pa.Table:
        return self._arrow("/bin/code", table)

    def event_arrow(self, hi: int, lo: int) -> pa.Table | None:
        try:
            return self._arrow(f"/bin/events/{hi}/{lo}")
        except InvalidRecord as e:
            if str(e).startswith("404"):
                return None
            raise
