"""HTTP routes, remote client and command line, and what they need: text ids and vectors of several lengths."""

import json
import threading

import numpy as np
import pyarrow as pa
import pytest

from secspark.__main__ import main
from secspark.client import Client
from secspark.errors import InvalidRecord, StorageError
from secspark.flow import Api
from secspark.operators import correlate, search
from secspark.remote import RemoteClient
from secspark.server import App, id_text, pair, serve

HASH = "ab" * 32


def event(i, **more):
    return {"id": {"hi": 1, "lo": i}, "event_type": "ProcessStart", "source_host": f"h{i}", "collector": "test"} | more


def artifact(i, **more):
    return {"id": {"hi": 2**64 - 1, "lo": i}, "hash_sha256": HASH, "file_type": "PE", "file_size": 1024} | more


def test_ids():
    assert pair(id_text(2**64 - 1, 7)) == {"hi": 2**64 - 1, "lo": 7}
    assert pair(12) == {"hi": 0, "lo": 12}


@pytest.fixture(scope="module")
def remote(spark, tmp_path_factory):
    server = serve(App(Client(spark, str(tmp_path_factory.mktemp("store")))))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield RemoteClient(f"http://127.0.0.1:{server.server_port}")
    server.shutdown()
    server.server_close()


def test_routes(remote):
    # an empty store
    assert remote.events() == [] and remote.artifacts() == [] and remote.correlate() == [] and remote.find_similar([1.0]) == []
    assert remote.event(1, 1) is None and remote.event_arrow(1, 1) is None

    texts = [event(1, raw_data=f"ran {HASH[:16]}", vector=[1, 0, 0], metadata={"severity": "high"}), event(2, event_type='odd "kind"', format="none", vector=[0, 1]), event(3, raw_data="opened dropper.exe", source_ip="10.0.0.1", format="Zeek")]
    assert remote.ingest_event(texts) == [{"hi": 1, "lo": i} for i in (1, 2, 3)]
    assert set(remote.ingest_event(event(0) | {"id": None})) == {"hi", "lo"}
    assert remote.ingest_event([]) == []
    assert remote.store_code(artifact(9, strings=["dropper.exe", "abc"], vector=[1.0, 0.1, 0.0])) == {"hi": 2**64 - 1, "lo": 9}

    got = remote.event(1, 1)
    assert got["metadata"] == {"severity": "high"} and got["vector"] == [1, 0, 0] and got["event_type"] == "ProcessStart" and got["source_ip"] is None
    assert remote.event(1, 2)["event_type"] == 'Custom("odd \\"kind\\"")' and remote.event(1, 2)["format"] == "Raw" and remote.event(1, 2)["metadata"] is None
    assert remote.event(1, 3)["format"] == "Zeek" and remote.event(1, 4) is None and remote.event(2**64, 1) is None
    assert remote.artifact(2**64 - 1, 9)["hash_sha256"] == HASH and remote.artifact(1, 1) is None
    assert len(remote.events()) == 4 and len(remote.artifacts()) == 1

    near = remote.find_similar([1.0, 0.0, 0.0])
    assert [r["id"] for r in near] == [{"hi": 1, "lo": 1}, {"hi": 2**64 - 1, "lo": 9}] and near[0]["score"] == pytest.approx(1)
    assert len(remote.find_similar([1.0, 0.0, 0.0], 1)) == 1 and remote.find_similar([1.0] * 7) == []

    found = {(r["source_id"]["lo"], r["target_id"]["lo"]): (r["correlation_type"], r["score"]) for r in remote.correlate()}
    assert found == {(1, 9): ("HashMatch", 1.0), (3, 9): ("FilenameMatch", 0.9)}


def test_newest_of_an_id(remote):
    for host in ("old", "new"):
        remote.ingest_event(event(77) | {"source_host": host})
    assert remote.event(1, 77)["source_host"] == "new"


def test_arrow(remote):
    ids = [id_text(5, i) for i in range(3)]
    t = pa.table({"id": [*ids[:2], None], "event_type": ["a", "b", "c"], "vec": pa.array([[1.0], [], None], pa.list_(pa.float64()))})
    back = remote.ingest_events_arrow(t)["id"].to_pylist()
    assert back[:2] == ids[:2] and len(set(back)) == 3
    row = remote.event_arrow(5, 0).to_pylist()[0]
    assert row["event_type"] == "a" and row["vec"] == [1.0] and row["host"] is None
    assert remote.event_arrow(5, 1).to_pylist()[0]["vec"] is None
    assert remote.event(5, 1)["source_host"] == "" and remote.event_arrow(5, 9) is None
    code = remote.store_code_arrow(pa.table({"hash": [HASH.upper()]}))["id"].to_pylist()[0]
    assert remote.artifact(**pair(code))["hash_sha256"] == HASH
    for bad in (pa.table({"other": [1]}), pa.table({"id": ["x"]}), pa.table({"ts_ms": ["x"]})):
        with pytest.raises(InvalidRecord):
            remote.ingest_events_arrow(bad)
    with pytest.raises(InvalidRecord):
        remote.store_code_arrow(pa.table({"hash": ["ab"]}))
    assert remote.ingest_events_arrow(t.slice(0, 0)).num_rows == 0


@pytest.mark.parametrize(
    ("path", "body", "status"),
    [
        ("/events", b"{", 400),
        ("/events", b"3", 422),
        ("/events", json.dumps({"event_type": "a", "source_host": "h"}).encode(), 422),
        ("/events", json.dumps(event(1) | {"vector": ["x"]}).encode(), 422),
        ("/events", json.dumps(event(1) | {"id": {"hi": -1, "lo": 0}}).encode(), 422),
        ("/code", json.dumps(artifact(1) | {"hash_sha256": "zz"}).encode(), 400),
        ("/code", json.dumps(artifact(1) | {"file_size": -1}).encode(), 422),
        ("/similar", b"{}", 422),
        ("/bin/events", b"no stream", 400),
        ("/other", b"", 404),
    ],
)
def test_bad_requests(spark, tmp_path, path, body, status):
    assert App(Client(spark, str(tmp_path))).handle("POST", path, body)[0] == status


def test_rate_limit(spark, tmp_path):
    app = App(Client(spark, str(tmp_path)), Api(requests_per_second=2))
    app.limiter.interval_s = 1000.0
    assert [app.handle("GET", "/health")[0] for _ in range(3)] == [200, 200, 429]


def test_command_line(remote, capsys):
    assert main(["health", "--url", remote.url]) == 0 and main(["health", "--url", "http://127.0.0.1:9"]) == 1
    assert capsys.readouterr().out.startswith("ok\ndown")
    with pytest.raises(StorageError):
        RemoteClient("http://127.0.0.1:9", 1.0)


@pytest.mark.parametrize("blocks", [False, True])
def test_text_ids_and_mixed_lengths(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(search, "WHOLE_ROWS", 0)
        monkeypatch.setattr(correlate, "SHIPPED_STRINGS", 0)
    rng = np.random.default_rng(3)
    vec = lambda i: [float(x) for x in rng.normal(size=2 + i % 2)] if i % 5 else None
    logs = [(f"log-{i}", f"text {i} file{i % 4}.exe", "", vec(i)) for i in range(20)]
    codes = [(f"code-{i}", f"{i:02x}" * 32, [f"file{i}.exe"], vec(i)) for i in range(1, 9)]
    left = spark.createDataFrame(logs, "id string, raw string, meta string, vec array<float>")
    right = spark.createDataFrame(codes, "id string, hash string, strings array<string>, vec array<float>")

    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    want = {(a[0], b[0]): cosine(a[3], b[3]) for a in logs for b in codes if a[3] and b[3] and len(a[3]) == len(b[3])}
    got = {(r["a"], r["b"]): r["score"] for r in search.similar_pairs(left, right, 0.5).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.5})
    top = {(r["query"], r["rank"]): r["id"] for r in search.knn_batch(right, left, 3).collect()}
    for b in codes:
        best = sorted((-v, k[0]) for k, v in want.items() if k[1] == b[0])[:3]
        assert [top.get((b[0], i + 1)) for i in range(len(best))] == [i for _, i in best]
    files = {(r["source_id"], r["target_id"]) for r in correlate.by_filename(left, right).collect()}
    assert files == {(a[0], b[0]) for a in logs for b in codes if b[2][0] in a[1]}
