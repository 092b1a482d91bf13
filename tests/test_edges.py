"""Core operators on nulls, empty tables, ties, repeated rows, odd vectors and clashing column names."""

import pytest
from pyspark.sql import functions as F

from secspark.functions import vectors as V
from secspark.operators import ann, chain, correlate, search
from secspark.operators import query as Q

NAN = float("nan")
LOGS = [(1, None, None, None), (2, "", "", []), (3, "f" * 20, "{}", [1.0, 0.0]), (3, "opened evil.exe", "{", [0.0, 0.0]), (None, "evil.exe", None, [1.0, 0.0]), (5, "evil.exe evil.exe", None, [1.0, NAN]), (5, "evil.exe", None, [None, 1.0]), (6, "x" * 100_000, None, [0.0, 1.0, 0.0])]
ARTIFACTS = [(1, None, None, None), (2, "", [], []), (3, "F" * 64, ["evil.exe", None, "", "ab"], [1.0, 0.0]), (3, "f" * 64, ["evil.exe"], [1.0, 0.0]), (None, "f" * 64, ["evil.exe"], [1.0, 0.0]), (4, "zz", [None], [0.0, 0.0])]
CLASH = ("short", "s", "t", "w", "head", "n", "source_id", "target_id", "kind", "score", "a", "b", "i", "j", "rn", "refs", "query", "rank", "cell", "total_matches", "before", "link", "x", "ts")


@pytest.fixture(scope="module", params=["plain", "clash"])
def tables(spark, request):
    logs = spark.createDataFrame(LOGS, "id long, raw string, meta string, vec array<float>")
    artifacts = spark.createDataFrame(ARTIFACTS, "id long, hash string, strings array<string>, vec array<float>")
    if request.param == "clash":
        logs, artifacts = (d.select("*", *[F.lit("7").alias(c) for c in CLASH]) for d in (logs, artifacts))
    return logs, artifacts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("blocks", [False, True])
def test_correlation(tables, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(search, "WHOLE_ROWS", 0)
        monkeypatch.setattr(correlate, "SHIPPED_STRINGS", 0)
    logs, artifacts = tables
    assert rows(correlate.by_hash(logs, artifacts)) == [(3, 3, "HashMatch", 1.0)]
    assert rows(correlate.by_filename(logs, artifacts)) == [(3, 3, "FilenameMatch", 0.9), (5, 3, "FilenameMatch", 0.9)]
    assert rows(correlate.correlate_all(logs, artifacts)) == [(3, 3, "VectorSimilarity", 1.0), (5, 3, "FilenameMatch", 0.9)]
    for a, b in ((logs.limit(0), artifacts), (logs, artifacts.limit(0)), (logs.limit(0), artifacts.limit(0))):
        assert rows(correlate.correlate_all(a, b)) == [] and rows(search.knn_batch(a, b, 2)) == []


def test_search(tables):
    logs, _ = tables
    q = V.literal([1.0, 0.0])
    known = logs.where("id is not null")
    assert rows(search.find_similar(known, q, 9)) == [(3, 0.0), (3, 1.0)]
    assert [tuple(r) for r in search.find_similar(known, q, 1).collect()] == [(3, 1.0)]
    for metric in search.METRICS:
        assert {r["id"] for r in search.knn(known, q, 9, metric).collect()} == {3}
    assert rows(search.find_similar(logs.limit(0), q, 3)) == [] == rows(search.knn(logs, V.literal([1.0] * 5), 3))
    batch = search.knn_batch(known.where("raw like 'f%'"), known, 9)
    assert [(r["query"], r["id"], r["score"], r["rank"]) for r in batch.orderBy("rank").collect()] == [(3, 3, 1.0, 1), (3, 3, 0.0, 2)]


def test_request(tables):
    logs, _ = tables
    logs = logs.drop("ts").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    found = Q.QueryRequest(vector_query=Q.VectorQuery([1.0, 0.0], 0.5)).run(logs.where("id is not null")).collect()
    assert [(r["id"], r["score"], r["total_matches"]) for r in found] == [(3, 1.0, 1)]
    assert Q.QueryRequest(time_range=Q.TimeRange(0, 10)).run(logs).collect() == []
    assert Q.QueryRequest().run(logs.limit(0)).collect() == []


def test_latest(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, 5, "c"), (None, 1, "d"), (None, 2, "e"), (3, 4, None)], "id long, seq int, v string")
    assert rows(Q.latest(df, "id", "seq")) == sorted([(1, None, "a"), (2, 5, "c"), (None, 2, "e"), (3, 4, None)], key=str)
    assert rows(Q.latest(df, "id", "seq", first=True)) == sorted([(1, None, "a"), (2, None, "b"), (None, 1, "d"), (3, 4, None)], key=str)
    assert rows(Q.latest(df.limit(0), "id", "seq")) == []


def test_index(tables, tmp_path):
    logs, _ = tables
    for name, df, want in (("some", logs.where("id is not null"), [(3, 0.0), (3, 1.0)]), ("none", logs.limit(0), [])):
        model = ann.fit(df)
        index = ann.store(model, df, str(tmp_path / name))
        model = ann.calibrate(model, index)
        assert rows(ann.ann_search(model, index, [1.0, 0.0], 9)) == want
        assert rows(ann.ann_search(model, index, [1.0, 0.0, 0.0], 9)) == []
        assert rows(model.assign(df).select("id", "cell")) == rows(index.select("id", "cell"))
        model.save(logs.sparkSession, str(tmp_path / f"{name}-model"))
        assert len(ann.CellModel.load(logs.sparkSession, str(tmp_path / f"{name}-model")).centers) == len(model.centers)
    assert [r["vectors"] for r in ann.index_stats(index).collect()] == [0]


@pytest.mark.parametrize("algorithm", ["sha256", "blake3"])
def test_chain(spark, algorithm):
    df = spark.createDataFrame([("c", 0, None), ("c", 1, ""), ("c", None, "x"), (None, 0, "y"), (None, 1, "y"), ("d", 0, "z" * 100_000)], "chain string, seq long, data string")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("hash", "prev_hash", "data_hash", "before", "link")])
    nodes = chain.build(df, algorithm)
    got = {(r["chain"], r["seq"]): r for r in nodes.collect()}
    empty = chain.next_hash(None, chain.HASHES[algorithm](b""), 0, algorithm)
    assert set(got) == {("c", 0), ("c", 1), (None, 0), (None, 1), ("d", 0)}
    assert got["c", 0]["hash"] == empty == got["c", 1]["prev_hash"] and got[None, 1]["prev_hash"] == got[None, 0]["hash"]
    assert rows(chain.build(df.limit(0), algorithm)) == []
    if algorithm == "sha256":
        assert rows(chain.verify(nodes)) == [] == rows(chain.verify(nodes.limit(0)))
        lost = nodes.withColumn("hash", F.when(F.col("chain") != "d", F.col("hash")))
        assert ("d", 0, "hash") in rows(chain.verify(lost))


def test_format_bytes_from_a_petabyte(spark, tmp_path):
    import duckdb

    from secspark.functions import scalar
    from secspark.plans import catalog

    n = spark.createDataFrame([(1 << 50,), ((1 << 50) - 1,)], "n long").select(scalar.format_bytes(F.col("n")), scalar.format_bytes(F.col("n"), "TB"))
    assert [tuple(r) for r in n.collect()] == [("1.00 PB", "1024 TB"), ("1024 TB", "1024 TB")]
    # cubes of these ids lie about 1024 TB and up to the largest long
    ids = [0, 1, 8, 104031, 104032, 104033, 599999, 2097151]
    e = spark.createDataFrame([(i,) for i in ids], "event_id long")
    e.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' ts", "0L user_id", "'' event_type", "0D value", "'' props").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = {tuple(r) for r in catalog.QUERIES["fn_format_bytes"](spark, str(tmp_path)).collect()}
    assert got == set(duck.sql(catalog.ORACLE_SQL["fn_format_bytes"]).fetchall()) and len(got) == len(ids)


@pytest.mark.parametrize("ids, kind", [([-2097152, 0, 2097151], "bigint"), ([-2097153, 0, 8, 2097151, 2097152, 5999999, 3 * 10**9], "decimal(38,0)")])
def test_format_bytes_of_cubes_beyond_a_long(spark, tmp_path, ids, kind):
    import duckdb

    from secspark.plans import catalog

    e = spark.createDataFrame([(i,) for i in ids], "event_id long")
    e.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' ts", "0L user_id", "'' event_type", "0D value", "'' props").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    # the SQL overflows on these ids as longs
    duck.sql(f"create view events as select event_id::hugeint event_id from '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.QUERIES["fn_format_bytes"](spark, str(tmp_path))
    assert got.schema["n"].dataType.simpleString() == kind
    assert {(int(n), text) for n, text in got.collect()} == set(duck.sql(catalog.ORACLE_SQL["fn_format_bytes"]).fetchall())
