"""Recall of the approximate search at its defaults."""

import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from secspark.operators import ann, search
from secspark.plans import catalog


def test_recall_at_ten(spark):
    recall = catalog.recall_at_ten(spark, "/root/testdata/sf0.1").first()["recall"]
    print("recall@10:", recall)
    assert recall >= 0.9


def test_recall_takes_time_in_proportion(spark, tmp_path):
    rnd = np.random.default_rng(3)
    v = pa.table({"vec_id": np.arange(12_000), "embedding": list(rnd.normal(size=(12_000, 64)).astype(np.float32)), "label": np.zeros(12_000, np.int32)})
    pq.write_table(v, f"{tmp_path}/embeddings.parquet", row_group_size=2_000)
    begun = time.perf_counter()
    assert catalog.recall_at_ten(spark, str(tmp_path)).first()["recall"] >= 0.9
    assert time.perf_counter() - begun < 60


@pytest.mark.parametrize("whole", [20_000, 0])  # queries shipped whole, or block by block
def test_batch_search_equals_brute_force_over_cells(spark, monkeypatch, whole):
    monkeypatch.setattr(search, "WHOLE_ROWS", whole)
    monkeypatch.setattr(search, "BLOCK_ROWS", 90)
    rnd = np.random.default_rng(5)
    vec = rnd.normal(size=(300, 8))
    vec[40:80] = vec[0]  # copies: ids decide
    vec[7] = 0
    ids = rnd.permutation(300)
    rows = [(int(i), x.tolist()) for i, x in zip(ids, vec, strict=True)]
    odd = [(None, [1.0] * 8), (900, None), (901, [1.0]), (902, [float("nan")] * 8)]
    v = spark.createDataFrame(rows + odd, "id long, vec array<double>").selectExpr("id", "cast(vec as array<float>) vec")
    model = ann.CellModel(rnd.normal(size=(9, 8)), 4)
    table = model.assign_arrow(v)
    queries = v.where("id % 10 = 0 or id > 900 or id is null")
    got = {}
    for r in ann.ann_search_batch(model, table, queries, 5).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], round(r["score"], 6))
    held = {r["id"]: (np.array(r["vec"], float), r["cell"]) for r in table.where("id is not null").collect()}
    want = {}
    for q, (x, _) in held.items():
        if q % 10 == 0:
            n = lambda y, x=x: np.linalg.norm(x) * np.linalg.norm(y)
            near = [(i, float(x @ y / n(y)) if n(y) else 0.0) for i, (y, c) in held.items() if c in model.cells(x)]
            want[q] = {k + 1: (i, round(s, 6)) for k, (i, s) in enumerate(sorted(near, key=lambda t: (-round(t[1], 9), t[0]))[:5])}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, (i, _) in sorted(got[q].items())] == [i for _, (i, _) in sorted(want[q].items())]
        assert np.allclose([s for _, (_, s) in sorted(got[q].items())], [s for _, (_, s) in sorted(want[q].items())], atol=1e-5)
