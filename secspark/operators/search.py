"""Vector search: exact top-k, thresholds, quantised, batches and pair joins by blocks, deletion.

Cases: vectors that are null, empty or of another length than the query match nothing; neither do scores that are no number
(an element that is null or NaN). A vector of zeros has similarity 0 with all. Batch and pair searches leave rows with a null id
out; repeated rows are rows like others. Empty tables give no rows. Ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secspark.functions import vectors as V

METRICS = ("cosine", "l2", "dot", "sq8")
#: Rows of the smaller side up to which a batch operator ships it whole; beyond it both sides are cut into blocks.
WHOLE_ROWS, BLOCK_ROWS = 20_000, 4096
#: Scores that a task holds at once.
SCORES = 1 << 22


def find_similar(vectors: DataFrame, query: Column, k: int, threshold: float | None = None, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Top ``k`` by cosine (ties by id): a heap in each partition, merged. Vectors of another length than the query don't count."""
    v = vectors.where((F.size(vec_col) == F.size(query)) & V.usable(F.col(vec_col)))
    scored = v.select(F.col(id_col).alias("id"), V.cosine(F.col(vec_col), query).alias("score")).where(~F.isnan("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def distance(vec: Column, query: Column, metric: str) -> Column:
    """Ascending distance: 1 - cosine, squared L2, negated dot, negated integer dot of quantised vectors."""
    if metric == "cosine":
        return 1 - V.cosine(vec, query)
    if metric == "l2":
        return V.l2_squared(vec, query)
    if metric == "dot":
        return -V.dot(vec, query)
    if metric == "sq8":
        return -V.dot_sq8(V.quantize_sq8(vec), V.quantize_sq8(query))
    raise ValueError(f"unknown metric {metric}")


def knn(vectors: DataFrame, query: Column, k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    v = vectors.where((F.size(vec_col) == F.size(query)) & V.usable(F.col(vec_col)))
    return v.select(F.col(id_col).alias("id"), distance(F.col(vec_col), query, metric).alias("distance")).where(~F.isnan("distance")).orderBy("distance", "id").limit(k)


def _unit(vecs) -> np.ndarray:
    a = np.stack([np.asarray(v, np.float64) for v in vecs])
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def id_type(df: DataFrame, col: str = "id") -> str:
    """The SQL name of an id's type; ids may be numbers or text."""
    return df.schema[col].dataType.simpleString()


def _takes_part(d: DataFrame) -> DataFrame:
    return d.where("id is not null").where(V.usable(F.col("vec"))).select("id", "vec")


def _by_length(a: pd.DataFrame, b: pd.DataFrame):
    """Rows of both frames whose vectors have the same length; those of other lengths have no similarity."""
    la, lb = a["vec"].map(len), b["vec"].map(len)
    for n in np.intersect1d(la.unique(), lb.unique()):
        if n:
            yield a[la == n], b[lb == n]


def _blocks(left: DataFrame, right: DataFrame, found, schema: str, rows: int) -> DataFrame:
    """Every left block meets every right block in a task of its own; ``found`` turns two frames into rows."""
    nl, nr = (max(1, -(-d.count() // rows)) for d in (left, right))
    block = lambda n, s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lhs = left.select("*", block(nl, 1).alias("i")).select("*", every(nr).alias("j"))
    # columns get names of their own: both sides may be the same table
    own = {c: f"r_{c}" for c in right.columns}
    rhs = right.select("*", block(nr, 2).alias("rj")).withColumnsRenamed(own).select("*", every(nl).alias("ri"))
    back = {r: c for c, r in own.items()}
    return lhs.groupBy("i", "j").cogroup(rhs.groupBy("ri", "rj")).applyInPandas(lambda a, b: found(a, b.rename(columns=back)), schema)


def _whole(left: DataFrame, right: DataFrame, found, schema: str) -> DataFrame:
    """``right`` (of a checked size) is shipped to all tasks that read ``left``."""
    side = left.sparkSession.sparkContext.broadcast(right.toPandas())

    def run(frames):
        for f in frames:
            if len(f) and len(side.value):
                yield found(f, side.value)

    return left.mapInPandas(run, schema)


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, score)`` of all pairs with cosine >= ``threshold``; both sides are ``(id, vec)``. Only these pairs leave a task."""

    def found(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": a["id"].iloc[:0], "b": b["id"].iloc[:0], "score": pd.Series(dtype="float64")})]
        for x, y in _by_length(a, b):
            s = _unit(x["vec"]) @ _unit(y["vec"]).T
            i, j = np.nonzero(s >= threshold)
            if len(i):
                out.append(pd.DataFrame({"a": x["id"].to_numpy()[i], "b": y["id"].to_numpy()[j], "score": s[i, j]}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    left, right = (_takes_part(d) for d in (left, right))
    schema = f"a {id_type(left)}, b {id_type(right)}, score double"
    small = right.limit(WHOLE_ROWS + 1).count() <= WHOLE_ROWS
    return _whole(left, right, found, schema) if small else _blocks(left, right, found, schema, BLOCK_ROWS)


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``(query, id, score, rank)``: cosine top ``k`` of each query; each block keeps its own k first."""

    def found(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _nearest_of(v, q, [_nearest(x, y, k) for x, y in _by_length(v, q)])

    queries, vectors = (_takes_part(d) for d in (queries, vectors))
    return merged_nearest(queries, vectors, found, k)


def _nearest(x: pd.DataFrame, y: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index labels of ``y`` and ``x`` and the cosine: the top ``k`` rows of ``x`` for each of ``y`` (scores to nine digits,
    ties by id)."""
    a, b = _unit(x["vec"]), _unit(y["vec"])
    order = np.unique(x["id"].to_numpy(), return_inverse=True)[1]
    step, out = max(1, SCORES // max(1, len(a))), []
    for first in range(0, len(b) if k > 0 else 0, step):
        s = b[first : first + step] @ a.T
        r = np.round(s, 9)
        if k < len(a):
            # all that tie with the k-th stay until ids decide
            i, j = np.nonzero(r >= np.partition(r, len(a) - k, axis=1)[:, [len(a) - k]])
        else:
            i, j = (v.ravel() for v in np.indices(r.shape))
        top = _top(i, r[i, j], order[j], k)
        i, j = i[top], j[top]
        out.append((i + first, j, s[i, j]))
    i, j, s = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return y.index.to_numpy()[i], x.index.to_numpy()[j], s


def _top(query: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each query; ties go to the smaller ``order``."""
    by = np.lexsort((order, -score, query))
    q = query[by]
    new = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    return by[np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q)))) < k]


def _nearest_of(v: pd.DataFrame, q: pd.DataFrame, parts: list, k: int | None = None) -> pd.DataFrame:
    """Rows ``(query, id, score)`` from what ``_nearest`` found; with ``k``, the top ``k`` of each query."""
    i, j, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    if k is not None:
        top = _top(i, np.round(s, 9), np.unique(v["id"].to_numpy(), return_inverse=True)[1][j], k)
        i, j, s = i[top], j[top], s[top]
    return pd.DataFrame({"query": q["id"].to_numpy()[i], "id": v["id"].to_numpy()[j], "score": s})


def merged_nearest(queries: DataFrame, vectors: DataFrame, found, k: int) -> DataFrame:
    """``(query, id, score, rank)`` from ``found``, which has the top ``k`` of a frame of vectors for a frame of queries."""
    schema = f"query {id_type(queries)}, id {id_type(vectors)}, score double"
    own = lambda a, b: found(a.reset_index(drop=True), b.reset_index(drop=True))
    small = queries.limit(WHOLE_ROWS + 1).count() <= WHOLE_ROWS
    part = _whole(vectors, queries, own, schema) if small else _blocks(vectors, queries, own, schema, BLOCK_ROWS)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def delete_vectors(vectors: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
    return vectors.join(gone.select(F.col(id_col).alias("gone")), vectors[id_col] == F.col("gone"), "left_anti")


def live_vectors(vectors: DataFrame, live: DataFrame, id_col: str = "id") -> DataFrame:
    return vectors.join(live.select(F.col(id_col).alias("live")), vectors[id_col] == F.col("live"), "left_semi")


def centroid(vectors: DataFrame, by: str, vec_col: str = "vec") -> DataFrame:
    """``(by, pos, mean)``: element-wise mean of each group, partially summed before the shuffle."""
    return vectors.select(by, F.posexplode(vec_col).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def medoid(vectors: DataFrame, by: str, vec_col: str = "vec") -> DataFrame:
    """The row of each group nearest to its centroid (L2, then id)."""
    mean = centroid(vectors, by, vec_col).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("m"))
    d = V.l2_squared(F.col(vec_col), F.col("m"))
    return vectors.join(mean, by).groupBy(by).agg(F.min_by("id", F.struct(F.round(d, 9).alias("d"), F.col("id").alias("i"))).alias("id"))


def similar_of_kinds(kinds: dict[str, DataFrame], query: Column, k: int, threshold: float | None = None) -> DataFrame:
    """``find_similar`` over several tables ``(id, vec)`` at once: ``(kind, id, score)``; ties go to the smaller kind, then id."""
    rows = None
    for name, df in kinds.items():
        part = df.where((F.size("vec") == F.size(query)) & V.usable(F.col("vec"))).select(F.lit(name).alias("kind"), F.col("id"), V.cosine(F.col("vec"), query).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(~F.isnan("score"))
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), "kind", "id").limit(k)
