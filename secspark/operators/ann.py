"""Approximate search: k-means cells, the nearest ``nprobe`` cells of a query scored exactly.

Cells number about the square root of the rows (16 to 4096) and are fitted on a bounded sample; every row is indexed, in a
table partitioned by cell, so that a search reads its cells alone. ``calibrate`` measures the cells of the true nearest
neighbours of sample queries and sets ``nprobe`` to the fewest cells that hold ``TARGET`` of them: vectors without
structure need most cells, clustered ones few.

Cases: an index holds vectors of one length, the most frequent one; rows with vectors that are null, of another length or with
elements that are no numbers are left out, and a query of another length finds nothing. A table without vectors gives a model
without cells. Repeated rows and null ids are rows like others; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.functions import vectors as V
from secspark.operators import search

#: Rows that k-means sees at most; every row is indexed.
FIT_ROWS = 100_000
#: Share of true neighbours that the searched cells hold; queries from which that is measured.
TARGET, QUERIES = 0.95, 200
LEAST_CELLS, MOST_CELLS = 16, 4096


@dataclass
class CellModel:
    centers: np.ndarray
    nprobe: int | None = None

    def cells(self, query, nprobe: int | None = None) -> list[int]:
        nprobe = nprobe or self.nprobe or len(self.centers)
        if len(query) != self.centers.shape[1]:
            return []
        q = np.asarray(query, float)
        q = q / (np.linalg.norm(q) or 1.0)
        d = ((self.centers - q) ** 2).sum(axis=1)
        return [int(i) for i in np.argsort(d, kind="stable")[:nprobe]]

    def _indexable(self, vectors: DataFrame) -> DataFrame:
        return vectors.where((F.size("vec") == self.centers.shape[1]) & V.usable(F.col("vec"))).select("id", "vec")

    def assign(self, vectors: DataFrame) -> DataFrame:
        """``(id, vec, cell)``: the nearest centre of each normalised vector."""
        if not len(self.centers):
            return self._indexable(vectors).withColumn("cell", F.lit(0))
        unit = V.normalized(F.col("vec"))
        d = F.array(*[F.struct(V.l2_squared(unit, V.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centers)])
        return self._indexable(vectors).select("id", "vec", F.array_min(d)["i"].alias("cell"))

    def assign_arrow(self, vectors: DataFrame) -> DataFrame:
        """As ``assign``, by matrix products in Arrow batches: for many cells."""
        import pyarrow as pa

        centers, half = self.centers, (self.centers**2).sum(axis=1) / 2

        def run(batches):
            for b in batches:
                for x in range(0, b.num_rows, 4096):
                    part = b.slice(x, 4096)
                    v = np.array(part.column("vec").to_pylist(), float).reshape(part.num_rows, -1)
                    norm = np.linalg.norm(v, axis=1, keepdims=True)
                    unit = v / np.where(norm == 0, 1, norm)
                    cell = (unit @ centers.T - half).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(cell.astype(np.int32))], ["id", "vec", "cell"])

        rows = self._indexable(vectors)
        return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vec {rows.schema['vec'].dataType.simpleString()}, cell int")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in c], self.nprobe) for i, c in enumerate(self.centers)]
        spark.createDataFrame(rows, "cell int, center array<double>, nprobe int").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellModel:
        rows = spark.read.parquet(path).orderBy("cell").collect()  # one row for each cell
        return CellModel(np.array([r["center"] for r in rows]), rows[0]["nprobe"]) if rows else NO_CELLS


NO_CELLS = CellModel(np.zeros((0, 0)))


def store(model: CellModel, vectors: DataFrame, path: str) -> DataFrame:
    """Write the index, partitioned by cell, and read it."""
    rows = model.assign_arrow(vectors)
    rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return vectors.sparkSession.read.schema(rows.schema).parquet(path)


def calibrate(model: CellModel, indexed: DataFrame, k: int = 10, target: float = TARGET, queries: int = QUERIES) -> CellModel:
    """The model with the fewest cells to search that hold ``target`` of the ``k`` nearest of sample queries."""
    n = indexed.count()
    some = indexed.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, 2 * queries / max(n, 1)) * (1 << 20))).orderBy(F.xxhash64("id")).limit(queries).select("id", "vec")
    asked = {r["id"]: np.asarray(r["vec"], float) for r in some.collect()}
    if not asked:
        return CellModel(model.centers, len(model.centers))
    near = search.knn_batch(some, indexed.select("id", "vec"), k).select("query", "id").join(indexed.select("id", "cell"), "id").collect()
    order = {q: {c: i for i, c in enumerate(model.cells(v, len(model.centers)))} for q, v in asked.items()}
    ranks = sorted(order[r["query"]][r["cell"]] for r in near)
    return CellModel(model.centers, ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] + 1)


def fit(vectors: DataFrame, cells: int | None = None, seed: int = 7, fit_rows: int = FIT_ROWS) -> CellModel:
    vectors = vectors.where(V.usable(F.col("vec")))
    sizes = vectors.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return NO_CELLS
    vectors, n = vectors.where(F.size("vec") == sizes["size"]), sizes["n"]
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, int(np.sqrt(n))))
    rows = vectors if n <= fit_rows else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(fit_rows / n * (1 << 20)))
    unit = rows.select(array_to_vector(V.normalized(F.col("vec"))).alias("features"))
    return CellModel(np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters()))


def ann_search(model: CellModel, indexed: DataFrame, query, k: int, nprobe: int | None = None) -> DataFrame:
    """Top ``k`` among the rows of the nearest cells; with ``indexed`` partitioned by cell only these are read."""
    near = indexed.where(F.col("cell").isin(model.cells(query, nprobe)))
    return search.find_similar(near, V.literal(query), k)


def ann_search_batch(model: CellModel, indexed: DataFrame, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
    """``(query, id, score, rank)``: cosine top ``k`` of each of ``queries (id, vec)`` among the rows of its nearest cells, by
    matrix products of a cell's rows and the queries that search it."""
    size = model.centers.shape[1]

    def found(v, q):
        probes = np.array([model.cells(x, nprobe) for x in q["vec"]], int).reshape(len(q), -1)
        asks = np.zeros((len(model.centers), len(q)), bool)
        asks[probes, np.arange(len(q))[:, None]] = True
        parts = [search._nearest(rows, q[asks[cell]], k) for cell, rows in v.groupby("cell") if asks[cell].any()]
        return search._nearest_of(v, q, parts, k)

    takes_part = lambda d: d.where("id is not null").where((F.size("vec") == size) & V.usable(F.col("vec")))
    return search.merged_nearest(takes_part(queries).select("id", "vec"), takes_part(indexed).select("id", "vec", "cell"), found, k)


def add(model: CellModel, indexed: DataFrame, new: DataFrame) -> DataFrame:
    return indexed.unionByName(model.assign(new))


def delete(indexed: DataFrame, ids: DataFrame) -> DataFrame:
    return indexed.join(ids.select("id").distinct(), "id", "left_anti")


def update(model: CellModel, indexed: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the vectors of ``new (id, vec)`` in place of those of the same ids."""
    return add(model, delete(indexed, new), new)


def index_stats(indexed: DataFrame) -> DataFrame:
    """One row: vectors, cells in use, and the smallest and largest cell."""
    per = indexed.groupBy("cell").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.count("*").alias("cells"), F.min("n").alias("least"), F.max("n").alias("most"))


def hybrid_search(vectors: DataFrame, query, k: int, threshold: int = 1000, index: tuple[CellModel, DataFrame] | None = None) -> DataFrame:
    """Exact below ``threshold`` rows, approximate from there on; score is 1 - min(distance, 1). ``index``: a model and its
    table; fitted here if none is given."""
    if vectors.limit(threshold).count() < threshold:
        found = search.find_similar(vectors, V.literal(query), k)
    else:
        if index is None:
            model = fit(vectors)
            table = model.assign_arrow(vectors)
            index = (calibrate(model, table), table)
        found = ann_search(*index, query, k)
    return found.select("id", (1 - F.least(1 - F.col("score"), F.lit(1.0))).alias("score"))


def query_vector(vectors: DataFrame, id_) -> list[float]:
    row = vectors.where(F.col("id") == id_).select("vec").first()
    return list(row["vec"]) if row else []


def literal_query(vectors: DataFrame, id_) -> Column:
    return V.literal(query_vector(vectors, id_))
