"""The query object: metadata filters, time range, vector predicate, order, offset and limit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secspark.errors import InvalidQuery
from secspark.functions import vectors as V

OPERATORS = ("Equals", "NotEquals", "GreaterThan", "LessThan", "In", "NotIn", "Contains", "StartsWith", "EndsWith")


def json_field(meta: Column, name: str) -> Column:
    """A field of a JSON object as text, whatever its name holds; whole numbers without decimals."""
    if "'" in name or "\\" in name:  # no path can hold these
        x = F.try_element_at(F.from_json(meta, "map<string,string>"), F.lit(name))
    else:
        x = F.get_json_object(meta, f"$['{name}']")
    return F.regexp_replace(x, r"^(-?[0-9]+)\.0+$", "$1")


@dataclass
class MetadataFilter:
    """A missing field (or unreadable JSON) never matches, not even under NotEquals and NotIn."""

    field: str
    operator: str
    value: object

    def column(self, meta: Column) -> Column:
        x = json_field(meta, self.field)
        # whole numbers have one form: 42.0 is 42
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
        if self.operator in ("GreaterThan", "LessThan"):
            n = x.try_cast("double")
            return n > float(self.value) if self.operator == "GreaterThan" else n < float(self.value)
        if self.operator in ("In", "NotIn"):
            hit = x.isin(*[text(v) for v in self.value])
            return hit if self.operator == "In" else ~hit
        v = text(self.value)
        tests = {"Equals": x == v, "NotEquals": x != v, "Contains": x.contains(v), "StartsWith": x.startswith(v), "EndsWith": x.endswith(v)}
        if self.operator not in tests:
            raise InvalidQuery(f"unknown operator {self.operator}")
        return tests[self.operator]


@dataclass
class TimeRange:
    """Closed interval of epoch milliseconds."""

    start_ms: int
    end_ms: int

    def __post_init__(self):
        if self.start_ms > self.end_ms:
            raise InvalidQuery("time range starts after its end")

    def column(self, ts: Column) -> Column:
        """On a timestamp without zone, so that files and row groups are skipped by their statistics."""
        at = lambda ms: F.expr(f"timestampadd(MICROSECOND, {ms}000, timestamp_ntz'1970-01-01 00:00:00')")
        return (ts >= at(self.start_ms)) & (ts < at(self.end_ms + 1))


@dataclass
class VectorQuery:
    vector: list[float]
    threshold: float | None = None
    metric: str = "cosine"

    def score(self, vec: Column) -> Column:
        q = V.literal(self.vector)
        if self.metric == "cosine":
            return V.cosine(vec, q)
        if self.metric == "dot":
            return V.dot(vec, q)
        if self.metric == "l2":
            return -V.l2(vec, q)
        raise InvalidQuery(f"unknown metric {self.metric}")


@dataclass
class QueryRequest:
    vector_query: VectorQuery | None = None
    metadata_filters: list[MetadataFilter] = field(default_factory=list)
    time_range: TimeRange | None = None
    limit: int | None = None
    offset: int = 0

    def run(self, logs: DataFrame) -> DataFrame:
        """``logs (id, ts, meta[, vec])``; adds ``score`` and ``total_matches``; ordered by score, else time, then id.

        A null time is in no range, null or unreadable metadata match no filter, vectors that are null, of another length or
        with elements that are no numbers match no vector query. A column named score or total_matches is replaced."""
        out = logs.drop("total_matches")
        if self.time_range:
            out = out.where(self.time_range.column(F.col("ts")))
        for f in self.metadata_filters:
            out = out.where(f.column(F.col("meta")))
        order = ["ts", "id"]
        if self.vector_query:
            out = out.where((F.size("vec") == len(self.vector_query.vector)) & V.usable(F.col("vec"))).withColumn("score", self.vector_query.score(F.col("vec")))
            if self.vector_query.threshold is not None:
                out = out.where(F.col("score") >= self.vector_query.threshold)
            order = [F.desc("score"), "id"]
        # counted apart and joined as one row: no window over all rows
        total = out.agg(F.count("*").alias("total_matches"))
        page = out.orderBy(*order)
        if self.offset:
            page = page.offset(self.offset)
        if self.limit is not None:
            page = page.limit(self.limit)
        return page.crossJoin(F.broadcast(total))


def explain(request: QueryRequest, logs: DataFrame, mode: str = "formatted") -> str:
    """The physical plan of a request."""
    plan = request.run(logs)
    return plan._jdf.queryExecution().explainString(plan.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def estimate_cost(request: QueryRequest, logs: DataFrame) -> dict:
    """Bytes that the optimiser expects to read and to return, and the operations that the request asks for."""
    stats = lambda d: int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return {"bytes_read": stats(logs), "bytes_out": stats(request.run(logs)), "filters": len(request.metadata_filters) + (request.time_range is not None), "sorts": 1, "vector": request.vector_query is not None}


def meta_add(meta: Column, key: str, value) -> Column:
    """``meta`` with one field set; unreadable JSON counts as empty."""
    m = F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>"))
    value = value if isinstance(value, Column) else F.lit(value)
    return F.to_json(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value)))


def inverted_index(logs: DataFrame, key: str) -> DataFrame:
    """``(value, ids)`` of a metadata key."""
    v = F.get_json_object("meta", f"$.{key}")
    return logs.select("id", v.alias("value")).where("value is not null").groupBy("value").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def latest(df: DataFrame, key: str, version: str, first: bool = False) -> DataFrame:
    """The row of the highest (or lowest) version of each key, by a partial aggregate instead of a sort. A null version is
    lower than all others; of equal versions any one row stays; a null key is a key like others."""
    rest = F.struct(*[c for c in df.columns if c != key])
    pick = F.min_by if first else F.max_by
    return df.groupBy(key).agg(pick(rest, F.struct(version)).alias("x")).select(key, "x.*")


def ranked(df: DataFrame, by: list, order: list, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n).drop("rn")
