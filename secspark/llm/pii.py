"""Operator 1 (native): personal data by candidate gradient boosting.

1. Generators (high recall, overlapping): each pattern is matched from left to right over the whole text; offsets come
   from the lengths of the matches and of the pieces between them.
2. Every candidate gets binned format features (generator, digits, separators, lead) and context features (characters and
   words beside it).
3. Boosted trees of depth two are fitted to the counts of positives and negatives in each combination of bins, over all
   rows of one half of the texts (by a hash of the text, so that copies stay together). Labels are weak and come from
   evidence that no feature shows: the last label of a domain is a word, octets are at most 255, Luhn's check digit holds, a
   phone number starts as numbering plans allow. Combinations number at most the product of the bins.
4. For each kind, the lowest score whose labelled precision in the other half of the texts is still ``precision`` is its
   threshold. Candidates beyond it that overlap no base span, and no earlier added one, are added. Base spans always stay.

Everything is DataFrame and SQL functions; the trees become CASE expressions. A row's candidates stay in its row, so
nothing is shuffled but the counts. Folds over a row's candidates run in blocks of the square root of their number, as
appending to an array copies it; overlaps are found by sweeps over sorted spans.

Cases: null text is empty; empty texts, empty tables and rows without matches give 0 and the hash of the empty string;
repeated rows and null doc_ids are rows like others; extra columns are ignored. Without labelled positives of a kind in
both halves nothing is added for it. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import materialize, read_table

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _OCTET = r"[A-Za-z0-9._%+-]", r"[0-9]{1,3}"
#: (kind, generator, guard, pattern); generator 1 is the base pattern of its kind. Possessive quantifiers and the
#: look-behinds keep the same leftmost matches without backtracking over long runs.
GENERATORS = (
    (1, 1, "contains(t, '@')", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (1, 2, "contains(t, '[at]') or contains(t, '(at)')", rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++"),
    (2, 1, "t rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (2, 2, "t rlike '[0-9][.][0-9]'", rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9.])"),
    (2, 3, "contains(t, '[.]')", rf"(?<![0-9]){_OCTET}(?:\[\.\]{_OCTET}){{3}}(?![0-9])"),
    (3, 1, "t rlike '[0-9][0-9 -]{11}'", r"[0-9](?:[\x20-]?[0-9]){15,}+"),
    (3, 2, "t rlike '[0-9][0-9 -]{11}'", r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    (3, 3, "t rlike '[0-9][0-9 -]{11}'", r"(?<![0-9])3[47][0-9]{2}([\x20-]?)[0-9]{6}\1[0-9]{5}(?![0-9])"),
    (4, 1, "contains(t, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
    (4, 2, "contains(t, '+')", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"),
    (4, 3, "t rlike '[0-9]{3}[ .-][0-9]{4}'", r"(?<![0-9+.-])(?<![0-9] )\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
_SPAN = "struct<k:int,g:int,s:int,e:int,m:string,l:string,r:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _scan(array: str, init: str, kind: str, step: str, emit: str) -> str:
    """SQL for the array of ``emit`` (of type ``kind``) for each element ``x``; ``q.s`` is the state before it, ``step`` the
    state after it."""
    block = "greatest(1, cast(ceil(sqrt(size(z))) as int))"
    none = f"cast(array() as array<{kind}>)"
    inner = f"aggregate(slice(z, b * {block} + 1, {block}), named_struct('s', a.s, 'o', {none}), (q, x) -> named_struct('s', {step}, 'o', concat(q.o, array({emit}))))"
    return f"""transform(array({array}), z -> flatten(aggregate(sequence(0, {block} - 1), named_struct('s', {init}, 'o', cast(array() as array<array<{kind}>>)),
 (a, b) -> transform(array({inner}), r -> named_struct('s', r.s, 'o', concat(a.o, array(r.o))))[0], a -> a.o)))[0]"""


def _find(kind: int, gen: int, guard: str, pattern: str) -> str:
    """Matches of one pattern with their places and the 16 characters beside them."""
    lengths = "transform(sequence(0, size(y.m) - 1), i -> named_struct('g', length(y.g[i]), 'm', length(y.m[i])))"
    starts = _scan(lengths, "0", "int", "q.s + x.g + x.m", "q.s + x.g")
    return f"""IF({guard}, transform(array(named_struct('m', regexp_extract_all(t, r'{pattern}', 0), 'g', split(t, r'{pattern}', -1))), y ->
 IF(size(y.m) = 0, {_NONE}, transform({starts}, (p, i) -> named_struct('k', {kind}, 'g', {gen}, 's', p, 'e', p + length(y.m[i]), 'm', y.m[i], 'l', right(y.g[i], 16), 'r', left(y.g[i + 1], 16)))))[0], {_NONE})"""


def _side(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN 0 WHEN {c} rlike '^[\\\\x09-\\\\x0D ]' THEN 1 WHEN {c} rlike '^[0-9]' THEN 2 WHEN {c} rlike '^[A-Za-z]' THEN 3 ELSE 4 END"


#: Bins of a candidate ``c`` with its digits ``d``: name, expression, number of values.
FEATURES = (
    ("kind", "c.k", 5),
    ("digits", "CASE WHEN length(d) = 0 THEN 0 WHEN length(d) < 8 THEN 1 WHEN length(d) < 10 THEN 2 WHEN length(d) = 10 THEN 3 WHEN length(d) < 13 THEN 4 WHEN length(d) < 16 THEN 5 WHEN length(d) = 16 THEN 6 WHEN length(d) < 20 THEN 7 ELSE 8 END", 9),
    ("generator", "c.g", 4),
    ("left", _side("right(c.l, 1)"), 5),
    ("right", _side("left(c.r, 1)"), 5),
    ("parts", "IF(c.m rlike '[0-9][^0-9.@]+[0-9]', 1, 0)", 2),
    ("lead", "IF(c.m rlike '^[+(]', 1, 0)", 2),
    ("hint", r"CASE WHEN c.l rlike '(?i)(?:token|secret|key|hash|sha|id)\\W*$' THEN 1 WHEN c.l rlike '(?i)(?:card|visa|phone|tel|call|mail|contact|addr)\\W*$' THEN 2 ELSE 0 END", 3),
)
_LUHN = "(length(d) between 13 and 19 and luhn_check(d))"
_OCTETS = r"forall(split(c.m, '[^0-9]+', -1), p -> p rlike '^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$')"
#: Whether a base match holds.
_VALID = f"CASE c.k WHEN 1 THEN true WHEN 2 THEN {_OCTETS} WHEN 3 THEN length(d) >= 16 and {_LUHN} ELSE length(d) between 8 and 15 END"
#: The evidence for a candidate, base or not.
_EVIDENCE = f"CASE c.k WHEN 1 THEN c.m rlike '[A-Za-z]{{2,10}}$' WHEN 2 THEN {_OCTETS} WHEN 3 THEN {_LUHN} WHEN 4 THEN IF(c.m like '+%', length(d) between 8 and 15 and d not like '0%', d rlike '^[2-9][0-9]{{2}}[2-9]') END"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its id, ``half``, and ``c``, the candidates with base validity ``v``, evidence ``y`` and
    bins ``f``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    spans = F.expr("concat(" + ", ".join(_find(*g) for g in GENERATORS) + ")")
    bins = ", ".join(f"cast({e} as int)" for _, e, _ in FEATURES)
    one = f"""transform(spans, c -> transform(array(regexp_replace(c.m, '[^0-9]', '')), d -> named_struct('k', c.k, 'g', c.g, 's', c.s, 'e', c.e, 'v', {_VALID}, 'y', {_EVIDENCE}, 'f', array({bins})))[0])"""
    half = F.pmod(F.xxhash64("t"), F.lit(2)).cast("int").alias("half")
    return d.select("doc_id", half, *(["t"] if keep_text else []), spans.alias("spans")).withColumn("c", F.expr(one)).drop("spans")


def count_cells(rows: DataFrame) -> list[list[tuple[tuple[int, ...], float, float]]]:
    """For each half, (bins, positives, negatives) of the candidates; as many as there are combinations of bins at most."""
    seen = rows.select("half", F.explode("c").alias("x")).groupBy("half", "x.f").agg(F.sum(F.col("x.y").cast("int")).alias("pos"), F.count("*").alias("n"))
    cells = [[], []]
    for r in seen.collect():
        cells[r["half"]].append((tuple(r["f"]), float(r["pos"]), float(r["n"] - r["pos"])))
    return [sorted(c) for c in cells]


def fit_trees(cells, rounds: int = 16, rate: float = 0.5, ridge: float = 1.0) -> list[tuple]:
    """Gradient boosting for the logistic loss on counted cells: trees ``(split, (split, a, b), (split, a, b))`` where a
    split is (feature, value) and goes left on equality; a leaf is a number."""
    splits = [(j, v) for j, (_, _, n) in enumerate(FEATURES) for v in range(n)]
    score = [0.0] * len(cells)
    trees = []

    def leaf(rows):
        g = sum(grad[i] for i in rows)
        h = sum(hess[i] for i in rows)
        return rate * g / (h + ridge), g * g / (h + ridge)

    def best(rows):
        top, found = 1e-9, None
        whole = leaf(rows)[1]
        for j, v in splits:
            a = [i for i in rows if cells[i][0][j] == v]
            if a and len(a) < len(rows):
                b = [i for i in rows if cells[i][0][j] != v]
                gain = leaf(a)[1] + leaf(b)[1] - whole
                if gain > top:
                    top, found = gain, ((j, v), a, b)
        return found

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [c[1] - (c[1] + c[2]) * q for c, q in zip(cells, p, strict=True)]
        hess = [(c[1] + c[2]) * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        root = best(range(len(cells)))
        if root is None:
            break
        halves = []
        for rows in root[1:]:
            sub = best(rows)
            halves.append((sub[0], leaf(sub[1])[0], leaf(sub[2])[0]) if sub else (root[0], leaf(rows)[0], leaf(rows)[0]))
        trees.append((root[0], *halves))
        for i, c in enumerate(cells):
            score[i] += tree_value(trees[-1], c[0])
    return trees


def tree_value(tree, f) -> float:
    (j, v), left, right = tree
    (j, v), a, b = left if f[j] == v else right
    return a if f[j] == v else b


def thresholds(cells, trees, precision: float) -> dict[int, float]:
    """For each kind the lowest score down to which the labelled precision of ``cells`` holds; kinds without positives have none."""
    out = {}
    for kind in range(1, 5):
        scored = sorted(((sum(tree_value(t, f) for t in trees), p, n) for f, p, n in cells if f[0] == kind), reverse=True)
        pos = neg = 0.0
        for s, same in itertools.groupby(scored, key=lambda x: round(x[0], 9)):
            for _, p, n in same:
                pos, neg = pos + p, neg + n
            if pos and pos / (pos + neg) >= precision:
                out[kind] = s - 1e-6
    return out


def _score_sql(trees, f: str) -> str:
    def sub(half):
        (j, v), a, b = half
        return f"IF({f}[{j}] = {v}, {a!r}D, {b!r}D)"

    return " + ".join(["0.0D"] + [f"IF({f}[{t[0][0]}] = {t[0][1]}, {sub(t[1])}, {sub(t[2])})" for t in trees])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.99, keep_text: bool = False) -> DataFrame:
    """Rows ``(doc_id[, t], base, found)``: sorted arrays of ``(k, s, e)``, ``found`` with the added spans."""
    rows = materialize(candidates(docs, id_col, text_col, keep_text), "candidates")
    fitted, other = count_cells(rows)
    trees = fit_trees(fitted) if fitted else []
    floor = thresholds(other, trees, precision)
    return rows.select("doc_id", *(["t"] if keep_text else []), *_select(trees, floor))


def _select(trees, floor: dict[int, float]) -> list[Column]:
    """``base`` and ``found`` from ``c``."""
    bound = "CASE x.k " + " ".join(f"WHEN {k} THEN {v!r}D" for k, v in floor.items()) + " ELSE null END" if floor else "cast(null as double)"
    place = "named_struct('k', x.k, 's', x.s, 'e', x.e)"
    base = f"array_sort(transform(filter(c, x -> x.g = 1 and x.v), x -> {place}))"
    # base spans come before others that start with them
    wanted = f"(x.g > 1 and ({_score_sql(trees, 'x.f')}) >= ({bound}))"
    spans = f"array_sort(transform(filter(c, x -> (x.g = 1 and x.v) or {wanted}), x -> named_struct('s', x.s, 'o', int(not (x.g = 1 and x.v)), 'e', x.e, 'k', x.k)))"
    seen = "struct<s:int,o:int,e:int,k:int,p:int>"
    behind = _scan(spans, "0", seen, "IF(x.o = 0, greatest(q.s, x.e), q.s)", "named_struct('s', x.s, 'o', x.o, 'e', x.e, 'k', x.k, 'p', q.s)")
    ahead = _scan(f"reverse({behind})", "2147483647", seen, "IF(x.o = 0, x.s, q.s)", "named_struct('s', x.s, 'o', x.o, 'e', x.e, 'k', x.k, 'p', IF(x.p <= x.s and q.s >= x.e, 1, 0))")
    free = f"reverse(filter({ahead}, x -> x.o = 1 and x.p = 1))"
    chosen = _scan(free, "0", seen, "IF(x.s >= q.s, x.e, q.s)", "named_struct('s', x.s, 'o', x.o, 'e', x.e, 'k', x.k, 'p', IF(x.s >= q.s, 1, 0))")
    added = f"transform(filter({chosen}, x -> x.p = 1), x -> {place})"
    found = f"IF(exists(c, x -> {wanted}), array_sort(concat({base}, {added})), {base})"
    return [F.expr(base).alias("base"), F.expr(found).alias("found")]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, redacted)``: each span replaced by its kind in brackets."""
    rows = detect(docs, id_col, text_col, keep_text=True, **options)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    ordered = "array_sort(transform(found, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k)))"
    # the text before each span that starts behind the last one's end, and the span's name
    cut = _scan(ordered, "0", "struct<p:int,n:int,k:int>", "IF(x.s >= q.s, x.e, q.s)", "IF(x.s >= q.s, named_struct('p', q.s, 'n', x.s - q.s, 'k', x.k), null)")
    parts = f"filter({cut}, x -> x is not null)"
    rows = rows.withColumn("parts", F.expr(parts)).withColumn("last", F.expr("coalesce(array_max(transform(found, x -> x.e)), 0)"))
    body = f"concat(array_join(transform(parts, x -> concat(substring(t, x.p + 1, x.n), {names}[x.k - 1])), ''), substring(t, last + 1))"
    return rows.select("doc_id", F.expr(body).alias("redacted"))


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"concat_ws(',', transform({spans}, x -> concat({names}[x.k - 1], ':', x.s, ':', x.e)))"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i + 1})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    added = F.expr("cast(size(found) - size(base) as bigint)").alias("n_added")
    return rows.select("doc_id", *counts, F.expr(f"sha2({_listed('base')}, 256)").alias("base_sha256"), F.expr(_listed("found")).alias("spans"), added)
