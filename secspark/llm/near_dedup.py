"""Operator 9: near duplicates by HyperMinHash.

A document's set is the set of its distinct k-word shingles (A-Z lowered, words parted by blanks and bytes 9-13); with
fewer words the whole sequence is its one shingle; without words the set is empty and linked with nothing.

1. Every set becomes 128 registers: the bucket is the hash's top 7 bits, the register the leading-zero count and 10
   mantissa bits of the smallest remainder in it. Empty buckets are filled from the other buckets' minima, rehashed, so
   small sets have 128 comparable registers too.
2. Equal sets collapse to one class first, so thousands of copies are one vertex.
3. 32 bands of 4 registers. A pair at the threshold shares no band with a probability under 1e-7. In each bucket all
   classes are compared with its hub, the most central one (in the most and largest buckets): a star, not all pairs.
4. A collision-corrected estimate from the registers drops star pairs far below the threshold (over six standard
   deviations); the others are confirmed on full sets, 64 classes to a copy of the hub's set.
5. Components of these links. Buckets whose classes then lie in one component are final. In the others two classes A and B
   with the hub H are compared by their differences D = set xor H's set, as |A xor B| = |D_A| + |D_B| - 2 |D_A and D_B|:
   a link that isn't already given by two links with H needs at least max(1, |D| - T) common members of D, T being the
   largest |A xor B| that a set of that size may have in a link. So only members of D that occur in two components at least
   ("live") count, a class with fewer live members than that can't link, and two that link share one of the first
   min(|D|, T + 1) members in order of rarity. Classes of hubs with more than ``BLOCK`` are dealt to lists (H, member) of
   these, others to one list: their number follows the sum of the differences, not the square of a bucket. Inside a list classes are compared on their live members and sizes, which
   decides exactly; a list of more than ``BLOCK`` rows is compared block by block. No pair is written but the links that join
   two components.

Cases: null text is empty; rows sharing a doc_id are in one component (each of its sets may link it; ids under 2**62); a null doc_id takes no
part (component_id null, kept true); repeated rows and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import components, materialize, read_table, sized_broadcast
from secspark.llm.textbytes import doc_shingles, mix, text_chunks, word_hashes

BUCKET_BITS, BUCKETS, MANTISSA_BITS = 7, 128, 10
BANDS, ROWS = 32, 4
#: Rows of a list compared at once in stage 5, and classes to a copy of a hub's set in stages 4 and 5.
BLOCK, MEMBERS = 1024, 64
#: The estimate is not trusted to drop pairs of sets smaller than this.
SMALL = 32
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_SEEDS = mix(np.arange(1001, 1001 + BUCKETS, dtype=np.uint64))


def registers(values: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa of 64-bit values as 16 bits."""
    top = values >> np.uint64(11)
    _, e = np.frexp(top.astype(np.float64))
    lz = (53 - e).astype(np.uint64)
    lz[top == 0] = 53
    m = (values << (lz + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    return ((lz << np.uint64(MANTISSA_BITS)) | m).astype(np.uint16)


def sketch(s: np.ndarray) -> np.ndarray:
    """128 register values (before compression) of a sorted distinct non-empty set."""
    at = np.searchsorted(s, _EDGES)
    got = s[np.minimum(at, len(s) - 1)]
    full = (at < len(s)) & (got >> np.uint64(64 - BUCKET_BITS) == _EDGES >> np.uint64(64 - BUCKET_BITS))
    out = got << np.uint64(BUCKET_BITS)
    if not full.all():
        empty = np.flatnonzero(~full)
        out[empty] = mix(got[full][None, :] ^ _SEEDS[empty][:, None]).min(axis=1)
    return out


#: Probability that two different minima have equal registers: of the same octave (1/3) and mantissa.
COLLISION = 2.0**-MANTISSA_BITS / 3


def estimate(matches):
    """Collision-corrected Jaccard estimate from the number of equal registers."""
    return (matches / BUCKETS - COLLISION) / (1 - COLLISION)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, j, data, off in text_chunks(b.column(1)):
                words, _, first = word_hashes(data, off)
                n, cls, regs = [], [], []
                for s in doc_shingles(words, first, k):
                    n.append(len(s))
                    cls.append(_digest(s) if len(s) else None)
                    if len(s):
                        regs.append(sketch(s))
                flat = registers(np.concatenate(regs)) if regs else np.zeros(0, np.uint16)
                at = np.concatenate(([0], np.cumsum(np.array(n) > 0) * BANDS)).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), bands], ["doc_id", "n", "cls", "bands"])

    return run


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text_chunks(b.column(1)):
                words, _, first = word_hashes(data, off)
                sets = list(doc_shingles(words, first, k))
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                cls = pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), cls, pa.ListArray.from_arrays(pa.array(at), pa.array(values))], ["doc_id", "cls", "s"])

    return run


def _lanes(col: pa.ListArray) -> np.ndarray:
    """A column of band lists as a matrix of registers."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint16).reshape(-1, BUCKETS)


def _limit(share: float) -> int:
    """Equal registers under which a pair at the threshold is not expected (six standard deviations)."""
    return int(np.floor(BUCKETS * (share - 6 * np.sqrt(share * (1 - share) / BUCKETS))))


def _estimator(share: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            same = (_lanes(b.column("ra")) == _lanes(b.column("rb"))).sum(axis=1)
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            lo, hi = np.minimum(na, nb), np.maximum(na, nb)
            ok = (lo >= share * hi - 1e-9) & ((estimate(same) >= estimate(_limit(share))) | (lo < SMALL))
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group, which come together."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(change), b.num_rows)
        for x, y in zip(at[:-1], at[1:], strict=True):
            k = tuple(c[x] for c in cols)
            if k != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = k
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _against_hubs(batches, found):
    """Calls ``found(hub, its set, v, set)`` for each member; rows come sorted by (hub, part, kind, v), the hub's set first."""
    hub, base, last = None, None, None
    for b in batches:
        hubs, kinds, vs = (b.column(c).to_numpy() for c in ("hub", "kind", "v"))
        sets = b.column("s")
        values, off = sets.values.to_numpy(zero_copy_only=False).view(np.uint64), sets.offsets.to_numpy()
        for r in range(b.num_rows):
            s = values[off[r] : off[r + 1]]
            if kinds[r] == 0:
                hub, base, last = hubs[r], s.copy(), None
            elif hub == hubs[r] and vs[r] != last:  # repeated rows of a document come once
                last = vs[r]
                found(hub, base, last, s)
        yield b.num_rows


def _star_links(per_cent: int):
    def run(batches):
        links: list[tuple[int, int]] = []

        def found(hub, base, v, s):
            both = len(np.intersect1d(base, s, assume_unique=True))
            if both and 100 * both >= per_cent * (len(base) + len(s) - both):
                links.append((min(hub, v), max(hub, v)))

        for _ in _against_hubs(batches, found):
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                links.clear()

    return run


def _differences(batches):
    """``(hub, v, n, d)``: each member's set xor its hub's."""
    rows: list[tuple] = []

    def found(hub, base, v, s):
        rows.append((hub, v, len(s), np.setxor1d(base, s, assume_unique=True).view(np.int64)))

    for _ in _against_hubs(batches, found):
        if rows:
            hub, v, n, d = zip(*rows, strict=True)
            at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in d]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(hub, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(d)))], ["hub", "v", "n", "d"])
            rows.clear()


def _list_links(per_cent: int):
    """Links between the components of a list (hub, x), block (i, j): ``low`` rows against all. Yields components that are one."""

    def run(batches):
        for rows in _groups(batches, ("hub", "x", "i", "j")):
            n, d, label, low = (rows[c].to_numpy() for c in ("n", "d", "label", "low"))
            live = rows["live"].combine_chunks()
            values, off = live.values.to_numpy(zero_copy_only=False), live.offsets.to_numpy()
            size = np.diff(off)
            of = np.repeat(np.arange(len(n)), size)
            values = values[off[0] : off[-1]]
            off = off - off[0]
            # members of the list, sorted, with their rows: which rows share a member is found by search
            order = np.argsort(values, kind="stable")
            member, owner = values[order], of[order]
            now, out = label.copy(), []
            for q in np.flatnonzero(low):
                mine = values[off[q] : off[q + 1]]
                x, y = np.searchsorted(member, mine, "left"), np.searchsorted(member, mine, "right")
                at = np.repeat(x, y - x) + np.arange((y - x).sum()) - np.repeat(np.cumsum(y - x) - (y - x), y - x)
                shared = np.bincount(owner[at], minlength=len(n))
                # |A xor B| = d + e - 2 shared, |A and B| = (a + b - |A xor B|) / 2
                both = (n + n[q] - (d + d[q] - 2 * shared)) // 2
                for k in np.flatnonzero((now != now[q]) & (both > 0) & (100 * both >= per_cent * (n + n[q] - both))):
                    if now[k] != now[q]:
                        out.append((label[q], label[k]))
                        now[now == now[k]] = now[q]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _vertex(doc_id: str, cls: str, shared: str) -> Column:
    """A class's vertex: its smallest doc_id, or, where several classes have that one, a number beyond all ids."""
    return F.when(F.col(shared).isNull(), F.col(doc_id)).otherwise(F.xxhash64(cls).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))


def _sets(docs: DataFrame, shared: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """``(v, s)``: the sorted sets of the classes in ``need (v)``."""
    need = materialize(need.unionByName(shared.select(F.col("shared").alias("v"))).distinct(), "need")
    sets = docs.join(sized_broadcast(need), docs["doc_id"] == need["v"], "left_semi").mapInArrow(_setter(k), "doc_id long, cls binary, s array<long>")
    sets = sets.where("cls is not null").join(sized_broadcast(shared), F.col("doc_id") == F.col("shared"), "left")
    return materialize(sets.select(_vertex("doc_id", "cls", "shared").alias("v"), "s"), "sets")


def _by_hub(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of ``pairs (hub, v)`` with their sets, ``MEMBERS`` to a copy of the hub's set, which comes first."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    members = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("v"), "parts").alias("part"), F.lit(1).alias("kind"), "v")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("v"))
    return members.unionByName(hubs).join(sets, "v").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", "v")


def _inside(docs: DataFrame, shared: DataFrame, pairs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Stage 5: labels ``(a, b)`` of components that a link joins, from ``pairs (hub, v, label)`` of mixed buckets."""
    sets = _sets(docs, shared, pairs.select(F.col("hub").alias("v")).union(pairs.select("v")), k)
    diff = materialize(_by_hub(pairs.select("hub", "v"), sets).mapInArrow(_differences, "hub long, v long, n long, d array<long>"), "differences")
    diff = diff.join(pairs, ["hub", "v"]).withColumn("size", F.size("d").cast("long"))
    # the largest |A xor B| of a link: (100 - p) / (100 + p) of |A| + |B|, with |B| <= 100 / p * |A|
    widest = F.floor(F.col("n") * (100 - per_cent) / per_cent + 1e-9).cast("long")
    diff = diff.withColumn("least", F.greatest(F.lit(1), F.col("size") - widest)).withColumn("first", F.least("size", widest + 1))
    each = diff.select("hub", "v", "label", F.explode("d").alias("x"))
    lists = each.groupBy("hub", "x").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    live = each.select("hub", "v", "x").join(lists.select("hub", "x", "m"), ["hub", "x"])
    live = live.groupBy("hub", "v").agg(F.array_sort(F.collect_list(F.struct("m", "x"))).alias("live"))
    live = materialize(diff.drop("d").join(live, ["hub", "v"]).where(F.size("live") >= F.col("least")), "live")
    # members that aren't live come first in the order; of the first members so many are left for live ones
    rows = live.withColumn("room", (F.col("first") - F.col("size") + F.size("live")).cast("int")).where("room > 0")
    own = F.transform("live", lambda z: z["x"])
    rows = rows.select("hub", "v", "n", F.col("size").alias("d"), "label", own.alias("live"), "room")
    # up to BLOCK members of a hub are one list; lists of single members are for larger ones
    many = materialize(rows.groupBy("hub").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("hub"), "many")
    many = sized_broadcast(many)
    few = rows.join(many, "hub", "left_anti").drop("room").withColumn("x", F.lit(0).cast("long"))
    rows = few.unionByName(rows.join(many, "hub", "left_semi").withColumn("x", F.explode(F.slice("live", F.lit(1), F.col("room")))).drop("room"))
    tally = rows.groupBy("hub", "x", "label").agg(F.count("*").alias("c"))
    cells = tally.groupBy("hub", "x").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.max("c").alias("big"), F.sum("c").alias("m"), F.count("*").alias("kinds")).where("kinds > 1")
    cells = cells.select("hub", "x", "major", F.ceil((F.col("m") - F.col("big")) / BLOCK).alias("ni"), F.ceil(F.col("m") / BLOCK).alias("nj"))
    rows = rows.join(cells, ["hub", "x"]).withColumn("low", F.col("label") != F.col("major"))
    keep = ["hub", "x", "v", "n", "d", "label", "live"]
    spread = lambda n, salt: F.pmod(F.xxhash64("v", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    small = rows.where("ni = 1 and nj = 1").select(*keep, "low", F.lit(0).alias("i"), F.lit(0).alias("j"))
    large = rows.where("ni > 1 or nj > 1")
    high = large.select(*keep, F.lit(False).alias("low"), every("ni").alias("i"), spread("nj", 1).alias("j"))
    low = large.where("low").select(*keep, "low", every("nj").alias("j"), spread("ni", 2).alias("i"))
    by = ["hub", "x", "i", "j"]
    return small.unionByName(high).unionByName(low).repartition(*by).sortWithinPartitions(*by).mapInArrow(_list_links(per_cent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id, kept)``, one for each row of ``docs``."""
    share = per_cent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = materialize(docs.mapInArrow(_signer(k), "doc_id long, n long, cls binary, bands array<long>"), "signatures")
    real = sigs.where("cls is not null and doc_id is not null")
    cls = materialize(real.groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    shared = materialize(cls.groupBy(F.col("least").alias("shared")).agg(F.count("*").alias("c")).where("c > 1").select("shared"), "shared")
    cls = cls.join(sized_broadcast(shared), F.col("least") == F.col("shared"), "left").withColumn("v", _vertex("least", "cls", "shared"))
    banded = cls.select("v", "n", F.posexplode("bands").alias("band", "key"))
    full = banded.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    multi = materialize(banded.join(full, ["band", "key"]).select("band", "key", "v", "n", "m"), "buckets")
    central = multi.groupBy("v").agg(F.sum("m").alias("weight"))
    hubs = multi.join(central, "v").groupBy("band", "key").agg(F.max_by("v", F.struct("weight", -F.col("v"))).alias("hub"))
    regs = cls.select("v", "n", "bands")

    def sides(pairs: DataFrame) -> DataFrame:
        a = regs.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ra"))
        b = regs.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("rb"))
        return pairs.join(a, "a").join(b, "b")

    hubs = materialize(hubs, "hubs")
    star = materialize(multi.join(hubs, ["band", "key"]).where("hub <> v").select("hub", F.col("v").alias("b")).distinct(), "star")
    near = sides(star.withColumnRenamed("hub", "a")).mapInArrow(_estimator(share), "a long, b long")
    near = materialize(near.select(F.col("a").alias("hub"), F.col("b").alias("v")), "candidates")
    ends = lambda p: p.select(F.col("hub").alias("v")).union(p.select("v"))
    sets = _sets(docs, shared, ends(near), k)
    links = materialize(_by_hub(near, sets).mapInArrow(_star_links(per_cent), "a long, b long").distinct(), "links")

    members = materialize(real.join(cls.select("cls", "v"), "cls").select("doc_id", "v"), "members")
    bridge = members.groupBy("doc_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi")
    bridges = members.join(bridge, "doc_id").select(F.col("lo").alias("a"), F.col("v").alias("b"))
    # a doc_id with several texts may not be its own class's smallest id: tie its vertices together
    own = cls.where("shared is not null").select(F.col("least").alias("a"), F.col("v").alias("b"))
    links = links.unionByName(bridges.where("a <> b").distinct()).unionByName(own)
    labels = components(links)

    labelled = multi.where("m > 2").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    mixed = labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band", "key")
    # a table by itself, so that the join with a hot bucket's rows can be split
    mixed = materialize(mixed.join(hubs, ["band", "key"]), "buckets")
    pairs = labelled.join(sized_broadcast(mixed), ["band", "key"]).where("hub <> v").select("hub", "v", "label").distinct()
    pairs = materialize(pairs, "mixed")
    if not pairs.isEmpty():
        joined = materialize(_inside(docs, shared, pairs, k, per_cent), "joined")
        if not joined.isEmpty():
            merged = components(joined).select(F.col("v").alias("label"), F.col("label").alias("root"))
            # a class without links is a component of its own
            alone = merged.join(labels, "label", "left_anti").select(F.col("label").alias("v"), F.col("root").alias("label"))
            labels = labels.join(merged, "label", "left").select("v", F.coalesce("root", "label").alias("label")).unionByName(alone)

    top = members.groupBy("doc_id").agg(F.min("v").alias("v")).join(labels, "v", "left").select("doc_id", F.coalesce("label", "v").alias("component_id"))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles")).join(top, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, per_cent=85)


OP9_SQL = r"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')]
   ELSE list_distinct(list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2])) END AS g FROM a),
 e AS (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS h FROM s),
 p AS (SELECT l.doc_id AS a, r.doc_id AS b, any_value(l.n) AS na, any_value(r.n) AS nb, count(*) AS c FROM e l JOIN e r ON l.h = r.h AND l.doc_id <> r.doc_id GROUP BY 1, 2),
 k AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
 reach(v, u) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, k.b FROM reach r JOIN k ON k.a = r.u)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CAST(m.u AS BIGINT) AS component_id, s.doc_id = m.u AS kept
FROM s JOIN (SELECT v, min(u) AS u FROM reach GROUP BY 1) m ON m.v = s.doc_id
"""
