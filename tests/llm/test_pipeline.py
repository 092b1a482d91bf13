"""Every stage, and run() as a whole, against plain Python: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as p
from secspark.llm import mixing, quality
from secspark.llm.tokens import encoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, good_id long, sha string, GOOD_SHA string, m string, m_copy int, M_id int, v long, label int, `a.b` int, kind int"
SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    real = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    base = real[0][1].split()
    edited = [" ".join(w if rnd.random() > 0.01 else "changed" for w in base) for _ in range(6)]
    real += [(10_000 + i, t, "en", "src1") for i, t in enumerate(edited)]
    real += [(20_000, None, "en", None), (20_001, "", None, "src1"), (20_002, " \n ", "en", "src2"), (None, "a text of no id at all", "en", "src2"), (None, real[3][1], "en", None), (20_003, "word " * 30_000, "en", "src3")]
    real += [real[5], real[5], (real[6][0], "another text of this id, which is long enough", "en", "src9"), (20_004, real[7][1].replace(" ", "  "), "en", "src0")]
    return [(i, t, lang, s, len(t or ""), i, "mine", "own", "x", 3, 4, 5, 6, 7, 8) for i, t, lang, s in real]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def kept(docs, stage, spark):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    return Counter(tuple(r) for r in out.collect())


def test_quality(spark, docs, rows):
    scored = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    good = {r["doc_id"] for r in scored if r["predicted"] == 1}
    assert len(scored) == len(rows) and 0 < len(good)
    assert kept(docs, p.quality, spark) == Counter(r for r in rows if r[0] in good)


def test_exact(spark, docs, rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    got = kept(docs, p.exact, spark)
    assert sum(got.values()) == len(groups)
    for g in groups.values():
        least = min(g, key=lambda r: (r[0] is None, r[0] or 0))[0]
        assert sum(got[r] for r in set(g) if r[0] == least) == 1


def test_near(spark, docs, rows):
    real = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in real}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(real):
        for j, b in real[:n]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = Counter(r for r in rows if r[0] is None or find(r[0]) == r[0])
    assert len(want) < len(set(rows)) and kept(docs, p.near, spark) == want


def test_mix(spark, docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = Counter()
    for r in rows:
        words[r[3]] += size(r[1])
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    # targets by trial: the excess of full sources goes to the others by weight
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = 1.5 * sum(words.values()) - sum(2 * words[s] for s in full)
        target = {s: 2 * words[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        more = {s for s in order if s not in full and target[s] > 2 * words[s]}
        if not more:
            break
        full |= more
    got = kept(docs, p.mix, spark)
    of = Counter(rows)
    assert set(got) <= set(of) and all(n <= 2 * of[r] for r, n in got.items())
    largest = max(size(r[1]) for r in rows)
    for s in order:
        assert abs(sum(n * size(r[1]) for r, n in got.items() if r[3] == s) - target[s]) <= 2 * largest
    assert got == kept(docs.repartition(5), p.mix, spark)
    assert target == pytest.approx(dict(zip(order, mixing.allocate([words[s] for s in order], [weight[s] for s in order], 1.5 * sum(words.values()), 2), strict=True)))


def test_packing(spark, docs, rows):
    enc = encoder(vocabulary_path())
    got = Counter()
    for r in p.packing(spark, docs, SF).collect():
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    want = Counter()
    for r in rows:
        n = len(enc.encode(r[1] or "")) + 1
        want[r[0], n] += n
    assert got == want


def test_no_rows(spark, docs):
    for _, stage in p.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, SF), name)
    whole = p.run(spark, SF)
    key = lambda d: Counter((r["doc_id"], r["doc_tokens"], r["length"]) for r in d.collect())
    assert [n for n, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    totals = lambda c: {k: v for k, v in Counter({(i, t): 0 for i, t, _ in c}).items()}
    assert totals(key(whole)) == totals(key(docs)) and sum(r["length"] for r in whole.collect()) == sum(r["length"] for r in docs.collect())
