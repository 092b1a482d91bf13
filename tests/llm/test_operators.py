"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from secspark.llm import exact_dedup, media, mixing, near_dedup, packing, pii, quality, suffix_tree, token_counts, warc
from secspark.llm.common import components
from secspark.llm.tokens import encoder, vocabulary_path

WORDS = [a + b for a in "ka lo mi nu ter san vel".split() for b in "da ri pon x .".split()]
SCHEMA = "doc_id long, text string, source string, n long, keep_id long, h string, kind int"


def words(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    out = [None, "", " \t\n", "a", "A b", "ab  c\nd", "ab c d", "mail x.y@d.example.com, +1 (743) 555-3824 and 4111 1111 1111 1111 or 10.2.3.4", "1.2.3.4.5 999.1.1.1 4465758382889437 4465758382889437"]
    base = words(rnd, 300)
    for _ in range(25):
        copy = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 6, 15])):
            copy[rnd.randrange(300)] = rnd.choice(WORDS)
        out.append(" ".join(copy))
    out += [" ".join(words(rnd, rnd.choice([2, 5, 40, 200]))) for _ in range(30)]
    out += ["x" * 30_000, "é😀 " * 5_000, "7" * 20_000, " ".join(words(rnd, 20_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["b", "a", None, "c"][i % 4], i, i, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (10, "another text for one id", "a", 0, 0, "x", 1), (None, "no id", "a", 0, 0, "x", 1), (None, texts[12], "a", 0, 0, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def base_spans(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(x[-9:]) if len(x.lstrip("0")) < 9 else 999 for x in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(docs, empty):
    shown = pii.detect(docs, keep_text=True).select("t", F.expr(pii._listed("base")).alias("b"), F.expr(pii._listed("found")).alias("f")).collect()
    assert len(shown) == docs.count()
    for r in shown:
        assert [x for x in r["b"].split(",") if x] == base_spans(r["t"])
        assert set(r["b"].split(",")) <= set(r["f"].split(",")) or not r["b"]
    assert any(len(r["f"]) > len(r["b"]) for r in shown)
    assert pii.detect(empty).count() == 0
    red = [r["redacted"] for r in pii.redact(docs).collect()]
    assert any("[EMAIL]" in t and "@" not in t and "[PHONE]" in t for t in red)


def side(c):
    return 0 if not c else 1 if c in "\t\n\x0b\x0c\r " else 2 if c in "0123456789" else 3 if c.isascii() and c.isalpha() else 4


def brute_candidates(t):
    """(kind, generator, start, end, evidence, bins) of all generators' matches."""
    out = []
    for kind, gen, _, pattern in pii.GENERATORS:
        for m in regex.finditer(pattern, t):
            x, before, after = m[0], t[: m.start()], t[m.end() :]
            # the pieces beside a match end at its neighbours
            last = max([e for k, g, _, e, *_ in out if (k, g) == (kind, gen)], default=0)
            near = before[last:][-16:]
            follow = next((n.start() for n in [regex.search(pattern, t, pos=m.end())] if n), len(t))
            d = re.sub("[^0-9]", "", x)
            octets = all(len(o.lstrip("0")) < 4 and int(o or 256) <= 255 for o in re.split("[^0-9]+", x))
            check = 13 <= len(d) <= 19 and luhn(d)
            if kind == 1:
                y = re.search("[A-Za-z]{2,10}$", x) is not None
            elif kind == 2:
                y = octets
            elif kind == 3:
                y = check
            else:
                y = 8 <= len(d) <= 15 and d[0] != "0" if x[0] == "+" else re.match("[2-9][0-9]{2}[2-9]", d) is not None
            n = len(d)
            digits = [n == 0, n < 8, n < 10, n == 10, n < 13, n < 16, n == 16, n < 20, True].index(True)
            hint = 1 if re.search(r"(?i)(?:token|secret|key|hash|sha|id)\W*$", near) else 2 if re.search(r"(?i)(?:card|visa|phone|tel|call|mail|contact|addr)\W*$", near) else 0
            bins = (kind, digits, gen, side(near[-1:]), side(t[m.end() : min(follow, m.end() + 1)]), int(re.search("[0-9][^0-9.@]+[0-9]", x) is not None), int(x[0] in "+("), hint)
            out.append((kind, gen, m.start(), m.end(), y, bins))
    return out


def test_pii_added_spans_and_thresholds(spark):
    rnd = random.Random(12)
    kinds = ["a.b{n}@mail{n}.example.com", "jo{n} [at] site [dot] org", "x{n} (at) y.net", "10.{n}.2.3", "10[.]2[.]3[.]{n}", "4111 1111 1111 1111", "3782 822463 10005", "+1 743 555 38{n}", "(743) 555-38{n}", "143-155-38{n}", "call 743.555.38{n}", "999.1.1.{n}", "1234567890123456", "token 4111111111111111"]
    texts = [" ".join(rnd.choice([rnd.choice(WORDS), rnd.choice(kinds).format(n=rnd.randrange(10, 99))]) for _ in range(rnd.randrange(30))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = pii.candidates(d, keep_text=True).cache()
    halves, cells = {}, [Counter(), Counter()]
    for r in rows.collect():
        want = brute_candidates(r["t"])
        assert [(c["k"], c["g"], c["s"], c["e"], c["y"], tuple(c["f"])) for c in r["c"]] == want
        halves[r["t"]] = r["half"]
        for *_, y, bins in want:
            cells[r["half"]][bins, y] += 1
    got = pii.count_cells(rows)
    for half in (0, 1):
        assert {f: (p, n) for f, p, n in got[half]} == {f: (cells[half][f, True], cells[half][f, False]) for f, _ in cells[half]}
    trees = pii.fit_trees(got[0])
    score = lambda f: sum(pii.tree_value(t, f) for t in trees)
    floor = pii.thresholds(got[1], trees, 0.99)
    for kind in range(1, 5):  # the lowest score at which the other half's candidates from there up are precise
        best = None
        for s in sorted({score(f) for f, *_ in got[1] if f[0] == kind}, reverse=True):
            above = [(p, n) for f, p, n in got[1] if f[0] == kind and score(f) >= s - 1e-9]
            pos, neg = sum(p for p, _ in above), sum(n for _, n in above)
            if pos and pos / (pos + neg) >= 0.99:
                best = s
        assert (kind in floor) == (best is not None) and (best is None or abs(floor[kind] - best) < 1e-5)
    found = pii.detect(d, keep_text=True).select("t", F.expr(pii._listed("found")).alias("f")).collect()
    more = 0
    for r in found:
        base = [x.split(":") for x in base_spans(r["t"])]
        taken = [(pii.KINDS.index(k) + 1, int(s), int(e)) for k, s, e in base]
        end = 0
        for s, e, k in sorted((s, e, k) for k, g, s, e, _, f in brute_candidates(r["t"]) if g > 1 and k in floor and score(f) >= floor[k]):
            if s >= end and not any(b[1] < e and s < b[2] for b in taken[: len(base)]):
                taken.append((k, s, e))
                end, more = e, more + 1
        assert r["f"] == ",".join(f"{pii.KINDS[k - 1]}:{s}:{e}" for k, s, e in sorted(taken))
    assert more > 50


def test_pii_of_many_addresses_takes_time_in_proportion(spark):
    d = spark.createDataFrame([(1, "ab@cd.ef jo (at) x.org " * 50_000)], "doc_id long, text string")
    begun = time.perf_counter()
    r = pii.detect(d).select(F.size("base").alias("b"), F.size("found").alias("f"), F.element_at("base", -1)["s"].alias("s")).first()
    assert (r["b"], r["s"]) == (50_000, 23 * 49_999) and time.perf_counter() - begun < 60


def test_suffix_tree(docs, empty):
    out = suffix_tree.score_texts(docs, suffix_tree.fold(F.col("doc_id")) != 0, head=20).collect()
    tokens = [(i, t.encode().lower().split() + [b"\n"]) for i, t in collected(docs)]
    c = Counter()
    for i, w in tokens:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(w), sum(x in c for x in w), round(sum(np.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, w in tokens)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in out)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)
    assert {r["train_tokens"] for r in out} == {n} and all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert suffix_tree.score_texts(empty, F.lit(True)).count() == 0


def brute_tree(texts, depth, head):
    """log10 probability of each text, by dictionaries over the symbols themselves; contexts have the nearest word first."""
    seqs = [["<end>", *t, "<end>"] for t in texts]
    root = Counter(x for s in seqs for x in s[1:])
    total, kinds = sum(root.values()), len(root)
    follow = {}
    for s in seqs:
        for i in range(1, len(s)):
            for k in range(1, min(depth, i) + 1):
                follow.setdefault(tuple(s[i - k : i][::-1]), Counter())[s[i]] += 1
    # whole classes of the most frequent words
    sized = sorted(((math.floor(math.log2(c) * 16), w) for w, c in root.items() if w != "<end>"), reverse=True)
    common = {"<end>"}
    for size in sorted({x for x, _ in sized}, reverse=True):
        here = [w for x, w in sized if x == size]
        if len(common) - 1 + len(here) > head:
            break
        common |= set(here)

    def base(w):
        return (root.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))

    kept = {}
    for ctx, c in follow.items():
        n, entries = sum(c.values()), {w: x for w, x in c.items() if x >= 2}
        up = follow[ctx[:-1]] if len(ctx) > 1 else {w: x for w, x in root.items() if w in common}
        up_n = sum(up.values()) if len(ctx) > 1 else total
        known = {w: x for w, x in entries.items() if w in up}
        k, up_k = sum(known.values()), sum(up[w] for w in known)
        gain = sum(x * math.log(x / n / (up[w] / up_n)) for w, x in known.items()) + ((n - k) * math.log((n - k) / n / ((up_n - up_k) / up_n)) if n > k else 0)
        if entries and gain > 0.5 * len(entries) * math.log(n):
            kept[ctx] = (n, entries)

    def prob(before, w):
        p = base(w)
        for k in range(1, len(before) + 1):
            if before[:k] in kept:
                n, entries = kept[before[:k]]
                p = (entries.get(w, 0) + (len(entries) + n - sum(entries.values())) * p) / (n + len(entries))
        return p

    def score(t):
        s = ["<end>", *t, "<end>"]
        return sum(math.log10(prob(tuple(s[max(0, i - depth) : i][::-1]), s[i])) for i in range(1, len(s)))

    return score, prob, kept, list(root)


@pytest.mark.parametrize("depth,head,split", [(2, 1000, 10**6), (5, 1000, 10**6), (5, 12, 10**6), (5, 1000, 100), (4, 12, 20), (1, 1000, 50)])
def test_suffix_tree_scores(spark, docs, depth, head, split):
    rnd = random.Random(2)
    echoes = " ".join(f"{w} m m m m {w}" for w in rnd.choices(["ka", "lo", "mi"], k=300))  # the word five places back decides
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, echoes) for i in range(4)], "doc_id long, text string"))
    held = [(i, t.encode().lower().split()) for i, t in collected(docs)]
    score, prob, kept, vocabulary = brute_tree([w for i, w in held if i is not None and zlib.crc32(str(i).encode()) % 10], depth, head)
    assert {len(c) for c in kept} == set(range(1, depth + 1))
    for ctx in sorted(kept, key=str)[:40]:
        assert abs(sum(prob(ctx, w) for w in vocabulary) + prob(ctx, "never seen") - 1) < 1e-9
    got = suffix_tree.score_texts(docs, suffix_tree.fold(F.col("doc_id")) != 0, depth=depth, head=head, split=split).collect()
    want = sorted((i if i is not None else -1, score(w)) for i, w in held)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["score"]) for r in got)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-5, atol=1e-3)


@pytest.mark.parametrize("depth,numbered,split", [(5, 12, 10**6), (4, 12, 20), (2, 0, 100), (1, 12, 10)])
def test_suffix_tree_scores_depend_on_no_numbers(spark, docs, depth, numbered, split):
    """Words without a number count in the test of one-word contexts too."""
    held = [(i, t.encode().lower().split()) for i, t in collected(docs)]
    learnt = [w for i, w in held if i is not None and zlib.crc32(str(i).encode()) % 10]
    score, some = (brute_tree(learnt, depth, head)[0] for head in (10**6, numbered))
    got = suffix_tree.score_texts(docs, suffix_tree.fold(F.col("doc_id")) != 0, depth=depth, split=split, numbered=numbered).collect()
    want = sorted((i if i is not None else -1, score(w)) for i, w in held)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["score"]) for r in got)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-5, atol=1e-3)
    assert max(abs(score(w) - some(w)) for _, w in held) > 1


@pytest.mark.parametrize("split", [1_500_000, 50_000])  # the second deals the common context to several shards
def test_suffix_tree_keeps_rare_ngrams_of_large_corpora(spark, split):
    rows = [(i, "a " * 200_000) for i in range(20)] + [(20, "x y"), (21, "x y"), (22, "y x q"), (23, "x z"), (24, "x y")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_tree.score_texts(d, F.col("doc_id") < 24, split=split).collect()}
    assert got[24]["score"] > got[24]["base_score"] + 1 and got[24]["score"] == pytest.approx(got[20]["score"])


def test_suffix_tree_packs_windows():
    rnd = np.random.default_rng(1)
    columns = [rnd.integers(0, 1 << 24, 1000, dtype=np.int32) for _ in range(3)]
    rare, text = [rnd.integers(1, 1 << 48, 5, dtype=np.uint64), np.zeros(0, np.uint64), rnd.integers(1, 1 << 63, 7, dtype=np.uint64)], rnd.integers(0, 1 << 16, 1000)
    got = suffix_tree._unpack(suffix_tree._pack(columns, rare, text), 2)
    assert all((g == w).all() for g, w in zip([*got[0], got[1], got[2]], [*columns, text, np.concatenate(rare)], strict=True))


def test_token_counts(docs, empty):
    enc = encoder(vocabulary_path())
    got = token_counts.token_counts(docs).collect()
    want = Counter()
    for i, t in collected(docs):
        u = t
        for s, e, x in reversed(token_counts.find_edits(t)):
            u = u[:s] + x + u[e:]
        want[i, len(enc.encode(t)), len(enc.encode(u))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["edited_tokens"]) for r in got) == want
    assert token_counts.token_counts(empty).count() == 0


def test_both_tokenizer_libraries_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    enc, rnd = encoder(vocabulary_path()), random.Random(3)
    pool = "ab Z\t\n\r\x0b\x00\x85\xa0éßİſ文١Ⅷ½😀’'sdmt_-.,"
    for _ in range(2000):
        t = "".join(rnd.choice([*pool, "<|endoftext|>", "'ll", "  "]) for _ in range(rnd.randrange(25)))
        assert other.encode(t, add_special_tokens=False).ids == enc.encode(t)
        assert "".join(enc.pieces(t)) == t and sum(enc.counts(list(enc.pieces(t)))) == len(enc.encode(t))
    for t in ("<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "  <|endoftext|>  ", "<|endoftext|", "x<|endoftext|>\n<|endoftext|>y", "<|endoftext<|endoftext|>|>"):
        assert other.encode(t, add_special_tokens=False).ids == enc.encode(t)
    assert enc.encode("a <|endoftext|> b").count(50256) == 1


def test_edits_at_random():
    enc, rnd = encoder(vocabulary_path()), random.Random(1)
    letters = [*"ab '\n\t19.-é're  ll", "<|endoftext|>", "<|endof", "text|>"]

    def some(n):
        return "".join(rnd.choice(letters) for _ in range(n))

    for _ in range(400):
        t = some(rnd.choice([0, 1, 5, 40, 900]))
        tree, _ = token_counts.TokenTree.of(t, enc)
        for _ in range(4):
            s = rnd.randint(0, len(t))
            e = min(len(t), s + rnd.choice([0, 1, 3, 50, 400]))
            x = some(rnd.choice([0, 1, 2, 60]))
            tree.edit(s, e, x)
            t = t[:s] + x + t[e:]
            assert (tree.text(), tree.total) == (t, len(enc.encode(t)))
    with pytest.raises(ValueError):
        token_counts.apply_edits(token_counts.TokenTree.of("abcdef", enc)[0], [(0, 3, ""), (2, 4, "")])
    with pytest.raises(ValueError):
        token_counts.TokenTree.of("abc", enc)[0].edit(2, 4, "")


def test_edits_of_long_texts_take_time_in_proportion():
    begun = time.perf_counter()
    assert token_counts.find_edits("x" * 1_000_000 + " @") == [] and token_counts.find_edits("1" * 1_000_000) == [(0, 1_000_000, "<NUMBER>")]
    assert len(token_counts.find_edits("ab.c@d.ef " * 50_000)) == 50_000
    enc = encoder(vocabulary_path())
    tree, _ = token_counts.TokenTree.of("some words of a text " * 40_000, enc)
    assert max(tree.edit(k * 21, k * 21 + 4, "any") for k in range(0, 40_000, 100)) < 4 * token_counts.LEAF
    assert time.perf_counter() - begun < 20


def test_edits_from_a_table(spark, docs):
    enc = encoder(vocabulary_path())
    edits = spark.createDataFrame([(9, 0, 5, "new "), (9, 20, 20, "more"), (11, 3, 9, None), (37, 0, 0, "<|endoftext|>"), (99_999, 0, 1, "none"), (None, 0, 1, "x")], "doc_id long, start int, end int, text string")
    trees = token_counts.build_trees(docs)
    got = Counter((r["doc_id"], r["n_tokens"], r["n_edits"], r["edited_tokens"]) for r in token_counts.edited_counts(trees, edits).collect())
    want = Counter()
    for i, t in collected(docs):
        mine = sorted(((s, e, x or "") for j, s, e, x in [tuple(r) for r in edits.collect()] if j == i and i is not None), reverse=True)
        u = t
        for s, e, x in mine:
            u = u[:s] + x + u[e:]
        want[i, len(enc.encode(t)), len(mine), len(enc.encode(u))] += 1
    assert got == want
    outside = spark.createDataFrame([(3, 0, 50, "x")], "doc_id long, start int, end int, text string")
    with pytest.raises(Exception, match="outside the text"):
        token_counts.edited_counts(trees, outside).collect()


def grouped(docs):
    groups = {}
    for i, t in collected(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    return groups


@pytest.mark.parametrize("hasher", [exact_dedup.content_hash, lambda c: (F.length(c) % 3).cast("string")])  # the second collides all the time
def test_exact_dedup(docs, empty, hasher):
    got = exact_dedup.exact_duplicates(docs, hasher=hasher).collect()
    want = Counter()
    for t, ids in grouped(docs).items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in grouped(docs)})
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_warc(spark):
    html = ["<p>a</p>", None, "", "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n", "é" * 1000, "<p>a</p>", "<p>a</p>"]
    rows = [(i, f"http://h/{i}\r\nX: y", h, "extra") for i, h in enumerate(html)] + [(6, "u", "<p>a</p>", "z"), (None, None, "<p>a</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.archive_round_trip(pages).collect()
    want = Counter()
    for i, _, h, _ in rows:
        same = [j for j, _, g, _ in rows if (g or "") == (h or "") and j is not None]
        raw = (h or "").encode()
        first = i == max(same)
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else max(same)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(bytes(r["payload"]) == (html[r["page_id"]] or "").encode() for r in got if r["record_type"] == "response")
    big = {r["record_type"] for r in warc.archive_round_trip(pages, min_bytes=10_000).collect()}
    assert big == {"response"}
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_warc_files(spark, tmp_path):
    html = [f"<p>{i % 7}</p>" + "é" * i for i in range(40)] + ["same"] * 10 + ["x" * 17_000_000]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(45, "http://h/45", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", "url", F.col("html").cast("binary").alias("payload")).repartition(3)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    ids, refers = [], []
    assert len(files) == 3
    for f in files:
        with gzip.open(f) as g:
            data = g.read()
        at, first = 0, True
        while at < len(data):  # by hand: version, header, block, two line breaks
            head, _, rest = data[at:].partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.0\r\n") and rest[n : n + 4] == b"\r\n\r\n" and first == (fields["WARC-Type"] == "warcinfo")
            if first:
                info = fields["WARC-Record-ID"]
            else:
                assert fields["WARC-Warcinfo-ID"] == info and rest.startswith(b"HTTP/1.1 200 OK\r\n")
                refers += [fields["WARC-Refers-To"]] if fields["WARC-Type"] == "revisit" else []
            ids.append(fields["WARC-Record-ID"])
            at, first = at + len(head) + 4 + n + 4, False
        # a member for each record
        raw, members = f.read_bytes(), 0
        while raw:
            z = zlib.decompressobj(31)
            z.decompress(raw)
            raw, members = z.unused_data, members + 1
        assert members >= data.count(b"WARC/1.0\r\n")
    assert len(set(ids)) == len(ids) == len(rows) + 3 and set(refers) <= set(ids) and len(refers) == 10


def test_warc_of_others(spark, tmp_path):
    block = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<p>WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\xff</p>"
    def record(kind, extra, body):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:1>\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    digest = base64.b32encode(hashlib.sha1(block.split(b"\r\n\r\n", 1)[1]).digest())
    records = [record(b"warcinfo", b"", b"software: x"), record(b"request", b"Content-Type: application/http; msgtype=request\r\n", b"GET / HTTP/1.0\r\n\r\n"), record(b"response", b"WARC-Target-URI: http://a\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:" + digest + b"\r\n", block), record(b"resource", b"WARC-Target-URI: http://b\r\n", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.txt").write_text("not an archive")
    got = [(r["page_id"], r["url"], r["record_type"], bytes(r["payload"]), r["payload_digest"]) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(2 * [(None, "http://a", "response", block.split(b"\r\n\r\n", 1)[1], digest.decode()), (None, "http://b", "resource", b"", base64.b32encode(hashlib.sha1(b"").digest()).decode())])
    for bad, why in ((records[2].replace(b"Server", b"server").replace(b"abc", b"abd"), "damaged"), (records[2][:-20], "cut off")):
        (tmp_path / "a.warc.gz").write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match=why):
            warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_media(docs, empty):
    got = media.read_media(media.store_media(docs)).collect()
    want = Counter((i, hashlib.sha256(media.padded(t.encode())).hexdigest(), zlib.crc32(media.padded(t.encode())[-16:])) for i, t in collected(docs))
    assert Counter((r["doc_id"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    sources = {hashlib.sha256(media.padded(t.encode())).hexdigest(): media.padded(t.encode()) for _, t in collected(docs)}
    for r in media.store_tiles(media.store_media(docs)).collect():
        a = np.frombuffer(sources[r["payload_sha256"]], np.uint8).reshape(-1, 64, 3)
        stored = media.encode_bmp(a) if zlib.crc32(a.tobytes()) & 1 else media.encode_ppm(a)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        tile = np.load(io.BytesIO(r["tile"]))

        def area(h, w, a=a):
            """Means of areas as products with each area's share of each row and column."""
            share = lambda n, m: np.array([[max(0, min(i + 1, (k + 1) * n / m) - max(i, k * n / m)) for i in range(n)] for k in range(m)]) * m / n
            return np.einsum("hi,ijc,wj->hwc", share(a.shape[0], h), a.astype(float), share(64, w), optimize=True)

        assert tile.shape == (16, 16, 3) and tile.dtype == np.uint8 and np.abs(tile - area(16, 16)).max() <= 0.5 + 1e-6
        grey = area(8, 9).mean(axis=2)
        near_tie = np.abs(np.diff(grey, axis=1)) < 1e-9
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r["dhash"]), np.uint8)).reshape(8, 8).astype(bool)
        assert ((bits == (np.diff(grey, axis=1) > 0)) | near_tie).all()
    assert media.read_media(media.store_media(empty)).count() == 0


def test_picture_codecs():
    rnd = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (17, 64)):
        a = rnd.integers(0, 256, (h, w, 3), np.uint8)
        assert (media.decode(media.encode_bmp(a)) == a).all() and (media.decode(media.encode_ppm(a)) == a).all()
        assert (media.decode(media.encode_ppm(a[:, :, 0])) == a[:, :, 0]).all()
        big = np.kron(a, np.ones((6, 4, 1)))
        assert np.allclose(media.area_resize(big, h, w), a)
    assert np.allclose(media.area_resize(np.arange(12.0).reshape(3, 4), 2, 2).ravel(), [(0 + 1 + (4 + 5) / 2) / 3, (2 + 3 + (6 + 7) / 2) / 3, ((4 + 5) / 2 + 8 + 9) / 3, ((6 + 7) / 2 + 10 + 11) / 3])
    for bad in (b"BM", b"P7 1 1", media.encode_bmp(rnd.integers(0, 9, (4, 4, 3), np.uint8))[:-5], media.encode_ppm(rnd.integers(0, 9, (4, 4, 3), np.uint8))[:-5]):
        with pytest.raises((ValueError, struct.error)):
            media.decode(bad)


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs, shards=4, rows_per_block=5).collect()
    assert len(got) == docs.count()
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len((r["text"] or "").encode().split())
    total = sum(size.values())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    share = mixing.allocate([size[s] for s in order], [3, 1, 2, 3], 1.5 * total, 2)
    largest = max(r["size"] for r in got)
    for s, t in zip(order, share, strict=True):
        rows = [r for r in got if r["source"] == s]
        assert {round(r["target"], 6) for r in rows} == {round(t, 6)} and {r["source_size"] for r in rows} == {size[s]}
        assert abs(sum(r["taken"] for r in rows) - t) <= largest and t <= 2 * size[s]
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) and (r["shard"] is None or 0 <= r["shard"] < 4) for r in rows)
    again = mixing.mix_sources(docs.repartition(5), shards=4, rows_per_block=5).collect()
    assert Counter((r["doc_id"], r["taken"], r["shard"]) for r in again) == Counter((r["doc_id"], r["taken"], r["shard"]) for r in got)
    q = mixing.split_quotas([7, 0, 30], 5, 1)
    assert q.sum(axis=1).tolist() == [7, 0, 30] and max(q.sum(axis=0)) - min(q.sum(axis=0)) <= 2
    assert mixing.allocate([10, 100], [3, 1], 100, 2) == [20, 80]
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_mixed_rows_leave_by_shard(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(words(rnd, rnd.choice([1, 5, 30]))), ["a", "b", None][i % 3]) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {s: [] for s in range(4)}
    for r in mixing.mix_sources(d, shards=4, rows_per_block=5).collect():
        for c in range(r["copies"]):
            want[(r["shard"] + 2 * c) % 4].append(r["doc_id"])
    got = [r["doc_id"] for r in mixing.mixed_rows(d, shards=4, rows_per_block=5).collect()]
    assert Counter(got) == Counter(x for w in want.values() for x in w) and max(Counter(got).values()) == 2
    assert all(a != b for a, b in zip(got, got[1:], strict=False))
    at = 0
    while at < len(got):  # shard after shard, none in the order of the table
        block = next(s for s, w in want.items() if w and Counter(got[at : at + len(w)]) == Counter(w))
        part = got[at : at + len(want[block])]
        assert part != sorted(part)
        at += len(want.pop(block))
    assert not any(want.values())


def test_mixed_rows_of_large_shards(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, " ".join(words(rnd, rnd.choice([1, 5, 30]))), ["a", "b", None][i % 3]) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = mixing.mixed_rows(d, shards=4, rows_per_block=5).collect()
    monkeypatch.setattr(mixing, "PART", 50)
    assert Counter(mixing.mixed_rows(d, shards=4, rows_per_block=5).collect()) == Counter(whole)


def test_packing(docs, empty):
    enc = encoder(vocabulary_path())
    got = packing.pack(docs).collect()
    want = Counter((i, len(enc.encode(t)) + 1) for i, t in collected(docs))
    ids = {}
    for i, t in collected(docs):
        ids.setdefault(i, []).append(enc.encode(t) + [0])
    covered, seqs = Counter(), {}
    for r in got:
        assert any(zlib.crc32(struct.pack(f"<{r['length']}I", *d[r["start"] : r["start"] + r["length"]])) == r["ids_crc32"] for d in ids[r["doc_id"]] if len(d) == r["doc_tokens"])
        covered[r["doc_id"], r["doc_tokens"]] += r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == Counter({k: k[1] * n for k, n in want.items()})
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.fill(packing.pack(docs)).first()["padding"] < 0.05 and packing.pack(empty).count() == 0
    assert all(sum(packing.cut(n)) == n and min(packing.cut(n)) > 0 for n in range(1, 3000))


@pytest.mark.parametrize("k, per_cent", [(3, 85), (5, 80)])
def test_near_dedup(docs, empty, k, per_cent):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    rows = [(i, shingles(t)) for i, t in collected(docs)]
    real = [(i, s) for i, s in rows if i is not None]
    root = {i: i for i, _ in real}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(real):
        for j, b in real[:n]:
            both = len(a & b)
            if both and 100 * both >= per_cent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(docs, k, per_cent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(s), None if i is None else find(i)) for i, s in rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_of_many_edited_copies(spark):
    """A large group whose members are linked to some others only: blocks, not stars, have to find all."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(300):
        t = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 6])):
            del t[rnd.randrange(len(t))]
        texts.append(" ".join(t))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(300):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(d, 3, 85).collect()}
    assert got == {i: find(i) for i in range(300)}


def test_estimates():
    pool = near_dedup.mix(np.arange(3000, dtype=np.uint64))
    for n in (12, 90, 900):
        a, b = np.sort(pool[:n]), np.sort(pool[n // 10 : n // 10 + n])
        e = [near_dedup.estimate((near_dedup.registers(near_dedup.sketch(x)) == near_dedup.registers(near_dedup.sketch(y))).sum()) for x, y in [(a, b)]]
        true = (n - n // 10) / (n + n // 10)
        assert abs(e[0] - true) < 6 * np.sqrt(true * (1 - true) / 128) + 0.02


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}


def brute_statistics(t):
    """``quality.STATS`` of one text, by plain Python."""
    raw = t.encode()
    size = max(1, len(raw))
    words = raw.lower().split()
    some = max(1, len(words))
    lines, now = [], []
    for i, line in enumerate(raw.lower().split(b"\n")):
        now = line.split()
        if now:
            lines.append(tuple(sorted(now)))
    pairs = list(zip(words, words[1:], strict=False))
    return [sum(raw.count(bytes([b])) for b in set(c)) / size for c in quality.CLASSES.values()] + [math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / some, sum(len(w) > 20 for w in words) / some, len(set(words)) / some, sum(a == b for a, b in pairs) / some, len(set(pairs)) / max(1, len(pairs)), len(set(lines)) / max(1, len(lines))]


def test_quality_against_a_direct_solution(spark):
    rnd = random.Random(18)
    rows = []
    for i in range(900):
        good = rnd.random() < 0.6
        w = words(rnd, rnd.randrange(1, 90))
        rows.append((i, "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)) if good else " ".join(rnd.choice([x.upper() + "!", x, "buy buy"]) for x in w), int(good != (rnd.random() < 0.05))))
    rows += [(900, "", 0), (901, None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(d.drop("quality"), d).collect()}
    x = np.array([brute_statistics(t or "") for _, t, _ in rows])
    y = np.array([q for *_, q in rows], float)
    rest = np.array([zlib.crc32(str(i).encode()) % 4 for i, *_ in rows])
    train, cal = (rest == 0) | (rest == 1), rest == 3
    learn = train | cal
    fourier = quality.Fourier(x[learn].mean(axis=0), x[learn].std(axis=0))
    z = np.stack([np.append(np.sqrt(2 / len(fourier.b)) * np.cos(v @ fourier.w + fourier.b), 1) for v in np.clip((x - fourier.mean) / fourier.std, -8, 8)])
    # ridge as least squares with extra rows
    k = z.shape[1]
    lam = 1e-3 * train.sum() / k
    beta = np.linalg.lstsq(np.vstack([z[train], np.sqrt(lam) * np.eye(k)]), np.append(y[train], np.zeros(k)), rcond=None)[0]
    raw = (z @ beta).clip(-1, 2)
    bins = {}
    for s, t in zip(raw[cal], y[cal], strict=True):
        bins.setdefault(math.floor((s + 1) / 3 * quality.BINS + 0.5), []).append((s, t))
    px = [-1.0] + [np.mean([s for s, _ in b]) for _, b in sorted(bins.items())] + [2.0]
    py, pw = [0.0] + [np.mean([t for _, t in b]) for _, b in sorted(bins.items())] + [1.0], [0.5] + [float(len(b)) for _, b in sorted(bins.items())] + [0.5]
    # isotonic regression as the max of min of means
    mean = lambda a, b: np.average(py[a : b + 1], weights=pw[a : b + 1])
    iso = [max(min(mean(a, b) for b in range(j, len(px))) for a in range(j + 1)) for j in range(len(px))]
    knots = []
    for v in dict.fromkeys(np.round(iso, 12)):
        i = [j for j in range(len(px)) if round(iso[j], 12) == v]
        knots.append((np.average([px[j] for j in i], weights=[pw[j] for j in i]), v))
    want = np.clip(np.interp(raw, *map(list, zip(*knots, strict=True))) * 0.999 + (raw + 1) / 3 * 0.001, 0, 1)
    assert np.allclose([got[i] for i, *_ in rows], want, atol=2e-3)


def test_quality(spark, docs, empty):
    rnd = random.Random(8)
    rows = [(i, " ".join(words(rnd, 60)) if i % 3 else " ".join(w.upper() + "!!" for w in words(rnd, 60))) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    got = quality.quality_scores(d, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 3 != 0) for r in held) >= 0.97 * len(held)
    odd = quality.quality_scores(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(d, labels.where("quality = 1")).collect()} == {1.0}
    x, y = quality.pool_adjacent(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]
