"""Resampling, vector codes and MinHash against brute force and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import odd
import pyarrow as pa
import pytest
from test_search_and_sets import components

from millrace.llm import minhash, resampling, vector_codes
from millrace.llm.shingles import shingle_sets

IN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, shortest, longest):
    w = IN_WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [" ".join(w[i : i + k]) for k in range(shortest, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("shortest, longest", [(1, 2), (1, 1), (2, 4), (3, 3)])
def test_suffix_arrays_enumerate_every_n_gram(shortest, longest):
    rng = random.Random(longest)
    texts = [" ".join(rng.choice(["a", "B", "the", "été", "x-y", "9"]) for _ in range(n)) for n in (0, 1, 2, 3, 40, 200)] + [None, "", "--", "a a a a a a"]
    for column in (pa.array(texts), pa.chunked_array([pa.array(["skip me", *texts])]).combine_chunks().slice(1)):
        row, bucket, n_words = resampling.bucket_ids(column, shortest, longest, 97)
        for i, t in enumerate(texts):
            n, g = grams(t, shortest, longest)
            assert n_words[i] == n
            assert Counter(bucket[row == i].tolist()) == Counter(zlib.crc32(x.encode()) % 97 for x in g)


def resampled(rows, target, percent=25, least=20, buckets=10_000):
    """Per row: (doc_id, n_features, weight, score), and the sorted drawn scores."""
    count = lambda texts: Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t, 1, 2)[1])
    s, t = count(r[1] for r in rows), count(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000.0 * math.log(((t[b] + 1.0) * (n_s + buckets)) / ((s[b] + 1.0) * (n_t + buckets))))
    out, drawable = [], []
    for d, text in rows:
        n_words, g = grams(text, 1, 2)
        weight = sum(gain(zlib.crc32(x.encode()) % buckets) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))
        out.append((d, len(g), weight, score))
        if n_words >= least:
            drawable.append((-score, d is None, d or 0, len(g)))
    return out, sorted(drawable)[: percent * len(drawable) // 100]


def test_resampling_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = [(i if i % 7 else None, " ".join(rng.choices(words, k=rng.choice([5, 19, 20, 60])))) for i in range(80)]
    rows += [(r[0], r[1]) for r in odd.ROWS] + rows[:5]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], odd.SCHEMA).selectExpr("*", "1 as bucket", "2 as score", "3 as rank", "4 as level", "5 as n")
    target = ["w1 w2 w3 w4 " * 30, None, "w1 été"]
    got = [tuple(r) for r in resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()]
    want, drawn = resampled(rows, target)
    assert sorted(map(repr, (g[:4] for g in got))) == sorted(map(repr, want))
    ranked = sorted((g for g in got if g[4] is not None), key=lambda g: g[4])
    assert [g[4] for g in ranked] == list(range(1, len(drawn) + 1))
    assert [(-g[3], g[0] is None, g[0] or 0, g[1]) for g in ranked] == drawn


def test_resampling_of_empty_tables(spark):
    none, target = odd.none(spark), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, target).collect() == []
    assert resampling.resample(odd.documents(spark), target.limit(0)).count() == len(odd.ROWS)


@pytest.mark.parametrize("width, peak", [(8, 4096), (7, 50), (1, 3), (3, 1 << 40), (0, 5)])
def test_nearest_entry_is_exact(width, peak):
    rng = np.random.default_rng(width)
    x, e = rng.integers(-peak, peak, (200, width)), rng.integers(-peak, peak, (16, width))
    e[5], x[:16] = e[3], e
    index, d = vector_codes.nearest(x, e)
    for row, i, got in zip(x.tolist(), index, d, strict=True):
        want = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in e.tolist()]
        assert (int(got), int(i)) == (min(want), want.index(min(want)))


def coded(vectors, parts, entries, rounds):
    """Codebooks and (code, error) of integer vectors, in plain loops."""
    width = len(vectors[0][1])
    cuts = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    first = {}
    for i, v in sorted((r for r in vectors if r[0] is not None)):
        first.setdefault(i, v)
    books = [[v[a:b] for _, v in sorted(first.items())[:entries]] for a, b in cuts]
    near = lambda v, book: min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            of = [[] for _ in books[p]]
            for _, v in vectors:
                of[near(v[a:b], books[p])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(of, books[p], strict=True)]
    best = [[near(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)] for _, v in vectors]
    return books, [("".join(f"{i:02x}" for _, i in row), sum(d for d, _ in row)) for row in best]


@pytest.mark.parametrize("parts", [8, 3])
def test_codes_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, *range(40)]), [rng.gauss(0, 1) for _ in range(16)], rng.choice([None, 1, 2])) for _ in range(120)]
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (2, [1.0] * 15 + [None], 1), (3, [nan] * 16, None), (4, [inf] * 16, 2), (5, [1.0], 2), (6, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as code", "2 as id", "3 as v", "4 as of", "5 as error")
    whole = [(i, [math.floor(4096 * x) for x in v]) for i, v, _ in rows]
    books, want = coded(whole, parts, 16, 6)
    label_error = Counter()
    for (_, _, label), (_, error) in zip(rows, want, strict=True):
        label_error[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = vector_codes.compress(df, parts=parts).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, code, error, label_error[label], sha)) for (i, _, label), (code, error) in zip(rows, want, strict=True))


def test_codes_of_few_large_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(None, [1.0] * 8, "a")], schema)).collect() == []
    rows = [(1, [1e30] * 8, "a"), (2, [-1e30] * 8, None), (2, [-1e30] * 8, None), (3, [1e10] * 8, None)]
    got = vector_codes.compress(spark.createDataFrame(rows, schema), rounds=2).orderBy("vec_id").collect()
    assert [r["code"] for r in got] == ["00" * 8, "01" * 8, "01" * 8, "02" * 8] and {r["error"] for r in got} == {0}


@pytest.mark.parametrize("pairs", [256, 0])
def test_minhash_of_families_equals_all_pairs(spark, monkeypatch, pairs):
    """Also where every open bucket goes the exact way."""
    monkeypatch.setattr(minhash, "PAIRED", pairs)
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(5000)}"

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [word()], [word(), w[at]]])
        return w

    passage, rows = [word() for _ in range(60)], []
    for family in range(6):
        base = [word() for _ in range(120)] + passage * (family % 2)
        kin = [base] * (family % 3)
        for _ in range(14):
            near = edited(base, rng.randrange(5))
            kin += [near, *(edited(near, rng.randrange(3)) for _ in range(rng.randrange(3)))]
        kin += [base[:at] for at in range(80, 120, 6)]
        rows += [" ".join(w) for w in kin]
    rows = [(i if i % 9 else None if i % 2 else 5, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_components(df, 5, 85).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == components(rows, 5, 85)
    assert all(r["kept"] == (None if r["doc_id"] is None else r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_odd_rows(spark):
    got = minhash.near_components(odd.documents(spark)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == components([(r[0], r[1]) for r in odd.ROWS], 5, 80)
    assert minhash.near_components(odd.none(spark)).collect() == []


def test_posterior_keeps_similar_pairs():
    """Pairs at the threshold stay, unrelated ones go after one batch."""
    least = minhash.least_matches(85)
    assert all(least[n] <= round(0.85 * n) for n in range(1, len(least))) and least[minhash.BATCH] > 5
    w = [f"v{i}" for i in range(4000)]
    texts = [" ".join(w), " ".join(w[320:] + [f"x{i}" for i in range(320)]), " ".join(f"y{i}" for i in range(4000))]
    s = shingle_sets(pa.array(texts), 5)
    a = minhash.signatures(s, np.arange(3))
    assert minhash.passing(a[[0, 0, 0]], a[[0, 1, 2]], 85).tolist() == [0, 1]
    agree = (a[0] == a[1]).mean()
    assert abs(agree - 0.852) < 0.08


def test_exchanged_texts_lose_no_link_at_the_threshold(spark):
    """Many pairs whose similarity is just 0.85: all of them are found."""
    rows = []
    for p in range(60):
        w = [f"p{p}w{i}" for i in range(304)]
        rows += [(2 * p, " ".join(w)), (2 * p + 1, " ".join(w[:280] + [f"q{p}w{i}" for i in range(24)]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 85).collect()}
    assert got == {i: i - i % 2 for i in range(120)}
