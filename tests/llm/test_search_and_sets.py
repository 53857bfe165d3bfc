"""Jaccard join, fingerprints, top-k and mixing against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import odd
import pytest
from compare import differences, tables
from conftest import DATA, SMALL

from millrace.llm import fingerprints, jaccard_join, mixing, queries, topk
from millrace.llm.common import WORD

WORDS = re.compile(WORD)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_equal_sql(spark, name):
    at = SMALL if name in ("op3_jaccard_join", "op13_minhash") else DATA
    assert differences(queries.QUERIES[name](spark, at), queries.ORACLE[name], tables(at)) is None


def shingles(text, size):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows, size, percent):
    """{row number: (set size, least doc_id of its component)} by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    name = lambda i: min((d for d in least[top(i)] if d is not None), default=None)
    return sorted(((rows[i][0], len(sets[i]), name(i) if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("size, percent, seed", [(4, 85, 1), (5, 80, 2), (2, 50, 3), (1, 95, 4)])
def test_join_equals_all_pairs(spark, size, percent, seed):
    rng = random.Random(seed)
    rows = []
    for family in range(25):
        base = [f"w{rng.randrange(60 if family % 3 else 8)}" for _ in range(rng.choice([1, 3, 4, 9, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 20])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
            rows.append((len(rows) + 1, rng.choice([" ", "\n", "  "]).join(w + ["end"] * rng.choice([0, 0, 2]))))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(df, size, percent).collect()), key=repr) == components(rows, size, percent)


def test_join_through_matrix_alone(spark, monkeypatch):
    """Without hub rounds the matrix finds every link."""
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", 0)
    test_join_equals_all_pairs(spark, 4, 85, 5)


def test_join_of_families(spark):
    """Bases with copies, copies of copies and passages that many share: what hubs and groups are for."""
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(5000)}"

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [word()], [word(), w[at]]])
        return w

    passage, rows = [word() for _ in range(60)], []
    for family in range(6):
        base = [word() for _ in range(100)] + passage * (family % 2)
        kin = [base] * (family % 3)
        for _ in range(14):
            near = edited(base, rng.randrange(9))
            kin += [near, *(edited(near, rng.randrange(4)) for _ in range(rng.randrange(3)))]
        kin += [base[:at] for at in range(60, 100, 8)]
        rows += [" ".join(w) for w in kin]
    rows = [(i if i % 9 else None if i % 2 else 5, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(df, 4, 85).collect()), key=repr) == components(rows, 4, 85)


T = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.mark.parametrize("rows", [
    [(None, T), (9, T + " more")],
    [(1, T), (2, T + " more"), (2, "quite another text of the same id as its near copy")],
    [(None, T), (None, T), (None, "something else entirely that is not near to any of the others")],
])
def test_join_of_rows_without_an_id_of_their_own(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(df, 4, 85).collect()), key=repr) == components(rows, 4, 85)


def test_join_odd_rows(spark):
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(odd.documents(spark)).collect()), key=repr)
    assert got == components([(r[0], r[1]) for r in odd.ROWS], 5, 80)
    assert jaccard_join.jaccard_components(odd.none(spark)).collect() == []


def edited(rows):
    """Per row of (doc_id, text) in descending doc_id, its own text, edited text and next text."""
    order = sorted(rows, key=lambda r: -r[0])
    for (d, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        yield d, t, t[: len(t) - len(t) // 2] + u[: len(t) // 2], u


def simhash(text):
    """Bit by bit, from the term hashes."""
    import pyarrow as pa

    from millrace.llm.shingles import _BASE, mix, words_of

    h = words_of(pa.array([text])).hash
    terms = [(int(x), 1) for x in mix(h)] + [(int(x), 2) for x in mix(h[:-1] * np.uint64(_BASE) + h[1:])]
    return sum(1 << b for b in range(64) if sum(w if x >> b & 1 else -w for x, w in terms) > 0)


def test_fingerprints_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for n, (d, t, e, u) in enumerate(edited(rows)):
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        if n % 10 == 0:
            a, b, c = simhash(t), simhash(e), simhash(u)
            assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{a:016x}", f"{b:016x}")
            assert (r["near_edited"], r["near_next"]) == (1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64)


def test_fingerprints_odd_rows(spark):
    got = fingerprints.fingerprint_edits(odd.documents(spark)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(r[0]), len(r[1] or "")) for r in odd.ROWS)
    assert all(r["fingerprint"] == "0" * 16 for r in got if r["doc_id"] in (3, 4, 5))
    assert fingerprints.fingerprint_edits(odd.none(spark)).collect() == []
    one = fingerprints.fingerprint_edits(odd.documents(spark, [(5, "abcd", "en", "a", 4)])).collect()
    assert [r["edited_sha256"] for r in one] == [hashlib.sha256(b"abab").hexdigest()]


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_radius_search_equals_all_pairs(spark, radius):
    rng = random.Random(radius)
    xs = [rng.getrandbits(64) for _ in range(60)]
    for x in list(xs):
        for _ in range(3):
            xs.append(x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in xs + xs[:5]] + [(None,)], "fingerprint long")
    got = {tuple(r) for r in fingerprints.near_fingerprints(df, radius).collect()}
    want = {(*sorted((signed(a), signed(b))), (a ^ b).bit_count()) for a, b in combinations(set(xs), 2) if (a ^ b).bit_count() <= radius}
    assert got == want


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [0.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-0.001, 0.1]), (None, [1.0, 1.0]), (2, [1.0, 0.5]), (8, []), (9, [1.0, 0.5, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.integer_vectors(df)
    assert [tuple(r) for r in v.where("id = 7").collect()] == [(7, [-1, 25])]
    got = [tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0"), 3, query_rows=2, block_rows=2).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 1, 81920), (0, 2, 2, 81920), (0, 3, 2, 81920)]
    assert [g[2] for g in got[3:]] == [0, 1, 2]
    assert topk.top_k(v.limit(0), v.limit(0)).collect() == []
    one = v.where("id = 0")
    assert topk.top_k(one, one).collect() == []


def best_by_hand(rows, queries, k):
    """Ranked inner products in whole numbers of any size."""
    low, high = -(2**63) + 1, 2**63 - 1
    out = []
    for q, a in queries:
        scores = sorted((-max(low, min(high, sum(x * y for x, y in zip(a, b, strict=False)))), c) for c, b in rows if c != q)
        out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("density, most", [(1.0, 300), (0.15, 300), (0.5, 2**62)])
def test_topk_equals_brute_force(spark, density, most):
    rng = random.Random(most)
    rows = [(i, [rng.randint(-most, most) if rng.random() < density else 0 for _ in range(rng.choice([7, 9]))]) for i in range(300)]
    schema = "id long, v array<long>, score long, cell int, rank int"  # names that the operator uses
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    queries = [r for r in rows if r[0] % 50 == 0]
    got = [tuple(r) for r in topk.top_k(df, df.where("id % 50 = 0"), 5, query_rows=4, block_rows=32).orderBy("query_id", "rank").collect()]
    assert got == best_by_hand(rows, queries, 5)


def test_blocks_are_dealt_evenly(spark):
    df = spark.range(51200).repartition(4).selectExpr("id", "array(id % 7, 1L) AS v")
    cells = [r["cell"] for r in topk._blocks(df, 800, 16).select("cell").collect()]
    assert len(set(cells)) == 16 and max(cells.count(c) for c in set(cells)) <= 2 * len(cells) / 16


def test_blocks_and_cells_are_bounded(spark):
    wide = spark.range(600).selectExpr("id", "transform(sequence(1, 2048), x -> x % 100 - id) AS v").coalesce(1)
    blocks = topk._blocks(wide, 4096, 3).collect()
    assert sorted(i for b in blocks for i in np.frombuffer(b["ids"], np.int64)) == list(range(600))
    assert max(len(b["rows"]) + len(b["weights"]) for b in blocks) <= 4 << 18
    vectors = spark.range(1_000_000).selectExpr("id", "array(id, 1L) AS v")
    across, down = topk._grid(vectors, vectors.where("id % 50 = 0"), 64, 4096)
    assert across * 8 * 4096 >= 1_000_000 and down * 256 * 64 >= 20_000
    assert down <= 2 and across <= 64 * spark.sparkContext.defaultParallelism  # copies of candidates, of queries


@pytest.mark.parametrize("most", [1, 300, 2**30, 2**62])
def test_best_of_several_blocks(spark, most):
    rng = random.Random(most)
    rows = [(i, [rng.randint(-most, most) if rng.random() < share else 0 for share in (1, 1, 0.5, 0.1, 0.1)]) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # ties over the blocks
    df = spark.createDataFrame(rows, "id long, v array<long>").coalesce(1)
    blocks = [topk.Block(*b[1:]) for b in topk._blocks(df, 32, 1).collect()]
    rng.shuffle(blocks)
    got = [x for b in blocks for x in zip(*(y.tolist() for y in topk.best_of(b, blocks, 5)), strict=True)]
    assert sorted(got) == sorted((q, c, s) for q, _, c, s in best_by_hand(rows, rows, 5))


def test_topk_odd_queries(spark):
    rows = [(1, [5]), (1, [3]), (2, [1]), (3, [2])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    assert [tuple(r) for r in topk.top_k(df, df.where("id = 1")).orderBy("rank").collect()] == [(1, 1, 3, 6), (1, 2, 2, 3)]
    far = spark.createDataFrame([(1, [3.0e38, -3.0e38])], "vec_id long, embedding array<float>")
    assert topk.integer_vectors(far).head()["v"] == [9200000000000000000, -9200000000000000000]


def test_mix_reaches_targets(spark):
    got = queries.op1_mix(spark, DATA).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    source = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").toPandas().set_index("doc_id").source
    by_source = got.groupby(got.doc_id.map(source)).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert by_source.target.sum() == pytest.approx(got["size"].sum(), rel=1e-6)
    assert (abs(by_source.taken - by_source.target) <= 0.01 * by_source.target + by_source.most / 2).all()
    again = queries.op1_mix(spark, DATA).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_mix_odd_rows(spark):
    got = mixing.mix(odd.documents(spark)).collect()
    assert len(got) == len(odd.ROWS)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0) and all(r["copies"] <= 3 for r in got)
    assert mixing.mix(odd.none(spark)).collect() == []
    empty = mixing.mix(odd.documents(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in empty] == [(0, 0, 0.0)] * 2
