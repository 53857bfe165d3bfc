"""Segmentation against all paths, and rights before the cut against trimming every row."""

import math
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from millrace.functions.text import audit_action, tokens
from millrace.operators import acl, raptor, retrieval, segmentation
from millrace.plans import compiler
from millrace.plans.queries import QUERIES


def every_path(run, longest):
    if not run:
        yield []
    for n in range(1, min(longest, len(run)) + 1):
        for rest in every_path(run[n:], longest):
            yield [run[:n], *rest]


def test_paths_are_the_most_probable_of_all(spark):
    rng = random.Random(5)
    letters = "天地人山水火"
    words = {c: rng.randrange(1, 50) for c in letters[:5]}
    for n in (2, 2, 2, 3, 3, 4, 4):
        words["".join(rng.choices(letters, k=n))] = rng.randrange(5, 60)
    total = sum(words.values())
    runs = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 10))) for _ in range(60)})
    dictionary = spark.createDataFrame([(w, n, math.log(n) - math.log(total)) for w, n in words.items()], "word string, n long, log_p double")
    got = {r["run"]: r["words"] for r in segmentation.paths(spark.createDataFrame([(r,) for r in runs], "run string"), dictionary).collect()}
    assert set(got) == set(runs)
    p = lambda w: math.log(words.get(w, 1 if len(w) == 1 else 0) or 1e-300) - math.log(total)
    for run in runs:
        cover, at = [], 0
        for i, w in enumerate(got[run]):  # shorter words stand before the word that holds them
            later = got[run][i + 1 :]
            if any(w in x and len(x) > len(w) >= 2 for x in later[:6]) and not run.startswith(w, at):
                continue
            cover.append(w)
        best = max(sum(map(p, path)) for path in every_path(run, 4))
        whole = [x for x in every_path(run, 4) if abs(sum(map(p, x)) - best) < 1e-9]
        expanded = []
        for path in whole:
            out = []
            for w in path:
                for n in range(2, len(w)):
                    out += [w[j : j + n] for j in range(len(w) - n + 1) if w[j : j + n] in words]
                out.append(w)
            expanded.append(out)
        assert got[run] in expanded


def test_a_planted_dictionary_is_learned_and_cut(spark):
    rng = random.Random(9)
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    lexicon = sorted({"".join(rng.sample(alphabet, rng.choice([2, 2, 3]))) for _ in range(120)})
    lines = [[rng.choice(lexicon) for _ in range(rng.randrange(1, 12))] for _ in range(800)]
    runs = spark.createDataFrame([("".join(x),) for x in lines], "text string")
    words = segmentation.learn(segmentation.han_runs(runs))
    found = {r["word"] for r in words.where(F.length("word") > 1).collect()}
    assert len(found & set(lexicon)) > 0.95 * len(lexicon)
    got = {r["run"]: r["words"] for r in segmentation.paths(segmentation.han_runs(runs), words).collect()}
    right = sum(w in got["".join(x)] for x in lines for w in x)
    assert right > 0.95 * sum(map(len, lines))


def test_texts_with_spaces_stay_as_they_are(spark):
    texts = [None, "", "  ", "Two words", "Été\tà la\n plage", "x中文字y Z", "中文字", "中文，字", "ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = spark.createDataFrame([("中文", 5, -0.5), ("字", 2, -1.0)], "word string, n long, log_p double")
    got = {r["id"]: r["words"] for r in segmentation.segmented(df, words, "id").collect()}
    plain = {r["id"]: r["w"] for r in df.select("id", tokens(F.col("text")).alias("w")).collect()}
    assert {i: got[i] for i in (0, 1, 2, 3, 4, 8)} == {i: plain[i] for i in (0, 1, 2, 3, 4, 8)}
    assert got[5] == ["x", "中文", "字", "y", "z"] and got[6] == ["中文", "字"] and got[7] == ["中文", "，", "字"]
    assert segmentation.learn(segmentation.han_runs(df.where("id < 5"))).count() == 0
    assert segmentation.segmented(df.where("id < 5"), words.limit(0), "id").count() == 5


def test_segmented_search_equals_bm25_of_its_words(spark):
    """Over texts without Han characters it is the plain search."""
    hits = QUERIES["r5_bm25_segmented"](spark, SMALL).collect()
    assert {r["query_id"] for r in hits} == {r["item_id"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()} and all(r["rank"] <= 5 for r in hits)


ACL = "chunk_id long, document_id long, chunk_index int, kb_id string, text string, sensitivity_level string, acl_users array<string>, acl_roles array<string>, acl_groups array<string>"
USERS = "user_id string, roles array<string>, groups array<string>, clearance string, is_admin boolean"


def secured(spark, seed, n=120):
    rng = random.Random(seed)
    some = lambda xs: rng.choice([None, [], [rng.choice(xs)], rng.sample(xs, 2), [None]])
    rows = [(i, i, 0, "kb", " ".join(rng.choices(["one", "two", "three", "four", "five"], k=rng.randrange(6))), rng.choice(["public", "PUBLIC", "restricted", "internal", None, "x"]), some(["u1", "u2", "u3"]), some(["r1", "r2"]), some(["g1", "g2"])) for i in range(n)]
    users = [("u0", [], [], "public", True), ("u1", ["r1"], [], "restricted", False), ("u2", None, ["g2", None], "Restricted", None), ("u3", ["r2"], ["g1"], "public", False), ("u4", [], [], None, False)]
    return spark.createDataFrame(rows, ACL), spark.createDataFrame(users, USERS)


def test_visible_classes_are_the_allowed_rows(spark):
    chunks, users = secured(spark, 1)
    classed = acl.with_class(chunks)
    got = {tuple(r) for r in classed.join(acl.visible(classed, users), "acl_class").select("user_id", "chunk_id").collect()}
    want = {tuple(r) for r in chunks.crossJoin(users).where(acl.allowed()).select("user_id", "chunk_id").collect()}
    assert got == want


@pytest.mark.parametrize("sent", [True, False])
@pytest.mark.parametrize("name", ["dense", "bm25", "hybrid"])
def test_users_get_the_best_of_what_they_may_see(spark, monkeypatch, name, sent):
    """k hits wherever k are allowed, equal to a search over each user's rows alone; both where
    queries are sent to the rows and where they are joined with them."""
    if not sent:
        monkeypatch.setattr(retrieval, "SENT", 0)
        monkeypatch.setattr(retrieval.hash_dense, "__defaults__", (5, 1024, None, 0))
    chunks, users = secured(spark, 2)
    queries = spark.createDataFrame([(10 * i + j, t, f"u{i}") for i in range(6) for j, t in enumerate(["one two", "five five", "nowhere"])], "query_id long, query string, user_id string")
    got = {}
    for r in compiler.retrieve(queries, compiler.Corpus(chunks), override={"name": name}, k=5, users=users).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    assert all(q // 10 < 5 for q in got)  # an unknown user sees nothing
    allowed = {}
    for r in chunks.crossJoin(users).where(acl.allowed()).select("user_id", "chunk_id").collect():
        allowed.setdefault(r["user_id"], set()).add(r["chunk_id"])
    everything = {n: {} for n in ("dense", "bm25")}
    for n, every in everything.items():
        for r in compiler.hits(n, {}, queries, compiler.Corpus(chunks), 1000).collect():
            every.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for q in [10 * i + j for i in range(5) for j in range(3)]:
        lists = {n: [x for x in sorted(every.get(q, []), key=lambda x: (-x[1], x[0])) if x[0] in allowed.get(f"u{q // 10}", ())][:5] for n, every in everything.items()}
        if name == "hybrid":
            total = {}
            for n, w in (("dense", 0.7), ("bm25", 0.3)):
                for c, s in lists[n]:
                    total[c] = total.get(c, 0) + w * s
            want = sorted(((c, round(s, 9)) for c, s in total.items()), key=lambda x: (-x[1], x[0]))[:5]
        else:
            want = lists[name]
        assert [(c, round(s, 6)) for _, c, s in sorted(got.get(q, []))] == [(c, round(s, 6)) for c, s in want]


def test_joined_and_sent_queries_score_alike(spark):
    chunks, _ = secured(spark, 3)
    queries = spark.createDataFrame([(1, "one two two"), (2, "five"), (3, "nowhere"), (4, "")], "query_id long, query string")
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 7)) for r in df.collect())
    assert key(retrieval.bm25(queries, chunks, 4, most=0)) == key(retrieval.bm25(queries, chunks, 4))
    assert key(retrieval.hash_dense(queries, chunks, 4, most=0)) == key(retrieval.hash_dense(queries, chunks, 4))


def test_cluster_ids_never_meet_leaf_ids(spark):
    first = 10**9 - 20
    rows = [(first + i, i, f"t{i}", [float(i % 3 == j) * 5 + (i * 7 + j) % 10 / 10 for j in range(4)]) for i in range(40)]
    nodes = raptor.build(spark.createDataFrame(rows, "node_id long, chunk_id long, text string, vector array<double>"), max_layers=2).collect()
    assert len({r["node_id"] for r in nodes}) == len(nodes) and sum(r["level"] == 0 for r in nodes) == 40


def test_paths_of_audits_are_tried_in_order(spark):
    cases = [("POST", "/v1/knowledge-bases/2/documents", "kb_create"), ("POST", "/v1/documents", "doc_upload"), ("DELETE", "/admin/tenants/1", "admin_delete"), ("GET", "/admin/documents", "admin_generic_read"), ("PATCH", "/v1/api-keys/3", "apikey_update"), ("GET", "/health", None)]
    df = spark.createDataFrame(cases, "method string, path string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", audit_action(F.col("method"), F.col("path"))).collect())
