"""Queries do the whole job: nothing of a text, a table or a list is left out."""

import math
import os
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from millrace.operators import raptor, retrieval
from millrace.plans.queries import QUERIES, chunks


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(texts):
    return [(i, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(texts)], DOCUMENTS


def bm25_by_hand(query, texts, k=5):
    words = {i: Counter(t.lower().split()) for i, t in texts.items()}
    n, mean = len(words), sum(sum(w.values()) for w in words.values()) / len(words)
    df = Counter(t for w in words.values() for t in w)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for i, w in words.items():
        s = sum(c * (raw[t] if raw[t] >= 0 else low) * w[t] * 2.5 / (w[t] + 1.5 * (0.25 + 0.75 * sum(w.values()) / mean)) for t, c in Counter(query.lower().split()).items() if t in w)
        out[i] = round(s, 9)
    return [(i, round(1 / (1 + math.exp(2 - s)), 6)) for i, s in sorted(out.items(), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.mark.parametrize("name", ["r5_bm25", "r6_bm25_per_kb", "r12_multi_query", "r19_rerank", "e12_prompt"])
def test_words_after_the_sixth_count(spark, tmp_path, name):
    texts = [f"filler number {i} says little" for i in range(30)] + ["Seventh words alone match", "nothing here"]
    d = write(spark, tmp_path, documents=documents(texts), benchmark=([(1, "one two three four five six Seventh words WORDS")], "item_id long, text string"))
    got = QUERIES[name](spark, d).collect()
    if name == "e12_prompt":
        assert got[0]["prompt"].startswith("参考资料:\n[来源 1] src0\nSeventh words alone match") and got[0]["prompt"].endswith("six Seventh words WORDS")
        return
    got.sort(key=lambda r: r["rank"])
    assert got[0]["chunk_id"] == 30 * 100000
    if name == "r5_bm25":
        want = bm25_by_hand("one two three four five six Seventh words WORDS", {i * 100000: t for i, t in enumerate(texts)})
        assert [(r["chunk_id"], round(r["score"], 6)) for r in got] == want


def per_kb_by_hand(queries, chunks, k):
    words = {c: (kb, Counter((t or "").split())) for kb, c, t in chunks if kb is not None}
    out = []
    for q, query in queries:
        for c, (kb, w) in words.items():
            own = [x for b, x in words.values() if b == kb]
            n, mean = len(own), sum(sum(x.values()) for x in own) / len(own)
            df = Counter(t for x in own for t in x)
            raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
            low = 0.25 * sum(raw.values()) / max(len(raw), 1)
            met = [(m * (raw[t] if raw[t] >= 0 else low) * w[t] * 2.5 / (w[t] + 1.5 * (0.25 + 0.75 * sum(w.values()) / mean))) for t, m in Counter((query or "").split()).items() if t in w]
            if met:
                out.append((q, round(sum(met), 6) + 0.0, c, kb))
    out.sort(key=lambda r: (r[0], -r[1], r[2]))
    return [r for i, r in enumerate(out) if i < k or out[i - k][0] != r[0]]


@pytest.mark.parametrize("most", [5_000, 0])
def test_each_kb_ranks_by_its_own_counts(spark, most):
    # a: common words; b: words in half of the chunks weigh nothing; c: one chunk, all weights below 0; d: no words
    texts = [("a", f"the w{i % 7} w{i % 3} {'the ' * (i % 4)}") for i in range(40)] + [("b", "the x") if i % 2 else ("b", "w1 y") for i in range(12)] + [("c", "the w1 w2"), ("d", " "), ("d", None), (None, "the w1 w2")]
    rows = [(kb, 100 + i, t) for i, (kb, t) in enumerate(texts)]
    queries = [(1, "the w1 w1"), (2, "x The"), (3, "y w2 nowhere"), (4, ""), (5, None), (6, "w6")]
    c, q = spark.createDataFrame(rows, "kb_id string, chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    for k in (3, 60):
        got = retrieval.bm25_per_kb(q, c, k, most=most).collect()
        want = per_kb_by_hand(queries, rows, k)
        assert sorted((r["query_id"], round(r["score"], 6), r["chunk_id"], r["kb_id"]) for r in got) == sorted(want)
        assert all(r["rank"] == 1 + [x[2] for x in want if x[0] == r["query_id"]].index(r["chunk_id"]) for r in got)


def test_per_kb_ranking_writes_no_words(spark, tmp_path):
    from millrace.sources.tables import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    written = lambda: sum(os.path.getsize(f"{d}/{x}") for d, _, xs in os.walk(folder) for x in xs if x.endswith(".parquet"))
    texts = [" ".join(f"w{(i * 31 + j * j) % 5_000}" for j in range(400)) for i in range(300)]
    d = write(spark, tmp_path, documents=documents(texts), benchmark=([(1, "w7 w8"), (2, "w9")], "item_id long, text string"))
    before = written()
    assert QUERIES["r6_bm25_per_kb"](spark, d).count() == 10
    assert written() - before < sum(map(len, texts)) / 8


def test_entry_takes_whole_texts(spark):
    import __spark_entry__

    assert sorted(__spark_entry__.entry(spark).collect()) == sorted(QUERIES["r5_bm25"](spark, SMALL).collect())


def window_by_hand(texts, at, before, after, limit):
    """The service's loop."""
    size, front, back = len(texts[at]), [], []
    for x in reversed(texts[max(0, at - before) : at]):
        if size + len(x) > limit:
            break
        front.insert(0, x)
        size += len(x)
    for x in texts[at + 1 : at + after + 1]:
        if size + len(x) > limit:
            break
        back.append(x)
        size += len(x)
    return "\n\n".join([*front, texts[at], *back]), len(front), len(back)


def test_windows_stop_at_the_budget_on_either_side(spark):
    docs = {1: ["a" * 50, "b" * 90, "c" * 40, "d" * 30, "e" * 200, "f"], 2: ["alone"], 3: ["x" * 300, "y" * 10, "z" * 300]}
    rows = [(d * 100 + i, d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)]
    c = spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_index int, text string")
    got = retrieval.context_window(c.select(F.col("chunk_id").alias("query_id"), "chunk_id"), c, 2, 2, 50).collect()
    want = {d * 100 + i: window_by_hand(ts, i, 2, 2, 100) for d, ts in docs.items() for i in range(len(ts))}
    assert {r["chunk_id"]: (r["context_text"], r["n_before"], r["n_after"]) for r in got} == want


def test_every_chunk_has_a_window_and_some_budgets_bind(spark):
    got, c = QUERIES["r20_context_window"](spark, SMALL), chunks(spark, SMALL).select("chunk_id", "chunk_index", "total_chunks")
    assert got.count() == c.count()
    full = F.least("chunk_index", F.lit(2)) + F.least(F.col("total_chunks") - 1 - F.col("chunk_index"), F.lit(2))
    assert got.join(c, "chunk_id").where(F.col("n_before") + F.col("n_after") < full).count() > 0


def test_dense_hits_equal_whole_vectors(spark):
    from millrace.functions.vectors import hash_embedding

    texts = ["one two two three", "Two one", "", None, "four five", "one", "two two two"]
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    q = spark.createDataFrame([(1, "one two"), (2, "nowhere"), (3, "")], "query_id long, query string")
    with_vector = lambda df, text: df.withColumn("vector", hash_embedding(F.col(text), 64))
    want = retrieval.dense(with_vector(q, "query"), with_vector(c, "text"), 4)
    got = retrieval.hash_dense(q, c, 4, 64)
    key = lambda r: (r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 7))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


@pytest.mark.parametrize("name", ["r8_hybrid", "r10_fusion_rrf", "r11_ensemble"])
def test_a_lexical_hit_reaches_the_fused_list(spark, tmp_path, name):
    # case differs, so they share no slot with the query and only BM25 sees the match
    texts = [f"filler number {i} says little" for i in range(30)] + ["SEVENTH WORDS ALONE"] * 12
    d = write(spark, tmp_path, documents=documents(texts), benchmark=([(1, "seventh words alone")], "item_id long, text string"))
    assert 30 * 100000 in {r["chunk_id"] for r in QUERIES[name](spark, d).collect()}


def test_summaries_are_the_joined_texts_cut(spark):
    rows = [(i, i % 3, None if i % 11 == 0 else "" if i % 7 == 0 else f"text {i} " * (i % 5)) for i in range(400)] + [(1000, 3, "long" * 100), (1001, 4, None)]
    got = {r["parent_id"]: r["text"] for r in raptor.summaries(spark.createDataFrame(rows, "node_id long, parent_id long, text string"), 300, 8).collect()}
    assert got == {p: "\n\n---\n\n".join(t for _, q, t in sorted(rows, key=lambda r: r[0]) if q == p and t is not None)[:300] for p in range(4)}


def test_the_built_tree_is_searched_with_its_summaries(spark, tmp_path, monkeypatch):
    from millrace.plans import queries

    rows = [(i, [float(j == i % 3) * 5 + ((i * 7 + j * 3) % 10) / 10 for j in range(4)], i % 3) for i in range(120)]
    d = write(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    tree = queries.built(spark, d)
    monkeypatch.setattr(queries, "built", lambda *_: tree)
    nodes = {r["node_id"]: r for r in QUERIES["e4_raptor_build"](spark, d).collect()}
    assert {i for i, r in nodes.items() if r["level"] == 0} == set(range(120)) and max(r["level"] for r in nodes.values()) >= 1
    stats = QUERIES["a4_raptor_stats"](spark, d).head()
    assert (stats["total"], stats["leaves"]) == (len(nodes), 120)
    under = {(up, i) for i in range(120) for up in ancestors(nodes, i)}
    assert {tuple(r) for r in QUERIES["r18_leaf_search"](spark, d).select("root", "node_id").collect()} == under
    assert {r["query_id"] for r in QUERIES["r17_raptor_traversal"](spark, d).collect()} == {0, 100}
    hits = retrieval.dense(queries.vector_queries(spark, d), tree.select(F.col("node_id").alias("chunk_id"), "vector"), 10, exclude_self=True).collect()
    assert len(QUERIES["r16_raptor_collapsed"](spark, d).collect()) == 20 and len(hits) == 20


def ancestors(nodes, i):
    while nodes[i]["parent_id"] is not None:
        i = nodes[i]["parent_id"]
        yield i


def test_no_rank_of_every_vector(spark):
    assert "1073741824" not in QUERIES["r2_dense_per_kb"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
