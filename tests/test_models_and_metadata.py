"""Calls of models that fail, filters against a model in Python, variants from the corpus."""

import json
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import feedback, metadata, model_calls
from millrace.operators.model_calls import Busy, Limits, answered, call, requests
from millrace.plans import compiler
from millrace.sources import tables

QUICK = Limits(items=4, chars=40, tries=3, wait=0.0)


def test_requests_keep_order_and_limits():
    items = ["a" * n for n in (1, 39, 1, 1, 100, 1, 1, 1, 1, 1)] + [("xx", "y" * 38), ("x", "y")]
    got = list(requests(items, QUICK))
    assert [x for r in got for x in r] == items
    assert all(len(r) <= 4 and (len(r) == 1 or sum(len("".join(x)) for x in r) <= 40) for r in got)
    assert ["a" * 100] in got and list(requests([], QUICK)) == []


def test_a_busy_model_is_asked_again_and_a_bad_item_fails_alone():
    asked = []

    def model(items):
        asked.append(list(items))
        if len(asked) < 3:
            raise Busy("later")
        if "bad" in items:
            raise ValueError("no")
        return {i: x.upper() for i, x in reversed(list(enumerate(items))) if x != "mute"}

    got = answered(model, ["a", "bad", "mute", "b"], QUICK)
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no"), "mute": (None, "no answer"), "b": ("B", None)}
    assert len(asked[0]) == 4 and asked[0] == asked[1] == asked[2]

    def never(items):
        raise Busy("down")

    assert answered(never, ["a", "b"], QUICK) == {x: (None, "Busy: down") for x in "ab"}
    # of too few answers none can be told apart: the items are asked for alone
    assert answered(lambda items: ["one"], ["a", "b"], QUICK) == {"a": ("one", None), "b": ("one", None)}
    assert answered(lambda items: [], ["a"], QUICK)["a"][0] is None


def test_limits_of_a_provider():
    assert model_calls.limits_of("qwen").items == 10 and model_calls.limits_of("qwen", 64).items == 10
    assert model_calls.limits_of("openai", 64).items == 64 and model_calls.limits_of("other").items == 100


def test_call_answers_every_row(spark):
    def model(items):
        if any("bad" in x for x in items):
            raise RuntimeError("refused")
        return [float(len(x)) for x in items]

    rows = [(i, x) for i, x in enumerate(["a", "bb", None, "", "bad", "a", "x" * 500, "日本"] * 60)]
    df = spark.createDataFrame(rows, "answer_id long, item string").repartition(3)
    got = {r["answer_id"]: (r["answer"], r["error"]) for r in call(df, "item", model, "double", QUICK).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        assert got[i] == ((None, None) if x is None else (None, "RuntimeError: refused") if x == "bad" else (float(len(x)), None))
    assert call(df.limit(0), "item", model, "double").count() == 0


def test_rerank_keeps_the_order_of_a_query_that_failed(spark):
    queries = spark.createDataFrame([(1, "a b"), (2, "boom"), (3, None)], "query_id long, query string")
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "a b", "c", None])], "chunk_id long, text string")
    hits = spark.createDataFrame([(q, c, 0.5, r) for q in (1, 2, 3) for r, c in enumerate((3, 2, 0, 1), 1)], "query_id long, chunk_id long, score double, rank int")

    def model(pairs):
        if any(q == "boom" for q, _ in pairs):
            raise ValueError("boom")
        return model_calls.overlap_scorer()(pairs)

    got = defaultdict(list)
    for r in model_calls.rerank(hits, queries, chunks, model, 4, QUICK, logits=True).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["chunk_id"], r["score"]))
    high = lambda x: round(1 / (1 + math.exp(-6 * (x - 0.5))), 9)
    assert got[1] == [(1, high(1)), (0, high(0.5)), (2, high(0)), (3, high(0))]
    assert got[2] == [(3, 1.0), (2, 1.0), (0, 1.0), (1, 1.0)]
    assert [c for c, _ in got[3]] == [0, 1, 2, 3]


def test_route_falls_back_to_the_rules(spark):
    queries = spark.createDataFrame([(1, "what is this"), (2, "foo_bar"), (3, None)], "query_id long, query string")
    names = {"keyword": "bm25", "semantic": "dense"}

    def route(model):
        return {r["query_id"]: (r["query_type"], r["by_model"]) for r in model_calls.route(queries, model, names, limits=QUICK).collect()}

    def down(items):
        raise Busy("down")

    assert route(lambda items: [" Keyword\n" if "is" in x else "poem" for x in items]) == {1: ("keyword", True), 2: ("keyword", False), 3: ("hybrid", False)}
    assert route(down) == {1: ("semantic", False), 2: ("keyword", False), 3: ("hybrid", False)}


# ---------------------------------------------------------------- metadata

ROWS = ['{"a":3,"b":"Xy","n":{"d":[1,{"e":"q"}]}}', '{"a":3.0,"b":"x","c d":true}', '{"a":"3","b":null}', "{}", '{"a":-1e3,"b":"ü\\"z"}']
FILTERS = [("a", "eq", "3"), ("a", "eq", '"3"'), ("a", "ge", "2.5"), ("a", "le", "0"), ("b", "eq", "null"), ("b", "contains", '"X"'), ("b", "ge", '"x"'), ("c d", "eq", "true"), ("$.n.d[1].e", "eq", '"q"'), ("zz", "contains", '"a"'), ("b", "contains", '"Ü\\""')]


def holds(meta, key, op, value):
    if key == "$.n.d[1].e":
        have = meta["n"]["d"][1]["e"] if "n" in meta else None
    else:
        have = meta.get(key)
    want, number = json.loads(value), lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if op == "eq":
        return have == want and isinstance(have, bool) == isinstance(want, bool)
    if op == "contains":
        return have is not None and want.lower() in str(have).lower()
    if not (number(have) and number(want) or isinstance(have, str) and isinstance(want, str)):
        return False
    return have >= want if op == "ge" else have <= want


@pytest.mark.parametrize("promoted", [(), ("b",)])
def test_filters_equal_a_model(spark, promoted):
    both = [(i, [f]) for i, f in enumerate(FILTERS)] + [(100 + i, [f, g]) for i, (f, g) in enumerate(zip(FILTERS, FILTERS[2:] + FILTERS[:2], strict=True))]
    both += [(200, [("b", "eq", '"x"'), ("a", "eq", "3")]), (201, [("b", "eq", '"x"'), ("b", "eq", '"Xy"')]), (202, [])]
    queries = spark.createDataFrame([(q, "") for q, _ in both], "query_id long, query string")
    filters = spark.createDataFrame([(q, *f) for q, fs in both for f in fs], "query_id long, key string, op string, value string")
    chunks = spark.createDataFrame(list(enumerate(ROWS)), "chunk_id long, j string").select("chunk_id", F.parse_json("j").alias("meta"), F.get_json_object("j", "$.b").alias("b"))
    got = {tuple(r) for r in metadata.matching(queries, filters, chunks, promoted).collect()}
    assert got == {(q, i) for q, fs in both for i, row in enumerate(ROWS) if all(holds(json.loads(row), *f) for f in fs)}
    hits = queries.crossJoin(chunks.select("chunk_id")).select("query_id", "chunk_id", F.lit(1.0).alias("score"))
    assert {(r["query_id"], r["chunk_id"]) for r in metadata.filtered(hits, filters, chunks).collect()} == got


def test_a_wrong_filter_is_an_error(spark):
    chunks = spark.createDataFrame([(1, "{}")], "chunk_id long, j string").select("chunk_id", F.parse_json("j").alias("meta"))
    queries = spark.createDataFrame([(1,)], "query_id long")
    for f in [("a", "like", "1"), ("a", "eq", "{")]:
        filters = spark.createDataFrame([(1, *f)], "query_id long, key string, op string, value string")
        with pytest.raises(Exception, match="no op|MALFORMED"):
            metadata.matching(queries, filters, chunks).collect()


# ---------------------------------------------------------------- feedback and requests

def corpus(spark):
    texts = ["solar panel power output", "panel panel power grid", "grid storage battery", "cats and dogs", None, ""]
    return spark.createDataFrame([(i, i, "k", t, 0, "{\"even\":%s}" % str(i % 2 == 0).lower()) for i, t in enumerate(texts)], "chunk_id long, document_id long, kb_id string, text string, chunk_index int, j string").withColumn("meta", F.parse_json("j")).drop("j")


def test_variants_come_from_first_hits(spark):
    queries = spark.createDataFrame([(1, "Solar"), (2, "none here"), (3, None)], "query_id long, query string")
    hits = spark.createDataFrame([(1, 0, 0.6, 1), (1, 1, 0.2, 2), (1, 5, 0.2, 3), (2, 3, 0.0, 1)], "query_id long, chunk_id long, score double, rank int")
    terms = [(r["term"], r["weight"]) for r in feedback.answer_terms(queries, hits, corpus(spark), 3).orderBy("no").collect()]
    assert terms == [("panel", 0.25), ("power", 0.2), ("output", 0.15)]
    got = {(r["query_id"], r["variant_no"]): r["query"] for r in feedback.variants(queries, hits, corpus(spark), 3).collect()}
    assert got == {(1, 0): "Solar", (1, 1): "Solar panel power output", (1, 2): "panel power output", (2, 0): "none here"}


def test_a_request_with_a_model_filters_and_feedback(spark):
    queries = spark.createDataFrame([(1, "solar power"), (2, "grid")], "query_id long, query string")
    filters = spark.createDataFrame([(1, "even", "eq", "true")], "query_id long, key string, op string, value string")
    setting = {"name": "multi_query", "params": {"base_retriever": "bm25", "generator": "feedback", "feedback_terms": 2}}
    found = compiler.retrieve(queries, compiler.Corpus(corpus(spark)), [setting], k=4, rerank=model_calls.overlap_scorer(), filters=filters, threshold=-9.0)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["chunk_id"], r["rank"]))
    assert got[1][0] == (0, 1) and all(c % 2 == 0 for c, _ in got[1])
    assert [c for c, _ in got[2]][:2] == [1, 2] and len(got[2]) == 4


def test_two_writers_take_two_numbers(spark, monkeypatch, tmp_path):
    path = f"file://{tmp_path}/lexical"
    one, two = (tables.IndexTable(spark, path, tables.LEXICAL) for _ in range(2))
    row = lambda word: spark.createDataFrame([("k", 1, 1, 1, [word])], tables.LEXICAL)
    claim = tables.IndexTable._claim

    def late(self):
        number = claim(self)
        if self is one:  # the other writer comes between the claim and the write
            two.upsert(row("later"))
        return number

    monkeypatch.setattr(tables.IndexTable, "_claim", late)
    one.upsert(row("sooner"))
    assert [r["words"] for r in two.read().collect()] == [["later"]]
    monkeypatch.undo()
    one.upsert(row("last"))
    assert sorted(r["change"] for r in one._stored().collect()) == [0, 1, 2]
    assert [r["words"] for r in two.read().collect()] == [["last"]]
    two.delete(kbs=["k"])
    assert one.read().count() == 0
