"""Parsers, index tables, requests, extraction and streams: what SQL can't say, and edge cases."""

import io
import zipfile
from collections import defaultdict

import duckdb
import pytest
from compare import differences
from conftest import SMALL
from pyspark.sql import functions as F

from millrace.functions import extraction
from millrace.functions import text as fx
from millrace.functions.vectors import hash_embedding
from millrace.operators import relational, retrieval, vector_index
from millrace.plans import compiler
from millrace.plans.queries import ORACLE, QUERIES, vector_queries, vectors
from millrace.sources import parsers, tables
from millrace.streaming import audit, ingest


def files(spark, rows):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


# ---------------------------------------------------------------- parsers

def test_texts_are_decoded_by_extension(spark):
    rows = [("/a/x.TXT", "zwölf 十二".encode()), ("/a/y.md", "中文内容".encode("gbk")), ("/a/z.txt", b"\xff\xfe\x81"), ("/a/e.txt", b""), ("/a/n.txt", None), ("/a/w.exe", b"MZ"), ("/a/none", b"x"), ("/a/bad.xlsx", b"no zip"), ("/a/bad.docx", zipped({"other": "x"}))]
    got = {r["filename"]: r for r in parsers.parse_files(files(spark, rows)).collect()}
    assert [got[n]["content"] for n in ("x.TXT", "y.md", "z.txt", "e.txt", "n.txt")] == ["zwölf 十二", "中文内容", b"\xff\xfe\x81".decode("utf-8", "replace"), "", ""]
    assert got["x.TXT"]["format"] == "txt" and got["x.TXT"]["char_count"] == 8
    assert all(got[n]["content"] is None and got[n]["error"] for n in ("w.exe", "none", "bad.xlsx", "bad.docx"))
    with pytest.raises(ValueError):
        parsers.parser_for("a.b/c.PDF")
    assert parsers.parse_files(files(spark, [])).collect() == []


def test_json_becomes_an_outline():
    assert parsers.json_text(b'{"a": 1, "b": {"c": [1, {"d": null}, ["x"]]}, "e": true}').content == "- **a**: 1\n- **b**:\n  - **c**:\n    - 1\n    2.\n      - **d**: None\n    3.\n      - x\n- **e**: True"
    assert parsers.json_text(b"[1, 2").content == "[1, 2" and parsers.json_text(b'"x"').content == '"x"'


def test_workbooks(spark):
    pages = {"One & more": [["name", "n", None], [None, None], ["a<b", 1, "beyond"], ["c", 2.5], [True]], "Empty": [], "Blank": [[None]]}
    out = parsers.workbook(parsers.workbook_bytes(pages))
    assert out.content == "## One & more\n\n| name | n |\n| --- | --- |\n| a<b | 1 |\n| c | 2.5 |\n| True |  |"
    assert out.tables == [{"sheet": "One & more", "headers": ["name", "n"], "rows": [["a<b", "1"], ["c", "2.5"], ["True", ""]], "row_count": 3}]
    assert out.meta == {"sheet_count": 3, "table_count": 1, "total_rows": 4}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    other = zipped({
        "xl/workbook.xml": f'<workbook {main} xmlns:r="urn:r"><sheets><sheet name="S" r:id="q"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="q" Target="/xl/worksheets/a.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>head</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/a.xml": f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>45292.5</v></c><c r="C2" t="str"><v>=x</v></c></row></sheetData></worksheet>',
    })
    assert parsers.workbook(other).tables[0]["rows"] == [["2024-01-01 00:00:00", "2024-01-01 12:00:00", "=x"]] and parsers.workbook(other).tables[0]["headers"] == ["head", "", "rich text"]


def test_templates(spark):
    book = parsers.workbook_bytes({"A": [["名称", "金额", "日期", None, "名称"], ["文本", "数字", "Date"]], "B": [["金额", "ok"], ["bool", "是否"]]})
    got = parsers.template_fields(files(spark, [("t.xlsx", book)])).orderBy("position").collect()
    assert [(r["name"], r["type"], r["sheet"]) for r in got] == [("名称", "string", "A"), ("金额", "number", "A"), ("日期", "date", "A"), ("ok", "boolean", "B")]


def test_word_documents():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda body, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{body}</w:tc>"
    table = f'<w:tbl><w:tr>{cell(p("A"))}{cell(p("B"), "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr><w:tr>{cell(p("x") + p("y"))}{cell(p("1"))}</w:tr></w:tbl>'
    body = p("Title", "H2") + p("  ") + p("Text") + p("Item", "LB") + table + p("Deep", "H9")
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H2", "heading 2"), ("H9", "heading 9"), ("LB", "List Bullet")))
    out = parsers.word_document(zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {w}>{styles}</w:styles>"}))
    assert out.content == "## Title\n\nText\n\n- Item\n\n| A | B | B |\n| --- | --- | --- |\n| x<br>y | 1 |  |\n\n###### Deep"
    assert out.tables[0]["rows"] == [["x<br>y", "1", ""]] and out.meta["table_count"] == 1


# ---------------------------------------------------------------- tables

def test_index_tables_forget_and_replace(spark, tmp_path):
    index = tables.IndexTable(spark, f"file://{tmp_path}/t", "kb_id string, chunk_id long, document_id long, v int")
    assert index.read().collect() == []
    rows = lambda *r: spark.createDataFrame(list(r), "kb_id string, chunk_id long, document_id long, v int")
    index.upsert(rows(("a", 1, 1, 10), ("a", 2, 1, 20), ("b", 1, 2, 30), ("a", 1, 1, 5)))
    index.upsert(rows(("a", 1, 1, 11), ("c", 9, 3, 1)))
    index.delete(documents=[2])
    index.delete(kbs=["c"])
    index.upsert(rows(("c", 9, 3, 2)))
    want = [("a", 1, 1, 11), ("a", 2, 1, 20), ("c", 9, 3, 2)]
    assert sorted(tuple(r) for r in index.read().collect()) == want
    assert sorted(tuple(r) for r in index.rebuild(f"file://{tmp_path}/u").read().collect()) == want
    with pytest.raises(ValueError):
        index.delete()


def test_vectors_of_one_length(spark):
    rows = spark.createDataFrame([("a", 1, 1, [1.0, 2.0]), ("a", 2, 1, [1.0])], "kb_id string, chunk_id long, document_id long, vector array<double>")
    assert tables.vector_rows(rows.where("chunk_id = 1"), "m").count() == 1
    with pytest.raises(Exception, match="vector of"):
        tables.vector_rows(rows, "m", 2).collect()


# ---------------------------------------------------------------- retrieval

def test_both_ways_of_bm25_agree(spark):
    texts = [(i, i % 3, f"w{i % 7} w{i % 11} the the common w{i % 5}") for i in range(300)] + [(300, 0, ""), (301, 1, None)]
    c = spark.createDataFrame(texts, "chunk_id long, document_id long, text string").withColumn("kb_id", F.lit("kb"))
    q = spark.createDataFrame([(1, "w1 the w2 w2"), (2, "nothing here"), (3, ""), (4, "W3 common")], "query_id long, query string")
    rows = lambda most: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in retrieval.bm25(q, c, 6, most=most).collect())
    assert rows(100) == rows(0) and len(rows(100)) == 24


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_search_finds_nine_of_ten(spark, sf):
    """While a tenth of the vectors at most is scored."""
    d = f"/root/testdata/{sf}"
    exact = {(r["query_id"], r["chunk_id"]) for r in QUERIES["r1_dense"](spark, d).collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in QUERIES["r3_ann"](spark, d).collect()}
    recall = len(exact & found) / len(exact)
    print(f"recall at 10: {recall:.3f}")
    assert recall >= 0.9 and 50 <= vectors(spark, d).count() / 10
    if sf == "sf0.01":
        index = vector_index.build(vectors(spark, d), cells=5)
        every = vector_index.search(index, vector_queries(spark, d), vectors(spark, d), 10, probes=5, shortlist=1000, exclude_self=True)
        assert {(r["query_id"], r["chunk_id"]) for r in every.collect()} == exact


def test_approximate_search_of_odd_vectors(spark, monkeypatch):
    nan = float("nan")
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0]), (53, [None, 1.0, 1.0]), (54, [nan, 1.0, 1.0])]
    c = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0]), (5, [2.0, 1.0, 0.0])], "query_id long, vector array<double>")
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect() if r["query_id"] != 4)
    fine = c.where("chunk_id < 52")
    want = key(retrieval.dense(q, fine, 4))
    assert key(vector_index.approximate(q, c, 4, cells=6, probes=6, shortlist=60)) == want
    monkeypatch.setattr(vector_index, "BROADCAST_QUERIES", 1)
    assert key(vector_index.approximate(q, c, 4, cells=6, probes=6, shortlist=60)) == want
    assert vector_index.approximate(q, c.limit(0), 4).collect() == [] and vector_index.approximate(q.limit(0), c, 4).collect() == []


def test_children_show_their_parents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    family = [("a\n\nb " * 400, 1), ("short", 2)]
    from millrace.operators import chunkers

    c = chunkers.parent_child(spark.createDataFrame(family, "text string, document_id long")).withColumn("chunk_id", F.col("document_id") * 1000 + F.col("chunk_index"))
    hits = c.where(~retrieval.is_parent(F.col("meta"))).select("chunk_id", F.lit(1).alias("query_id"))
    text = {r["chunk_id"]: r["text"] for r in c.collect()}
    got = retrieval.parent_context(hits, c).collect()
    assert len(got) == hits.count() and all(text[r["chunk_id"]].split()[-1] in r["context_text"] for r in got)
    assert {r["context_text"][:5] for r in got if r["chunk_id"] >= 2000} == {"short"}
    assert QUERIES["r21_parent_context"](spark, SMALL).where("digest is null").count() == 0
    assert QUERIES["f12_parent_chunks"](spark, SMALL).select("document_id").distinct().count() == sum(bool(t) for t in docs.values())


def test_settings_become_plans():
    resolve = compiler.resolve
    assert resolve([]) == ("dense", {}) and resolve([{"name": "no such"}]) == ("dense", {})
    assert resolve([{"name": "hybrid", "params": {"dense_weight": 1}}] * 2) == ("hybrid", {"dense_weight": 1})
    with pytest.raises(compiler.SettingsError):
        resolve([{"name": "hybrid"}, {"name": "dense"}])
    assert resolve([{"name": "hybrid", "allow_mixed": True}, {"name": "dense"}])[0] == "hybrid"
    assert resolve([{"name": "hybrid"}, {"name": "dense"}], {"name": "fusion"}) == ("fusion", {})
    names = lambda **p: [(m["name"], m["weight"]) for m in resolve([], {"name": "ensemble", "params": p})[1]["retrievers"]]
    assert names() == names(preset="custom") == [("dense", 1.0), ("llama_bm25", 1.0)]
    assert names(preset="hybrid_hyde") == [("hybrid", 1.0), ("hyde", 1.0)] and names(retrievers="dense, bm25") == [("dense", 1.0), ("bm25", 1.0)]
    assert names(retrievers=["dense", "bm25"], weights=[0.6]) == [("dense", 0.6), ("bm25", 1.0)] and names(retrievers=[{"name": "bm25", "weight": 2}]) == [("bm25", 2)]


@pytest.mark.parametrize("override", [{"name": "bm25"}, {"name": "fusion", "params": {"rerank": True}}, {"name": "hyde"}, {"name": "multi_query", "params": {"base_retriever": "bm25"}}, {"name": "ensemble", "params": {"retrievers": "dense,bm25,no such"}}])
def test_requests_run(spark, override):
    c = spark.createDataFrame([(i, i // 4, i % 4, f"alpha beta{i} gamma{i % 3} delta") for i in range(40)], "chunk_id long, document_id long, chunk_index int, text string").withColumn("kb_id", F.lit("kb"))
    q = spark.createDataFrame([(1, "beta7 gamma1"), (2, "delta beta39")], "query_id long, query string")
    got = compiler.retrieve(q, compiler.Corpus(c), override=override, k=3, context=(1, 1), rerank="overlap").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"]) for r in got] == [(i, n) for i in (1, 2) for n in (1, 2, 3)]
    assert got[0]["chunk_id"] == 7 and got[3]["chunk_id"] == 39 and "beta6" in got[0]["context_text"]


# ---------------------------------------------------------------- extraction, scalars

def test_payloads_of_answers(spark):
    said = ['```json\n[{"项目": "nd-003", "x": 1}, {"项目": "C-001"}]\n```', 'text ```json {"items": [{"a": "b"}]} ``` more', '```\n{"a": {"b": 2}}\n```', "[1, 2]", "no json", "", None, '{"a": null}']
    df = spark.createDataFrame(list(enumerate(said)), "i int, c string").select("i", extraction.payloads(F.col("c")).alias("p"))
    got = [r["p"] for r in df.orderBy("i").collect()]
    assert got[:3] == [[{"项目": "nd-003", "x": "1"}, {"项目": "C-001"}], [{"a": "b"}], [{"a": '{"b":2}'}]] and got[4:7] == [None] * 3 and got[7] == [{"a": None}]
    ids = spark.createDataFrame([(["ND-003", "XX-999", "C-001"], ["ND-003"]), (["A-1"], [])], "m array<string>, t array<string>").select(extraction.confirmed_ids(F.col("m"), F.col("t")).alias("x")).collect()
    assert [r["x"] for r in ids] == [["ND-003"], ["A-1"]]


def test_project_ids(spark):
    texts = ["XY001 and ND-003, ND_004 nd 017; ABCDEFGHIJK-001, A-123, ND-00312", "none"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fx.project_ids(F.col("t"))).collect()]
    assert got == [["XY-001", "ND-003", "ND-004", "ND-017"], []]


def test_project_ids_of_other_letters_equal_sql(spark, tmp_path):
    texts = ["ciónja 101.21", "éch 146 xAB-001é ÀB_002", "x_AB-003 AB-004_ 9AB-005", "\ufb01-001 a\ufb01 002 \ufb06-003", "stra\u00dfe 123 \u00df 456 \u1e9e-007", "d\u0131r-012 \u017fo 013 \u0149a-014", "AB-\u0661\u0662\u0663 AB-015\u0661 \uff21\uff22-016", "e\u0301ab-017 ab-018\u0301", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = QUERIES["e9_project_ids"](spark, str(tmp_path))
    assert differences(found, ORACLE["e9_project_ids"], con) is None
    assert {r["doc_id"]: r["ids"] for r in found.collect()}[0] == "NJA-101"


def test_hash_embeddings(spark):
    df = spark.createDataFrame([("one two two",), ("",), (None,)], "t string").select(hash_embedding(F.col("t"), 32).alias("v"))
    a, b, c = (r["v"] for r in df.collect())
    assert len(a) == len(b) == len(c) == 32 and abs(sum(x * x for x in a) - 1) < 1e-9 and set(b) == {0.0} and all(-1 <= x <= 1 for x in a)


def test_masks_slugs_durations(spark):
    df = spark.createDataFrame([("sk-1234567890", "Hello,  World!", 90061)], "k string, s string, n long")
    r = df.select(fx.masked_key(F.col("k")), fx.masked_key(F.lit("short")), fx.slug(F.col("s")), fx.duration(F.col("n"))).head()
    assert tuple(r) == ("sk-1****7890", "****", "hello_world", "1d 1h 1m")


def test_repeated_titles_map_every_document(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, title string")
    assert sorted(tuple(r) for r in relational.by_title(docs, docs.where("doc_id = 1")).collect()) == [("a", 1, 2), ("a", 2, 2)]


# ---------------------------------------------------------------- streams

def limited_by_hand(rows, most, seconds):
    allowed, out = defaultdict(list), {}
    for at, event, key in sorted(rows):
        recent = [x for x in allowed[key] if x >= at - seconds * 1_000_000]
        out[event] = len(recent) < most
        allowed[key] = recent + [at] * out[event]
    return out


def test_refused_requests_do_not_count(spark):
    got = {r["event_id"]: r["allowed"] for r in QUERIES["t6_rate_limiter"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")), "event_id", "user_id").collect()
    want = limited_by_hand([tuple(r) for r in rows], 2, 24 * 3600)
    assert got == want and not all(want.values())


def test_limits_hold_over_triggers(spark, tmp_path):
    rows = [(10**15 + i * 4_000_000, i, i % 3) for i in range(200)]
    for n in range(4):
        spark.createDataFrame(rows[n * 50 : (n + 1) * 50], "at long, event_id long, api_key_id long").select(F.timestamp_micros("at").alias("ts"), "event_id", "api_key_id").coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
    schema = "ts timestamp, event_id long, api_key_id long, n int"
    stream = audit.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    got = audit.gathered(audit.limited(stream, most=3, seconds=60), f"file://{tmp_path}/out")
    got, want = {r["event_id"]: r["allowed"] for r in got.collect()}, limited_by_hand(rows, 3, 60)
    assert [(k, got.get(k)) for k in want if got.get(k) != want[k]] == [] and not all(want.values())


def test_late_events_are_dropped(spark, tmp_path):
    def write(n, times):
        rows = [(f"2024-01-01 {t}:00", "a", 200, 1.0) for t in times]
        df = spark.createDataFrame(rows, "ts string, action string, status_code int, duration_ms double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")

    for n, times in enumerate((["10:05", "10:50"], ["12:30", "10:55"], ["12:05"], ["10:59", "12:40"], ["15:00"])):
        write(n, times)
    stream = audit.event_stream(spark, f"{tmp_path}/in", "ts timestamp, action string, status_code int, duration_ms double, n int", files_per_trigger=1)
    got = audit.gathered(audit.window_stats(stream, late="30 minutes"), f"file://{tmp_path}/out").collect()
    # 10:55 comes with the event that closes its hour, 10:59 after it was closed
    assert sorted((r["start"].hour, r["total"]) for r in got) == [(10, 3), (12, 3)]


def test_sessions(spark):
    rows = [("2024-01-01 10:00:00", 1), ("2024-01-01 10:20:00", 1), ("2024-01-01 11:00:00", 1), ("2024-01-01 10:00:00", 2)]
    df = spark.createDataFrame(rows, "ts string, api_key_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r["api_key_id"], r["start"].hour, r["requests"]) for r in audit.session_stats(df).collect())
    assert got == [(1, 10, 2), (1, 11, 1), (2, 10, 1)]


def test_ingest_says_what_became_of_each_file(spark, tmp_path):
    folder, state = tmp_path / "files", f"file://{tmp_path}/state"
    folder.mkdir()
    (folder / "a.txt").write_text("one two. " * 30)
    (folder / "b.json").write_text('{"k": "v"}')
    (folder / "c.exe").write_bytes(b"MZ")
    (folder / "d.txt").write_text(" ")
    index = tables.IndexTable(spark, f"{state}/index", tables.LEXICAL)
    go = lambda: ingest.ingest(spark, f"file://{folder}", index, f"{state}/status", f"{state}/checkpoint", "kb", chunk_size=100, overlap=10).awaitTermination()
    go()
    (folder / "e.md").write_text("later")
    go()
    got = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["n_chunks"]) for r in ingest.document_status(spark, f"{state}/status").collect()}
    assert got == {"a.txt": ("completed", 3), "b.json": ("completed", 1), "c.exe": ("failed", 0), "d.txt": ("completed", 0), "e.md": ("completed", 1)}
    assert index.read().count() == 5
    spark.createDataFrame([(7, "x", "processing", None, None)], "document_id long, path string, status string, n_chunks long, error string").write.parquet(f"{state}/status/batch=9/step=0")
    assert ingest.document_status(spark, f"{state}/status").where("document_id = 7").head()["status"] == "interrupted"


def test_streams_meet_within_the_interval_and_late_ones_are_dropped(spark, tmp_path):
    files = [[(1, "10:00", "a", 7), (2, "10:05", "b", 7), (8, "10:05", "b", None), (9, "10:00", "a", None), (10, "10:05", "b", 6)], [(3, "13:00", "a", 7), (4, "13:10", "b", 7)], [(6, "13:05", "a", 7)], [(5, "10:20", "b", 7), (7, "14:05", "b", 7)]]
    for n, rows in enumerate(files):
        df = spark.createDataFrame([(i, f"2024-01-01 {t}:00", kind, key) for i, t, kind, key in rows], "event_id long, ts string, kind string, api_key_id long")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
    of = lambda kind: audit.event_stream(spark, f"{tmp_path}/in", "event_id long, ts timestamp, kind string, api_key_id long, n int", files_per_trigger=1).where(F.col("kind") == kind)
    got = audit.gathered(audit.followed(of("a"), of("b")), f"file://{tmp_path}/out").collect()
    # 10:20 comes a trigger after its interval was closed; as tables, it meets 10:00; an hour after 13:05 still counts
    assert sorted((r["event_id"], r["then_id"], r["waited_ms"]) for r in got) == [(1, 2, 300_000), (3, 4, 600_000), (6, 4, 300_000), (6, 7, 3_600_000)]
    table = spark.read.parquet(f"{tmp_path}/in")
    whole = audit.followed(table.where("kind = 'a'"), table.where("kind = 'b'")).collect()
    assert {(r["event_id"], r["then_id"]) for r in whole} == {(1, 2), (1, 5), (3, 4), (6, 4), (6, 7)}
