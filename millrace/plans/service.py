"""Registered queries of parsers, index tables, extraction, request plans and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import extraction
from ..functions import text as fx
from ..operators import chunkers, raptor, relational, retrieval, vector_index
from ..sources import parsers, tables
from ..streaming import audit, ingest
from . import compiler
from .queries import _ACL, _LEXICAL, CHUNKS, TOKENS, chunks, items, protected, query, table, users, vector_queries, vectors


def _new(spark, label: str) -> str:
    return f"{tables.shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- parsers

@query("s2_text_parser", "SELECT source || '-' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' ELSE '.markdown' END AS filename, CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'markdown' END AS format, length(coalesce(text, ''))::INTEGER AS char_count, md5(coalesce(text, '')) AS digest FROM documents")
def s2_text_parser(spark, d):
    """Documents as files of three kinds, through the parser of each."""
    suffix = F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 3 == 1, ".MD").otherwise(".markdown")
    files = table(spark, d, "documents").select(F.concat(F.lit("/kb/"), "source", F.lit("-"), F.col("doc_id").cast("string"), suffix).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return parsers.parse_files(files).select("filename", "format", "char_count", F.md5("content").alias("digest"))


@query("s3_json_markdown", "SELECT event_id, '- **k**: ' || json_extract_string(props, '$.k') AS content FROM events")
def s3_json_markdown(spark, d):
    files = table(spark, d, "events").select(F.concat("event_id", F.lit(".json")).alias("path"), F.encode("props", "UTF-8").alias("content"))
    return parsers.parse_files(files).select(F.substring_index("path", ".", 1).cast("long").alias("event_id"), "content")


def _workbooks(spark, d):
    nations = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return parsers.results_workbooks(nations.orderBy("n_nationkey"), "n_regionkey", "nations")


@query("s4_excel", r"""
SELECT n_regionkey::VARCHAR || '.xlsx' AS filename, n_nationkey::VARCHAR AS key, n_name AS name, (count(*) OVER (PARTITION BY n_regionkey))::INTEGER AS row_count FROM nation""")
def s4_excel(spark, d):
    """Workbooks written for each region and parsed again: a row each of their tables."""
    found = parsers.parse_files(_workbooks(spark, d)).select("filename", F.explode("tables").alias("t"))
    return found.select("filename", F.col("t.row_count").alias("row_count"), F.explode("t.rows").alias("r")).select("filename", F.col("r")[0].alias("key"), F.col("r")[1].alias("name"), "row_count")


@query("s10_template_fields", "SELECT DISTINCT n_regionkey::VARCHAR || '.xlsx' AS path, name, 'string' AS type, 'nations' AS sheet FROM nation, (VALUES ('key'), ('name')) AS f(name)")
def s10_template_fields(spark, d):
    return parsers.template_fields(_workbooks(spark, d)).select("path", "name", "type", "sheet")


@query("k8_results_table", "SELECT 'file-' || doc_id AS 文件名, CASE WHEN quality = 1 THEN toxic::VARCHAR END AS toxic, CASE WHEN quality = 1 THEN '成功' ELSE '失败' END AS 状态, CASE WHEN quality = 1 THEN NULL ELSE 'low quality' END AS 错误信息 FROM labels WHERE quality IS NOT NULL")
def k8_results_table(spark, d):
    results = table(spark, d, "labels").where("quality is not null").select(F.concat(F.lit("file-"), "doc_id").alias("filename"), (F.col("quality") == 1).alias("success"), F.lit("low quality").alias("error"), F.create_map(F.lit("toxic"), F.col("toxic").cast("string")).alias("fields"))
    return parsers.results_table(results, ["toxic"])


# ---------------------------------------------------------------- index tables

@query("k1_vector_table", """
SELECT label::VARCHAR AS kb_id, vec_id AS chunk_id, round(CASE WHEN vec_id % 10 = 0 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 9) AS first FROM embeddings WHERE label <> 3 AND vec_id % 7 <> 0 AND vec_id // 10 <> 4""")
def k1_vector_table(spark, d):
    """All vectors inserted, every tenth replaced, then deletes by kb, by key and by document."""
    rows = tables.vector_rows(vectors(spark, d).withColumn("document_id", F.floor(F.col("chunk_id") / 10).cast("long")), "given", 64)
    index = tables.IndexTable(spark, _new(spark, "vectors"), tables.VECTORS)
    index.upsert(rows)
    index.upsert(rows.where("chunk_id % 10 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    index.delete(kbs=["3"])
    index.delete(ids=rows.where("chunk_id % 7 = 0"))
    index.delete(documents=[4])
    return index.read().select("kb_id", "chunk_id", F.round(F.col("vector")[0], 9).alias("first"))


@query("k4_lexical_table", f"WITH {CHUNKS} SELECT kb_id, chunk_id, len({TOKENS.format('text')})::INTEGER AS dl, md5(array_to_string({TOKENS.format('text')}, ' ')) AS digest FROM c WHERE document_id % 5 <> 0 OR document_id % 10 = 0")
def k4_lexical_table(spark, d):
    """The lexical index of all chunks, less some documents, some of them added again, rebuilt."""
    rows = tables.kept(tables.lexical_rows(chunks(spark, d)), "rows")
    index = tables.IndexTable(spark, _new(spark, "lexical"), tables.LEXICAL)
    index.upsert(rows)
    index.delete(ids=rows.where("document_id % 5 = 0"))
    index.upsert(rows.where("document_id % 10 = 0"))
    fresh = index.rebuild(_new(spark, "rebuilt"))
    return fresh.read().select("kb_id", "chunk_id", "dl", F.md5(F.array_join("words", " ")).alias("digest"))


# ---------------------------------------------------------------- requests

@query("r3_ann")
def r3_ann(spark, d):
    """The approximate twin of r1_dense: fifty vectors a query are scored."""
    return vector_index.approximate(vector_queries(spark, d), vectors(spark, d), 10, exclude_self=True).select("query_id", "chunk_id", "score", "rank")


@query("r22_request", f"""{_LEXICAL}, f AS (SELECT query_id, chunk_id, round(sum(g), 9) AS score FROM (SELECT query_id, chunk_id, 0.7 * score AS g FROM top WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, 0.3 * score FROM second WHERE rank <= 5) GROUP BY ALL),
h AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f), {_ACL}
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM h JOIN c USING (chunk_id) JOIN p ON p.doc_id = c.document_id AND p.user_id = 'u1' WHERE rank <= 5 AND score >= 0.2 AND (admin OR pub OR (clear AND named))""")
def r22_request(spark, d):
    """A request with the settings of two knowledge bases that agree, a threshold and a user."""
    return _request(spark, d, F.lit("u1"), "post", 0.2)


def _request(spark, d, user, acl_mode, threshold):
    rights = protected(spark, d).withColumnRenamed("doc_id", "document_id")
    corpus = compiler.Corpus(chunks(spark, d).join(rights, "document_id"), index=retrieval.lexical_index(chunks(spark, d)))
    setting = {"name": "hybrid", "params": {"dense_weight": 0.7, "sparse_weight": 0.3}}
    return compiler.retrieve(items(spark, d).withColumn("user_id", user), corpus, [setting, dict(setting)], k=5, threshold=threshold, users=users(spark), acl_mode=acl_mode)


_FIRST = _LEXICAL.index("dots AS (")


@query("r22_request_allowed", f"""{_LEXICAL[:_FIRST]}{_ACL},
asks AS (SELECT query_id, ['u0', 'u1', 'u2', 'u3', 'src4'][(query_id % 5 + 1)::INTEGER] AS user_id FROM q),
may AS (SELECT query_id, chunk_id FROM asks JOIN p ON p.user_id = asks.user_id AND (admin OR pub OR (clear AND named)) JOIN c ON c.document_id = p.doc_id),
{_LEXICAL[_FIRST:].replace("SELECT query_id, chunk_id, 0 FROM nq, (SELECT chunk_id FROM nc ORDER BY chunk_id LIMIT 10) AS z", "SELECT query_id, chunk_id, 0 FROM may")
 .replace("FROM dots JOIN nq USING (query_id)", "FROM dots JOIN may USING (query_id, chunk_id) JOIN nq USING (query_id)")
 .replace("UNION ALL SELECT query_id, chunk_id, 0.0 FROM q, (SELECT chunk_id FROM c ORDER BY chunk_id LIMIT 10) AS z", "UNION ALL SELECT query_id, chunk_id, 0.0 FROM may")
 .replace("raw AS (SELECT query_id, chunk_id, round(sum(s), 9) AS raw FROM hit GROUP BY ALL)", "raw AS (SELECT query_id, chunk_id, round(sum(s), 9) AS raw FROM hit SEMI JOIN may USING (query_id, chunk_id) GROUP BY ALL)")},
f AS (SELECT query_id, chunk_id, round(sum(g), 9) AS score FROM (SELECT query_id, chunk_id, 0.7 * score AS g FROM top WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, 0.3 * score FROM second WHERE rank <= 5) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 5""")
def r22_request_allowed(spark, d):
    """The same request by five users in turn, each of whom gets the best five of what they may see."""
    names = F.array(*(F.lit(x) for x in ("u0", "u1", "u2", "u3", "src4")))
    return _request(spark, d, F.element_at(names, (F.col("query_id") % 5 + 1).cast("int")), "pre", 0.0)


def _family(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return tables.kept(chunkers.parent_child(docs).withColumn("chunk_id", F.col("document_id") * 1_000_000 + F.col("chunk_index")), "family")


@query("f12_parent_chunks")
def f12_parent_chunks(spark, d):
    """What is shown, not indexed: the parents."""
    return _family(spark, d).where(retrieval.is_parent(F.col("meta"))).select("document_id", "chunk_id", F.md5("text").alias("digest"))


@query("r21_parent_context")
def r21_parent_context(spark, d):
    """Every child as a hit, with its parent's text."""
    family = _family(spark, d)
    found = family.where(~retrieval.is_parent(F.col("meta"))).select(F.lit(0).alias("query_id"), "chunk_id")
    return retrieval.parent_context(found, family).select("chunk_id", F.md5("context_text").alias("digest"))


_TREE = """n AS (
  SELECT vec_id AS node_id, 1000000 + vec_id // 20 AS parent_id, 0 AS level, vec_id AS chunk_id FROM embeddings
  UNION ALL SELECT DISTINCT 1000000 + vec_id // 20, 2000000, 1, NULL FROM embeddings
  UNION ALL SELECT 2000000, NULL, 2, NULL
)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary tree over the vectors: twenty neighbours under a summary, all under a root."""
    up = (F.floor(F.col("chunk_id") / 20) + 1_000_000).cast("long")
    leaves = vectors(spark, sf_dir).select(F.col("chunk_id").alias("node_id"), up.alias("parent_id"), F.lit(0).alias("level"), "chunk_id", "vector", F.lit("kb").alias("kb_id"))
    mean = leaves.select("parent_id", F.posexplode("vector").alias("i", "x")).groupBy("parent_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float")).alias("vector"))
    mid = mean.select(F.col("parent_id").alias("node_id"), F.lit(2_000_000).cast("long").alias("parent_id"), F.lit(1).alias("level"), F.lit(None).cast("long").alias("chunk_id"), "vector", F.lit("kb").alias("kb_id"))
    top = spark.createDataFrame([(2_000_000, None, 2, None, [1.0] * 64, "kb")], leaves.schema)
    return leaves.unionByName(mid).unionByName(top)


@query("a4_tree_stats", """
SELECT 'kb' AS kb_id, (SELECT count(*) FROM embeddings) + (SELECT count(DISTINCT vec_id // 20) FROM embeddings) + 1 AS total, (SELECT count(*) FROM embeddings) AS leaves, (SELECT count(DISTINCT vec_id // 20) FROM embeddings) + 1 AS summaries, 2::INTEGER AS max_level,
'0:' || (SELECT count(*) FROM embeddings) || ',1:' || (SELECT count(DISTINCT vec_id // 20) FROM embeddings) || ',2:1' AS by_level, 'partial' AS status""")
def a4_tree_stats(spark, d):
    nodes = tree(spark, d).withColumn("indexing_status", F.when(F.col("level") == 2, "pending").otherwise("indexed"))
    return raptor.stats(nodes).withColumn("by_level", F.array_join(F.transform(F.array_sort(F.map_entries("by_level")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ","))


# ---------------------------------------------------------------- extraction and scalars

_ANSWER = "'Here:' || chr(10) || '```json' || chr(10) || '[{\"项目\": \"nd' || lpad((event_id % 50)::VARCHAR, 3, '0') || '\", \"k\": ' || json_extract_string(props, '$.k') || '}, {\"项目\": \"X-001\", \"k\": 0}]' || chr(10) || '```'"


def _answers(spark, d):
    """Events as a model's answers: a fenced list of payloads."""
    number = F.lpad((F.col("event_id") % 50).cast("string"), 3, "0")
    said = F.concat(F.lit('Here:\n```json\n[{"项目": "nd'), number, F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit('}, {"项目": "X-001", "k": 0}]\n```'))
    return table(spark, d, "events").select("event_id", extraction.payloads(said).alias("found"))


@query("e8_field_extraction", "SELECT event_id, 'nd' || lpad((event_id % 50)::VARCHAR, 3, '0') AS project, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def e8_field_extraction(spark, d):
    fields = extraction.typed(F.col("found")[0], {"项目": "string", "k": "int"})
    return _answers(spark, d).select("event_id", fields["项目"].alias("project"), fields["k"].alias("k"))


@query("e10_payloads", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'ND-' || lpad((event_id % 50)::VARCHAR, 3, '0') END AS confirmed, CASE WHEN event_id % 2 = 0 THEN 'ND-000' ELSE 'ND-' || lpad((event_id % 50)::VARCHAR, 3, '0') END AS project, json_extract_string(props, '$.k') AS k FROM events""")
def e10_payloads(spark, d):
    """Ids confirmed by a text that names other projects (even events) or the answer's first, and the
    payload of a project that is asked for."""
    own = F.concat(F.lit("ND-"), F.lpad((F.col("event_id") % 50).cast("string"), 3, "0"))
    in_text = F.array(F.when(F.col("event_id") % 2 == 0, "OTHER-123").otherwise(own))
    asked = F.when(F.col("event_id") % 2 == 0, "ND-000").otherwise(own)
    chosen = extraction.payload_of(F.col("found"), asked)
    return _answers(spark, d).select("event_id", F.array_join(extraction.confirmed_ids(extraction.payload_ids(F.col("found")), in_text), ",").alias("confirmed"), chosen["项目"].alias("project"), chosen["k"].alias("k"))


@query("n4_chunk_keys", f"WITH {CHUNKS} SELECT chunk_id, md5(document_id || '|' || chunk_index) AS by_place, sha256(text) AS by_content FROM c")
def n4_chunk_keys(spark, d):
    return chunks(spark, d).select("chunk_id", fx.place_key(F.col("document_id"), F.col("chunk_index")).alias("by_place"), F.sha2("text", 256).alias("by_content"))


@query("n6_json_round_trip", "SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS dumped FROM events")
def n6_json_round_trip(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.from_json("props", "map<string,string>")).alias("dumped"))


@query("n9_last_hours", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS said, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END || (s % 86400 // 3600) || 'h ' || (s % 3600 // 60) || 'm' AS age FROM (SELECT *, date_diff('second', date_trunc('second', ts), date_trunc('second', max(ts) OVER ())) AS s FROM events) WHERE s < 72 * 3600")
def n9_last_hours(spark, d):
    """Events of the last 72 hours before the newest, their time, and how long ago it was."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = events.agg(F.max("ts").alias("now"))
    seconds = F.unix_seconds("now") - F.unix_seconds("ts")
    return events.crossJoin(F.broadcast(now)).where(seconds < 72 * 3600).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("said"), fx.duration(seconds).alias("age"))


@query("n12_masked_keys", "SELECT c_custkey, substr(md5(c_custkey::VARCHAR), 1, 4) || '****' || right(md5(c_custkey::VARCHAR), 4) AS masked FROM customer")
def n12_masked_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", fx.masked_key(F.md5(F.col("c_custkey").cast("string"))).alias("masked"))


# ---------------------------------------------------------------- streams

def _event_stream(spark, d):
    """The events table as a stream, be it a file or a folder of them."""
    return audit.event_stream(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)


def _requests(spark, d):
    return relational.audit(_event_stream(spark, d))


@query("t1_audit_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS action, count(*) AS total, count_if(event_type = 'error')::BIGINT AS errors, round(avg(value), 6) AS mean_ms FROM events GROUP BY ALL")
def t1_audit_windows(spark, d):
    """The events as a stream, by hour and action; the last state of all windows."""
    last = audit.gathered(audit.window_stats(_requests(spark, d)), _new(spark, "windows"), "complete")
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "action", "total", "errors", F.round("mean_ms", 6).alias("mean_ms"))


@query("t1_sliding_windows", """WITH w AS (SELECT *, unnest([0, 1, 2]) AS back FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - back * INTERVAL 2 HOUR AS start FROM w)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type AS action, count(*) AS total, count_if(event_type = 'error')::BIGINT AS errors, round(avg(value), 6) AS mean_ms FROM s GROUP BY ALL""")
def t1_sliding_windows(spark, d):
    """The events as a stream: six hours by action, anew every two; the last state of all windows."""
    last = audit.gathered(audit.window_stats(_requests(spark, d), "6 hours", "2 hours"), _new(spark, "sliding"), "complete")
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "action", "total", "errors", F.round("mean_ms", 6).alias("mean_ms"))


@query("t1_sessions", """WITH b AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 8 HOUR, true) AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM b)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS until, count(*) AS requests FROM s GROUP BY user_id, n""")
def t1_sessions(spark, d):
    """The events as a stream: each user's runs without a pause of eight hours."""
    last = audit.gathered(audit.session_stats(_event_stream(spark, d), "8 hours", key="user_id"), _new(spark, "sessions"), "complete")
    second = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return last.select("user_id", second("start").alias("start"), second("end").alias("until"), "requests")


@query("t1_followed", "SELECT a.user_id, a.event_id, b.event_id AS then_id, floor((epoch_us(b.ts) - epoch_us(a.ts)) / 1000)::BIGINT AS waited_ms FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'error' AND b.event_type = 'view'")
def t1_followed(spark, d):
    """Two streams of events, joined: errors, and what the same user viewed within six hours after."""
    of = lambda kind: _event_stream(spark, d).where(F.col("event_type") == kind)
    return audit.gathered(audit.followed(of("error"), of("view"), "6 hours", key="user_id"), _new(spark, "followed"))


@query("t6_rate_limiter")
def t6_rate_limiter(spark, d):
    """At most two requests of a key in a day; refused ones don't count."""
    return audit.gathered(audit.limited(_requests(spark, d), most=2, seconds=24 * 3600), _new(spark, "limited"))


@query("k9_audit_log", "SELECT CASE WHEN event_type = 'error' THEN 'doc_delete' WHEN event_id % 3 = 0 THEN 'retrieve' ELSE 'kb_read' END AS action, count(*) AS n FROM events WHERE event_type = 'error' OR event_id % 3 < 2 GROUP BY ALL")
def k9_audit_log(spark, d):
    bad = F.col("event_type") == "error"
    stream = _event_stream(spark, d)
    path = F.when(bad, "/v1/documents/7").when(F.col("event_id") % 3 == 0, "/v1/retrieve").when(F.col("event_id") % 3 == 1, "/v1/knowledge-bases/2").otherwise("/health")
    method = F.when(bad, "DELETE").when(F.col("event_id") % 3 == 0, "POST").otherwise("GET")
    log = _new(spark, "log")
    audit.append_log(stream.select("event_id", "ts", method.alias("method"), path.alias("path")), log, _new(spark, "log-state")).awaitTermination()
    return spark.read.parquet(log).groupBy("action").agg(F.count("*").alias("n"))


@query("t3_ingest", "SELECT 'completed' AS status, count(*) AS documents, sum(1 + CAST(ceil(greatest(length(text) - 800, 0) / 600.0) AS BIGINT))::BIGINT AS chunks FROM benchmark WHERE length(text) > 0")
def t3_ingest(spark, d):
    """Benchmark items as files of a folder, ingested as a stream; what became of them."""
    folder, state = _new(spark, "files"), _new(spark, "ingest")
    table(spark, d, "benchmark").where("length(text) > 0").select("item_id", "text").write.partitionBy("item_id").option("lineSep", "\x00").text(folder)
    index = tables.IndexTable(spark, f"{state}/index", tables.LEXICAL)
    ingest.ingest(spark, folder, index, f"{state}/status", f"{state}/checkpoint", "kb", "sliding_window", window=800, overlap=200).awaitTermination()
    indexed = index.read().groupBy("document_id").agg(F.count("*").alias("n"))
    return ingest.document_status(spark, f"{state}/status").join(indexed, "document_id", "left").groupBy("status").agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"))
