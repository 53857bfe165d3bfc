"""The registered queries over the driver tables, each with the SQL that gives the same rows.

Documents play the tenant's documents: lang is the tenant, source the knowledge base. Events
play the audit log, benchmark items the queries, embeddings the vectors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.vectors import hash_slot
from ..operators import acl, chunkers, feedback, metadata, model_calls, raptor, relational, retrieval, segmentation
from ..sources.tables import IndexTable, kept, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_TREES: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared relations

CHUNKS = """c AS (
  SELECT doc_id * 100000 + i AS chunk_id, doc_id AS document_id, source AS kb_id, lang AS tenant_id, i AS chunk_index, substr(text, i * 600 + 1, 800) AS text
  FROM (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(length(text) - 800, 0) / 600.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)
)"""
TOKENS = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda t: t <> '')"
ITEMS = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
DENSE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
)"""


def bm25_sql(source: str, name: str = "bm25", k: int = 5) -> str:
    """CTEs that rank ``source`` (chunk_id, text) for q by Okapi BM25."""
    return f"""tok AS (SELECT chunk_id, unnest({TOKENS.format("text")}) AS term FROM {source}),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, len({TOKENS.format("text")}) AS dl FROM {source}),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM q) GROUP BY ALL),
hit AS (SELECT query_id, chunk_id, qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS s FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id), st
  UNION ALL SELECT query_id, chunk_id, 0.0 FROM q, (SELECT chunk_id FROM {source} ORDER BY chunk_id LIMIT {k}) AS z),
raw AS (SELECT query_id, chunk_id, round(sum(s), 9) AS raw FROM hit GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-(raw - 2.0))), 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM raw) WHERE rank <= {k})"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("kb_id"), F.col("lang").alias("tenant_id"), "text")
    return chunkers.sliding_window(docs, 800, 200).withColumn("chunk_id", F.col("document_id") * 100000 + F.col("chunk_index"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("kb_id"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100."""
    return vectors(spark, sf_dir).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def dense_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.dense(vector_queries(spark, sf_dir), vectors(spark, sf_dir), k, exclude_self=True)


# ---------------------------------------------------------------- chunkers

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("c1_simple", f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format("x")}), lambda x: length(x) > 0) AS ps FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ps) = 0 THEN [''] ELSE ps END) AS p, unnest(range(1, greatest(len(ps), 1) + 1)) AS no FROM p),
x AS (SELECT doc_id, no, p, unnest(range(0, 1 + CAST(floor((greatest(length(p), 1) - 1) / 300) AS BIGINT))) AS i FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY no, i) - 1)::INTEGER AS chunk_index, substr(p, i * 300 + 1, 300) AS text FROM x
""")
def c1_simple(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return chunkers.simple(docs, max_chars=300, separator="\\n").select("doc_id", "chunk_index", "text")


@query("c2_sliding_window", f"WITH {CHUNKS} SELECT document_id, chunk_index::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY document_id))::INTEGER AS total_chunks, md5(text) AS digest FROM c")
def c2_sliding_window(spark, d):
    return chunks(spark, d).select("document_id", "chunk_index", "total_chunks", F.md5("text").alias("digest"))


@query("c9_token_window", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(0, 1 + CAST(ceil(greatest(len(w) - 128, 0) / 112.0) AS BIGINT))) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i::INTEGER AS chunk_index, md5(array_to_string(w[i * 112 + 1:i * 112 + 128], ' ')) AS digest FROM x
""")
def c9_token_window(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return chunkers.token_window(docs, 128, 16).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


def _markdown(spark, d):
    """Documents as markdown: each line a paragraph under a heading of its source."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.regexp_replace("text", "\n", "\n\n")).alias("text"))


def _chunked(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "chunk_index", "total_chunks", "text", F.to_json("meta").alias("meta"))


@query("c3_recursive")
def c3_recursive(spark, d):
    return _chunked(chunkers.recursive(_markdown(spark, d), 1024, 256))


@query("c4_markdown")
def c4_markdown(spark, d):
    return _chunked(chunkers.markdown(_markdown(spark, d), 1024, 256))


@query("c5_markdown_section")
def c5_markdown_section(spark, d):
    return _chunked(chunkers.markdown_section(_markdown(spark, d)))


@query("c6_parent_child")
def c6_parent_child(spark, d):
    return _chunked(chunkers.parent_child(_markdown(spark, d)))


@query("c7_code")
def c7_code(spark, d):
    return _chunked(chunkers.code(table(spark, d, "documents").select("doc_id", "text")))


@query("c8_sentence")
def c8_sentence(spark, d):
    return _chunked(chunkers.sentence(table(spark, d, "documents").select("doc_id", "text"), 128, 16))


# ---------------------------------------------------------------- scans and scalars

@query("s9_url_documents", "SELECT page_id, 'url' AS source, url AS title, length(html)::INTEGER AS char_count, md5(html) AS digest FROM pages")
def s9_url_documents(spark, d):
    return table(spark, d, "pages").select("page_id", F.lit("url").alias("source"), F.col("url").alias("title"), F.length("html").alias("char_count"), F.md5("html").alias("digest"))


@query("s11_scope_scan", "SELECT doc_id, source AS kb_id, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')")
def s11_scope_scan(spark, d):
    return relational.in_scope(table(spark, d, "documents"), "en", ["src1", "src2", "src3"]).select("doc_id", F.col("source").alias("kb_id"), "n_chars")


@query("n7_sanitize", """SELECT event_id, '***' AS token, CASE WHEN length(props) > 12 THEN substr(props, 1, 12) || '...' ELSE props END AS props FROM events""")
def n7_sanitize(spark, d):
    safe = fx.sanitized(F.create_map(F.lit("Token"), F.col("user_id").cast("string"), F.lit("props"), F.col("props")), 12)
    return table(spark, d, "events").select("event_id", safe["Token"].alias("token"), safe["props"].alias("props"))


@query("n8_titles", "SELECT conv_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS title FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1")
def n8_titles(spark, d):
    return relational.conversation_titles(table(spark, d, "conversations"))


@query("n10_audit_action", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'doc_delete' WHEN event_id % 3 = 0 THEN 'retrieve' WHEN event_id % 3 = 1 THEN 'kb_read' ELSE NULL END AS action FROM events""")
def n10_audit_action(spark, d):
    e = table(spark, d, "events")
    bad = F.col("event_type") == "error"
    path = F.when(bad, "/v1/documents/7").when(F.col("event_id") % 3 == 0, "/v1/retrieve").when(F.col("event_id") % 3 == 1, "/v1/knowledge-bases/2").otherwise("/health")
    method = F.when(bad, "DELETE").when(F.col("event_id") % 3 == 0, "POST").otherwise("GET")
    return e.select("event_id", fx.audit_action(method, path).alias("action"))


@query("n11_language", """SELECT doc_id, CASE WHEN contains(text, 'def ') AND contains(text, 'import ') THEN 'python' WHEN contains(text, 'function ') OR contains(text, 'const ') OR contains(text, '=>') THEN 'javascript'
  WHEN contains(text, 'public class ') OR contains(text, 'private ') THEN 'java' WHEN contains(text, 'func ') AND contains(text, 'package ') THEN 'go' WHEN contains(text, 'fn ') AND contains(text, 'let mut ') THEN 'rust' ELSE 'python' END AS language FROM documents""")
def n11_language(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.language(F.col("text")).alias("language"))


@query("e9_project_ids", r"""
WITH x AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '\b([A-Z]{2,10}[-_ ]?[0-9]{3,4})\b'), lambda m: regexp_extract(m, '^([A-Z]+)', 1) || '-' || regexp_extract(m, '([0-9]+)$', 1))) AS ids FROM documents)
SELECT doc_id, len(ids)::INTEGER AS n_ids, array_to_string(list_sort(ids), ',') AS ids FROM x WHERE len(ids) > 0""")
def e9_project_ids(spark, d):
    found = table(spark, d, "documents").select("doc_id", fx.project_ids(F.col("text")).alias("ids")).where(F.size("ids") > 0)
    return found.select("doc_id", F.size("ids").alias("n_ids"), F.array_join(F.array_sort("ids"), ",").alias("ids"))


@query("e13_token_estimate", "SELECT doc_id, (length(text) // 4)::BIGINT AS usage_tokens, (length(text) // 2)::BIGINT AS summary_tokens FROM documents")
def e13_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.token_estimate(F.col("text"), 4).alias("usage_tokens"), fx.token_estimate(F.col("text"), 2).alias("summary_tokens"))


@query("e6_summary", r"SELECT doc_id, CASE WHEN length(text) // 2 >= 500 THEN substr(text, 1, 200) || '...' END AS summary FROM documents")
def e6_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", relational.lead_summary(F.col("text"), 500, 200).alias("summary"))


@query("e7_enrichment_context", f"""WITH {CHUNKS}
SELECT chunk_id, coalesce(substr(lag(text) OVER w, 1, 200), '') AS before, coalesce(substr(lead(text) OVER w, 1, 200), '') AS after FROM c WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)""")
def e7_enrichment_context(spark, d):
    return relational.neighbours(chunks(spark, d))


# The router's patterns, as in functions.text.route, words of any letters.
_CODE = r"\b(function|def|class|method|api|endpoint)\b|\b(import|from|require|include)\b|\b(error|exception|bug|fix)\b.*\b(code|function|method)\b|`[^`]+`|[\w\p{L}]+\(\)|\b(how to|how do i)\b.*\b(implement|code|write|create)\b|\.(py|js|ts|java|go|rs|cpp|c|h)\b"
_SEMANTIC = r"^(what|what''s|whats)\s+(is|are|was|were)\b|^(how|why|when|where|who)\b|^(explain|describe|tell me|can you)\b|(什么|为什么|怎么|如何|怎样|哪个|哪些)|(解释|说明|介绍|描述)"
_KEYWORD = r"^[a-z]+(?:_[a-z]+)*$|^[a-z]+(?:-[a-z]+)*$|^\S+$"


@query("r23_router", f"""
WITH t AS (SELECT item_id * 10 + n AS query_id, CASE n WHEN 0 THEN text WHEN 1 THEN split_part(text, ' ', 1) WHEN 2 THEN 'what is ' || text WHEN 3 THEN '请解释 ' || split_part(text, ' ', 2) ELSE split_part(text, ' ', 1) || '()' END AS q FROM benchmark, range(5) AS r(n)),
k AS (SELECT query_id, CASE WHEN regexp_matches(q, '(?i){_CODE}') THEN 'code' WHEN regexp_matches(q, '(?i){_SEMANTIC}') THEN 'semantic'
  WHEN len({TOKENS.format("q")}) <= 3 AND regexp_matches(trim(lower(q), ' ' || chr(9) || chr(10) || chr(13)), '{_KEYWORD}') THEN 'keyword' ELSE 'hybrid' END AS query_type FROM t)
SELECT query_id, query_type, CASE query_type WHEN 'semantic' THEN 'dense' WHEN 'keyword' THEN 'bm25' ELSE 'hybrid' END AS retriever, CASE query_type WHEN 'keyword' THEN 0.7::DOUBLE WHEN 'hybrid' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM k""")
def r23_router(spark, d):
    return _requests_of_all_classes(spark, d).select("query_id", fx.route(F.col("query")).alias("r")).select("query_id", "r.query_type", "r.retriever", F.col("r.confidence").cast("double").alias("confidence"))


def _requests_of_all_classes(spark, d):
    """Whole items and, of each, a word, a question, a Chinese request and a call: all classes."""
    first = F.substring_index("text", " ", 1)
    forms = F.array(F.col("text"), first, F.concat(F.lit("what is "), "text"), F.concat(F.lit("请解释 "), F.split_part("text", F.lit(" "), F.lit(2))), F.concat(first, F.lit("()")))
    q = table(spark, d, "benchmark").select("item_id", F.posexplode(forms).alias("n", "q"))
    return q.select((F.col("item_id") * 10 + F.col("n")).alias("query_id"), F.col("q").alias("query"))


# ---------------------------------------------------------------- retrieval

@query("r1_dense", f"WITH {DENSE} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM dense WHERE rank <= 10")
def r1_dense(spark, d):
    return dense_hits(spark, d, 10).select("query_id", "chunk_id", "score", "rank")


@query("r2_dense_per_kb", f"""WITH {DENSE}, k AS (SELECT dense.*, label AS kb_id, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, chunk_id) AS r FROM dense JOIN embeddings ON vec_id = chunk_id)
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k WHERE r <= 2) WHERE rank <= 8""")
def r2_dense_per_kb(spark, d):
    per_kb = retrieval.dense(vector_queries(spark, d), vectors(spark, d), 2, exclude_self=True, by=("kb_id",)).drop("rank")
    return retrieval.top_k(per_kb, 8).select("query_id", "chunk_id", "score", "rank")


@query("r5_bm25", f"WITH {CHUNKS}, {ITEMS}, {bm25_sql('c')} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM bm25")
def r5_bm25(spark, d):
    return retrieval.bm25(items(spark, d), chunks(spark, d), 5)


# Texts of two languages are spelled in Han characters without spaces: a word's length gives the number
# of its characters, its hash which ones. So the given tables hold mixed texts.
_HAN_OF = "array_to_string(list_transform(" + TOKENS.format("{0}") + """, lambda w: list_reduce(list_transform(range(1, CASE WHEN length(w) <= 3 THEN 2 WHEN length(w) <= 8 THEN 3 ELSE 4 END), lambda i: chr((19968 + (('0x' || substr(md5(regexp_replace(w, '[.,]$', '')), i * 4, 4))::INTEGER % 300))::INTEGER)), lambda x, y: x || y)
    || CASE WHEN regexp_matches(w, '[.,]$') THEN '。' ELSE '' END), '')"""
MIXED = f"m AS (SELECT doc_id, CASE WHEN lang IN ('de', 'es') THEN {_HAN_OF.format('text')} ELSE text END AS text FROM documents)"


def in_han(text):
    bare = lambda w: F.regexp_replace(w, "[.,]$", "")
    code = lambda w, i: F.lpad(F.hex((F.conv(F.substr(F.md5(bare(w)), i * 4, F.lit(4)), 16, 10).cast("int") % 300 + 19968).cast("long")), 4, "0")
    number = lambda w: F.when(F.length(w) <= 3, 1).when(F.length(w) <= 8, 2).otherwise(3)
    spelled = lambda w: F.decode(F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), number(w)), lambda i: code(w, i)), "")), "UTF-16BE")
    return F.array_join(F.transform(fx.tokens(text), lambda w: F.concat(spelled(w), F.when(w.rlike("[.,]$"), "。").otherwise(""))), "")


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    han = F.col("lang").isin("de", "es")
    return table(spark, sf_dir, "documents").withColumn("text", F.when(han, in_han(F.col("text"))).otherwise(F.col("text")))


@query("r5_dictionary", f"""WITH {MIXED}, runs AS (SELECT unnest(regexp_extract_all(text, '\\p{{Han}}+')) AS run FROM m),
g AS (SELECT word, count(*) AS n FROM (SELECT substr(run, i, k) AS word FROM (SELECT run, k, unnest(range(1, length(run) - k + 2)) AS i FROM runs, range(1, 5) AS r(k))) GROUP BY word HAVING length(word) = 1 OR count(*) >= 5),
t AS (SELECT sum(n)::DOUBLE AS total FROM g WHERE length(word) = 1),
c AS (SELECT word, n, unnest(range(1, length(word))) AS k FROM g WHERE length(word) > 1),
w AS (SELECT c.word, c.n, max(h.n::DOUBLE * e.n) AS by_chance FROM c JOIN g h ON h.word = substr(c.word, 1, k) JOIN g e ON e.word = substr(c.word, k + 1) GROUP BY ALL),
d AS (SELECT word, n FROM g WHERE length(word) = 1 UNION ALL SELECT word, n FROM w, t WHERE n * total >= 10.0::DOUBLE * by_chance)
SELECT word, n, round(ln(n::DOUBLE) - ln((SELECT sum(n) FROM d)::DOUBLE), 9) AS log_p FROM d""")
def r5_dictionary(spark, d):
    """The words that the runs of Han characters of all documents give."""
    return segmentation.learn(segmentation.han_runs(mixed_documents(spark, d))).select("word", "n", F.round("log_p", 9).alias("log_p"))


@query("r5_bm25_segmented")
def r5_bm25_segmented(spark, d):
    """BM25 over mixed texts: chunks and queries are cut into words by the documents' own dictionary."""
    docs = kept(mixed_documents(spark, d).select(F.col("doc_id").alias("document_id"), F.col("source").alias("kb_id"), "text"), "mixed")
    words = kept(segmentation.learn(segmentation.han_runs(docs)), "words")
    c = chunkers.sliding_window(docs, 800, 200).withColumn("chunk_id", F.col("document_id") * 100000 + F.col("chunk_index"))
    index = kept(segmentation.segmented(c, words, "chunk_id").select("chunk_id", "words", F.size("words").alias("dl")), "segmented-index")
    q = items(spark, d).withColumn("query", F.when(F.col("query_id") % 2 == 1, in_han(F.col("query"))).otherwise(F.col("query")))
    return retrieval.bm25(segmentation.segmented(q, words, "query_id", "query"), None, 5, index=index)


@query("r6_bm25_per_kb", f"""WITH {CHUNKS}, {ITEMS},
tok AS (SELECT kb_id, chunk_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS term FROM c),
tf AS (SELECT kb_id, chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT kb_id, chunk_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS dl FROM c),
st AS (SELECT kb_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY kb_id),
df AS (SELECT kb_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (kb_id) GROUP BY kb_id, term, n),
mi AS (SELECT kb_id, avg(raw) AS m FROM df GROUP BY kb_id),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(query, '\\s+'), lambda t: t <> '')) AS term FROM q) GROUP BY ALL),
s AS (SELECT query_id, kb_id, chunk_id, round(sum(qtf * (CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qt JOIN df USING (term) JOIN mi USING (kb_id) JOIN tf USING (kb_id, term) JOIN dl USING (kb_id, chunk_id) JOIN st USING (kb_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, chunk_id) AS r FROM s)
SELECT query_id, kb_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k WHERE r <= 5) WHERE rank <= 5""")
def r6_bm25_per_kb(spark, d):
    return retrieval.bm25_per_kb(items(spark, d), chunks(spark, d), 5)


_SLOTS = "(SELECT {0}, slot, count(*) AS c FROM (SELECT {0}, (('0x' || substr(md5(w), 25, 8))::BIGINT % 1024)::INTEGER AS slot FROM (SELECT {0}, unnest(list_filter(regexp_split_to_array({1}, '\\s+'), lambda t: t <> '')) AS w FROM {2})) GROUP BY ALL)"
_LEXICAL = f"""WITH {CHUNKS}, {ITEMS}, qs AS {_SLOTS.format("query_id", "query", "q")}, cs AS {_SLOTS.format("chunk_id", "text", "c")},
nq AS (SELECT query_id, sum(c * c) AS nq FROM qs GROUP BY ALL), nc AS (SELECT chunk_id, sum(c * c) AS nc FROM cs GROUP BY ALL),
dots AS (SELECT query_id, chunk_id, sum(dot) AS dot FROM (SELECT query_id, chunk_id, sum(qs.c * cs.c) AS dot FROM qs JOIN cs USING (slot) GROUP BY ALL
  UNION ALL SELECT query_id, chunk_id, 0 FROM nq, (SELECT chunk_id FROM nc ORDER BY chunk_id LIMIT 10) AS z) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(dot / sqrt((nq * nc)::DOUBLE), 9) AS score FROM dots JOIN nq USING (query_id) JOIN nc USING (chunk_id))) WHERE rank <= 10),
{bm25_sql("c", "second", 10)}"""


@query("e1_hash_embedding", f"""WITH {CHUNKS}, {ITEMS}, n AS (SELECT 'chunk' AS kind, chunk_id AS id, slot, c FROM {_SLOTS.format("chunk_id", "text", "c")} UNION ALL SELECT 'query', query_id, slot, c FROM {_SLOTS.format("query_id", "query", "q")})
SELECT kind, id, slot, round(c / sqrt(sum(c * c) OVER (PARTITION BY kind, id)), 9) AS value FROM n""")
def e1_hash_embedding(spark, d):
    """The sparse form of the embeddings of every chunk and every benchmark item."""
    c = retrieval.slots(chunks(spark, d), "chunk_id", "text").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "slot", "c")
    q = retrieval.slots(items(spark, d), "query_id", "query").select(F.lit("query").alias("kind"), F.col("query_id").alias("id"), "slot", "c")
    return c.unionByName(q).select("kind", "id", "slot", F.round(F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("kind", "id"))), 9).alias("value"))


def _dense_and_lexical(spark, d):
    c, q = chunks(spark, d), items(spark, d)
    return retrieval.hash_dense(q, c, 10), retrieval.bm25(q, c, 10)


def _fused_sql(gain_a: str, gain_b: str, k: int) -> str:
    return f"""{_LEXICAL}, f AS (SELECT query_id, chunk_id, round(sum(g), 9) AS score FROM (SELECT query_id, chunk_id, {gain_a} AS g FROM top UNION ALL SELECT query_id, chunk_id, {gain_b} FROM second) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= {k}"""


@query("r8_hybrid", _fused_sql("0.7 * score", "0.3 * score", 5))
def r8_hybrid(spark, d):
    return retrieval.hybrid(*_dense_and_lexical(spark, d), 5)


@query("r10_fusion_rrf", _fused_sql("1.0 / (60 + rank)", "1.0 / (60 + rank)", 5))
def r10_fusion_rrf(spark, d):
    return retrieval.fusion(*_dense_and_lexical(spark, d), 5)


@query("r11_ensemble", _fused_sql("2.0 / 3 * score", "1.0 / 3 * score", 5))
def r11_ensemble(spark, d):
    return retrieval.ensemble(list(_dense_and_lexical(spark, d)), 5, "weighted", [2.0, 1.0])


_VARIANTS = f"""{ITEMS.replace("q AS", "q0 AS")},
vr AS (SELECT query_id AS base, unnest([query, array_to_string(list_filter({TOKENS.format("query")}, lambda w: length(w) > 3), ' '), array_to_string(list_reverse({TOKENS.format("query")}), ' ')]) AS query, unnest([0, 1, 2]) AS variant_no FROM q0),
vd AS (SELECT base, query, min(variant_no) AS variant_no FROM vr GROUP BY ALL),
q AS (SELECT base * 10 + row_number() OVER (PARTITION BY base ORDER BY variant_no) - 1 AS query_id, base, query, row_number() OVER (PARTITION BY base ORDER BY variant_no) - 1 AS variant_no FROM vd)"""


def _multi_query(q: DataFrame, c: DataFrame) -> DataFrame:
    v = q.select("query_id", F.posexplode(retrieval.keyword_variants(F.col("query"))).alias("variant_no", "query")).withColumn("variant_id", F.col("query_id") * 10 + F.col("variant_no"))
    hits = retrieval.bm25(v.select(F.col("variant_id").alias("query_id"), "query"), c, 5).withColumnRenamed("query_id", "variant_id")
    return retrieval.over_variants(hits, v, 5)


@query("r12_multi_query", f"""WITH {CHUNKS}, {_VARIANTS}, {bm25_sql('c')},
f AS (SELECT base AS query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, arg_min(score, variant_no) AS score FROM bm25 JOIN q USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, score, rrf_score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f) WHERE rank <= 5""")
def r12_multi_query(spark, d):
    return _multi_query(items(spark, d), chunks(spark, d))


@query("r14_self_query", f"""WITH {DENSE}, m AS (SELECT query_id, chunk_id, score FROM dense JOIN embeddings e ON e.vec_id = chunk_id WHERE rank <= 30 AND contains(e.label::VARCHAR, '3'))
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) WHERE rank <= 10""")
def r14_self_query(spark, d):
    parsed = retrieval.parsed_filters(F.lit("find things label:3"))
    q = vector_queries(spark, d).select("query_id", parsed["filters"].alias("filters"))
    c = vectors(spark, d).select("chunk_id", F.create_map(F.lit("label"), F.col("kb_id").cast("string")).alias("meta"))
    return retrieval.self_query(dense_hits(spark, d, 30), q, c, 10)


@query("r15_parent_document", f"""WITH {DENSE}, p AS (SELECT query_id, (chunk_id // 10) * 10 AS parent, score, rank FROM dense WHERE rank <= 15),
f AS (SELECT query_id, parent AS chunk_id, max(score) AS score, count(*) AS n FROM p GROUP BY ALL)
SELECT query_id, chunk_id, score, least(n, 3)::INTEGER AS n_previews, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 5""")
def r15_parent_document(spark, d):
    """Ten neighbouring vectors form a document; each tenth is the parent of those after it."""
    doc = F.floor(F.col("chunk_id") / 10).cast("long")
    kids = vectors(spark, d).select("chunk_id", doc.alias("document_id"), F.lit("p_0").alias("parent_id"), F.lit(None).cast("string").alias("local_id"), F.concat(F.lit("child "), F.col("chunk_id").cast("string")).alias("text"))
    heads = kids.select((F.col("document_id") * 10).alias("chunk_id"), "document_id", F.lit(None).cast("string").alias("parent_id"), F.lit("p_0").alias("local_id"), F.lit("parent").alias("text")).distinct()
    hits = dense_hits(spark, d, 15).withColumn("chunk_id", F.col("chunk_id") + 1_000_000)
    tree = kids.withColumn("chunk_id", F.col("chunk_id") + 1_000_000).unionByName(heads)
    return retrieval.parent_document(hits, tree, 5).select("query_id", "chunk_id", "score", F.size("matched_children").alias("n_previews"), "rank")


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary tree that clustering builds over all embeddings, whose texts are their names. It is
    built once a session and folder and read by every query on trees."""
    key = (spark.sparkContext.applicationId, shared_folder(spark), sf_dir)
    if key in _TREES:
        return _TREES[key]
    leaves = vectors(spark, sf_dir).select(F.col("chunk_id").alias("node_id"), "chunk_id", F.concat(F.lit("vector "), F.col("chunk_id").cast("string")).alias("text"), "vector")
    _TREES[key] = kept(raptor.build(leaves), "tree")
    return _TREES[key]


@query("e4_raptor_build")
def e4_raptor_build(spark, d):
    return built(spark, d).select("node_id", "parent_id", "level", "chunk_id", "text")


@query("e5_tree_upkeep")
def e5_tree_upkeep(spark, d):
    """All embeddings in a stored tree: nine of ten build it, the others come later and are added."""
    leaves = kept(vectors(spark, d).select(F.col("chunk_id").alias("node_id"), "chunk_id", F.concat(F.lit("vector "), F.col("chunk_id").cast("string")).alias("text"), "vector"), "leaves")
    table = IndexTable(spark, f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}", raptor.TREES, raptor.TREE_KEY)
    late = F.pmod(F.xxhash64("node_id"), F.lit(10)) == 0
    # ids of summaries follow those of all leaves
    top = leaves.agg(F.max("node_id")).head()[0] or 0
    tree = kept(raptor.build(leaves.where(~late)), "tree")
    above = lambda c: F.when(F.col("level") + int(c == "parent_id") > 0, F.col(c) + top + 1).otherwise(F.col(c)).alias(c)
    raptor.store(tree.select(above("node_id"), above("parent_id"), "level", "chunk_id", "text", "vector"), "kb", table)
    raptor.add(leaves.where(late), "kb", table)
    return table.read().select("kb_id", "node_id", "parent_id", "level", "chunk_id", "text")


@query("a4_raptor_stats")
def a4_raptor_stats(spark, d):
    return raptor.stats(built(spark, d).withColumn("kb_id", F.lit("kb")))


@query("r16_raptor_collapsed")
def r16_raptor_collapsed(spark, d):
    """Summaries are searched as nodes beside the leaves."""
    nodes = built(spark, d)
    hits = retrieval.dense(vector_queries(spark, d), nodes.select(F.col("node_id").alias("chunk_id"), "vector"), 10, exclude_self=True)
    return raptor.collapsed(hits.withColumnRenamed("chunk_id", "node_id"), nodes, 10)


@query("r18_leaf_search")
def r18_leaf_search(spark, d):
    nodes = built(spark, d)
    return raptor.descendants(nodes, nodes.where("level > 0")).join(nodes.where("level = 0").select("node_id"), "node_id", "left_semi").select("root", "node_id")


@query("r17_raptor_traversal")
def r17_raptor_traversal(spark, d):
    return raptor.traversal(vector_queries(spark, d), built(spark, d), 5)


@query("r19_rerank", f"""WITH {CHUNKS}, {ITEMS}, {bm25_sql('c', k=20)},
s AS (SELECT query_id, chunk_id, round(len(list_intersect(list_distinct({TOKENS.format("query")}), {TOKENS.format("c.text")})) / greatest(len(list_distinct({TOKENS.format("query")})), 1), 9) AS score FROM bm25 JOIN q USING (query_id) JOIN c USING (chunk_id))
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def r19_rerank(spark, d):
    c, q = chunks(spark, d), items(spark, d)
    return retrieval.rerank(retrieval.bm25(q, c, 20), q, c, 5)


@query("r19_rerank_none", f"WITH {DENSE} SELECT query_id, chunk_id, round(1 - 0.01 * (rank - 1), 9)::DOUBLE AS score, rank::INTEGER AS rank FROM dense WHERE rank <= 5")
def r19_rerank_none(spark, d):
    return retrieval.rerank(dense_hits(spark, d, 10), None, None, 5, "none")


@query("r20_context_window", f"""WITH {CHUNKS}, n AS (
  SELECT h.chunk_id, length(h.text) AS own, x.chunk_index - h.chunk_index AS off, x.text, length(h.text) + sum(length(x.text)) OVER (PARTITION BY h.chunk_id, sign(x.chunk_index - h.chunk_index) ORDER BY abs(x.chunk_index - h.chunk_index)) AS used
  FROM c h JOIN c x ON x.document_id = h.document_id AND x.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2),
m AS (SELECT *, coalesce(max(used - own) FILTER (off < 0 AND used <= 2400) OVER (PARTITION BY chunk_id), 0) AS taken FROM n)
SELECT chunk_id AS query_id, chunk_id, string_agg(text, chr(10) || chr(10) ORDER BY off) AS context_text, count(*) FILTER (off < 0) AS n_before, count(*) FILTER (off > 0) AS n_after
FROM m WHERE off = 0 OR (off < 0 AND used <= 2400) OR (off > 0 AND used + taken <= 2400) GROUP BY chunk_id""")
def r20_context_window(spark, d):
    """Every chunk's window; 2400 characters hold three of five whole chunks."""
    c = chunks(spark, d)
    return retrieval.context_window(c.select(F.col("chunk_id").alias("query_id"), "chunk_id"), c, 2, 2, 1200)


@query("e12_prompt", f"""WITH {CHUNKS}, {ITEMS}, {bm25_sql('c', k=3)},
p AS (SELECT query_id, string_agg('[来源 ' || rank || '] ' || kb_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS x FROM bm25 JOIN c USING (chunk_id) GROUP BY query_id)
SELECT query_id, '参考资料:' || chr(10) || x || chr(10) || chr(10) || '问题: ' || query AS prompt FROM q JOIN p USING (query_id)""")
def e12_prompt(spark, d):
    c, q = chunks(spark, d), items(spark, d)
    return retrieval.prompt(retrieval.bm25(q, c, 3), c.withColumn("title", F.col("kb_id")), q)


# ---------------------------------------------------------------- model calls

@query("e2_model_embedding", f"""WITH {CHUNKS}, n AS {_SLOTS.format("chunk_id", "text", "c")}
SELECT chunk_id, slot, round(c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)), 9) AS value FROM n""")
def e2_model_embedding(spark, d):
    """Every chunk through the call of a model that takes sixty-four texts; slots that aren't 0."""
    found = model_calls.embed(chunks(spark, d).select("chunk_id", "text"), "text", model_calls.hash_embedder(), model_calls.limits_of("siliconflow"))
    filled = F.filter(F.transform("vector", lambda v, i: F.struct(i.alias("slot"), F.round(v, 9).alias("value"))), lambda s: s["value"] != 0)
    return found.select("chunk_id", F.explode(filled).alias("s")).select("chunk_id", "s.slot", "s.value")


@query("r19_rerank_model", f"""WITH {CHUNKS}, {ITEMS}, {bm25_sql('c', k=20)},
s AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-6.0 * (len(list_intersect(list_distinct({TOKENS.format("query")}), {TOKENS.format("c.text")}))::DOUBLE / greatest(len(list_distinct({TOKENS.format("query")})), 1) - 0.5))), 9) AS score FROM bm25 JOIN q USING (query_id) JOIN c USING (chunk_id))
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def r19_rerank_model(spark, d):
    """Twenty lexical hits of every item, scored as pairs by a model that gives logits."""
    c, q = chunks(spark, d), items(spark, d)
    return model_calls.rerank(retrieval.bm25(q, c, 20), q, c, model_calls.overlap_scorer(), 5, logits=True)


def _topic(texts: list) -> list:
    """An offline model for routes: long requests are about meaning; of others it isn't sure."""
    return ["Semantic " if len(t.split()) >= 12 else "unsure" for t in texts]


@query("r24_router_model", ORACLE["r23_router"].replace("CASE WHEN regexp_matches", f"CASE WHEN len(list_filter(regexp_split_to_array(q, '\\s+'), lambda t: t <> '')) >= 12 THEN 'model' WHEN regexp_matches", 1)
    .replace("SELECT query_id, query_type, CASE query_type", "SELECT query_id, CASE query_type WHEN 'model' THEN 'semantic' ELSE query_type END AS query_type, query_type = 'model' AS by_model, CASE query_type WHEN 'model' THEN 'dense'")
    .replace("CASE query_type WHEN 'keyword' THEN 0.7::DOUBLE", "CASE query_type WHEN 'model' THEN 0.9::DOUBLE WHEN 'keyword' THEN 0.7::DOUBLE"))
def r24_router_model(spark, d):
    """The router's requests by a model's answer, and by the rules where it has none of the classes."""
    return model_calls.route(_requests_of_all_classes(spark, d), _topic, {"semantic": "dense", "keyword": "bm25", "code": "hybrid", "hybrid": "hybrid"})


# ---------------------------------------------------------------- feedback and metadata

_SECOND = re.sub(r"\b(qt|hit|raw|q)\b", r"\1_2", bm25_sql("c", "second_hits")[bm25_sql("c", "second_hits").index("qt AS"):])


@query("r25_feedback", f"""WITH {CHUNKS}, {ITEMS}, {bm25_sql('c', 'first', 10)},
m AS (SELECT query_id, chunk_id, score / sum(score) OVER (PARTITION BY query_id) AS mass FROM first),
said AS (SELECT query_id, mass / len({TOKENS.format("text")}) AS part, unnest({TOKENS.format("text")}) AS term FROM m JOIN c USING (chunk_id)),
w AS (SELECT query_id, term, round(sum(part), 9) AS weight FROM said WHERE length(term) >= 4 GROUP BY ALL),
own AS (SELECT query_id, unnest(list_distinct({TOKENS.format("query")})) AS term FROM q),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS no FROM w ANTI JOIN own USING (query_id, term)),
t AS (SELECT query_id, string_agg(term, ' ' ORDER BY no) AS terms FROM best WHERE no <= 10 GROUP BY query_id),
v AS (SELECT query_id AS base, 0 AS variant_no, query FROM q UNION ALL SELECT query_id, 1, query || ' ' || terms FROM q JOIN t USING (query_id) UNION ALL SELECT query_id, 2, terms FROM t),
q_2 AS (SELECT base * 10 + variant_no AS query_id, base, variant_no, query FROM v), {_SECOND},
f AS (SELECT base AS query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, arg_min(score, variant_no) AS score FROM second_hits JOIN q_2 USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, score, rrf_score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f) WHERE rank <= 5""")
def r25_feedback(spark, d):
    """Every item beside what its first ten hits say: three variants, fused."""
    c, q = chunks(spark, d), items(spark, d)
    index = kept(retrieval.lexical_index(c), "index")
    said = feedback.variants(q, retrieval.bm25(q, c, 10, index=index), c)
    v = kept(said.withColumn("variant_id", F.col("query_id") * 10 + F.col("variant_no")), "variants")
    hits = retrieval.bm25(v.select(F.col("variant_id").alias("query_id"), "query"), c, 5, index=index)
    return retrieval.over_variants(hits.withColumnRenamed("query_id", "variant_id"), v, 5)


def _filters(spark, d):
    """Filters of every item, by its id: of a source, of part of a language's name, of lengths."""
    i, text = F.col("query_id"), lambda c: F.to_json(F.struct(c.alias("v")))
    quoted = lambda c: F.regexp_extract(text(c), ":(.*)}$", 1)
    one = lambda key, op, value: F.struct(F.lit(key).alias("key"), F.lit(op).alias("op"), value.alias("value"))
    source = F.when(i % 3 != 2, one("source", "eq", quoted(F.concat(F.lit("src"), (i % 8).cast("string")))))
    lang = F.when(i % 4 == 1, one("lang", "contains", F.lit('"E"')))
    low, high = F.when(i % 2 == 0, one("n_chars", "ge", (i * 20).cast("string"))), one("$.n_chars", "le", (i * 50 + 1500).cast("string"))
    none = F.when(i % 7 == 0, one("owner", "eq", F.lit("null")))
    return items(spark, d).select("query_id", F.explode(F.array_compact(F.array(source, lang, low, high, none))).alias("f")).select("query_id", "f.*")


_FITS = "(i % 3 = 2 OR source = 'src' || i % 8) AND (i % 4 <> 1 OR contains(lower(lang), 'e')) AND (i % 2 <> 0 OR n_chars >= i * 20) AND n_chars <= i * 50 + 1500"


@query("f3_filters", f"SELECT i AS query_id, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM documents JOIN (SELECT item_id AS i FROM benchmark) AS b ON {_FITS} GROUP BY i")
def f3_filters(spark, d):
    """The filters of every item over all documents: how many fit, and the sum of their ids."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", metadata.of_columns("source", "lang", "n_chars").alias("meta"))
    found = metadata.matching(items(spark, d), _filters(spark, d), c, ["source"])
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))


@query("f4_filtered_hits", f"""WITH {CHUNKS}, {ITEMS}, {bm25_sql('c', k=50)}, f AS (SELECT query_id AS i, chunk_id, score FROM bm25)
SELECT i AS query_id, chunk_id, score, (row_number() OVER (PARTITION BY i ORDER BY score DESC, chunk_id))::INTEGER AS rank FROM f JOIN c USING (chunk_id) JOIN documents ON doc_id = document_id WHERE {_FITS}""")
def f4_filtered_hits(spark, d):
    """Of fifty lexical hits of every item those that meet its filters, as a request has it."""
    c, q = chunks(spark, d), items(spark, d)
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), metadata.of_columns("source", "lang", "n_chars").alias("meta"))
    return metadata.filtered(retrieval.bm25(q, c, 50), _filters(spark, d), c.drop("meta").join(meta, "document_id"))


# ---------------------------------------------------------------- filters and ACL

def users(spark: SparkSession) -> DataFrame:
    rows = [("u0", [], [], "public", True), ("u1", ["r1"], [], "restricted", False), ("u2", [], ["g2"], "restricted", False), ("u3", ["r1"], ["g2"], "public", False), ("src4", [], [], "restricted", False)]
    return spark.createDataFrame(rows, "user_id string, roles array<string>, groups array<string>, clearance string, is_admin boolean")


def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the ACL that their labels and ids give them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    level = F.when(F.col("toxic") == 1, "restricted").when(F.col("toxic") == 0, "public").otherwise("internal")
    return docs.join(labels, "doc_id", "left").select("doc_id", level.alias("sensitivity_level"), F.array("source").alias("acl_users"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("r1"))).alias("acl_roles"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("g2"))).alias("acl_groups"))


_ACL = """u AS (SELECT * FROM (VALUES ('u0', false, false, false, true), ('u1', true, false, true, false), ('u2', false, true, true, false), ('u3', true, true, false, false), ('src4', false, false, true, false)) AS t(user_id, r1, g2, clear, admin)),
l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
p AS (SELECT user_id, doc_id, admin, clear, coalesce(toxic = 0, false) AS pub, source = user_id OR (r1 AND doc_id % 5 = 0) OR (g2 AND doc_id % 7 = 0) AS named FROM documents LEFT JOIN l USING (doc_id), u)"""


@query("f5_acl_trim", f"WITH {_ACL} SELECT user_id, doc_id FROM p WHERE admin OR pub OR (clear AND named)")
def f5_acl_trim(spark, d):
    return retrieval.every_pair(users(spark), protected(spark, d).withColumnRenamed("doc_id", "chunk_id")).where(acl.allowed()).select("user_id", F.col("chunk_id").alias("doc_id"))


@query("f6_acl_pushdown", f"WITH {_ACL} SELECT user_id, doc_id FROM p WHERE pub OR named")
def f6_acl_pushdown(spark, d):
    return retrieval.every_pair(users(spark), protected(spark, d).withColumnRenamed("doc_id", "chunk_id")).where(acl.pushdown()).select("user_id", F.col("chunk_id").alias("doc_id"))


@query("f7_acl_blocked", f"WITH {_ACL} SELECT doc_id AS query_id, NOT bool_or(admin OR pub OR (clear AND named)) AS acl_blocked FROM p WHERE user_id = 'u1' GROUP BY doc_id")
def f7_acl_blocked(spark, d):
    hits = protected(spark, d).withColumn("query_id", F.col("doc_id")).withColumn("user_id", F.lit("u1"))
    return acl.blocked(hits, users(spark))


@query("f2_threshold", f"WITH {DENSE} SELECT query_id, chunk_id, score FROM dense WHERE rank <= 20 AND score >= 0.2")
def f2_threshold(spark, d):
    return retrieval.threshold(dense_hits(spark, d, 20), 0.2).select("query_id", "chunk_id", "score")


for _name, (_f, _sql) in relational.registered(table).items():
    QUERIES[_name] = _f
    if _sql:
        ORACLE[_name] = _sql


from . import service  # noqa: E402, F401  (registers its queries)
