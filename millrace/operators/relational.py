"""Listings, joins, aggregates, windows and set operations of the service's own tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shortened
from ..streaming.ingest import retry_outcomes


def in_scope(docs: DataFrame, tenant: str, kbs: Sequence[str], tenant_col: str = "lang", kb_col: str = "source") -> DataFrame:
    """A tenant's rows in some knowledge bases; both predicates reach the scan."""
    return docs.where((F.col(tenant_col) == tenant) & F.col(kb_col).isin(*kbs))


def scope_violations(requested: Column, scope: Column) -> Column:
    """Requested knowledge bases that a key's scope doesn't hold; an empty scope holds all."""
    return F.when(F.size(scope) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array_except(requested, scope))


def lead_summary(text: Column, min_tokens: int = 500, chars: int = 200) -> Column:
    """The start of texts long enough to need a summary (the offline summarizer)."""
    return F.when(F.floor(F.length(text) / 2) >= min_tokens, shortened(text, chars))


def neighbours(chunks: DataFrame, chars: int = 200) -> DataFrame:
    """(chunk_id, before, after): the starts of the chunks beside each, for enrichment."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    side = lambda c: F.coalesce(F.substring(c, 1, chars), F.lit(""))
    return chunks.select("chunk_id", side(F.lag("text").over(w)).alias("before"), side(F.lead("text").over(w)).alias("after"))


def conversation_titles(messages: DataFrame) -> DataFrame:
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("text"))
    return first.select("conv_id", shortened(F.col("text"), 50).alias("title"))


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a listing: sort, offset, limit, as one top-k and no full sort."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def audit(events: DataFrame) -> DataFrame:
    """Events as audit rows."""
    return events.select("event_id", "ts", F.col("user_id").alias("api_key_id"), F.col("event_type").alias("action"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"))


def audit_filter(rows: DataFrame, action: str | None = None, since: str | None = None, until: str | None = None, min_status: int | None = None) -> DataFrame:
    """Rows that fit every filter that is given."""
    tests = [F.col("action") == action if action else None, F.col("ts") >= F.lit(since).cast("timestamp_ntz") if since else None, F.col("ts") < F.lit(until).cast("timestamp_ntz") if until else None, F.col("status_code") >= min_status if min_status else None]
    for t in tests:
        if t is not None:
            rows = rows.where(t)
    return rows


def audit_stats(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, errors (status 400 and up), their share (0 of none), mean duration."""
    errors = F.count_if(F.col("status_code") >= 400)
    share = F.when(F.count("*") > 0, F.round(errors / F.count("*"), 6)).otherwise(0.0)
    return rows.groupBy(*by).agg(F.count("*").alias("total"), errors.alias("errors"), share.alias("error_rate"), F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"))


def rate_counts(rows: DataFrame, key: str = "api_key_id", seconds: int = 60) -> DataFrame:
    """Requests of a key in the window that ends with each: what a limiter sees."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("in_window", F.count("*").over(w))


def last_calls(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Per action, over its last calls: how many, mean and longest duration, errors."""
    order = Window.partitionBy("action").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return kept.groupBy("action").agg(F.count("*").alias("calls"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.count_if(F.col("status_code") >= 400).alias("errors"))


def merged_config(*layers: Column) -> Column:
    """Of maps from weak to strong, for each key the strongest value that isn't null."""
    keys = F.array_distinct(F.flatten(F.array(*(F.map_keys(m) for m in layers))))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(*(F.element_at(m, k) for m in reversed(layers))).alias("value"))))


def newest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def valid_keys(presented: DataFrame, keys: DataFrame, tenants: DataFrame, now: Column) -> DataFrame:
    """(request_id, key_id, verdict) of presented keys: ok; disabled, where the tenant is not active; or
    invalid, where no key of that hash is neither revoked nor expired. ``presented``: request_id,
    secret; ``keys``: key_id, hashed_key, revoked, expires_at, tenant_id; ``tenants``: tenant_id, status."""
    good = keys.where(~F.col("revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).join(tenants, "tenant_id")
    asked = presented.select("request_id", F.sha2("secret", 256).alias("hashed_key"))
    verdict = F.when(F.col("key_id").isNull(), "invalid").when(F.col("status") != "active", "disabled").otherwise("ok")
    return asked.join(good, "hashed_key", "left").select("request_id", "key_id", verdict.alias("verdict"))


def to_retry(chunks: DataFrame, most: int = 3, n: int = 50) -> DataFrame:
    """The next ``n`` failed chunks (chunk_id, indexing_status, retry_count) that may be tried again."""
    return chunks.where((F.col("indexing_status") == "failed") & (F.col("retry_count") < most)).orderBy("chunk_id").limit(n)


def _chunk_states(log: DataFrame) -> DataFrame:
    """A key's calls as attempts to index a chunk: the last call decides, errors count as retries."""
    return log.groupBy(F.col("api_key_id").alias("chunk_id")).agg(F.when(F.max_by("status_code", F.struct("ts", "event_id")) >= 400, "failed").otherwise("indexed").alias("indexing_status"), (F.count_if(F.col("status_code") >= 400) % 5).cast("int").alias("retry_count"))


def _keys(customers: DataFrame, nations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as key holders, nations as tenants, and the secrets that are presented."""
    secret = lambda n: F.concat(F.lit("sk-"), n.cast("string"))
    key = F.col("c_custkey")
    keys = customers.select(key.alias("key_id"), F.sha2(secret(key), 256).alias("hashed_key"), (key % 7 == 0).alias("revoked"), F.when(key % 3 == 0, F.to_date(F.lit("2024-01-01")) + (key % 20).cast("int")).alias("expires_at"), F.col("c_nationkey").alias("tenant_id"))
    tenants = nations.select(F.col("n_nationkey").alias("tenant_id"), F.when(F.col("n_nationkey") % 4 == 1, "disabled").otherwise("active").alias("status"))
    return customers.select(key.alias("request_id"), secret(key * 2).alias("secret")), keys, tenants


def by_title(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(title, doc_id, n_same) of the documents whose titles are wanted. Titles may repeat: each of a
    title's documents is mapped, none overwrites another."""
    same = Window.partitionBy("title")
    return docs.join(wanted.select("title").distinct(), "title").select("title", "doc_id", F.count("*").over(same).alias("n_same"))


def registered(table: Callable) -> dict[str, tuple[Callable, str | None]]:
    """Queries over the driver tables, with their SQL."""
    docs = lambda s, d: table(s, d, "documents")
    log = lambda s, d: audit(table(s, d, "events"))
    kbs = lambda s, d: docs(s, d).groupBy(F.col("source").alias("kb_id")).agg(F.count("*").alias("n_docs"))
    log_sql = "(SELECT event_id, ts, user_id AS api_key_id, event_type AS action, value AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code FROM events)"
    stats_sql = "count(*) AS total, count_if(status_code >= 400)::BIGINT AS errors, round(count_if(status_code >= 400) / count(*), 6) AS error_rate, round(avg(duration_ms), 2) AS avg_duration_ms"
    states_sql = "(SELECT user_id AS chunk_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' ELSE 'indexed' END AS indexing_status, (count_if(event_type = 'error') % 5)::INTEGER AS retry_count FROM events GROUP BY user_id)"
    return {
        "f1_tenant_kb": (lambda s, d: in_scope(docs(s, d), "fr", ["src0", "src7"]).select("doc_id"), "SELECT doc_id FROM documents WHERE lang = 'fr' AND source IN ('src0', 'src7')"),
        "f3_metadata_match": (lambda s, d: docs(s, d).where(F.col("lang").eqNullSafe("de") & F.col("source").eqNullSafe("src3")).select("doc_id"), "SELECT doc_id FROM documents WHERE lang IS NOT DISTINCT FROM 'de' AND source IS NOT DISTINCT FROM 'src3'"),
        "f4_fuzzy_match": (lambda s, d: docs(s, d).where(F.contains(F.lower("source"), F.lit("src1"))).select("doc_id", "source"), "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1')"),
        "f8_scope_check": (lambda s, d: kbs(s, d).select("kb_id", F.size(scope_violations(F.array("kb_id"), F.array(F.lit("src1"), F.lit("src2")))).alias("n_outside")), "SELECT source AS kb_id, CASE WHEN source IN ('src1', 'src2') THEN 0 ELSE 1 END AS n_outside FROM documents GROUP BY source"),
        "f9_json_flag": (lambda s, d: table(s, d, "events").where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"),
        "f10_retry_selection": (lambda s, d: to_retry(_chunk_states(log(s, d))).select("chunk_id", "retry_count"), f"SELECT chunk_id, retry_count FROM {states_sql} WHERE indexing_status = 'failed' AND retry_count < 3 ORDER BY chunk_id LIMIT 50"),
        "a13_retry_outcomes": (lambda s, d: retry_outcomes(_chunk_states(log(s, d)).where("indexing_status = 'failed' and retry_count < 3").withColumn("ok", F.col("chunk_id") % 2 == 0)), f"SELECT count_if(chunk_id % 2 = 0)::BIGINT AS success, count_if(chunk_id % 2 = 1 AND retry_count < 2)::BIGINT AS failed, count_if(chunk_id % 2 = 1 AND retry_count >= 2)::BIGINT AS skipped FROM {states_sql} WHERE indexing_status = 'failed' AND retry_count < 3"),
        "f11_audit_filter": (lambda s, d: audit_filter(log(s, d), action="click", min_status=200).select("event_id", "duration_ms"), f"SELECT event_id, duration_ms FROM {log_sql} WHERE action = 'click' AND status_code >= 200"),
        "f13_key_validity": (
            lambda s, d: valid_keys(*_keys(table(s, d, "customer"), table(s, d, "nation")), F.to_date(F.lit("2024-01-10"))),
            "WITH k AS (SELECT c_custkey AS key_id, CASE WHEN c_nationkey % 4 = 1 THEN 'disabled' ELSE 'active' END AS status FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 <> 0 AND (c_custkey % 3 <> 0 OR DATE '2024-01-01' + (c_custkey % 20)::INTEGER > DATE '2024-01-10')) SELECT c_custkey AS request_id, key_id, CASE WHEN key_id IS NULL THEN 'invalid' WHEN status <> 'active' THEN 'disabled' ELSE 'ok' END AS verdict FROM customer LEFT JOIN k ON key_id = c_custkey * 2",
        ),
        "f14_indexable": (lambda s, d: docs(s, d).where("text is not null and length(text) > 0").select("doc_id"), "SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 0"),
        "j1_document_kb": (lambda s, d: docs(s, d).join(kbs(s, d), F.col("source") == F.col("kb_id")).select("doc_id", "kb_id", "n_docs"), "SELECT doc_id, kb_id, n_docs FROM documents JOIN (SELECT source AS kb_id, count(*) AS n_docs FROM documents GROUP BY source) ON source = kb_id"),
        "j2_document_label_count": (lambda s, d: docs(s, d).select("doc_id").join(table(s, d, "labels").groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_labels")), "SELECT doc_id, coalesce(n, 0) AS n_labels FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) USING (doc_id)"),
        "j3_key_tenant": (lambda s, d: table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"), "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
        "j4_semi": (lambda s, d: docs(s, d).join(table(s, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
        "j5_anti": (lambda s, d: docs(s, d).join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
        "j11_title_mapping": (lambda s, d: by_title(docs(s, d).select("doc_id", F.concat_ws("-", "source", F.col("doc_id") % 20).alias("title")), docs(s, d).join(table(s, d, "labels").where("quality = 1"), "doc_id", "left_semi").select(F.concat_ws("-", "source", F.col("doc_id") % 20).alias("title"))), "WITH t AS (SELECT doc_id, source || '-' || (doc_id % 20) AS title FROM documents) SELECT title, doc_id, count(*) OVER (PARTITION BY title) AS n_same FROM t WHERE title IN (SELECT title FROM t JOIN labels USING (doc_id) WHERE quality = 1)"),
        "a1_total": (lambda s, d: page_count(docs(s, d), 20), "SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM documents"),
        "a2_per_group": (lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn")), "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id"),
        "a3_kbs_per_tenant": (lambda s, d: docs(s, d).groupBy("lang").agg(F.countDistinct("source").alias("kbs")), "SELECT lang, count(DISTINCT source) AS kbs FROM documents GROUP BY lang"),
        "a5_audit_stats": (lambda s, d: audit_stats(log(s, d)), f"SELECT {stats_sql} FROM {log_sql}"),
        "a5_audit_by_action": (lambda s, d: audit_stats(log(s, d), ["action"]), f"SELECT action, {stats_sql} FROM {log_sql} GROUP BY action"),
        "a6_score_metrics": (lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean")), "SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY event_type"),
        "a7_last_calls": (lambda s, d: last_calls(log(s, d)), f"SELECT action, count(*) AS calls, round(avg(duration_ms), 2) AS avg_ms, max(duration_ms) AS max_ms, count_if(status_code >= 400)::BIGINT AS errors FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY ts DESC, event_id DESC) AS n FROM {log_sql}) WHERE n <= 1000 GROUP BY action"),
        "a10_distinct_kbs": (lambda s, d: docs(s, d).select("source").distinct(), "SELECT DISTINCT source FROM documents"),
        "a11_ordered_dedupe": (lambda s, d: newest(table(s, d, "conversations"), ["conv_id", "role"], [F.col("turn"), F.col("text")]).select("conv_id", "role", "turn"), "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role"),
        "a12_outcomes": (lambda s, d: log(s, d).groupBy("api_key_id").agg(F.count_if(F.col("status_code") == 200).alias("succeeded"), F.count_if(F.col("status_code") == 500).alias("failed")), f"SELECT api_key_id, count_if(status_code = 200)::BIGINT AS succeeded, count_if(status_code = 500)::BIGINT AS failed FROM {log_sql} GROUP BY api_key_id"),
        "w3_rate_window": (lambda s, d: rate_counts(log(s, d), seconds=3600).select("event_id", "in_window"), f"SELECT event_id, count(*) OVER (PARTITION BY api_key_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM {log_sql}"),
        "o1_page": (lambda s, d: page(docs(s, d).select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 2, 20), "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20"),
        "o3_multi_key": (lambda s, d: docs(s, d).select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("place")), "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INTEGER AS place FROM documents"),
        "o4_json_order": (lambda s, d: table(s, d, "events").select("event_id", F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as int)"), F.lit(0)).alias("position")), "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS position FROM events"),
        "u2_difference": (lambda s, d: docs(s, d).select("doc_id").subtract(table(s, d, "labels").select("doc_id")), "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"),
        "u3_intersection": (lambda s, d: docs(s, d).select("doc_id").intersect(table(s, d, "labels").select("doc_id")), "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels"),
        "u4_config_merge": (lambda s, d: docs(s, d).select("doc_id", merged_config(F.create_map(F.lit("a"), F.lit("env"), F.lit("b"), F.lit("env")), F.create_map(F.lit("b"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))).alias("m")).select("doc_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b")), "SELECT doc_id, 'env' AS a, CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN lang ELSE 'env' END AS b FROM documents"),
    }
