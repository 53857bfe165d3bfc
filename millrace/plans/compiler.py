"""From a request's settings to a plan: which retriever, with which parameters, and what follows.

Retrievers, in the order of the service: an override, else what the knowledge bases agree on,
else dense search. The plan is DataFrame operators only; Catalyst does the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import acl, feedback, metadata, model_calls, registry, retrieval
from ..sources.tables import kept

#: What preset names of an ensemble stand for.
PRESETS = {
    "hybrid_hyde": ["hybrid", "hyde"],
    "dense_multi_query": ["dense", "multi_query"],
    "hybrid_multi_query": ["hybrid", "multi_query"],
}


class SettingsError(ValueError):
    """Knowledge bases whose retriever settings can't be used together."""


def resolve(settings: Sequence[dict | None], override: dict | None = None) -> tuple[str, dict]:
    """(name, parameters) of the retriever for knowledge bases' settings ({"name", "params",
    "allow_mixed"}). Several must agree unless the first allows them not to; a name that no
    retriever has means dense search."""
    chosen = override or next(iter(settings), None) or {}
    if not override:
        asked = [((s or {}).get("name", "dense"), (s or {}).get("params") or {}) for s in settings]
        if any(a != asked[0] for a in asked) and not chosen.get("allow_mixed"):
            raise SettingsError("knowledge bases differ in their retriever settings")
    name, params = chosen.get("name") or "dense", dict(chosen.get("params") or {})
    if name not in registry.names("retriever"):
        return "dense", {}
    return name, {**params, "retrievers": members(params)} if name == "ensemble" else params


def members(params: dict) -> list[dict]:
    """An ensemble's retrievers with their weights, from any of the forms settings take: a preset,
    names with commas, a list of names beside one of weights, a list of {"name", "weight"}."""
    given, weights = params.get("retrievers"), params.get("weights") or []
    if params.get("preset") in PRESETS:
        given = PRESETS[params["preset"]]
    elif isinstance(given, str):
        given = [x.strip() for x in given.split(",") if x.strip()]
    elif params.get("preset") == "custom" or not given:
        given = ["dense", "llama_bm25"]
    named = [x if isinstance(x, dict) else {"name": x} for x in given]
    return [{"weight": weights[i] if i < len(weights) and weights[i] is not None else 1.0, **x} for i, x in enumerate(named)]


@dataclass
class Corpus:
    """What is searched: chunks (chunk_id, document_id, kb_id, text, ...), and vectors of theirs (chunk_id,
    vector) where they are not embedded by their words; ``index`` if the words are indexed. Under
    ``visible`` all of them have acl_class."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    index: DataFrame | None = None
    #: (user_id, acl_class) if queries (with user_id) search only what their user may see.
    visible: DataFrame | None = None


def hits(name: str, params: dict, queries: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) of one retriever over ``queries`` (query_id, query[, vector])."""
    seen = None if corpus.visible is None else queries.select("query_id", "user_id").join(corpus.visible, "user_id").select("query_id", "acl_class")
    lexical = lambda n: retrieval.bm25(queries, corpus.chunks, n, index=corpus.index, visible=seen)
    dense = lambda n: retrieval.dense(queries, corpus.vectors, n, visible=seen) if corpus.vectors is not None else retrieval.hash_dense(queries, corpus.chunks, n, visible=seen)
    if name in ("dense", "llama_dense"):
        return dense(k)
    if name in ("bm25", "llama_bm25"):
        return lexical(k)
    if name in ("hybrid", "llama_hybrid"):
        return retrieval.hybrid(dense(k), lexical(k), k, params.get("dense_weight", 0.7), params.get("sparse_weight", 0.3))
    if name == "fusion":
        recall = k * (3 if params.get("rerank") else 2)
        fused = retrieval.fusion(dense(recall), lexical(recall), params.get("rerank_top_n", 10) * 3 if params.get("rerank") else k, params.get("mode", "rrf"), params.get("dense_weight", 0.7), params.get("sparse_weight", 0.3), params.get("rrf_k", 60))
        return retrieval.rerank(fused, queries, corpus.chunks, k) if params.get("rerank") else fused
    if name in ("multi_query", "hyde"):
        user = [] if corpus.visible is None else ["user_id"]
        if params.get("generator") == "feedback":
            said = kept(feedback.variants(queries, lexical(params.get("feedback_hits", 10)), corpus.chunks, params.get("feedback_terms", 10)), "variants")
            forms = said.join(queries.select("query_id", *user), "query_id") if user else said
        else:
            forms = queries.select("query_id", *user, F.posexplode(retrieval.keyword_variants(F.col("query"))).alias("variant_no", "query"))
        variants = forms.withColumn("variant_id", F.xxhash64("query_id", "variant_no"))
        asked = variants.select(F.col("variant_id").alias("query_id"), "query", *user)
        found = hits(params.get("base_retriever", "dense"), params.get("base_params") or {}, asked, Corpus(corpus.chunks, None, corpus.index, corpus.visible), k)
        return retrieval.over_variants(found.withColumnRenamed("query_id", "variant_id"), variants, k, params.get("rrf_k", 60))
    if name == "ensemble":
        lists, weights = [], []
        for m in members(params) if "retrievers" not in params else params["retrievers"]:
            # a member that there is no retriever for gives no hits; the others do
            if m["name"] in registry.names("retriever"):
                lists.append(hits(m["name"], m.get("params") or {}, queries, corpus, 2 * k))
                weights.append(m.get("weight", 1.0))
        return retrieval.ensemble(lists, k, params.get("mode", "rrf"), weights, params.get("rrf_k", 60))
    raise SettingsError(f"{name} needs more than queries and chunks: call it directly")


def retrieve(queries: DataFrame, corpus: Corpus, settings: Sequence[dict | None] = (), override: dict | None = None, k: int = 5, threshold: float = 0.0, rerank: str | Callable | None = None, context: tuple[int, int] | None = None, users: DataFrame | None = None, acl_mode: str = "pre", filters: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank[, context_text]) of a request for every query.

    Hits, a rerank (an offline one by name, or a model of ``model_calls``), the threshold, ``filters``
    (``metadata``; chunks then have meta) and context. ``users`` has user_id, roles, groups, clearance,
    is_admin and, to join by, the queries' user_id; chunks then have ACL columns. With ``acl_mode``
    "pre" retrievers rank only what a query's user may see, so that k hits are found where k are
    allowed; with "post", as the service has it, rights trim the hits and may leave fewer."""
    name, params = resolve(settings, override)
    if users is not None and acl_mode == "pre":
        classed = acl.with_class(corpus.chunks)
        own = lambda df: df if df is None or "acl_class" in df.columns else df.join(classed.select("chunk_id", "acl_class"), "chunk_id")
        corpus = Corpus(classed, own(corpus.vectors), own(corpus.index), kept(acl.visible(classed, users), "visible"))
    found = hits(name, params, queries, corpus, k).select("query_id", "chunk_id", "score", "rank")
    if rerank:
        found = model_calls.rerank(found, queries, corpus.chunks, rerank, k) if callable(rerank) else retrieval.rerank(found, queries, corpus.chunks, k, rerank)
    found = retrieval.threshold(found, threshold)
    if filters is not None:
        found = metadata.filtered(found, filters, corpus.chunks)
    if users is not None and acl_mode == "post":
        rights = corpus.chunks.select("chunk_id", "sensitivity_level", "acl_users", "acl_roles", "acl_groups")
        seen = found.join(rights, "chunk_id").join(queries.select("query_id", "user_id"), "query_id")
        found = acl.trim(seen, users).select("query_id", "chunk_id", "score", "rank")
    if context:
        windows = retrieval.context_window(found, corpus.chunks, *context).select("query_id", "chunk_id", "context_text")
        found = found.join(windows, ["query_id", "chunk_id"])
    return found
