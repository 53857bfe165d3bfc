"""Calls of models that answer many items at once: embeddings, scores of pairs, classes of texts.

A model is a function that Spark can send to its workers: from a list of items (texts, or tuples
of a struct's fields) to a list of their answers in order, or to a dict of index to answer. It
raises ``Busy`` for what may succeed later. The functions at the end are offline models.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from ..functions.text import route as by_rules
from ..functions.text import strip
from ..functions.vectors import sigmoid

Model = Callable[[list], "Sequence | dict"]

#: The most items that a provider's embeddings take in one request; others take 100.
MOST_ITEMS = {"ollama": 1000, "openai": 2048, "qwen": 10, "zhipu": 16, "gemini": 100, "siliconflow": 64, "deepseek": 100, "kimi": 100}


class Busy(Exception):
    """The model may answer later: a limit of its rate, a lost connection."""


@dataclass(frozen=True)
class Limits:
    """Of a request: its items and their characters, how often it is tried, seconds before the
    second try (doubled before each other)."""

    items: int = 100
    chars: int = 200_000
    tries: int = 3
    wait: float = 0.5


def limits_of(provider: str, items: int | None = None) -> Limits:
    """The provider's limits, or fewer items if asked for."""
    most = MOST_ITEMS.get(provider, 100)
    return Limits(items=most if items is None else max(1, min(items, most)))


def call(df: DataFrame, item: str, model: Model, answer: str, limits: Limits = Limits(), into: str = "answer", error: str = "error") -> DataFrame:
    """``df`` with the column ``item`` replaced by the model's answers (of the type ``answer``) and
    errors; a row has at most one of both.

    Requests hold distinct items of a task's rows, whatever these rows belong to, within the limits;
    an item that is longer goes alone. A busy model is asked again, later. A request that fails
    otherwise is halved, so an item that the model does not take fails alone, and no other row nor
    the job with it. A null item, or a struct with a null field, is not asked for and has neither
    answer nor error; empty texts are asked for. Tasks that are run again ask again: keep the
    result (``tables.kept``) before it is read several times."""
    kind = _parse_datatype_string(answer)
    rest = [f for f in df.schema.fields if f.name != item]
    names, arrow = [f.name for f in rest], to_arrow_type(kind)
    schema = StructType([*rest, StructField(into, kind), StructField(error, StringType())])
    rows = max(512, limits.items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                items = [tuple(x.values()) if isinstance(x, dict) else x for x in part.column(0).to_pylist()]
                wanted = [x for x in dict.fromkeys(items) if x is not None and not (isinstance(x, tuple) and None in x)]
                found: dict = {}
                for request in requests(wanted, limits):
                    found.update(answered(model, request, limits))
                both = [found.get(x, (None, None)) for x in items]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([a for a, _ in both], arrow), pa.array([e for _, e in both], pa.string())], names=[*names, into, error])

    return df.select(item, *names).mapInArrow(run, schema)


def requests(items: list, limits: Limits) -> Iterator[list]:
    """The items, in order, in requests within the limits."""
    request, size = [], 0
    for x in items:
        chars = sum(len(y) for y in (x if isinstance(x, tuple) else (x,)) if isinstance(y, str))
        if request and (len(request) >= limits.items or size + chars > limits.chars):
            yield request
            request, size = [], 0
        request.append(x)
        size += chars
    if request:
        yield request


def answered(model: Model, request: list, limits: Limits) -> dict:
    """(answer, error) of each item of a request."""
    why: Exception | None = None
    for tried in range(limits.tries):
        if tried:
            time.sleep(limits.wait * 2 ** (tried - 1))
        try:
            got = model(request)
            if not isinstance(got, dict):
                if len(got) != len(request):
                    raise ValueError(f"{len(got)} answers to {len(request)} items")
                got = dict(enumerate(got))
            return {x: (got[i], None) if got.get(i) is not None else (None, "no answer") for i, x in enumerate(request)}
        except Busy as e:
            why = e
        except Exception as e:
            if len(request) > 1:
                half = len(request) // 2
                return {**answered(model, request[:half], limits), **answered(model, request[half:], limits)}
            why = e
            break
    return {x: (None, f"{type(why).__name__}: {why}") for x in request}


def embed(texts: DataFrame, text: str, model: Model, limits: Limits = Limits()) -> DataFrame:
    """``texts`` with ``vector`` and ``error`` in place of the text."""
    return call(texts, text, model, "array<double>", limits, "vector")


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, model: Model, k: int = 5, limits: Limits = Limits(), logits: bool = False) -> DataFrame:
    """Hits ordered by the model's score of (query, text), ties by chunk_id; ``logits`` go through a
    sigmoid. A query of which one pair got no score keeps its order, each hit with score 1.

    Hits of queries or chunks that are not there drop out."""
    both = hits.join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    pairs = both.select("query_id", "chunk_id", F.col("rank").alias("_rank"), F.struct(F.coalesce("query", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("text")).alias("_pair"))
    asked = call(pairs, "_pair", model, "double", limits, "_raw", "_error")
    failed = F.max(F.col("_raw").isNull() | F.isnan("_raw")).over(Window.partitionBy("query_id"))
    score = F.round(sigmoid(F.col("_raw")) if logits else F.col("_raw"), 9)
    scored = asked.withColumn("_failed", failed).withColumn("score", F.when(F.col("_failed"), 1.0).otherwise(score))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.when(F.col("_failed"), F.col("_rank")), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def route(queries: DataFrame, model: Model, retrievers: dict[str, str], sure: float = 0.9, limits: Limits = Limits()) -> DataFrame:
    """(query_id, query_type, retriever, confidence, by_model): the model's class of a query, if it
    is one of ``retrievers`` (class to retriever), else that of the rules."""
    asked = call(queries.select("query_id", "query", F.col("query").alias("_item")), "_item", model, "string", limits, "_said", "_error")
    said = F.lower(strip(F.col("_said")))
    known = F.create_map(*(F.lit(x) for pair in retrievers.items() for x in pair))
    rules = asked.withColumn("_r", by_rules(F.coalesce("query", F.lit("")))).withColumn("by_model", F.coalesce(said.isin(*retrievers), F.lit(False)))
    pick = lambda a, b: F.when(F.col("by_model"), a).otherwise(b)
    return rules.select("query_id", pick(said, F.col("_r.query_type")).alias("query_type"), pick(F.element_at(known, said), F.col("_r.retriever")).alias("retriever"), pick(F.lit(sure), F.col("_r.confidence").cast("double")).alias("confidence"), "by_model")


# ---------------------------------------------------------------- offline models

def hash_embedder(dim: int = 1024) -> Model:
    """Counts of white-space words in hashed slots, at length 1; zeros without words."""

    def model(texts: list) -> list:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.split():
                row[int(hashlib.md5(word.encode()).hexdigest(), 16) % dim] += 1
        return list(out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300))

    return model


def overlap_scorer(scale: float = 6.0) -> Model:
    """A logit from the share of a query's distinct words that the text has."""

    def model(pairs: list) -> list:
        words = [(set(q.lower().split()), set(t.lower().split())) for q, t in pairs]
        return [scale * (len(q & t) / max(len(q), 1) - 0.5) for q, t in words]

    return model
