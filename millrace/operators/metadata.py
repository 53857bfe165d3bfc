"""Filters on typed metadata: rows of a table, not code, one or more for each query.

Metadata is a VARIANT. A filter is (query_id, key, op, value): the key is a field's name, or a path
that begins with ``$``; the value is JSON, so that 3 and "3" differ. Ops:

* ``eq``: equal, numbers by value (3 equals 3.0); null equals a missing field.
* ``contains``: the field's text contains the value's, whatever the case.
* ``ge``, ``le``: numbers, or else texts, by order; values of two kinds do not fit.

All filters of a query must hold, and a field that is missing fails but for ``eq`` null. A query
without filters takes every row. An unknown op, or a value that isn't JSON, is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import every_pair, top_k

_NUMBER = r"^-?[0-9]"


def of_columns(*names: str) -> Column:
    """The columns as one VARIANT, nulls left out."""
    return F.parse_json(F.to_json(F.struct(*names)))


def _path(key: Column) -> Column:
    return F.when(key.startswith("$"), key).otherwise(F.concat(F.lit('$["'), key, F.lit('"]')))


def _holds(meta: Column, f: Column) -> Column:
    """Whether one filter (as ``_of_queries`` has it) holds for the metadata."""
    got = lambda kind: F.try_variant_get(meta, f["path"], kind)
    # a missing field has no JSON form, and counts as null
    have = F.coalesce(F.to_json(got("variant")), F.lit("null"))
    numbers = have.rlike(_NUMBER) & f["json"].rlike(_NUMBER)
    texts = have.startswith('"') & f["json"].startswith('"')
    order = lambda less: F.when(numbers, less(got("double"), f["number"])).when(texts, less(got("string"), f["text"])).otherwise(F.lit(False))
    return (
        F.when(f["op"] == "eq", (have == f["json"]) | (numbers & (got("double") == f["number"])))
        .when(f["op"] == "contains", F.contains(F.lower(got("string")), F.lower(f["text"])))
        .when(f["op"] == "ge", order(lambda a, b: a >= b))
        .when(f["op"] == "le", order(lambda a, b: a <= b))
        .otherwise(F.raise_error(F.concat(F.lit("no op "), F.coalesce(f["op"], F.lit("null")))).cast("boolean"))
    )


def _hold(meta: Column, filters: Column) -> Column:
    return filters.isNull() | F.forall(filters, lambda f: F.coalesce(_holds(meta, f), F.lit(False)))


def _of_queries(filters: DataFrame) -> DataFrame:
    """(query_id, _filters): each filter's value is parsed once, not for every row it meets."""
    value = F.parse_json("value")
    own = F.struct("key", "op", _path(F.col("key")).alias("path"), F.to_json(value).alias("json"), F.try_variant_get(value, F.lit("$"), "double").alias("number"), F.try_variant_get(value, F.lit("$"), "string").alias("text"))
    return filters.groupBy("query_id").agg(F.collect_list(own).alias("_filters"))


def _equal_text(name: str) -> Column:
    """The text that the first such filter of a query wants a field to equal; null without one."""
    asked = F.filter("_filters", lambda f: (f["key"] == name) & (f["op"] == "eq") & f["json"].startswith('"'))
    return F.try_element_at(asked, F.lit(1))["text"]


def filtered(hits: DataFrame, filters: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """Hits whose chunk's ``meta`` meets its query's filters, ranked anew; at most k of them if given."""
    both = hits.join(_of_queries(filters), "query_id", "left").join(chunks.select("chunk_id", "meta"), "chunk_id")
    return top_k(both.where(_hold(F.col("meta"), F.col("_filters"))).select("query_id", "chunk_id", "score"), k or 2**31 - 1)


def matching(queries: DataFrame, filters: DataFrame, chunks: DataFrame, promoted: Sequence[str] = ()) -> DataFrame:
    """(query_id, chunk_id) of every chunk that meets the filters of a query.

    ``promoted`` names fields that are text columns of ``chunks``, too. Queries that ask for one of
    them to equal a text meet only its rows, in an equi-join, and a table cut by that column is read in
    those parts only. The rest, a stated set of queries, meets all rows in blocks."""
    left = queries.select("query_id").distinct().join(_of_queries(filters), "query_id", "left")
    found = None
    for name in promoted:
        keyed = left.withColumn("_key", _equal_text(name))
        near = chunks.withColumn("_key", F.col(name)).join(keyed.where("_key is not null"), "_key").select("query_id", "chunk_id", "meta", "_filters")
        found = near if found is None else found.unionByName(near)
        left = keyed.where("_key is null").drop("_key")
    rest = every_pair(left, chunks.select("chunk_id", "meta")).select("query_id", "chunk_id", "meta", "_filters")
    every = rest if found is None else found.unionByName(rest)
    return every.where(_hold(F.col("meta"), F.col("_filters"))).select("query_id", "chunk_id")
