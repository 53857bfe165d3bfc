"""Variants of queries from the corpus itself: relevance feedback over first hits.

The words of a query's first hits, each weighed by its share of the hit and the hit's share of
all scores, are a model of what an answer says. Its heaviest words stand for a generated answer
(``hyde``) and, beside the query, for a rephrasing (``multi_query``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def answer_terms(queries: DataFrame, hits: DataFrame, chunks: DataFrame, most: int = 10, least_length: int = 4) -> DataFrame:
    """(query_id, term, weight, no): the ``most`` heaviest words of a query's hits that it lacks
    itself, ties by word. Words shorter than ``least_length`` say little and are left out.

    Hits with score 0 or less, or without words, say nothing; a query without hits has no terms. The work
    is in the hits' words: k hits a query, joined by chunk_id."""
    mass = hits.where("score > 0").withColumn("_mass", F.col("score") / F.sum("score").over(Window.partitionBy("query_id")))
    said = mass.select("query_id", "chunk_id", "_mass").join(chunks.select("chunk_id", tokens(F.col("text")).alias("_words")), "chunk_id")
    words = said.select("query_id", (F.col("_mass") / F.size("_words")).alias("_part"), F.explode("_words").alias("term")).where(F.length("term") >= least_length)
    weighed = words.groupBy("query_id", "term").agg(F.round(F.sum("_part"), 9).alias("weight"))
    own = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return weighed.join(own, ["query_id", "term"], "left_anti").withColumn("no", F.row_number().over(order)).where(F.col("no") <= most)


def variants(queries: DataFrame, hits: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, variant_no, query): 0 the query, 1 the query with its answer's words, 2 those
    words alone. A query without such words has itself only."""
    terms = answer_terms(queries, hits, chunks, most).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "term"))), lambda x: x["term"]), " ").alias("_said"))
    both = queries.select("query_id", "query").join(terms, "query_id", "left")
    forms = F.array_compact(F.array("query", F.when(F.col("_said").isNotNull(), F.concat_ws(" ", "query", "_said")), "_said"))
    return both.select("query_id", F.posexplode(forms).alias("variant_no", "query"))
