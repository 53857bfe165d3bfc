"""From documents to training sequences: quality, near duplicates, mixing, packing.

``STAGES`` lists the stages. Each takes (spark, docs, sf_dir), works on all rows of docs,
and returns a DataFrame, which is written as Parquet and read again as the next one's docs;
all but the last return the columns of documents. Stages with Python in their tasks bound the
session's Arrow batches where they are not set, so that memory does not follow the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, mixing, packing, quality
from millrace.llm.common import bounded_batches, read, small, written

#: Near duplicates share 0.8 of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labels and these documents) doesn't reject.

    Rows are judged one by one: null, empty and very long texts are scored like any other,
    repeated rows alike; an empty table stays empty. Other columns of any name are kept."""
    bounded_batches(spark)
    return quality.kept(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, id, hash): whole rows as one column, so that no name of theirs can clash."""
    return docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("hash"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id, nulls last.

    Rows are told apart by doc_id and text: rows of one id with unrelated texts are documents of
    their own, a null id with the text of another is its copy, and of equal rows one stays.
    Documents without words are near nothing, and all stay. Long texts count whole. An empty
    table stays empty. Other columns of any name are kept."""
    bounded_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(jaccard_join.shingled(slim, SHINGLE), "sets")
    found = written(jaccard_join.set_components(sets, slim, SHINGLE, PERCENT).where("n_shingles > 0").select("root", "doc_id", "text_hash"), "groups")
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("stays"))
    rows = found.join(stays, "root").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))).alias("stays"))
    rows = written(rows.groupBy("k_id", "k_hash").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("times")), "duplicates")
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash"))
    left = _keyed(docs).join(small(rows.where("not stays")), same, "left_anti")
    repeated = small(written(rows.where("stays and times > 1").select("k_id", "k_hash"), "repeated"))
    once = left.join(repeated, same, "left_semi").dropDuplicates(["id", "hash"])
    return left.join(repeated, same, "left_anti").unionByName(once).select("doc.*").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 1, 2, 3, repeating, at most 3 times each.

    Texts without words are taken 0 times, a null source is a source. Rows equal in doc_id,
    source and text are one document: what the mix takes of them is dealt evenly, the
    remainder to one of them. An empty table stays empty. Other columns of any name are kept."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("text_hash").alias("k_hash")).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").cast("int").alias("times"))
    taken = small(written(taken.where("copies > 0"), "copies"))
    same = F.col("id").eqNullSafe(F.col("k_id")) & F.col("doc.source").eqNullSafe(F.col("k_source")) & (F.col("hash") == F.col("k_hash"))
    both = _keyed(docs).join(taken, same)
    often = both.select("doc", F.floor(F.col("copies") / F.col("times")).cast("int").alias("n"))
    rest = both.where("copies % times > 0").dropDuplicates(["k_id", "k_source", "k_hash"]).select("doc", (F.col("copies") % F.col("times")).alias("n"))
    return often.unionByName(rest).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("doc.*").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens.

    Null and empty texts pack as their end token; a document taken twice packs twice. An
    empty table gives no rows. Other columns are ignored."""
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)


STAGES = [("quality", good_quality), ("near duplicates", one_of_each), ("mixing", mixed), ("packing", packed)]

#: A fitted classifier has no SQL form; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
