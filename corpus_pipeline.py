"""The training-data pipeline over ``documents``: five stages, each written and read again as the next one's input.

``run(spark, sf_dir)`` applies them to the documents of ``sf_dir``. A stage is a function of (spark, docs, sf_dir); all
but the last return the columns of its input, so that any stage can be left out or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import lines, minhash, mixing, packing, quality
from tideline.llm.common import saved, word_count

#: No SQL: the classifier's random features, MinHash and the packing program have none.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts, from one reading of their texts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_scores(docs, model, "__score").filter(F.col("__score") >= quality.GOOD).drop("__score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they repeat; one that only repeats others is gone with its last line.

    ``n_chars`` follows the text. A document that had no text stays.
    """
    cleaned = lines.drop_repeated_lines(docs, ("__n_lines", "__n_removed"))
    emptied = (F.col("__n_removed") > 0) & (F.length(F.trim("text")) == 0)
    chars = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.filter(~emptied).withColumn("n_chars", chars).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each class of near duplicates; rows without an id stay.

    Of rows that repeat an id and a text one stays. Where one id has several texts, these are numbered in the order of
    their smallest ids and go by their own classes.
    """
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    names = saved(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", key.alias("__key")).agg(F.count("*").alias("rows")), "names")
    if names.groupBy("doc_id").count().filter("count > 1").isEmpty():
        goes = minhash.near_classes(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__goes")).distinct()
        left = docs.join(goes, F.col("doc_id") == F.col("__goes"), "left_anti")
        if names.filter("rows > 1").isEmpty():
            return left
        left = left.withColumn("__key", key)
    else:
        firsts = names.groupBy("__key").agg(F.min("doc_id").alias("__first")).repartitionByRange("__first", "__key")
        order = firsts.sortWithinPartitions("__first", "__key").withColumn("__number", F.monotonically_increasing_id())
        order = saved(order.withColumnRenamed("__key", "__other"), "order")
        numbered = docs.withColumn("__key", key).join(order, (F.col("__key") == F.col("__other")) & F.col("doc_id").isNotNull(), "left").drop("__other")
        numbered = saved(numbered, "numbered").filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("__first")))
        classes = minhash.near_classes(numbered.select(F.col("__number").alias("doc_id"), "text"))
        goes = classes.filter(~F.col("kept")).select(F.col("doc_id").alias("__goes")).distinct()
        left = numbered.join(goes, F.col("__number") == F.col("__goes"), "left_anti")
    named = left.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "__key"])
    return named.unionByName(left.filter(F.col("doc_id").isNull())).select(*docs.columns)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (not at all, once, or repeated); documents without words stay out."""
    taken = mixing.mix_documents(docs).filter("taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("size").alias("__size"), (F.col("taken") / F.col("size")).cast("int").alias("__laps")
    )
    times = taken.groupBy("__id", "__size").agg(F.max("__laps").alias("__laps"))
    rows = docs.withColumn("__words", word_count(F.col("text")))
    joined = rows.join(times, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__laps"))).alias("__lap")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in batches of optimal length buckets."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", one_of_near_duplicates),
    ("mixing to weights", mixed_to_weights),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = saved(docs, f"pipeline-{number}")
    return docs
