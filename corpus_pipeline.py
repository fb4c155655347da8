"""From raw documents to packed token sequences, in stages that each call one operator of cohortlens.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Rows that a stage keeps are returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm.common import columns_of, free_name, shared_folder, written
from cohortlens.llm.language_id import UNDETERMINED, identify
from cohortlens.llm.near_dedup import near_duplicates
from cohortlens.llm.packing import pack
from cohortlens.llm.queries import tokenizer
from cohortlens.llm.quality_rules import judge
from cohortlens.operators.ordered import number_rows
from cohortlens.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: texts without a letter and those between two codewords go."""
    ship_package(spark)
    mark = free_name(docs, "_language_")
    told = identify(docs, all_columns=True, prefix=mark)
    return told.where((F.col(mark + "lang_pred") != UNDETERMINED) & ~F.col(mark + "ambiguous")).select(*columns_of(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs learned from the labelled ones among them."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mark = free_name(docs, "text_hash")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    kept = judge(marked, labels, keep=[mark], nested=True).where("kept").select(F.col("doc_id").alias("i"), F.col(mark).alias("h")).distinct()
    return marked.join(kept, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col(mark) == F.col("h")), "left_semi").select(*columns_of(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), that with the smallest id.

    A document is an id with a text: of rows that repeat both one stays, and rows of one id with other texts are judged
    each. Rows without an id all stay.
    """
    ship_package(spark)
    key, mark = free_name(docs, "doc_key"), free_name(docs, "text_hash")
    hashed = docs.where("doc_id is not null").withColumn(mark, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    told = hashed.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"))
    if told.where("lo < hi").isEmpty():
        marked = docs.where("doc_id is not null").withColumn(key, F.col("doc_id"))
    else:  # numbers that order as ids do, and texts of one id by their hashes
        keys = number_rows(hashed.select(F.col("doc_id").alias("i"), F.col(mark).alias("h")).distinct(), [], ["i", "h"], key)
        keys = written(keys, "keys")
        marked = hashed.join(keys, (F.col("doc_id") == F.col("i")) & (F.col(mark) == F.col("h"))).drop("i", "h")
    found = near_duplicates(marked, id=key, n=5, threshold=80).where("kept").groupBy(key).agg(F.count("*").alias("times")).withColumnRenamed(key, "k")
    stay = lambda which: marked.join(found.where(which), F.col(key) == F.col("k"), "left_semi")
    out = stay("times = 1").select(*columns_of(docs)).union(docs.where("doc_id is null"))
    if found.where("times > 1").isEmpty():
        return out
    return out.union(stay("times > 1").dropDuplicates([key]).select(*columns_of(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048."""
    ship_package(spark)
    return pack(docs, tokenizer("word_bpe_49k.json"), capacity=2048)


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("packing", packing)]

#: Language models, near duplicates and packing are beyond SQL; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        folder = shared_folder(spark, name)
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
    return docs
