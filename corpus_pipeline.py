"""The corpus pipeline: each stage takes what the one before it kept, and all but the last return the columns of documents.

1. quality: documents that the pairwise ranking rejects go.
2. line_dedup: repeated chunks of lines and passages of over 50 words go; a document left without words goes.
3. near_duplicates: of each component of linked documents the one with the smallest doc_id stays.
4. mix: documents are taken once, several times or not at all, so that sources meet their targets.
5. bpe: what stays is encoded and decoded.

Defined results: a null text has no words and no shingles: the classifier scores it as an empty one, no line of it goes, it is
no one's copy, the mix takes it as a document without words, and it is encoded as an empty text; so is an empty text, and
long ones are read to their end. A null doc_id counts as the last one; a component of rows without doc_id keeps them. Of
rows alike in doc_id and text the third stage keeps one. A null source is the last source. Columns other than
COLUMNS are dropped, whatever their names; an empty table gives an empty result at every stage.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import public_tokenizers
from versejobs.llm import bpe, jaccard, line_dedup, mixing, quality
from versejobs.llm.common import cut, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def good_ones(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranking = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id"), 5, 0))
    return quality.scored(docs, ranking).where("predicted = 1").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(docs.select(*COLUMNS)).where((F.col("removed_lines") == 0) | (word_count(F.col("text")) > 0))
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows alike in doc_id and text are one document; a component of rows without doc_id keeps them."""
    stay = cut(jaccard.join(docs).where("doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(-1)).alias("_stays"), F.col("doc_id").isNull().alias("_none")).distinct())
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"))
    kept = keyed.join(stay, (F.col("_id") == F.col("_stays")) & (F.col("_null") == F.col("_none")), "left_semi")
    kept = kept.withColumn("_same", F.row_number().over(Window.partitionBy("_id", "_null", F.xxhash64("text")).orderBy("_id")))
    return kept.where("_same = 1").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", good_ones),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("mix", mixed),
    ("bpe", encoded),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage keeps is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
