"""A corpus pipeline of five stages, each of which calls one operator of vigilspark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows to the
shared folder, hands them on and deletes what the stage needed.  All but the last return the columns
of documents.  Empty tables pass through; every column may be null, and other columns are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm.bpe import encode_documents
from vigilspark.llm.mixing import mix
from vigilspark.llm.ngram_jaccard import jaccard_components
from vigilspark.llm.quality import judge
from vigilspark.llm.shared import column_name, scratch, shared_folder
from vigilspark.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged.

    Each row is judged by its text alone, so repeated rows stay or go together; null, empty and word-less
    texts go."""
    return judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest doc_id.

    Rows are told apart by doc_id and text: rows that are equal in both leave one, rows that share a doc_id
    or have none are compared by their texts like any others.  A null doc_id comes after all others.
    Documents without words aren't in any group and stay."""
    docs = docs.select(*COLUMNS)
    node = column_name(docs, "node")
    rows = docs.withColumn(node, F.xxhash64("doc_id", "text"))
    found = jaccard_components(rows.select(F.col(node).alias("doc_id"), "text"), n=5, percent=80).select("doc_id", "component_id").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(node).alias("row")).alias("place")
    first = found.join(rows.select(F.col(node).alias("row"), place).distinct(), F.col("row") == found["doc_id"]).groupBy("component_id").agg(F.min("place").alias("place"))
    return rows.dropDuplicates([node]).join(first.select(F.col("place.row").alias(node)), node, "left_semi").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages (200 bytes or more); documents left empty go.

    A repeat may begin or end within a character: the bytes left of that character go too.  Repeated rows
    of 200 bytes or more repeat each other and go; null and empty texts stay as they are."""
    cut = remove_repeats(docs.select(*COLUMNS), decode=True).where("n_bytes = 0 or n_removed < n_bytes")
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0 to 3 rows.

    Rows that are equal in doc_id and text are taken equally often; null texts have no words, a null source
    is a source."""
    mixed = mix(docs.select(*COLUMNS))
    return mixed.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each row; a row whose ids don't decode to its text fails the run.

    Every row is encoded by itself; null and empty texts have no ids."""
    coded = encode_documents(docs.select("doc_id", "source", "text"))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", F.when(same, F.col("n_tokens")).otherwise(F.raise_error("ids don't decode to the text")).alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: Hashes of a suffix array, of connected components and of a tokenizer aren't SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What each stage wrote goes as soon as the next one's rows are stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/vigilspark/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
