"""From raw documents to token ids: five stages of tidemark.llm, each working on all that the one before kept.

All stages but the last return the columns of documents, extra ones included, whatever their names. Nulls and empty texts are
texts without words to the classifier, stay as they are in line dedup, link with nothing in near dedup, have no tokens and the
rate of their cell in mixing, and give no ids. Rows without doc_id pass near dedup and are sampled alike. Rows that repeat an
id are judged row by row, but for mixing, which samples an id as a whole. Ties go to the lesser id. An empty table passes
every stage empty; without labels the classifier scores 0.5 and so keeps nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_documents
from tidemark.llm.common import Scratch
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.quality import classify
from tidemark.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return classify(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; those of which nothing is left go."""
    cut = dedup_lines(docs)
    changed = F.col("n_removed") > 0
    left = cut.filter(~changed | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and one of the rows equal in id and text; rows that repeat an id stand for themselves."""
    key = ["doc_id", "text_hash"]
    rows = near_duplicates(docs, digest=True).filter("doc_id is not null").groupBy(*key).agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    # the documents that go or are repeated; written, as the two joins then see its true size
    told = Scratch(spark, "near-dedup-rows").save(rows.filter("not kept or n > 1"))
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    single = own.join(told.select(key), key, "left_anti")
    repeated = own.join(told.filter("kept").select(key), key, "left_semi").dropDuplicates(key)
    return single.union(repeated.select(single.columns)).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards flatter shares of sources, languages and topics."""
    return mix(docs).filter("sampled").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the digest of what they decode to."""
    return encode_documents(docs, tokenizer(), outputs=("n_tokens", "ids", "decoded_sha256"), keep=("doc_id", "lang", "source"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]
#: Training, alignment and tokenizing aren't expressible in SQL; tests/llm/test_pipeline.py holds each stage against a second version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
