"""The test tables in the shape of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality_gate import quarter_label

R_ORD_SQL = """r AS (SELECT l_orderkey, l_linenumber, p_name AS product_name, p_brand AS brand, p_type AS theme, n_name AS channel,
  CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS batch, o_orderdate AS created_at,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating,
  CASE l_returnflag WHEN 'R' THEN 'NEGATIVE' WHEN 'A' THEN 'NEUTRAL' ELSE 'POSITIVE' END AS sentiment, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_as_reviews(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """An order line as a review: priority is the rating, the return flag the sentiment, the part's type the theme.

    columns: those wanted (default: all); tables that none of them needs aren't joined, as each line has one row in every one.
    """
    t = lambda n: read(spark, sf_dir, n)
    flag = F.col("l_returnflag")
    of = {
        "l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber"), "product_name": F.col("p_name"), "brand": F.col("p_brand"), "theme": F.col("p_type"), "channel": F.col("n_name"),
        "batch": quarter_label(F.col("o_orderdate")), "created_at": F.col("o_orderdate"), "rating": F.substring("o_orderpriority", 1, 1).cast("int"),
        "sentiment": F.when(flag == "R", "NEGATIVE").when(flag == "A", "NEUTRAL").otherwise("POSITIVE"), "quantity": F.col("l_quantity"),
    }
    wanted = columns or tuple(of)
    out = t("lineitem")
    if {"batch", "created_at", "rating"} & set(wanted):
        out = out.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if {"product_name", "brand", "theme"} & set(wanted):
        out = out.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    if "channel" in wanted:
        out = out.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return out.select(*(of[c].alias(c) for c in wanted))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a sentiment from their labels: toxic is negative, good quality positive, other labelled ones neutral."""
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.when(F.col("toxic") == 1, "NEGATIVE").when(F.col("quality") == 1, "POSITIVE").when(F.col("quality").isNotNull(), "NEUTRAL")
    return joined.withColumn("sentiment", label)


# Conversations as reviews of several sentences: a conversation is a review, a turn a sentence. What the table doesn't have is
# made of the ids, and some sentences get an ending that the rules look for.
ENDINGS = (" It burns.", " The pump leaks.", " So dry now.", " More acne.", "", "", " I love it.")
REV_SQL = """s AS (SELECT conv_id AS review_id, turn AS sentence_idx, text || CASE (conv_id + turn) % 7 WHEN 0 THEN ' It burns.' WHEN 1 THEN ' The pump leaks.' WHEN 2 THEN ' So dry now.' WHEN 3 THEN ' More acne.' WHEN 6 THEN ' I love it.' ELSE '' END AS sentence_text,
  CASE WHEN (conv_id * 7 + turn * 3) % 10 <= 2 THEN 'COMPLAINT' WHEN (conv_id * 7 + turn * 3) % 10 <= 5 THEN 'PRAISE' WHEN (conv_id * 7 + turn * 3) % 10 = 6 THEN 'RECOMMENDATION' WHEN (conv_id * 7 + turn * 3) % 10 = 7 THEN 'NEUTRAL' END AS label,
  'P' || ((conv_id + turn) % 4) AS severity, 0.5::DOUBLE + (turn % 5) / 10 AS confidence FROM conversations),
 v AS (SELECT conv_id AS review_id, 'Product ' || (conv_id % 6) AS product_name, 'Brand ' || (conv_id % 3) AS brand_name, '2024-Q' || (1 + conv_id % 4) AS batch, CASE WHEN conv_id % 11 < 10 THEN (1 + conv_id % 5)::INTEGER END AS rating,
  CASE WHEN conv_id % 5 <= 1 THEN 'NEGATIVE' WHEN conv_id % 5 = 2 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS sentiment, text || CASE WHEN conv_id % 9 = 0 THEN ' I Used to love it.' ELSE '' END AS redacted_text, conv_id % 6 = 0 AS span_detected, CASE WHEN conv_id % 4 = 0 THEN 'EMAIL;PHONE' ELSE '' END AS entities
  FROM conversations WHERE turn = 0)"""


def conversations_as_reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, sentences) as tidemark.operators.service describes them. The first turn is the review's own text."""
    c = read(spark, sf_dir, "conversations")
    k, v = F.col("conv_id") + F.col("turn"), (F.col("conv_id") * 7 + F.col("turn") * 3) % 10
    label = F.when(v <= 2, "COMPLAINT").when(v <= 5, "PRAISE").when(v == 6, "RECOMMENDATION").when(v == 7, "NEUTRAL")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (k % 7 + 1).cast("int"))
    sentences = c.select(F.col("conv_id").alias("review_id"), F.col("turn").alias("sentence_idx"), F.concat("text", ending).alias("sentence_text"), label.alias("label"), F.concat(F.lit("P"), (k % 4).cast("string")).alias("severity"), (0.5 + F.col("turn") % 5 / 10).alias("confidence"))
    i = F.col("conv_id")
    sentiment = F.when(i % 5 <= 1, "NEGATIVE").when(i % 5 == 2, "NEUTRAL").otherwise("POSITIVE")
    reviews = c.filter("turn = 0").select(
        i.alias("review_id"), F.concat(F.lit("Product "), (i % 6).cast("string")).alias("product_name"), F.concat(F.lit("Brand "), (i % 3).cast("string")).alias("brand_name"), F.concat(F.lit("2024-Q"), (1 + i % 4).cast("string")).alias("batch"), F.when(i % 11 < 10, (1 + i % 5).cast("int")).alias("rating"),
        sentiment.alias("sentiment"), F.concat("text", F.when(i % 9 == 0, " I Used to love it.").otherwise("")).alias("redacted_text"), (i % 6 == 0).alias("span_detected"), F.when(i % 4 == 0, "EMAIL;PHONE").otherwise("").alias("entities"),
    )
    return reviews, sentences
