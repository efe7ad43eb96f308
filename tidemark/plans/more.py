"""More queries over the test tables: breakdowns, joins, ranking, splits, scalars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import quality_gate as Q
from tidemark.operators import severity as S
from tidemark.operators import vectors as V
from tidemark.plans.adapters import orders_as_reviews, read
from tidemark.plans.queries import R, query
from tidemark.sources import synthetic


@query(R + "SELECT count(*) AS n, round(avg((sentiment = 'NEGATIVE')::INTEGER), 6) AS negative_fraction, round(avg(coalesce(rating, 4)), 4) AS baseline_rating FROM r")
def a10_a41_baselines(spark, sf):
    return orders_as_reviews(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg((F.col("sentiment") == "NEGATIVE").cast("int")), 6).alias("negative_fraction"), F.round(F.avg(F.coalesce("rating", F.lit(4))), 4).alias("baseline_rating"))


@query("SELECT lang, count(*) FILTER (quality = 0) AS low, count(*) FILTER (quality = 1) AS high, round(count(*) FILTER (quality = 1) * 100.0 / count(*), 2) AS pct FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a34_stratified_check(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").groupBy("lang").pivot("quality", [0, 1]).agg(F.count(F.lit(1)))
    low, high = F.coalesce("0", F.lit(0)), F.coalesce("1", F.lit(0))
    return d.select("lang", low.alias("low"), high.alias("high"), F.round(high * 100.0 / (low + high), 2).alias("pct"))


@query("SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality")
def a36_class_weights(spark, sf):
    n = read(spark, sf, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    both = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all"), F.count("*").alias("k"))))
    return both.select("quality", "n", F.round(F.col("all") / (F.col("k") * F.col("n")), 6).alias("weight"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "part", "documents", "events")))
def a37_row_counts(spark, sf):
    out = None
    for t in ("orders", "part", "documents", "events"):
        one = read(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, substr(text, 1, 4000) AS cut, length(text) > 4000 AS warned FROM documents")
def q5_truncation(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.substring("text", 1, 4000).alias("cut"), (F.length("text") > 4000).alias("warned"))


@query("SELECT event_id, rating, (rating <> value)::INTEGER AS warnings FROM (SELECT event_id, value, least(greatest(round_even(value, 0), 1), 5)::INTEGER AS rating FROM events)")
def q6_clamped_rating(spark, sf):
    own = read(spark, sf, "events").withColumns({"rating": F.col("value"), "text": F.lit("")})
    return Q.repaired(own, "text", "rating").select("event_id", "rating", "warnings")


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1996 OR year(o_orderdate) > 1998 THEN DATE '1997-06-01' ELSE o_orderdate::DATE END AS day, (year(o_orderdate) < 1996 OR year(o_orderdate) > 1998)::INTEGER AS warnings FROM orders")
def q7_sane_dates(spark, sf):
    own = Q.repaired(read(spark, sf, "orders").withColumn("text", F.lit("")), "text", None, "o_orderdate", oldest=1996, as_of=F.lit("1997-06-01").cast("timestamp"))
    return own.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "warnings")


@query("SELECT * FROM (VALUES ('review_text', 'text', 1.0::DOUBLE), ('channel', 'source', 1.0), (NULL, 'lang', NULL), (NULL, 'n_chars', NULL)) t(target, \"column\", confidence)")
def p10_u5_mapping_report(spark, sf):
    return Q.mapping_report(read(spark, sf, "documents"), "doc_id")


@query("SELECT count(*) AS total_rows, '0-100' AS rating_scale, 1.0::DOUBLE AS date_success_rate FROM orders")
def p10_mapping_figures(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.lit("a text").alias("review"), (F.col("o_orderkey") % 100).cast("string").alias("score"), F.col("o_orderdate").alias("date"))
    return Q.mapping_figures(o, "o_orderkey")


@query("SELECT doc_id, 0::BIGINT AS violations FROM documents WHERE regexp_matches(text, '\\S')")
def q12_span_check(spark, sf):
    s = read(spark, sf, "documents").select("doc_id", "text", F.explode(text.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count_if(~text.span_holds(F.col("text"), F.col("s.text"), F.col("s.start"), F.col("s.end"))).alias("violations"))


@query(R + """, a AS (SELECT theme, count(*) AS n FROM r WHERE batch = '1996-Q1' GROUP BY theme), b AS (SELECT theme, count(*) AS n FROM r WHERE batch = '1996-Q2' GROUP BY theme)
 SELECT theme, coalesce(a.n, 0) AS baseline, coalesce(b.n, 0) AS target FROM a FULL JOIN b USING (theme)""")
def j6_u2_full_outer(spark, sf):
    r = orders_as_reviews(spark, sf)
    a, b = (r.filter(F.col("batch") == q).groupBy("theme").agg(F.count("*").alias(n)) for q, n in (("1996-Q1", "baseline"), ("1996-Q2", "target")))
    return a.join(b, "theme", "full").select("theme", F.coalesce("baseline", F.lit(0)).alias("baseline"), F.coalesce("target", F.lit(0)).alias("target"))


@query("SELECT d.doc_id, coalesce('q' || l.quality::VARCHAR, 'General') AS batch FROM documents d LEFT JOIN labels l USING (doc_id)")
def j4_j5_defaulted_join(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.concat(F.lit("q"), F.col("quality").cast("string")), F.lit("General")).alias("batch"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def f6_norms(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT doc_id, sha256(text) AS key, printf('%05d', doc_id) AS label FROM documents")
def f7_f15_keys(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.format_string("%05d", "doc_id").alias("label"))


@query("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY source")
def f11_f12_joined_lists(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT source, doc_id, round(n_chars / sum(n_chars) OVER (PARTITION BY source), 9) AS share FROM documents")
def v9_v10_shares(spark, sf):
    return read(spark, sf, "documents").select("source", "doc_id", F.round(F.col("n_chars") / F.sum("n_chars").over(W.partitionBy("source")), 9).alias("share"))


@query()
def s16_s17_synthetic(spark, sf):
    return synthetic.reviews(spark, 500).unionByName(synthetic.reviews(spark, 500, "software"))
