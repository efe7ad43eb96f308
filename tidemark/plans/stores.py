"""Queries over the test tables for sources, sinks, vectors of texts, and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import embedding as E
from tidemark.functions import text as T
from tidemark.operators import aggregates as A
from tidemark.operators import clusters as C
from tidemark.operators import keywords as K
from tidemark.operators import quality_gate as Q
from tidemark.operators import records as P
from tidemark.operators import service as S
from tidemark.operators import severity as V
from tidemark.operators import vectors as X
from tidemark.plans.adapters import read
from tidemark.plans.queries import GUESS, guesses, query
from tidemark.plans.service import CLUSTERED, FACTS, both, clustered, few
from tidemark.plans.service import c8_o3_feature_requests as requests
from tidemark.plans.service import c9_praise_clusters as praise
from tidemark.plans.service import V as REVIEWS
from tidemark.sources import artifacts, readers, sinks


@query("SELECT printf('REV-USER-%05d', doc_id + 1) AS id, 'Custom Item' AS product_name, 'Batch-Custom' AS batch_or_version, 3 AS rating, 'NEUTRAL' AS ground_truth_label FROM documents WHERE trim(text) <> '' AND lower(text) <> 'nan'")
def s19_legacy_records(spark, sf):
    return artifacts.parse_legacy(read(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id").select("id", "product_name", "batch_or_version", "rating", "ground_truth_label")


@query("""WITH o AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS z FROM documents WHERE source IN ('src1', 'src2')),
 k AS (SELECT 'src1' AS source UNION ALL SELECT 'src2'), f AS (SELECT source, count(*) AS n, sum(length(text)) AS c, string_agg(text, '_' ORDER BY doc_id) FILTER (a <= 5) AS head, string_agg(text, '_' ORDER BY doc_id) FILTER (z <= 5) AS tail FROM o GROUP BY source)
 SELECT source, substr(sha256(concat('prop_', n, '_', c, '_', head, '_', tail)), 1, 16) AS key FROM k JOIN f USING (source)""")
def x9_sampled_keys(spark, sf):
    d, out = read(spark, sf, "documents"), None
    for s in ("src1", "src2"):
        one = E.sampled_key(d.filter(F.col("source") == s), "text", "doc_id", "prop").select(F.lit(s).alias("source"), "key")
        out = one if out is None else out.union(one)
    return out


@query("WITH b AS (SELECT doc_id // 10000 AS b, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS d FROM documents GROUP BY 1) SELECT substr(sha256(string_agg(d, '' ORDER BY b) || '|model|384|'), 1, 16) AS key FROM b")
def x9_content_key(spark, sf):
    return E.content_key(read(spark, sf, "documents"), "text", "doc_id", "model", 384)


@query("SELECT doc_id, 'prop_' || lang AS namespace, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]{2}') THEN 1.0::DOUBLE ELSE 0 END AS length, 384 AS size FROM documents")
def x6_x8_hashed_vectors(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("intent"))
    return E.encoded_by_aspect(d, "text", "intent", E.hashed_vector).select("doc_id", "namespace", F.round(X.norm(F.col("vector")), 6).alias("length"), F.size("vector").alias("size"))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, 'L3' AS intent, greatest(0, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4)) AS similarity_score FROM embeddings, q WHERE label = 3 ORDER BY 3 DESC, 1 LIMIT 10")
def c19_search_by_intent(spark, sf):
    v = read(spark, sf, "embeddings").withColumn("intent", F.concat(F.lit("L"), F.col("label").cast("string")))
    return E.search_by_intent(v, list(v.filter("vec_id = 7").select("embedding").first()[0]), "embedding", "vec_id", "l3")


@query(f"WITH {CLUSTERED} SELECT cluster_id AS Cluster_ID, CASE WHEN cluster_id = -1 THEN 'Zero-Day Outlier Radar' ELSE made END AS Theme_Title, 'General' AS Category, 'MEDIUM' AS Severity, n AS Review_Count, round(n / total * 100, 1) AS Negative_Share_Pct, 3.13::DOUBLE AS Avg_Rating, array_to_string(CASE WHEN cluster_id = -1 THEN ['unclassified', 'novel-defect', 'emerging'] ELSE keywords END, '; ') AS Top_Keywords, medoid_verbatim AS Medoid_Sample FROM eo")
def k3_theme_dimension(spark, sf):
    own = few(spark, sf)
    total = own.agg(F.sum("sentence_count").alias("total"))
    own = own.crossJoin(F.broadcast(total)).select("cluster_id", "title", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("severity"), F.col("sentence_count").alias("review_count"), (F.col("sentence_count") / F.col("total")).alias("negative_share"), F.lit(3.1254).alias("avg_rating"), F.split("keywords", ",").alias("keywords"), "medoid_verbatim")
    return sinks.theme_dimension(own)


@query(REVIEWS + FACTS + """ SELECT round((count(*) FILTER (Calibrated_Sentiment = 'POSITIVE') - count(*) FILTER (Calibrated_Sentiment = 'NEGATIVE')) * 100.0 / count(*), 2) AS net_sentiment, round(count(*) FILTER (Complaint_Clauses > 0) * 100.0 / count(*), 2) AS defect_pct, count(*) FILTER (Has_Silent_Defect) AS hidden_defects, round(count(*) FILTER (Is_Actionable) * 100.0 / count(*), 2) AS actionable_pct,
 round(count(*) FILTER (Is_PII_Scrubbed) * 100.0 / count(*), 2) AS redacted_pct, count(*) FILTER (Complaint_Clauses > 0 AND Rating <= 2) AS severe FROM f""")
def a24_a29_measures(spark, sf):
    return S.fact_table(*both(spark, sf)).agg(*(F.expr(e).alias(n) for n, e in sinks.measures().items()))


@query(f"WITH {GUESS}, a AS (SELECT avg((t = g)::INTEGER) AS accuracy, count(*) AS n FROM g), l AS (SELECT t AS label, (t = g)::INTEGER AS hit, 1 AS tr, 0 AS sa FROM g UNION ALL SELECT g, 0, 0, 1 FROM g), s AS (SELECT label, sum(hit) AS hit, sum(tr) AS support, sum(sa) AS said FROM l GROUP BY label), q AS (SELECT CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM s) SELECT round(accuracy, 4) AS accuracy, (SELECT round(avg(p), 4) FROM q) AS macro_precision, (SELECT round(avg(r), 4) FROM q) AS macro_recall, (SELECT round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 4) FROM q) AS macro_f1, n FROM a")
def d12_overall(spark, sf):
    return A.overall(guesses(spark, sf), "t", "g")


@query(f"WITH {GUESS}, h AS (SELECT *, (p >= 0.5)::INTEGER AS b FROM g) SELECT round(avg((g = t)::INTEGER), 4) AS accuracy_a, round(avg((b = t)::INTEGER), 4) AS accuracy_b, round(avg((b = t)::INTEGER) - avg((g = t)::INTEGER), 4) AS accuracy_delta, count(*) FILTER (g <> b) AS disagree, round(count(*) FILTER (g <> b) * 100.0 / count(*), 2) AS disagreement_pct, count(*) AS n FROM h")
def d22_model_deltas(spark, sf):
    return A.compared(guesses(spark, sf).withColumn("b", (F.col("p") >= 0.5).cast("int")), "t", "g", "b")


@query(f"WITH {GUESS} SELECT round(count(t) * 100.0 / (SELECT count(*) FROM documents), 2) AS coverage_pct FROM g")
def d15_label_coverage(spark, sf):
    return A.coverage(read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"), "quality")


@query("SELECT count(*) - count(text) AS text, count(*) FILTER (lang IS NULL) AS lang, count(*) FILTER (n_chars > 1000) AS long_nulls FROM documents")
def a31_null_counts(spark, sf):
    d = read(spark, sf, "documents")
    return A.null_counts(d.select("text", "lang", F.when(F.col("n_chars") <= 1000, F.col("n_chars")).alias("long_nulls")))


@query("SELECT 'part' AS right_table, count(*) AS rows, count(p.p_partkey) AS linked, round(count(p.p_partkey) * 100.0 / count(*), 2) AS linkage_pct FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 > 0) p ON l_partkey = p_partkey")
def j1_linkage_rate(spark, sf):
    part = read(spark, sf, "part").filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("l_partkey"))
    return A.linkage(read(spark, sf, "lineitem"), part, "l_partkey").withColumn("right_table", F.lit("part"))


def grams_sql(n: int) -> str:
    more = "".join(f", [{' || '.join(f't[i + {k}] || chr(32)' if k < m - 1 else f't[i + {k}]' for k in range(m))} for i in range(1, greatest(len(t) - {m - 2}, 1))]" for m in range(2, n + 1))
    return f"list_concat(t{more})"


@query(f"WITH w AS (SELECT lang, regexp_extract_all(lower(text), '[a-z]{{3,15}}') AS t FROM documents), g AS (SELECT lang, unnest({grams_sql(3)}) AS term FROM w), a AS (SELECT lang, term, count(*) AS tf FROM g GROUP BY ALL), m AS (SELECT term FROM a GROUP BY term HAVING count(*) >= 2), x AS (SELECT term FROM a JOIN m USING (term) GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 2000), n AS (SELECT a.* FROM a JOIN x USING (term)), f AS (SELECT term, count(*) AS df FROM n GROUP BY term), c AS (SELECT count(DISTINCT lang) AS n FROM n), u AS (SELECT lang, term, (1 + ln(tf)) * (ln((1 + c.n) / (1 + df)) + 1) AS w FROM n JOIN f USING (term), c), v AS (SELECT lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY lang)) AS weight FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(weight, 9) DESC, term) AS rank FROM v) SELECT lang, rank::INTEGER AS rank, term, round(weight, 6) AS weight FROM k WHERE rank <= 8")
def x3_x5_sublinear_terms(spark, sf):
    own = K.term_counts(read(spark, sf, "documents"), "lang", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,15})"), F.lit(1)), [], 3, 2000, least_groups=2)
    return K.top_terms(K.tfidf(own, "lang", True), "lang", 8)


@query()
def t19_telemetry(spark, sf):
    return P.telemetry(both(spark, sf)[0], "review_id", "redacted_text")


@query()
def p16_propositions(spark, sf):
    return P.propositions(both(spark, sf)[0], "review_id", "redacted_text")


@query(REVIEWS + "SELECT review_id, brand_name || ' - ' || product_name AS sku_or_module, rating, coalesce(CASE WHEN review_id % 7 < 5 THEN 'Theme ' || (review_id % 7) END, 'Cluster ' || (review_id % 7)) AS theme_title, (SELECT count(*) FROM s WHERE s.review_id = v.review_id) AS n_sentences, review_id * 2 AS score FROM v")
def p15_records(spark, sf):
    reviews, sentences = both(spark, sf)
    stages = [reviews.select("review_id", (F.col("review_id") * 2).alias("score")), reviews.select("review_id", (F.col("review_id") % 7).alias("cluster_id"))]
    titles = spark.range(5).select(F.col("id").alias("cluster_id"), F.concat(F.lit("Theme "), F.col("id").cast("string")).alias("title"))
    out = P.assembled(reviews, sentences, "review_id", stages, themes=titles)
    return out.select("review_id", "sku_or_module", "rating", "theme_title", F.size("sentences").cast("long").alias("n_sentences"), "score")


@query()
def v1_analysed_clauses(spark, sf):
    r = both(spark, sf)[1]
    return r.select("review_id", "sentence_idx", F.posexplode(T.analysed_clauses(F.col("sentence_text"))).alias("i", "c")).select("review_id", "sentence_idx", "i", "c.*")


@query("SELECT * FROM (VALUES ('theme', 'critical', 0.35::DOUBLE), ('theme', 'critical_volume', 500), ('theme', 'high', 0.35), ('theme', 'medium', 0.2), ('complaint', 'critical', 120), ('complaint', 'high', 60), ('complaint', 'medium', 20)) t(scope, name, value)")
def d11_thresholds(spark, sf):
    return V.thresholds(spark)


def tier_grid(spark):
    n = spark.range(0, 150, 7).select(F.col("id").alias("n"))
    return n.crossJoin(spark.range(0, 4).select(F.col("id").alias("p0"))).crossJoin(spark.range(0, 6, 2).select(F.col("id").alias("p1"))).crossJoin(spark.createDataFrame([(0,), (400,)], "total long"))


GRID = "g AS (SELECT a.n, b.p0, c.p1, d.total FROM range(0, 150, 7) a(n), range(0, 4) b(p0), range(0, 6, 2) c(p1), (VALUES (0::BIGINT), (400)) d(total))"
NAMED = "['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']"


@query(f"WITH {GRID}, k AS (SELECT *, CASE WHEN total > 0 THEN CASE WHEN n / total >= 0.2 AND n >= 3 THEN 3 WHEN n / total >= 0.14 AND n >= 2 THEN 2 WHEN n / total >= 0.08 THEN 1 ELSE 0 END ELSE CASE WHEN n >= 120 THEN 3 WHEN n >= 60 THEN 2 WHEN n >= 20 THEN 1 ELSE 0 END END AS b, CASE WHEN p0 > 0 THEN CASE WHEN p0 >= 2 OR n >= 4 THEN 3 ELSE 2 END WHEN p1 > 0 THEN CASE WHEN p1 >= 3 OR n >= 5 THEN 2 ELSE 1 END ELSE 0 END AS e FROM g) SELECT n, p0, p1, total, {NAMED}[greatest(b, e) + 1] AS severity FROM k")
def d9_all_branches(spark, sf):
    return tier_grid(spark).withColumn("severity", V.complaint_severity(F.col("n"), F.col("total"), F.col("p0"), F.col("p1")))


@query(f"WITH {GRID}, h AS (SELECT *, total / 1000 AS f, n * 5 AS v FROM g), k AS (SELECT *, CASE WHEN f >= 0.35 AND v >= 500 THEN 3 WHEN f >= 0.35 THEN 2 WHEN f >= 0.2 THEN 1 ELSE 0 END AS b, CASE WHEN v >= 25 THEN CASE WHEN f / 0.1 >= 3 AND f >= 0.1 AND v >= 100 THEN 2 WHEN f / 0.1 >= 1.25 THEN 1 ELSE 0 END ELSE 0 END AS l, CASE WHEN p0 > 0 THEN CASE WHEN p0 >= 3 OR f >= 0.1 OR v >= 25 THEN 3 ELSE 2 END WHEN p1 > 0 THEN CASE WHEN p1 >= 5 OR (p1 >= 2 AND (f >= 0.15 OR v >= 50)) THEN 2 ELSE 1 END ELSE 0 END AS e FROM h) SELECT n, p0, p1, total, {NAMED}[greatest(b, l, e) + 1] AS severity FROM k")
def d8_all_branches(spark, sf):
    own = tier_grid(spark)
    return own.withColumn("severity", V.theme_severity(F.col("total") / 1000, F.col("n") * 5, F.lit(0.1), F.col("p0"), F.col("p1")))


@query(f"WITH {CLUSTERED}, m AS (SELECT cluster_id, centroid FROM cm), t AS (SELECT * FROM (VALUES ('A', 0), ('B', 0), ('C', 1), ('D', 2)) t(title, k)), s AS (SELECT m.cluster_id, title, round(list_cosine_similarity(m.centroid, c.centroid), 6) - ascii(title) / 100000 AS similarity FROM m, t JOIN cm c ON c.cluster_id = t.k) SELECT cluster_id, title, similarity >= 0.46 AS near FROM s")
def c11_title_candidates(spark, sf):
    e = clustered(spark, sf)
    m = X.centroids(e, "cluster_id", "embedding").select("cluster_id", "centroid")
    t = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1), ("D", 2)], "title string, k int").join(m.select(F.col("cluster_id").alias("k"), F.col("centroid").alias("c")), "k")
    s = m.crossJoin(F.broadcast(t)).select("cluster_id", "title", (F.round(X.cosine(F.col("centroid"), F.col("c")), 6) - F.ascii("title") / 100000).alias("similarity"))
    return s.select("cluster_id", "title", (F.col("similarity") >= 0.46).alias("near"))


@query(REVIEWS + "SELECT count(*) AS total, count(*) FILTER (entities <> '') AS pii_count, round(count(*) FILTER (entities <> '') * 100.0 / count(*), 1) AS pii_rate FROM v")
def a2_entity_rate(spark, sf):
    return A.entity_summary(both(spark, sf)[0])


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))::INTEGER AS words FROM documents")
def p13_word_count(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '([\\\\`*_{}\\[\\]()#+!|<>])', '\\\\\\1', 'g'), '[\\r\\n]+', ' ', 'g') AS escaped FROM documents")
def t22_escaped(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.markdown_escaped(F.col("text")).alias("escaped"))


@query("SELECT doc_id, source, concat(text, ':') AS display_text FROM documents")
def p14_q21_public_view(spark, sf):
    d = read(spark, sf, "documents").withColumn("redacted", F.concat("text", F.lit(":")))
    return Q.public_view(d, ["doc_id", "source", "text"], "text", "redacted", False)


@query("SELECT doc_id, text FROM documents WHERE trim(text) <> ''")
def q19_s12_required(spark, sf):
    return readers.required(read(spark, sf, "documents"), ("doc_id", "text"), "text").select("doc_id", "text")


@query("SELECT count(*) AS n, 5::BIGINT AS classes FROM orders")
def s11_guarded(spark, sf):
    o = read(spark, sf, "orders")
    return readers.guarded(o, "o_orderpriority", 20, 10**9).agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("classes"))


@query(f"WITH {CLUSTERED} SELECT sum(n)::BIGINT AS total, round(avg(CASE WHEN cluster_id = 0 THEN 85.0::DOUBLE ELSE delight END), 1) AS mean_delight FROM eo WHERE n / total >= 0.02")
def v5_praise_figures(spark, sf):
    own = praise(spark, sf).withColumn("delight_score", F.when(F.col("cluster_id") != 0, F.col("delight_score")))
    return C.praise_figures(own.crossJoin(F.broadcast(own.agg(F.sum("praise_count").alias("t")))).filter(F.col("praise_count") / F.col("t") >= 0.02))


@query(f"WITH {CLUSTERED} SELECT cluster_id AS request_id, n AS vote_count FROM eo WHERE n / total < 0.16 AND contains(lower(coalesce(made || ' Request', 'Feature Proposal #' || (cluster_id + 1))), 'the')")
def v6_filtered_requests(spark, sf):
    return S.matching(requests(spark, sf), ["title"], "THE", priority="low").select("request_id", "vote_count")


@query("SELECT 'REV-U-' || upper(substr(sha256(concat_ws('_', regexp_replace(text, '^\\\\s+|\\\\s+$', '', 'g'), 'static_ts', doc_id)), 1, 12)) AS review_id, doc_id AS row_index FROM documents ORDER BY doc_id LIMIT 3")
def p10_preview(spark, sf):
    return Q.preview(Q.normalize(read(spark, sf, "documents"), "doc_id", "2024-01-01T00:00:00")).select("review_id", "row_index")


@query("SELECT 'lang,n_chars,source,text' AS extra, 'rating' AS missing, count(*) AS n FROM documents")
def u5_column_differences(spark, sf):
    d = read(spark, sf, "documents")
    extra, missing = P.column_differences(sorted(d.columns), ["doc_id", "rating"])
    return d.agg(F.lit(",".join(extra)).alias("extra"), F.lit(",".join(missing)).alias("missing"), F.count("*").alias("n"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS dot, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, q")
def f6_products(spark, sf):
    v = read(spark, sf, "embeddings")
    q = v.filter("vec_id = 7").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(X.dot(F.col("embedding"), F.col("q")), 6).alias("dot"), F.round(X.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("SELECT event_id, ts FROM events")
def f1_p6_iso_stamps(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("raw"))
    return e.select("event_id", Q.timestamp_of(F.col("raw"), F.lit("1970-01-01").cast("timestamp"))[0].alias("ts"))


@query(REVIEWS + ", b AS (SELECT batch, round(count(*) FILTER (sentiment = 'POSITIVE') * 100.0 / count(*), 2) AS sentiment_index, count(*) FILTER (sentiment = 'NEGATIVE') * 100.0 / count(*) AS neg FROM v GROUP BY batch) SELECT batch, sentiment_index, round(neg, 2) AS negative_pct, round(neg - lag(neg) OVER (ORDER BY batch), 2) AS negative_delta FROM b")
def a30_release_measures(spark, sf):
    return A.release_measures(both(spark, sf)[0])
