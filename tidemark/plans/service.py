"""Queries over the test tables for what the routes report: intents, products, stars, cohorts, clusters, propositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators import clusters as C
from tidemark.operators import records as P
from tidemark.operators import service as S
from tidemark.plans.adapters import REV_SQL, conversations_as_reviews, read
from tidemark.plans.queries import query

V = f"WITH {REV_SQL} "
KIND = "CASE WHEN label IN ('COMPLAINT', 'RECOMMENDATION', 'PRAISE') THEN label ELSE 'NOISE' END"
PER = f", k AS (SELECT *, {KIND} AS kind FROM s), p AS (SELECT review_id, count(*) AS n_sentences, " + ", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x.lower()}" for x in ("COMPLAINT", "RECOMMENDATION", "PRAISE", "NOISE")) + " FROM k GROUP BY review_id)"


def tokens_sql(t: str) -> str:
    """Runs of word characters that are 3 to 15 letters from a to z."""
    return f"list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,15}}'))"


def both(spark, sf):
    return conversations_as_reviews(spark, sf)


@query(V + PER + """, t AS (SELECT sum(n_complaint)::BIGINT AS complaint, sum(n_recommendation)::BIGINT AS recommendation, sum(n_praise)::BIGINT AS praise, sum(n_noise)::BIGINT AS noise, count(*) FILTER (n_complaint > 0) AS complaint_reviews, count(*) FILTER (n_recommendation > 0) AS recommendation_reviews,
 count(*) FILTER (n_praise > 0) AS praise_reviews, count(*) FILTER (n_noise > 0) AS noise_reviews, sum(n_sentences)::BIGINT AS total_sentences, sum(n_sentences - n_noise)::BIGINT AS actionable_count FROM p) SELECT *, round(actionable_count * 100.0 / greatest(total_sentences, 1), 1) AS actionable_rate_pct FROM t""")
def a7_intent_breakdown(spark, sf):
    return S.intent_breakdown(both(spark, sf)[1])


@query(V + PER + " SELECT 'total' AS pool, count(*) AS n FROM k UNION ALL SELECT 'complaints', count(*) FROM k WHERE kind = 'COMPLAINT' UNION ALL SELECT 'recommendations', count(*) FROM k WHERE kind = 'RECOMMENDATION' UNION ALL SELECT 'praise_noise', count(*) FROM k WHERE kind IN ('PRAISE', 'NOISE') UNION ALL SELECT 'praise', count(*) FROM k WHERE kind = 'PRAISE' UNION ALL SELECT 'noise', count(*) FROM k WHERE kind = 'NOISE'")
def a8_u4_pools(spark, sf):
    return S.pools(both(spark, sf)[1])


@query(V + PER + " SELECT " + ", ".join(f"count(*) FILTER (kind = '{x}') AS {x}" for x in ("COMPLAINT", "RECOMMENDATION", "PRAISE", "NOISE")) + ", count(*) AS total, count(*) FILTER (kind <> 'NOISE') AS actionable FROM k")
def a13_proposition_counts(spark, sf):
    return S.proposition_counts(both(spark, sf)[1])


def reason_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({t}), {w!r})' for w in words)} THEN '{name}'" for name, words in S.REASONS) + f" ELSE '{S.OTHER_REASON}' END"


@query(V + f""", b AS (SELECT review_id, sentence_idx, sentence_text FROM s WHERE label = 'COMPLAINT'), h AS (SELECT v.*, sentiment = 'NEGATIVE' OR review_id IN (SELECT review_id FROM b) AS bad FROM v),
 g AS (SELECT product_name, arg_min(brand_name, review_id) AS brand_name, count(*) AS total_reviews, round(avg(coalesce(rating, 3)), 2) AS avg_rating, count(*) FILTER (bad) AS complaint_count, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(batch) FILTER (bad))), 1, 3), ','), '') AS affected_cohorts, arg_min(substr(redacted_text, 1, 120), review_id) AS opening FROM h GROUP BY product_name),
 t AS (SELECT product_name, b.*, {reason_sql('sentence_text')} AS reason FROM b JOIN v USING (review_id)), m AS (SELECT product_name, reason, count(*) AS n, min(row(review_id, sentence_idx)) AS f FROM t GROUP BY ALL), r AS (SELECT product_name, first(reason ORDER BY n DESC, f) AS reason FROM m GROUP BY product_name),
 q AS (SELECT product_name, first(sentence_text ORDER BY review_id, sentence_idx) AS quote FROM t WHERE length(sentence_text) > 20 GROUP BY product_name),
 x AS (SELECT g.*, round(complaint_count * 100.0 / total_reviews, 1) AS defect_rate_pct, coalesce(reason, '{S.NO_REASON}') AS top_defect_theme, coalesce(quote, opening) AS sample_defect_quote FROM g LEFT JOIN r USING (product_name) LEFT JOIN q USING (product_name) WHERE total_reviews >= 15 OR (SELECT max(total_reviews) FROM g) < 15),
 y AS (SELECT *, CASE WHEN defect_rate_pct >= 28 OR contains(top_defect_theme, 'Chemical Irritation') THEN 'CRITICAL' WHEN defect_rate_pct >= 15 THEN 'ELEVATED' ELSE 'STABLE' END AS risk_tier FROM x)
 SELECT product_name, brand_name, total_reviews, avg_rating, complaint_count, defect_rate_pct, risk_tier, top_defect_theme, sample_defect_quote, affected_cohorts FROM y ORDER BY CASE risk_tier WHEN 'CRITICAL' THEN 0 WHEN 'ELEVATED' THEN 1 ELSE 2 END, defect_rate_pct DESC, product_name LIMIT 15""")
def a14_o5_product_risk(spark, sf):
    return S.product_risk(*both(spark, sf))


@query(V + f"SELECT review_id, sentence_idx, {reason_sql('sentence_text')} AS reason FROM s")
def t25_reasons(spark, sf):
    return both(spark, sf)[1].select("review_id", "sentence_idx", S.reason(F.col("sentence_text")).alias("reason"))


@query(V + PER + """, o AS (SELECT coalesce(rating, 3) AS star, sum(coalesce(n_complaint, 0)) AS c, count(*) AS n FROM v LEFT JOIN p USING (review_id) GROUP BY 1), t AS (SELECT sum(c) AS a, sum(c) FILTER (star >= 4) AS h FROM o)
 SELECT g.i::INTEGER AS star, coalesce(c, 0)::BIGINT AS complaint_count, round(coalesce(c, 0) * 100.0 / greatest(a, 1), 1) AS complaint_pct, coalesce(n, 0) AS total_reviews, h::BIGINT AS trojan_complaint_count, round(h * 100.0 / greatest(a, 1), 1) AS trojan_rate_pct FROM generate_series(1, 5) g(i) LEFT JOIN o ON o.star = g.i, t""")
def a15_star_divergence(spark, sf):
    return S.star_divergence(*both(spark, sf))


@query(V + PER + " SELECT review_id, product_name, batch, rating, sentiment FROM v LEFT JOIN p USING (review_id) WHERE rating >= 4 AND (span_detected OR n_complaint > 0) ORDER BY review_id LIMIT 50")
def q16_silent_reviews(spark, sf):
    return S.silent_defects(*both(spark, sf)).select("review_id", "product_name", "batch", "rating", "sentiment")


@query(V + """, f AS (SELECT review_id, first(sentence_text ORDER BY sentence_idx) AS complaint_text FROM s WHERE label = 'COMPLAINT' GROUP BY review_id), o AS (SELECT review_id, product_name, rating, complaint_text, substr(redacted_text, 1, 180) || '...' AS snippet, row_number() OVER (PARTITION BY complaint_text ORDER BY review_id) AS r FROM v JOIN f USING (review_id) WHERE rating >= 4 AND length(complaint_text) > 25)
 SELECT review_id, product_name, rating, complaint_text, snippet FROM o WHERE r = 1 ORDER BY review_id LIMIT 8""")
def a15_trojan_samples(spark, sf):
    return S.trojan_samples(*both(spark, sf))


@query(V + f"SELECT review_id, product_name, rating, regexp_extract(redacted_text, '{S.LOYALTY}') AS trigger_phrase, substr(redacted_text, 1, 160) || '...' AS quote, coalesce(batch, 'Latest Batch') AS batch FROM v WHERE coalesce(rating, 3) <= 3 AND regexp_matches(redacted_text, '{S.LOYALTY}') ORDER BY review_id LIMIT 6")
def q18_turncoats(spark, sf):
    return S.turncoats(both(spark, sf)[0])


SIDE = "CASE WHEN batch <= '2024-Q2' THEN 'A' ELSE 'B' END"


@query(V + PER + f""", j AS (SELECT {SIDE} AS label, coalesce(rating, 3) AS r, coalesce(n_complaint, 0) > 0 OR span_detected AS d, coalesce(n_praise, 0) > 0 AS h FROM v LEFT JOIN p USING (review_id))
 SELECT label, count(*) AS total_reviews, round(avg(r), 2) AS avg_rating, round(count(*) FILTER (r >= 4) * 100.0 / count(*), 1) AS positive_pct, round(count(*) FILTER (r = 3) * 100.0 / count(*), 1) AS neutral_pct, round(count(*) FILTER (r <= 2) * 100.0 / count(*), 1) AS negative_pct, count(*) FILTER (d) AS defect_count, round(count(*) FILTER (d) * 100.0 / count(*), 1) AS defect_rate_pct,
 count(*) FILTER (h) AS praise_count, round(count(*) FILTER (h) * 100.0 / count(*), 1) AS praise_rate_pct, """ + ", ".join(f"count(*) FILTER (r = {i}) AS stars_{i}" for i in range(1, 6)) + " FROM j GROUP BY label")
def a16_cohort_profile(spark, sf):
    return S.cohort_profile(*both(spark, sf), F.expr(SIDE))


@query(V + PER + " SELECT count(*) FILTER (kind = 'NOISE') AS total_noise_sentences, count(*) AS total_sentences, round(count(*) FILTER (kind = 'NOISE') * 100.0 / greatest(count(*), 1), 1) AS noise_rate_pct, round(count(*) FILTER (kind = 'NOISE') * 2.0::DOUBLE / 60, 1) AS engineering_hours_saved FROM k")
def a19_noise_summary(spark, sf):
    return S.noise_summary(both(spark, sf)[1])


@query(V + PER + f", w AS (SELECT unnest({tokens_sql('sentence_text')}) AS word FROM k WHERE kind = 'NOISE' AND length(sentence_text) > 15) SELECT word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(map(repr, S.NOISE_STOP))}) GROUP BY word ORDER BY n DESC, word LIMIT 60")
def a19_noise_words(spark, sf):
    return S.noise_words(both(spark, sf)[1])


@query(V + PER + " SELECT review_id, sentence_idx FROM k WHERE kind = 'NOISE' AND length(sentence_text) > 15 AND regexp_matches(sentence_text, '(?i)\\bpump\\b')")
def q17_v13_noise_with_word(spark, sf):
    return S.noise_sentences(both(spark, sf)[1], "pump").select("review_id", "sentence_idx")


FACTS = PER + """, f AS (SELECT review_id AS Review_ID, product_name AS Product_Name, batch AS Batch_or_Version, rating AS Rating, sentiment AS Calibrated_Sentiment, coalesce(n_sentences, 0) AS Sentence_Count, coalesce(n_complaint, 0) AS Complaint_Clauses, coalesce(n_praise, 0) AS Praise_Clauses, coalesce(n_recommendation, 0) AS Recommendation_Clauses,
 coalesce(n_complaint + n_praise + n_recommendation, 0) > 0 AS Is_Actionable, coalesce(rating, 0) >= 4 AND (span_detected OR coalesce(n_complaint, 0) > 0) AS Has_Silent_Defect, entities <> '' AS Is_PII_Scrubbed, entities AS PII_Entities_Detected, redacted_text AS Sanitized_Verbatim FROM v LEFT JOIN p USING (review_id))"""


@query(V + FACTS + " SELECT * FROM f")
def a21_k2_fact_table(spark, sf):
    return S.fact_table(*both(spark, sf))


@query(V + FACTS + """ SELECT count(*) AS total_reviews, round((count(*) FILTER (Calibrated_Sentiment = 'POSITIVE') - count(*) FILTER (Calibrated_Sentiment = 'NEGATIVE')) * 100.0 / count(*), 1) AS net_sentiment_score, """
    + ", ".join(f"round(count(*) FILTER ({c}) * 100.0 / count(*), 1) AS {n}" for n, c in (("positive_rate_pct", "Calibrated_Sentiment = 'POSITIVE'"), ("negative_rate_pct", "Calibrated_Sentiment = 'NEGATIVE'"), ("neutral_rate_pct", "Calibrated_Sentiment = 'NEUTRAL'"), ("defect_surge_rate_pct", "Complaint_Clauses > 0"), ("actionable_rate_pct", "Is_Actionable"), ("redacted_pct", "Is_PII_Scrubbed")))
    + ", count(*) FILTER (Has_Silent_Defect) AS silent_defects_count FROM f")
def a20_a28_kpi_summary(spark, sf):
    return S.kpi_summary(S.fact_table(*both(spark, sf)))


THEMES = """t AS (SELECT source, count(*) AS review_count, round(count(*) FILTER (quality = 0) * 100.0 / count(*), 1) AS negative_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
 u AS (SELECT row_number() OVER (ORDER BY source) AS position, source AS title, review_count, negative_rate, CASE WHEN negative_rate >= 35 THEN 'CRITICAL' WHEN negative_rate >= 15 THEN 'HIGH' ELSE 'LOW' END AS severity, [source, upper(source), 'x', 'word ' || source] AS keywords FROM t)"""


def themes(spark, sf):
    from pyspark.sql import Window as W

    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    t = d.groupBy(F.col("source").alias("title")).agg(F.count("*").alias("review_count"), F.round(F.count_if(F.col("quality") == 0) * 100.0 / F.count("*"), 1).alias("negative_rate"))
    tier = F.when(F.col("negative_rate") >= 35, "CRITICAL").when(F.col("negative_rate") >= 15, "HIGH").otherwise("LOW")
    return t.withColumns({"position": F.row_number().over(W.orderBy("title")), "severity": tier, "keywords": F.array("title", F.upper("title"), F.lit("x"), F.concat(F.lit("word "), "title"))})


@query(f"WITH {THEMES}, k AS (SELECT position, i, lower(trim(keywords[i])) AS keyword, review_count FROM u, generate_series(1, 4) g(i)), f AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY position, i) AS r FROM k WHERE length(keyword) > 2), o AS (SELECT *, row_number() OVER (ORDER BY position, i) AS place FROM f WHERE r = 1) SELECT place::INTEGER AS place, keyword, review_count AS count FROM o WHERE place <= 16")
def a6_keyword_cloud(spark, sf):
    return S.keyword_cloud(themes(spark, sf))


ALERTS = "a(position, message, psi) AS (VALUES (1, 'Drift in 2024-Q3', 0.314::DOUBLE), (2, 'Drift in 2024-Q4', 0.12))"


def alert_rows(spark):
    return spark.createDataFrame([(2, "Drift in 2024-Q4", 0.12), (1, "Drift in 2024-Q3", 0.314)], "position int, message string, psi double")


@query(V + f""", {ALERTS}, {THEMES}, g AS (SELECT * FROM u WHERE severity IN ('CRITICAL', 'HIGH') ORDER BY position LIMIT 1), r AS (SELECT round_even(count(*) FILTER (sentiment = 'POSITIVE') * 100.0 / count(*), 0)::INTEGER AS p FROM v)
 SELECT 1 AS place, message AS title, printf('%.2f', psi) AS value FROM a WHERE position = 1 UNION ALL SELECT 2, 'Highest-severity cluster ''' || title || ''' (' || negative_rate || '% negative)', review_count::VARCHAR FROM g UNION ALL SELECT 3, 'Overall product satisfaction at ' || p || '% positive sentiment', p || '%' FROM r""")
def a40_insights(spark, sf):
    return S.insights(alert_rows(spark), themes(spark, sf), both(spark, sf)[0])


@query(f"WITH {THEMES} SELECT row_number() OVER (ORDER BY severity = 'CRITICAL' DESC, negative_rate DESC, review_count DESC, position)::INTEGER AS place, title FROM u")
def o1_theme_order(spark, sf):
    own = C.theme_order(themes(spark, sf).withColumn("cluster_id", F.col("position")))
    return own.agg(F.collect_list("title").alias("t")).select(F.posexplode("t").alias("place", "title")).select((F.col("place") + 1).alias("place"), "title")


CLUSTERED = f"""e AS (SELECT vec_id, CASE WHEN vec_id % 10 = 9 THEN -1 ELSE label END AS cluster_id, embedding, coalesce(text, '') AS sentence_text, CASE WHEN vec_id % 23 = 0 THEN 'P0' WHEN vec_id % 7 = 0 THEN 'P1' ELSE 'P3' END AS severity, 0.5::DOUBLE + (vec_id % 10) / 20 AS confidence, source AS batch FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
 cc AS (SELECT cluster_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM e, generate_series(1, 64) g(i) GROUP BY ALL), cm AS (SELECT cluster_id, list(x ORDER BY i) AS centroid FROM cc GROUP BY cluster_id),
 ed AS (SELECT e.*, round(sqrt(list_sum(list_transform(list_zip(embedding, centroid), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))), 9) AS distance FROM e JOIN cm USING (cluster_id)),
 md AS (SELECT cluster_id, first(vec_id ORDER BY distance, vec_id) AS medoid, first(sentence_text ORDER BY distance, vec_id) AS medoid_verbatim FROM ed GROUP BY cluster_id),
 ei AS (SELECT cluster_id, list(vec_id ORDER BY vec_id) AS ids FROM e GROUP BY cluster_id), eq AS (SELECT md.*, list_slice(list_concat([medoid], list_filter(list_slice(ids, 1, 100), lambda i: i <> medoid)), 1, 100) AS quotes FROM md JOIN ei USING (cluster_id)),
 ew AS (SELECT cluster_id, {tokens_sql('sentence_text')} AS t FROM e WHERE cluster_id >= 0), eg AS (SELECT cluster_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))])) AS term FROM ew), ea AS (SELECT cluster_id, term, count(*) AS tf FROM eg GROUP BY ALL), ex AS (SELECT term FROM ea GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 3000), en AS (SELECT ea.* FROM ea JOIN ex USING (term)),
 ef AS (SELECT term, count(*) AS f FROM en GROUP BY term), ev AS (SELECT cluster_id, term, (1 + ln(tf)) * ln(1 + (SELECT avg(f) FROM ef) / f) AS weight FROM en JOIN ef USING (term)), er AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 9) DESC, term) AS rank FROM ev WHERE weight > 0), ek AS (SELECT cluster_id, list(term ORDER BY rank) AS keywords FROM er WHERE rank <= 6 GROUP BY cluster_id),
 et AS (SELECT cluster_id, keywords, keywords[1] AS head, list_filter(keywords[2:], lambda k: len(list_intersect(string_split(k, ' '), string_split(keywords[1], ' '))) = 0)[1] AS other FROM ek),
 ep AS (SELECT *, array_to_string(list_transform(string_split(head, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || coalesce(' & ' || array_to_string(list_transform(string_split(other, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), '') AS made FROM et),
 es AS (SELECT cluster_id, count(*) AS n, count(*) FILTER (severity = 'P0') AS p0, count(*) FILTER (severity = 'P1') AS p1, round(avg(confidence) * 100, 1) AS delight FROM e GROUP BY cluster_id), eo AS (SELECT es.*, (SELECT sum(n) FROM es) AS total, eq.* EXCLUDE (cluster_id), ep.keywords, ep.made FROM es JOIN eq USING (cluster_id) LEFT JOIN ep USING (cluster_id))"""
TIER = "['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(CASE WHEN n / total >= 0.2 AND n >= 3 THEN 3 WHEN n / total >= 0.14 AND n >= 2 THEN 2 WHEN n / total >= 0.08 THEN 1 ELSE 0 END, CASE WHEN p0 >= 2 OR (p0 >= 1 AND n >= 4) THEN 3 WHEN p0 > 0 THEN 2 WHEN p1 >= 3 OR (p1 >= 1 AND n >= 5) THEN 2 WHEN p1 > 0 THEN 1 ELSE 0 END) + 1]"


def clustered(spark, sf):
    e = read(spark, sf, "embeddings").join(read(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id"), "left")
    i = F.col("vec_id")
    return e.select("vec_id", F.when(i % 10 == 9, -1).otherwise(F.col("label")).alias("cluster_id"), "embedding", F.coalesce("text", F.lit("")).alias("sentence_text"), F.when(i % 23 == 0, "P0").when(i % 7 == 0, "P1").otherwise("P3").alias("severity"), (0.5 + i % 10 / 20).alias("confidence"), F.col("source").alias("batch"))


NAMED = ("cluster_id", "embedding", "vec_id", "sentence_text")


def joined(c):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(f"""WITH {CLUSTERED} SELECT cluster_id, CASE WHEN cluster_id = -1 THEN '{C.OUTLIER_TITLE}' ELSE made END AS title, array_to_string(CASE WHEN cluster_id = -1 THEN ['unclassified', 'novel-defect', 'emerging'] ELSE keywords END, ',') AS keywords, n AS sentence_count,
 CASE WHEN cluster_id = -1 THEN CASE WHEN (n / total >= 0.1 AND n >= 3) OR p0 >= 1 THEN 'HIGH' ELSE 'MEDIUM' END ELSE {TIER} END AS severity, medoid, medoid_verbatim, array_to_string(quotes, ',') AS quotes FROM eo""")
def c7_c12_w3_o2_complaint_clusters(spark, sf):
    own = C.complaint_clusters(clustered(spark, sf), *NAMED, tokens(F.col("sentence_text")))
    return own.select("cluster_id", "title", joined("keywords"), "sentence_count", "severity", "medoid", "medoid_verbatim", joined("quotes"))


@query(f"WITH {CLUSTERED} SELECT cluster_id AS request_id, coalesce(made || ' Request', 'Feature Proposal #' || (cluster_id + 1)) AS title, n AS vote_count, CASE WHEN n / total >= 0.28 AND n >= 2 THEN 'HIGH' WHEN n / total >= 0.16 THEN 'MEDIUM' ELSE 'LOW' END AS priority, medoid_verbatim AS medoid_quote FROM eo")
def c8_o3_feature_requests(spark, sf):
    return C.feature_requests(clustered(spark, sf), *NAMED, tokens(F.col("sentence_text"))).select("request_id", "title", "vote_count", "priority", "medoid_quote")


@query(f"WITH {CLUSTERED} SELECT cluster_id, coalesce(made, 'Product Strength #' || (cluster_id + 1)) AS title, n AS praise_count, delight AS delight_score, CASE WHEN n / total >= 0.28 AND n >= 3 THEN 'EXCEPTIONAL' WHEN n / total >= 0.15 THEN 'STRONG' ELSE 'NOTABLE' END AS delight_tier, medoid, array_to_string(quotes, ',') AS quotes FROM eo")
def c9_praise_clusters(spark, sf):
    return C.praise_clusters(clustered(spark, sf), *NAMED, tokens(F.col("sentence_text"))).select("cluster_id", "title", "praise_count", "delight_score", "delight_tier", "medoid", joined("quotes"))


FEW = f"WITH {CLUSTERED}, c AS (SELECT cluster_id, coalesce(made, 'none') AS title, n AS sentence_count, CASE WHEN cluster_id = -1 THEN 'HIGH' ELSE {TIER} END AS severity FROM eo) "


def few(spark, sf):
    return c7_c12_w3_o2_complaint_clusters(spark, sf)


@query(FEW + "SELECT sum(sentence_count)::BIGINT AS total_citations, max(sentence_count) AS largest, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high FROM c")
def v3_cluster_figures(spark, sf):
    return C.cluster_figures(few(spark, sf))


@query(FEW + "SELECT cluster_id, severity, sentence_count FROM c ORDER BY list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) DESC, sentence_count DESC, cluster_id LIMIT 3")
def v4_prioritized(spark, sf):
    return C.prioritized(few(spark, sf)).select("cluster_id", "severity", "sentence_count")


@query(FEW + "SELECT cluster_id, sentence_count FROM c WHERE severity = 'CRITICAL' AND contains(lower(title), 'a')")
def q15_v2_filtered_clusters(spark, sf):
    return S.matching(few(spark, sf), ["title"], " A", severity="critical").select("cluster_id", "sentence_count")


@query(f"WITH {THEMES} SELECT title, review_count FROM u WHERE contains(lower(title || chr(10) || array_to_string(keywords, ' ')), 'src1')")
def v8_filtered_themes(spark, sf):
    return S.matching(themes(spark, sf), ["title", "keywords"], "SRC1").select("title", "review_count")


@query(FEW + "SELECT cluster_id, title FROM c WHERE severity = 'HIGH'")
def v5_v7_filtered_by_tier(spark, sf):
    own = few(spark, sf).withColumn("title", F.when(F.col("cluster_id") == -1, "none").otherwise(F.col("title")))
    return S.matching(own, ["title"], None, severity="HIGH").select("cluster_id", "title")


@query(V + PER + """, l AS (SELECT batch, count(*) AS review_count, count(*) FILTER (sentiment = 'NEGATIVE') AS negative_count FROM v GROUP BY batch ORDER BY batch DESC LIMIT 12), c AS (SELECT severity AS cluster_id, CASE WHEN severity = 'P0' THEN 'CRITICAL' ELSE 'LOW' END AS tier, count(*) AS sentence_count FROM s WHERE label = 'COMPLAINT' GROUP BY severity ORDER BY (severity = 'P0') DESC, sentence_count DESC, cluster_id LIMIT 6),
 d AS (SELECT severity AS cluster_id, batch, count(*) AS direct FROM s JOIN v USING (review_id) WHERE label = 'COMPLAINT' AND sentence_idx < 2 GROUP BY ALL), g AS (SELECT cluster_id, l.batch, review_count, greatest(coalesce(direct, 0), round_even(sentence_count / greatest((SELECT count(*) FROM v) * 0.2::DOUBLE, 1) * negative_count, 0)::BIGINT) AS n FROM l CROSS JOIN c LEFT JOIN d USING (cluster_id, batch))
 SELECT cluster_id, batch AS cohort, n AS count, round(n / review_count * 100, 2) AS rate_pct, review_count AS review_volume FROM g""")
def d20_drift_series(spark, sf):
    reviews, sentences = both(spark, sf)
    bad = sentences.filter("label = 'COMPLAINT'").withColumn("cluster_id", F.col("severity"))
    own = bad.groupBy("cluster_id").agg(F.count("*").alias("sentence_count")).withColumn("severity", F.when(F.col("cluster_id") == "P0", "CRITICAL").otherwise("LOW"))
    line = reviews.groupBy("batch").agg(F.count("*").alias("review_count"), F.count_if(F.col("sentiment") == "NEGATIVE").alias("negative_count"))
    return S.drift_series(own, bad.filter("sentence_idx < 2").select("cluster_id", "review_id"), line, reviews)


@query("SELECT * FROM (VALUES ('Batch-24C', 0.384::DOUBLE, 'CRITICAL', 'Burning', true, 0), ('2024-Q3', 0.314, 'CRITICAL', 'Leak', false, 1)) a(batch, psi, level, top_driver, is_simulated, place)")
def d21_simulated_alert(spark, sf):
    real = spark.createDataFrame([("2024-Q3", 0.314, "CRITICAL", "Leak")], "batch string, psi double, level string, top_driver string")
    once = S.with_anomaly(real, "old", 0.3, "Crash")
    return S.with_anomaly(S.with_anomaly(S.without_anomaly(once), "other", 0.2, "x"), "Batch-24C", 0.384, "Burning")


@query(V + ", r AS (SELECT rating, coalesce(rating, 3) AS r FROM v), c AS (SELECT severity AS title, severity, count(*) AS n FROM s GROUP BY severity), o AS (SELECT count(*) AS total_reviews, round(avg(coalesce(rating, 4)), 2) AS csat_score, round(count(*) FILTER (r >= 4) * 100.0 / count(*), 1) AS positive_sentiment_pct, round(count(*) FILTER (r <= 2) * 100.0 / count(*), 1) AS negative_sentiment_pct, round(count(*) FILTER (r = 3) * 100.0 / count(*), 1) AS neutral_sentiment_pct FROM r) SELECT o.*, (SELECT count(*) FROM c WHERE severity IN ('P0', 'CRITICAL')) AS critical_clusters, (SELECT title FROM c ORDER BY n DESC, title DESC LIMIT 1) AS top_complaint, 2::BIGINT AS active_drift_alarms FROM o")
def a23_briefing(spark, sf):
    reviews, sentences = both(spark, sf)
    own = sentences.groupBy("severity").agg(F.count("*").alias("n")).withColumn("title", F.col("severity"))
    return S.briefing(reviews, own, alert_rows(spark))


@query(V + """, c AS (SELECT severity AS priority, 'pump ' || severity AS title, count(*) AS n FROM s WHERE label = 'COMPLAINT' GROUP BY severity), m AS (SELECT *, round(n / (SELECT count(*) FROM v) * 100, 2) AS blast FROM c), i AS (SELECT *, least(round(blast * 4 * CASE priority WHEN 'P0' THEN 3.0::DOUBLE WHEN 'P1' THEN 2 WHEN 'P2' THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END, 1), 99.0) AS impact, round(n * 2.7::DOUBLE / (SELECT count(*) FROM v), 3) AS lift FROM m),
 q AS (SELECT *, CASE WHEN impact >= 50 THEN 'QUICK_WIN' WHEN priority = 'P0' THEN 'CRITICAL_BLOCKER' ELSE 'QUALITY_OF_LIFE' END AS quadrant FROM i) SELECT round(least(4.1::DOUBLE + least(sum(lift), 0.75), 5.0), 2) AS projected_target_csat, round(least(sum(lift), 0.75), 2) AS max_potential_lift, count(*) FILTER (quadrant = 'QUICK_WIN') AS quick_wins, count(*) FILTER (quadrant = 'CRITICAL_BLOCKER') AS critical_blockers, 0::BIGINT AS strategic_revamp, count(*) FILTER (quadrant = 'QUALITY_OF_LIFE') AS quality_of_life FROM q""")
def a22_o6_action_totals(spark, sf):
    reviews, sentences = both(spark, sf)
    own = sentences.filter("label = 'COMPLAINT'").groupBy(F.col("severity").alias("priority")).agg(F.count("*").alias("n")).withColumn("title", F.concat(F.lit("pump "), "priority"))
    total = reviews.agg(F.count("*").alias("total"))
    return S.action_totals(S.action_matrix(own.crossJoin(F.broadcast(total)), F.col("total")), 4.1)


@query("SELECT q AS query, array_to_string(list_filter(['severe', 'drift', 'praise', 'feature', 'action'], lambda k: len(list_filter(w[k], lambda x: contains(lower(q), x))) > 0), ',') AS kinds FROM (SELECT unnest(['Which batch is the worst?', 'What do people love', 'Plan the next sprint and fix the crash', 'hello']) AS q), (SELECT MAP {"
    + ", ".join(f"'{k}': [{', '.join(map(repr, w))}]" for k, w in S.QUERY_KINDS.items()) + "} AS w)")
def t27_query_kinds(spark, sf):
    df = spark.createDataFrame([(q,) for q in ("Which batch is the worst?", "What do people love", "Plan the next sprint and fix the crash", "hello")], "query string")
    return df.select("query", F.array_join(S.query_kinds(F.col("query")), ",").alias("kinds"))


@query(V + ", w AS (SELECT *, list_distinct(regexp_extract_all(lower(redacted_text), '[\\p{L}\\p{N}_]+')) AS t FROM v) SELECT review_id, len(list_filter(t, lambda x: x IN ('used', 'the', 'love', 'pump'))) * CASE WHEN sentiment = 'NEGATIVE' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS score, CASE WHEN length(redacted_text) > 160 THEN substr(redacted_text, 1, 160) || '...' ELSE redacted_text END AS quote FROM w ORDER BY score DESC, review_id LIMIT 4")
def o11_ranked_evidence(spark, sf):
    return S.ranked_evidence(both(spark, sf)[0], "used the love pump", F.col("sentiment") == "NEGATIVE")


@query(V + ", o AS (SELECT *, count(*) OVER () AS total FROM s WHERE label = 'COMPLAINT' AND severity = 'P1' AND contains(lower(sentence_text), 'pump')) SELECT review_id, sentence_idx, total, ceil(total / 5)::BIGINT AS pages, total > 5 AS has_more FROM o ORDER BY review_id, sentence_idx LIMIT 5")
def q14_o8_proposition_page(spark, sf):
    rows = both(spark, sf)[1]
    return P.proposition_page(rows, 1, 5, "complaint", "p1", True, None, "PUMP").select("review_id", "sentence_idx", "total", "pages", "has_more")


@query("WITH b AS (SELECT doc_id, lang, source, trim(text) AS base FROM documents), o AS (SELECT DISTINCT lang, base FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || base), base) AS r, count(*) OVER (PARTITION BY lang) AS n FROM o) SELECT doc_id, CASE WHEN base IN (SELECT base FROM r WHERE r <= greatest(1, floor(n * 0.2))) THEN 'val' ELSE 'train' END AS split FROM b")
def a35_leak_free_split(spark, sf):
    return P.leak_free_split(read(spark, sf, "documents").select("doc_id", "lang", "text"), "text", ["lang"]).select("doc_id", "split")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10")
def o12_sampled(spark, sf):
    return P.sampled(read(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 10)


@query(V + "SELECT count(*) AS n, count(DISTINCT lower(trim(sentence_text))) AS texts FROM (SELECT DISTINCT ON (lower(trim(sentence_text))) sentence_text FROM s WHERE regexp_matches(lower(trim(sentence_text)), 'pump|burn') AND NOT regexp_matches(lower(trim(sentence_text)), 'love') AND len(regexp_split_to_array(trim(sentence_text), '\\s+')) >= 4 AND length(trim(sentence_text)) >= 16)")
def t29_harvest(spark, sf):
    own = P.harvested(both(spark, sf)[1], "sentence_text", "pump|burn", "love")
    return own.agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.trim("sentence_text"))).alias("texts"))


@query(V + "SELECT 'sentiment' AS figure, sentiment AS value, count(*) AS n FROM v GROUP BY sentiment UNION ALL SELECT 'batch', batch, count(*) FROM v GROUP BY batch UNION ALL SELECT 'label', label, count(*) FROM s GROUP BY label UNION ALL SELECT 'reviews', 'all', count(*) FROM v UNION ALL SELECT 'sentences', 'all', count(*) FROM s")
def a38_run_summary(spark, sf):
    return P.run_summary(*both(spark, sf))


@query("WITH p AS (SELECT 0 AS part, doc_id AS review_id, quality AS cluster_id, 'low' AS why FROM labels WHERE quality = 0 UNION ALL SELECT 1, doc_id, quality, 'toxic' FROM labels WHERE toxic = 1) SELECT review_id, cluster_id, why FROM (SELECT *, row_number() OVER (PARTITION BY review_id, cluster_id ORDER BY part) AS r FROM p) WHERE r = 1")
def u6_audit_list(spark, sf):
    labels = read(spark, sf, "labels")
    own = lambda c, why: labels.filter(c).select(F.col("doc_id").alias("review_id"), F.col("quality").alias("cluster_id"), F.lit(why).alias("why"))
    return P.audit_list(own("quality = 0", "low"), own("toxic = 1", "toxic"))


@query("SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, 'again' FROM labels")
def u1_concat(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "source").unionByName(read(spark, sf, "labels").select("doc_id", F.lit("again").alias("source")))


@query("SELECT * FROM (VALUES ('1.5', 1.5::DOUBLE, 'a|b'), ('NaN', 0, ''), ('Infinity', 0, 'x'), ('', 0, 'y'), ('-2', -2, 'p q|r')) t(raw, number, parts)")
def f8_f14_scalars(spark, sf):
    df = spark.createDataFrame([("1.5", " a, b"), ("NaN", None), ("Infinity", "x,"), ("", ",y"), ("-2", "p q , r ")], "raw string, cell string")
    return df.select("raw", P.safe_number(F.col("raw")).alias("number"), F.array_join(P.cell_list(F.col("cell")), "|").alias("parts"))


@query("SELECT d.doc_id, l.quality FROM (SELECT row_number() OVER (ORDER BY doc_id) AS i, * FROM labels) l JOIN (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) d USING (i)")
def j2_by_position(spark, sf):
    from pyspark.sql import Window as W

    labels = read(spark, sf, "labels").select("doc_id", "quality")
    place = F.row_number().over(W.orderBy("doc_id"))  # small tables here; readers.indexed numbers rows without one task
    left = read(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id").withColumn("i", place)
    return P.by_position(left, labels.withColumn("i", place).withColumnRenamed("doc_id", "same"), "i", ("doc_id", "same")).select("doc_id", "quality")


@query("SELECT event_id, c_custkey FROM events JOIN customer ON user_id = c_custkey WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def j11_live_sessions(spark, sf):
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_custkey")
    return P.live_sessions(read(spark, sf, "events").select("event_id", "user_id", "ts"), users, "user_id", "ts", F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j14_cascaded(spark, sf):
    left = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "l_orderkey")
    return P.cascaded(read(spark, sf, "lineitem"), left, "l_orderkey").select("l_orderkey", "l_linenumber")


@query(V + PER + ", d AS (SELECT review_id, severity AS cluster_id, sentence_idx FROM s WHERE label = 'COMPLAINT') SELECT review_id, batch, count(*) AS quotes FROM d JOIN v USING (review_id) GROUP BY ALL")
def j8_quotes_by_cohort(spark, sf):
    reviews, sentences = both(spark, sf)
    return sentences.filter("label = 'COMPLAINT'").join(reviews.select("review_id", "batch"), "review_id").groupBy("review_id", "batch").agg(F.count("*").alias("quotes"))
