"""Queries over the test tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import pii, text
from tidemark.operators import aggregates as A
from tidemark.operators import drift as D
from tidemark.operators import keywords as K
from tidemark.operators import quality_gate as Q
from tidemark.operators import severity as S
from tidemark.operators import vectors as V
from tidemark.plans.adapters import R_ORD_SQL, labelled_documents, orders_as_reviews, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
R = f"WITH {R_ORD_SQL} "
PCT = "CASE WHEN {b} > 0 THEN round({a} * 100.0 / {b}, {n}) ELSE 0 END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pct(a: str, b: str, n: int = 1) -> str:
    return PCT.format(a=a, b=b, n=n)


COUNTS = ", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s.lower()}_count" for s in A.SENTIMENTS)


@query(R + f", t AS (SELECT batch, count(*) AS review_count, {COUNTS} FROM r GROUP BY batch) SELECT *, round(negative_count * 100.0 / review_count, 1) AS negative_rate FROM t")
def a12_cohort_timeline(spark, sf):
    r = orders_as_reviews(spark, sf, "batch", "sentiment").groupBy("batch").agg(F.count("*").alias("review_count"), *A.counted("sentiment"))
    return r.withColumn("negative_rate", F.round(F.col("negative_count") * 100.0 / F.col("review_count"), 1))


@query(R + f", t AS (SELECT count(*) AS total, {COUNTS} FROM r) SELECT *, {pct('positive_count', 'total')} AS positive_rate, {pct('negative_count', 'total')} AS negative_rate FROM t")
def a1_sentiment_summary(spark, sf):
    return A.sentiment_summary(orders_as_reviews(spark, sf, "sentiment"))


@query(R + f"SELECT s.star::INTEGER AS star, count(r.rating) AS n, {pct('count(r.rating)', '(SELECT count(*) FROM r)')} AS percent FROM generate_series(1, 5) s(star) LEFT JOIN r ON r.rating = s.star GROUP BY s.star")
def a3_rating_distribution(spark, sf):
    return A.rating_distribution(orders_as_reviews(spark, sf, "rating"))


@query(R + "SELECT channel AS label, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (sentiment = '{s}') * 100.0 / count(*), 2) AS {s[:3].lower()}" for s in A.SENTIMENTS) + " FROM r GROUP BY channel")
def a4_sentiment_by_channel(spark, sf):
    return A.sentiment_by(orders_as_reviews(spark, sf, "channel", "sentiment"), "channel")


@query(R + "SELECT batch AS label, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (sentiment = '{s}') * 100.0 / count(*), 2) AS {s[:3].lower()}" for s in A.SENTIMENTS) + " FROM r GROUP BY batch")
def a5_sentiment_trend(spark, sf):
    return A.sentiment_by(orders_as_reviews(spark, sf, "batch", "sentiment"), "batch")


@query(R + f", t AS (SELECT theme, count(*) AS review_count, {COUNTS} FROM r GROUP BY theme) SELECT *, {pct('negative_count', 'review_count')} AS negative_rate FROM t")
def a9_theme_summary(spark, sf):
    return A.theme_summary(orders_as_reviews(spark, sf, "theme", "sentiment"))


@query(R + "SELECT batch, theme, count(*) AS n FROM r GROUP BY ALL")
def a11_theme_distribution(spark, sf):
    return D.distributions(orders_as_reviews(spark, sf, "batch", "theme"))


@query(R + """, t AS (SELECT product_name, count(*) AS n, round(avg(rating), 2) AS avg_rating, count(*) FILTER (sentiment = 'NEGATIVE') AS complaints,
 array_to_string(list_slice(list_sort(list_distinct(list(batch) FILTER (sentiment = 'NEGATIVE'))), 1, 3), ',') AS cohorts FROM r GROUP BY product_name HAVING count(*) >= 15),
 u AS (SELECT *, round(complaints * 100.0 / n, 1) AS defect_pct FROM t)
 SELECT product_name, n, avg_rating, complaints, defect_pct, coalesce(cohorts, '') AS cohorts, CASE WHEN defect_pct >= 40 THEN 'HIGH' WHEN defect_pct >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM u""")
def a14_product_matrix(spark, sf):
    return A.product_matrix(orders_as_reviews(spark, sf, "product_name", "rating", "sentiment", "batch"))


@query(R + f", t AS (SELECT rating AS star, count(*) AS n, count(*) FILTER (sentiment = 'NEGATIVE') AS complaints FROM r GROUP BY rating) SELECT star, n, complaints, {pct('(SELECT sum(complaints) FROM t WHERE star >= 4)', '(SELECT sum(complaints) FROM t)')} AS hidden_pct FROM t")
def a15_rating_divergence(spark, sf):
    return A.rating_divergence(orders_as_reviews(spark, sf, "rating", "sentiment"))


SIDE = "CASE WHEN batch < '1998-Q1' THEN 'A' ELSE 'B' END"
STATS = f"s AS (SELECT {SIDE} AS side, count(*) AS n, round(avg(coalesce(rating, 3)), 2) AS avg_rating, " + ", ".join(f"round(count(*) FILTER (sentiment = '{s}') * 100.0 / count(*), 1) AS {s.lower()}_pct" for s in A.SENTIMENTS) + ", " + ", ".join(f"count(*) FILTER (coalesce(rating, 3) = {k}) AS stars_{k}" for k in range(1, 6)) + " FROM r GROUP BY 1)"


@query(R + f", {STATS} SELECT * FROM s")
def a16_cohort_stats(spark, sf):
    return A.cohort_stats(orders_as_reviews(spark, sf, "batch", "rating", "sentiment"), F.expr(SIDE))


@query(R + f""", o AS (SELECT theme, {SIDE} AS side FROM r), n AS (SELECT count(*) FILTER (side = 'A') AS na, count(*) FILTER (side = 'B') AS nb FROM o),
 p AS (SELECT theme, round(count(*) FILTER (side = 'A') * 100.0 / greatest(max(na), 1), 2) AS pct_a, round(count(*) FILTER (side = 'B') * 100.0 / greatest(max(nb), 1), 2) AS pct_b FROM o, n GROUP BY theme),
 d AS (SELECT *, round(pct_b - pct_a, 2) AS delta_pp, round(pct_b / greatest(pct_a, 0.001), 2) AS ratio FROM p)
 SELECT *, CASE WHEN delta_pp >= 1.5 THEN 'SURGE' WHEN delta_pp <= -1.5 THEN 'DROP' ELSE 'STABLE' END AS direction FROM d ORDER BY abs(delta_pp) DESC, theme LIMIT 6""")
def a17_topic_shifts(spark, sf):
    return A.topic_shifts(orders_as_reviews(spark, sf, "batch", "theme"), F.expr(SIDE))


@query(R + f""", {STATS}, v AS (SELECT round(max(avg_rating) FILTER (side = 'B') - max(avg_rating) FILTER (side = 'A'), 2) AS rating_delta, round(max(negative_pct) FILTER (side = 'B') - max(negative_pct) FILTER (side = 'A'), 1) AS negative_delta FROM s)
 SELECT *, CASE WHEN rating_delta <= -0.2 OR negative_delta >= 4 THEN 'REGRESSED' WHEN rating_delta >= 0.2 OR negative_delta <= -4 THEN 'IMPROVED' ELSE 'STABLE' END AS verdict FROM v""")
def a18_verdict(spark, sf):
    return A.verdict(A.cohort_stats(orders_as_reviews(spark, sf, "batch", "rating", "sentiment"), F.expr(SIDE)))


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,15}')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 60")
def a19_word_counts(spark, sf):
    return A.word_counts(read(spark, sf, "documents"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,15})"), F.lit(1)), [])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY event_type")
def a31_describe(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))


@query("SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a32_resample_by_year(spark, sf):
    return read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(R + "SELECT DISTINCT batch FROM r")
def a39_cohorts(spark, sf):
    return orders_as_reviews(spark, sf, "batch").select("batch").distinct()


PAIRS = """, c AS (SELECT batch, theme, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT batch, sum(n) AS nt FROM c GROUP BY batch),
 o AS (SELECT batch, nt, lag(batch) OVER (ORDER BY batch) AS previous, lag(nt) OVER (ORDER BY batch) AS nb FROM t),
 k AS (SELECT batch, theme, n AS kt, 0 AS kb FROM c UNION ALL SELECT o.batch, c.theme, 0, c.n FROM o JOIN c ON c.batch = o.previous),
 p AS (SELECT k.batch, theme, sum(kt) AS kt, sum(kb) AS kb, any_value(nt) AS nt, any_value(nb) AS nb, any_value(previous) AS previous FROM k JOIN o USING (batch) GROUP BY k.batch, theme)"""
LINE = PAIRS + f""", m AS (SELECT batch, greatest(0, sum((kt / nt - kb / nb) * ln((kt / nt + 1e-4) / (kb / nb + 1e-4)))) AS psi, any_value(previous) AS previous FROM p GROUP BY batch),
 n AS (SELECT batch, count(*) AS review_count, {COUNTS} FROM r GROUP BY batch),
 line AS (SELECT batch, review_count, negative_count, neutral_count, positive_count,
 CASE WHEN previous IS NULL THEN 0.0 WHEN review_count >= 100 THEN round(m.psi, 4) END AS psi,
 CASE WHEN previous IS NULL THEN 'BASELINE' WHEN review_count < 100 THEN 'INSUFFICIENT_DATA' WHEN m.psi >= 0.25 THEN 'CRITICAL_DRIFT' WHEN m.psi >= 0.1 THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS status,
 round(negative_count * 100.0 / review_count, 1) AS negative_rate FROM n JOIN m USING (batch))"""


@query(R + LINE + " SELECT * FROM line")
def d1_d3_drift_timeline(spark, sf):
    return D.timeline(orders_as_reviews(spark, sf, "batch", "theme", "sentiment"))


def log_choose(n: str, k: str) -> str:
    return f"lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - ({k}) + 1.0)"


def fisher_sql(cells: str, a: str, b: str, c: str, d: str) -> str:
    """From rows of cells, with a..d as the table's cells: z AS cells with p and p2, of Fisher's exact test."""
    row, col, rest = f"({a} + {b})", f"({a} + {c})", f"({c} + {d})"
    of = lambda x: f"{log_choose(row, x)} + {log_choose(rest, f'({col} - {x})')} - ({log_choose(f'({row} + {rest})', col)})"
    return f"""fa AS (SELECT *, row_number() OVER () AS fid FROM {cells}), fx AS (SELECT *, {of(a)} AS fm, unnest(range(greatest(0, {col} - {rest}), least({row}, {col}) + 1)) AS x FROM fa), fp AS (SELECT *, {of('x')} AS lp FROM fx),
 fs AS (SELECT fid, least(1, sum(exp(lp)) FILTER (x >= {a})) AS p, least(1, sum(exp(lp)) FILTER (lp <= fm + 1e-7)) AS p2 FROM fp GROUP BY fid), z AS (SELECT fa.*, p, p2 FROM fa JOIN fs USING (fid))"""


def attribution_sql(theme: str) -> str:
    """From p as PAIRS has it, a table att of attributions."""
    return f"""pc AS (SELECT batch, {theme}, kt::BIGINT AS kt, kb::BIGINT AS kb, nt::BIGINT AS nt, nb::BIGINT AS nb FROM p WHERE previous IS NOT NULL), {fisher_sql('pc', 'kt', '(nt - kt)', 'kb', '(nb - kb)')},
 att AS (SELECT batch, {theme}, kt AS target_count, kb AS baseline_count, round(kt / nt * 100, 2) AS target_rate_pct, round(kb / nb * 100, 2) AS baseline_rate_pct, round((kt / nt - kb / nb) * 100, 2) AS rate_delta_pp, round(((kt + 0.5) / (nt + 0.5)) / ((kb + 0.5) / (nb + 0.5)), 2) AS relative_risk, round(p, 5) AS p_value, round(p2, 5) AS p_value_two_sided,
 p < 0.05 AND kt >= 3 AND kt / nt > kb / nb AS significant, CASE WHEN p < 0.001 THEN 'p < 0.001' WHEN p < 0.05 THEN 'p < 0.05' ELSE 'n.s.' END AS tier FROM z)"""


BRANDS = R.replace("WITH r AS", "WITH r0 AS") + ", r AS (SELECT substr(batch, 1, 4) AS batch, brand FROM r0)" + PAIRS.replace("theme", "brand") + ", " + attribution_sql("brand")


def brands(spark, sf):
    return D.distributions(orders_as_reviews(spark, sf, "batch", "brand").withColumn("batch", F.substring("batch", 1, 4)), "batch", "brand")


@query(BRANDS + " SELECT * FROM att")
def d5_d7_attribution(spark, sf):
    return D.attribution(brands(spark, sf), "batch", "brand")


# every second quarter a share of the lines moves to one theme, so that there is drift to be seen
MOVED = R.replace("WITH r AS", "WITH r0 AS") + ", r AS (SELECT batch, CASE WHEN right(batch, 1) = '2' AND l_orderkey % 3 = 0 THEN 'Surge' ELSE brand END AS theme, sentiment FROM r0)"


def moved_reviews(spark, sf):
    r = orders_as_reviews(spark, sf, "batch", "brand", "sentiment", "l_orderkey")
    return r.select("batch", F.when((F.right("batch", F.lit(1)) == "2") & (F.col("l_orderkey") % 3 == 0), "Surge").otherwise(F.col("brand")).alias("theme"), "sentiment")


@query(MOVED + LINE + ", " + attribution_sql("theme") + """, dr AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY rate_delta_pp DESC, p_value, theme) AS k FROM att), dl AS (SELECT batch, list(theme ORDER BY k) AS drivers FROM dr WHERE k <= 3 GROUP BY batch)
 SELECT batch, psi, CASE WHEN status = 'CRITICAL_DRIFT' THEN 'CRITICAL' ELSE 'WARNING' END AS level, drivers[1] AS top_driver, array_to_string(drivers, ',') AS drivers FROM line LEFT JOIN dl USING (batch) WHERE status IN ('CRITICAL_DRIFT', 'MODERATE_DRIFT')""")
def d4_o4_alerts(spark, sf):
    r = moved_reviews(spark, sf)
    return D.alerts(D.timeline(r), D.attribution(D.distributions(r))).withColumn("drivers", F.array_join("drivers", ","))


@query(MOVED + LINE + ", " + attribution_sql("theme") + """, b AS (SELECT batch, first(theme ORDER BY rate_delta_pp DESC, theme) AS t, max(rate_delta_pp) AS d FROM att GROUP BY batch)
 SELECT batch AS Batch_or_Version, review_count AS Total_Reviews, negative_count AS Negative_Count, positive_count AS Positive_Count, neutral_count AS Neutral_Count, negative_rate AS Negative_Rate_Pct, psi AS PSI_Score, status AS Drift_Status, t AS Primary_Surging_Theme, coalesce(d, 0) AS Surging_Delta_Pct FROM line LEFT JOIN b USING (batch)""")
def k4_drift_rows(spark, sf):
    r = moved_reviews(spark, sf)
    return D.drift_rows(D.timeline(r), D.attribution(D.distributions(r)))


@query(MOVED + LINE + " SELECT batch, psi FROM line WHERE psi > 0.25")
def v11_psi_band(spark, sf):
    return D.psi_band(D.timeline(moved_reviews(spark, sf)), strict=True).select("batch", "psi")


@query(R.replace("WITH r AS", "WITH r0 AS") + ", r AS (SELECT CASE right(batch, 2) WHEN 'Q3' THEN '000000|Q3' WHEN 'Q1' THEN '000001|Q1' WHEN 'Q4' THEN '000002|Q4' END AS batch, brand AS theme, sentiment FROM r0 WHERE right(batch, 2) <> 'Q2')" + PAIRS + " SELECT batch, any_value(previous) AS previous, round(greatest(0, sum((kt / nt - kb / nb) * ln((kt / nt + 1e-4) / (kb / nb + 1e-4)))), 6) AS psi FROM p WHERE previous IS NOT NULL GROUP BY batch")
def d2_explicit_order(spark, sf):
    r = orders_as_reviews(spark, sf, "batch", "brand").select(F.right("batch", F.lit(2)).alias("batch"), F.col("brand").alias("theme"))
    own = D.pairs(D.explicit_order(D.distributions(r), ["Q3", "Q1", "Q4"])).filter("previous is not null")
    return own.groupBy("batch").agg(F.first("previous").alias("previous"), F.round(D.psi(F.col("kt"), F.col("nt"), F.col("kb"), F.col("nb")), 6).alias("psi"))


@query(R + """, c AS (SELECT brand, coalesce(channel, 'General') AS channel, count(*) AS k FROM r GROUP BY ALL), w AS (SELECT *, sum(k) OVER (PARTITION BY brand)::BIGINT AS n, sum(k) OVER (PARTITION BY channel)::BIGINT AS b, sum(k) OVER ()::BIGINT AS t, row_number() OVER (PARTITION BY brand ORDER BY k DESC, channel) AS turn FROM c), f AS (SELECT * FROM w WHERE turn = 1), """ + fisher_sql("f", "k", "(n - k)", "(b - k)", "(t - n - (b - k))") + """,
 y AS (SELECT *, (k / n) / greatest((b - k) / greatest(t - n, 1), 1e-4) AS risk FROM z) SELECT brand, CASE WHEN n < 3 THEN 'Omnichannel' ELSE channel END AS batch, n, CASE WHEN p < 0.05 AND n >= 3 AND risk >= 1.5 THEN round(risk, 2) ELSE 1.0 END AS relative_risk, p < 0.05 AND n >= 3 AND risk >= 1.5 AS significant FROM y""")
def d6_relative_risk(spark, sf):
    return D.relative_risk(orders_as_reviews(spark, sf, "brand", "channel"), "brand", "channel")


@query(R + """, b AS (SELECT avg((sentiment = 'NEGATIVE')::INTEGER) AS base FROM r), t AS (SELECT theme, count(*) AS volume, avg((sentiment = 'NEGATIVE')::INTEGER) AS f FROM r GROUP BY theme),
 k AS (SELECT theme, volume, f, CASE WHEN f >= 0.35 AND volume >= 500 THEN 3 WHEN f >= 0.35 THEN 2 WHEN f >= 0.2 THEN 1 ELSE 0 END AS base_rank,
 CASE WHEN base > 0 AND volume >= 25 THEN CASE WHEN f / base >= 3 AND f >= 0.1 AND volume >= 100 THEN 2 WHEN f / base >= 1.25 THEN 1 ELSE 0 END ELSE 0 END AS lift_rank FROM t, b)
 SELECT theme, volume, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(base_rank, lift_rank) + 1] AS severity, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][base_rank + 1] AS simple FROM k""")
def d8_d10_theme_severity(spark, sf):
    r = orders_as_reviews(spark, sf, "theme", "sentiment")
    bad = F.avg((F.col("sentiment") == "NEGATIVE").cast("int"))
    t = r.groupBy("theme").agg(F.count("*").alias("volume"), bad.alias("f")).crossJoin(F.broadcast(r.agg(bad.alias("base"))))
    return t.select("theme", "volume", S.theme_severity(F.col("f"), F.col("volume"), F.col("base")).alias("severity"), S.simple_severity(F.col("f"), F.col("volume")).alias("simple"))


@query(R + """, t AS (SELECT brand, count(*) FILTER (sentiment = 'NEGATIVE') AS n FROM r GROUP BY brand), u AS (SELECT *, sum(n) OVER () AS total FROM t)
 SELECT brand, n, CASE WHEN n / total >= 0.2 AND n >= 3 THEN 'CRITICAL' WHEN n / total >= 0.14 AND n >= 2 THEN 'HIGH' WHEN n / total >= 0.08 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM u""")
def d9_complaint_severity(spark, sf):
    t = orders_as_reviews(spark, sf, "brand", "sentiment").groupBy("brand").agg(F.count_if(F.col("sentiment") == "NEGATIVE").alias("n"))
    t = t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("total"))))
    return t.select("brand", "n", S.complaint_severity(F.col("n"), F.col("total")).alias("severity"))


@query(R + """, t AS (SELECT theme AS title, count(*) FILTER (sentiment = 'NEGATIVE') AS n FROM r GROUP BY theme), u AS (SELECT *, sum(n) OVER () AS total FROM t),
 v AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'P0' WHEN n % 4 = 1 THEN 'P1' WHEN n % 4 = 2 THEN 'P2' ELSE 'P3' END AS priority, round(n / greatest(total, 1) * 100, 2) AS blast_radius_pct FROM u),
 w AS (SELECT *, least(round(blast_radius_pct * 4 * CASE priority WHEN 'P0' THEN 3.0::DOUBLE WHEN 'P1' THEN 2 WHEN 'P2' THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END, 1), 99.0) AS impact_score,
 CASE WHEN regexp_matches(lower(title), 'formula|burn|reaction|ingredient|architecture|rewrite') THEN 'HIGH' WHEN regexp_matches(lower(title), 'packaging|pump|cap|leak|biometric|button|ui') THEN 'MEDIUM' ELSE 'LOW' END AS effort FROM v)
 SELECT title, n, priority, blast_radius_pct, impact_score, effort, CASE effort WHEN 'LOW' THEN 3 WHEN 'MEDIUM' THEN 5 ELSE 13 END AS story_points, round(n * 2.7::DOUBLE / greatest(total, 1), 3) AS csat_lift,
 CASE WHEN impact_score >= 50 AND effort <> 'HIGH' THEN 'QUICK_WIN' WHEN priority = 'P0' OR (impact_score >= 60 AND effort = 'HIGH') THEN 'CRITICAL_BLOCKER' WHEN effort = 'HIGH' AND impact_score < 50 THEN 'STRATEGIC_REVAMP' ELSE 'QUALITY_OF_LIFE' END AS quadrant FROM w""")
def a22_action_matrix(spark, sf):
    t = orders_as_reviews(spark, sf, "theme", "sentiment").groupBy(F.col("theme").alias("title")).agg(F.count_if(F.col("sentiment") == "NEGATIVE").alias("n"))
    t = t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("total")))).withColumn("priority", F.concat(F.lit("P"), (F.col("n") % 4).cast("string")))
    return t.withColumns(S.action_columns(F.col("title"), F.col("n"), F.col("priority"), F.col("total"))).drop("total")


@query("WITH d AS (SELECT doc_id, text, lower(trim(text)) AS s FROM documents) SELECT doc_id, length(text) AS n, CASE WHEN s = '' OR s IN ('nan','null','none','n/a','undefined') THEN 'EMPTY_TEXT' END AS empty_code FROM d")
def q1_empty_texts(spark, sf):
    s = F.lower(F.trim("text"))
    return read(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), F.when((s == "") | s.isin(*Q.L.SENTINELS), "EMPTY_TEXT").alias("empty_code"))


STRIPPED = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
GATE = f"""WITH a AS (SELECT doc_id, text, lower({STRIPPED}) AS s FROM documents), b AS (SELECT *, CASE WHEN s = '' OR s IN ({", ".join(map(repr, Q.L.SENTINELS))}) THEN 'EMPTY_TEXT' WHEN length(s) >= 8 AND list_max(map_values(list_histogram(string_split(s, '')))) / length(s) >= 0.75 THEN 'REPETITIVE_CHARACTER_SPAM'
 WHEN length(trim(regexp_replace(s, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'))) < 6 OR s IN ({", ".join(map(repr, Q.L.FILLERS))}) THEN 'DEGENERATE_SHORT_TEXT' END AS code FROM a),
 g AS (SELECT doc_id, coalesce(code, CASE WHEN row_number() OVER (PARTITION BY regexp_replace(s, '\\s+', ' ', 'g'), code IS NULL ORDER BY doc_id) > 1 THEN 'DUPLICATE_TEXT' END) AS rejection_code, coalesce(length(text) > 4000, false) AS truncated FROM b)"""


@query(GATE + " SELECT * FROM g")
def q8_quality_gate(spark, sf):
    return Q.gate(read(spark, sf, "documents"), "text", "doc_id").select("doc_id", "rejection_code", "truncated")


@query(GATE + """, m AS (SELECT count(*) AS total, count(*) FILTER (rejection_code IS NULL) AS passed, count(rejection_code) AS quarantined, count(*) FILTER (rejection_code = 'DUPLICATE_TEXT') AS duplicates, count(*) FILTER (rejection_code IS NULL AND truncated) AS warnings FROM g)
 SELECT *, round(greatest(0, least(100, 100 * (1 - (0.5::DOUBLE * quarantined / total + 0.3::DOUBLE * duplicates / total + 0.2::DOUBLE * warnings / total)))), 2) AS quality_score FROM m""")
def q9_gate_manifest(spark, sf):
    return Q.manifest(Q.gate(read(spark, sf, "documents"), "text", "doc_id"))


@query(f"""WITH t AS (SELECT {STRIPPED} AS t, CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' WHEN quality IS NOT NULL THEN 'NEUTRAL' END AS sentiment FROM documents LEFT JOIN labels USING (doc_id))
 SELECT 'blank_text' AS "check", 'ERROR' AS level, count(*) FILTER (t = '') AS n_affected FROM t UNION ALL SELECT 'short_text', 'WARNING', count(*) FILTER (t <> '' AND length(t) < 5) FROM t UNION ALL SELECT 'unknown_label', 'WARNING', count(*) FILTER (sentiment IS NULL) FROM t UNION ALL SELECT 'duplicate_text', 'WARNING', count(*) - count(DISTINCT lower(t)) FROM t WHERE t <> ''""")
def q10_validation(spark, sf):
    return Q.validation(labelled_documents(spark, sf), "text", label="sentiment", short=5)


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') AND lang = 'en'")
def q13_filtered_search(spark, sf):
    return read(spark, sf, "documents").filter(F.lower("text").contains("license") & (F.col("lang") == "en")).select("doc_id", "source")


@query(R + "SELECT l_orderkey, l_linenumber, rating, theme FROM r WHERE rating >= 4 AND sentiment = 'NEGATIVE' ORDER BY l_orderkey, l_linenumber LIMIT 50")
def q16_silent_defects(spark, sf):
    return orders_as_reviews(spark, sf, "l_orderkey", "l_linenumber", "rating", "theme", "sentiment").filter("rating >= 4 AND sentiment = 'NEGATIVE'").select("l_orderkey", "l_linenumber", "rating", "theme").orderBy("l_orderkey", "l_linenumber").limit(50)


@query()
def t1_t8_redaction(spark, sf):
    return pii.redact(read(spark, sf, "documents").select("doc_id", "text"), "text").withColumn("entities", F.array_join("entities", ","))


#: A sentence ends at white space after an end mark, but not after an initialism or an abbreviation of two letters.
SENTENCES = """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''), w AS (SELECT *, lag(c, 1) OVER d AS c1, lag(c, 2) OVER d AS c2, lag(c, 3) OVER d AS c3, lag(c, 4) OVER d AS c4 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 b AS (SELECT doc_id, i, c, regexp_matches(c, '\\s') AS blank, coalesce(regexp_matches(c, '\\s') AND c1 IN ('.', '?', '!') AND NOT coalesce(regexp_matches(c4, '\\w') AND c3 = '.' AND regexp_matches(c2, '\\w'), false) AND NOT coalesce(regexp_matches(c3, '[A-Z]') AND regexp_matches(c2, '[a-z]') AND c1 = '.', false), false) AS ends FROM w),
 n AS (SELECT *, sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM b), p AS (SELECT doc_id, part, min(i) - 1 AS a, max(i) AS z FROM n WHERE NOT blank GROUP BY ALL), t AS (SELECT doc_id, part, substr(text, a + 1, z - a) AS text, a::INTEGER AS start, z::INTEGER AS "end" FROM p JOIN documents USING (doc_id))"""


@query(SENTENCES + """, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i FROM t WHERE len(regexp_split_to_array(text, '\\s+')) >= 3) SELECT doc_id || '::S' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END AS sentence_id, text, start, "end" FROM k""")
def t10_sentences(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"), 3)).alias("i", "s")).select(F.format_string("%d::S%03d", "doc_id", "i").alias("sentence_id"), "s.*")


@query()
def t14_intents(spark, sf):
    s = read(spark, sf, "conversations").select("conv_id", "turn", text.router_intent(F.col("text")).alias("r"), text.proposition_intent(F.col("text")).alias("p"))
    return s.select("conv_id", "turn", "r.label", "r.confidence", "p.intent", "p.severity", "p.marker")


@query()
def t18_spans(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.complaint_span(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT doc_id, CASE WHEN length(text) > 180 THEN concat(substr(text, 1, 175), '...') ELSE text END AS snippet FROM documents")
def t24_snippets(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), 175, 180).alias("snippet"))


@query("SELECT o_orderkey, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR AS cohort, CASE WHEN substr(o_orderpriority, 1, 1)::INTEGER <= 2 THEN 'NEGATIVE' WHEN substr(o_orderpriority, 1, 1)::INTEGER = 3 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS label FROM orders")
def p11_p12_labels(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", Q.quarter_label(F.col("o_orderdate")).alias("cohort"), Q.weak_label(F.substring("o_orderpriority", 1, 1).cast("int")).alias("label"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS v FROM lineitem), t AS (SELECT quantile_cont(v, 0.99) AS top FROM v)
 SELECT l_orderkey, l_linenumber, round_even(least(greatest(CASE WHEN top > 10 THEN 1 + v / 100 * 4 WHEN top > 5 THEN 1 + (v - 1) / 9 * 4 ELSE v END, 1), 5), 0)::INTEGER AS rating FROM v, t""")
def p5_rating_scale(spark, sf):
    return Q.normalize_ratings(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").select("l_orderkey", "l_linenumber", "rating")


@query("SELECT doc_id, 'REV-U-' || upper(substr(sha256(concat(text, '_static_ts_', doc_id)), 1, 12)) AS review_id FROM documents")
def p9_review_id(spark, sf):
    return read(spark, sf, "documents").select("doc_id", Q.review_id(F.col("text"), F.lit("static_ts"), F.col("doc_id")).alias("review_id"))


@query(f"""SELECT 'REV-U-' || upper(substr(sha256(concat_ws('_', {STRIPPED}, 'static_ts', doc_id)), 1, 12)) AS review_id, {STRIPPED} AS review_text, 3 AS rating, 'Custom Product' AS product_name, 'General' AS sku_or_module, 'Batch-Custom' AS batch_or_version, coalesce(nullif(trim(source), ''), 'Client Upload') AS channel, '2024-01-01T00:00:00' AS created_at,
 '{{' || array_to_string(list_filter(['"lang":"' || lang || '"', '"n_chars":"' || n_chars || '"'], lambda x: x IS NOT NULL), ',') || '}}' AS extra_metadata, doc_id AS row_index FROM documents""")
def p1_p10_normalize(spark, sf):
    return Q.normalize(read(spark, sf, "documents"), "doc_id", "2024-01-01T00:00:00").withColumn("extra_metadata", F.to_json("extra_metadata"))


@query("""WITH t AS (SELECT p_brand, p_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k = 1),
 j AS (SELECT l_linenumber, t.p_type FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN t ON t.p_brand = part.p_brand) SELECT p_type, count(*) AS n FROM j GROUP BY p_type""")
def j1_catalogue_join(spark, sf):
    part = read(spark, sf, "part")
    first = part.groupBy("p_brand").agg(F.min_by("p_type", "p_partkey").alias("p_type"))
    return read(spark, sf, "lineitem").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(first, "p_brand", "left").groupBy("p_type").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j3_left_join(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j12_semi_join(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j13_anti_join(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def w1_first_occurrence(spark, sf):
    return read(spark, sf, "documents").groupBy("text").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("d")).select("d.*")


@query("SELECT source, doc_id, k::INTEGER AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5")
def w2_first_rows(spark, sf):
    return A.first_rows(read(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 5)


@query(R + ", t AS (SELECT batch, round(avg(rating), 4) AS mean FROM r GROUP BY batch) SELECT batch, mean, round(mean - lag(mean) OVER (ORDER BY batch), 4) AS delta FROM t")
def w4_w6_previous_cohort(spark, sf):
    t = orders_as_reviews(spark, sf, "batch", "rating").groupBy("batch").agg(F.round(F.avg("rating"), 4).alias("mean"))
    return t.withColumn("delta", F.round(F.col("mean") - F.lag("mean").over(W.orderBy("batch")), 4))


@query(R + "SELECT theme, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share FROM r GROUP BY theme")
def w8_share_of_total(spark, sf):
    t = orders_as_reviews(spark, sf, "theme").groupBy("theme").agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("all")))).select("theme", "n", F.round(F.col("n") * 100.0 / F.col("all"), 4).alias("share"))


@query("SELECT doc_id, source, (SELECT count(*) FROM documents) AS total, ceil((SELECT count(*) FROM documents) / 20)::BIGINT AS pages, (SELECT count(*) FROM documents) > 60 AS has_more FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def o7_page(spark, sf):
    return A.page(read(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], 3, 20)


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u3_intersect(spark, sf):
    return read(spark, sf, "documents").select("doc_id").intersect(read(spark, sf, "labels").select("doc_id"))


CENTERS = "c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x, count(*) AS n FROM embeddings, generate_series(1, 64) g(i) GROUP BY label, i), m AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS centroid FROM c GROUP BY label)"
DIST = f"WITH {CENTERS}, d AS (SELECT vec_id, e.label, round(sqrt(list_sum(list_transform(list_zip(embedding, centroid), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))), 9) AS distance FROM embeddings e JOIN m USING (label)), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM d) "


def vectors(spark, sf):
    v = read(spark, sf, "embeddings")
    return v, V.centroids(v, "label", "embedding")


@query(f"WITH {CENTERS} SELECT label, n, round(centroid[1], 9) AS x1, round(centroid[64], 9) AS x64 FROM m")
def k10_centroids(spark, sf):
    return vectors(spark, sf)[1].select("label", "n", F.round(F.get("centroid", F.lit(0)), 9).alias("x1"), F.round(F.get("centroid", F.lit(63)), 9).alias("x64"))


@query(DIST + "SELECT label, vec_id, round(distance, 6) AS distance FROM k WHERE r = 1")
def c10_medoids(spark, sf):
    return V.medoids(*vectors(spark, sf), "label", "embedding", "vec_id")


@query(DIST + "SELECT label, r::INTEGER AS rank, vec_id, round(distance, 6) AS distance FROM k WHERE r <= 3")
def c16_representatives(spark, sf):
    return V.representatives(*vectors(spark, sf), "label", "embedding", "vec_id")


@query(DIST + "SELECT label, p::INTEGER AS percentile, vec_id FROM k, (SELECT unnest([0, 10, 20, 30, 40, 50, 60, 70, 80, 90]) AS p) WHERE floor(p / 100 * (n - 1)) + 1 = r")
def c17_strata(spark, sf):
    return V.strata(*vectors(spark, sf), "label", "embedding", "vec_id")


@query(f"WITH {CENTERS}, d AS (SELECT vec_id, m.label, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) DESC, m.label) AS k FROM embeddings e, m) SELECT vec_id, label, similarity FROM d WHERE k = 1")
def c13_nearest_centroid(spark, sf):
    return V.nearest(*vectors(spark, sf), "label", "embedding", "vec_id")


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, greatest(0, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4)) AS similarity FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 10")
def c18_search(spark, sf):
    v = read(spark, sf, "embeddings")
    return V.search(v, list(v.filter("vec_id = 7").select("embedding").first()[0]), "embedding", "vec_id")


@query()
def c1_k_means(spark, sf):
    return V.k_means(read(spark, sf, "embeddings"), "embedding", 6)[0].groupBy("cluster_id").agg(F.count("*").alias("n"))


TERMS = "w AS (SELECT source, regexp_extract_all(lower(text), '[a-z]{3,15}') AS t FROM documents), g AS (SELECT source, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))])) AS term FROM w), a AS (SELECT source, term, count(*) AS tf FROM g GROUP BY ALL), x AS (SELECT term FROM a GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 3000), n AS (SELECT a.* FROM a JOIN x USING (term))"


def terms(spark, sf):
    return K.term_counts(read(spark, sf, "documents"), "source", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,15})"), F.lit(1)), [])


@query(f"WITH {TERMS}, f AS (SELECT term, count(*) AS f FROM n GROUP BY term), v AS (SELECT source, term, (1 + ln(tf)) * ln(1 + (SELECT avg(f) FROM f) / f) AS weight FROM n JOIN f USING (term)), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(weight, 9) DESC, term) AS rank FROM v) SELECT source, rank::INTEGER AS rank, term, round(weight, 6) AS weight FROM k WHERE rank <= 8")
def x1_class_tfidf(spark, sf):
    return K.top_terms(K.class_tfidf(terms(spark, sf), "source"), "source")


@query(f"WITH {TERMS}, f AS (SELECT term, count(*) AS df FROM n GROUP BY term), c AS (SELECT count(DISTINCT source) AS n FROM n), u AS (SELECT source, term, tf * (ln((1 + c.n) / (1 + df)) + 1) AS w FROM n JOIN f USING (term), c), v AS (SELECT source, term, w / sqrt(sum(w * w) OVER (PARTITION BY source)) AS weight FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(weight, 9) DESC, term) AS rank FROM v) SELECT source, rank::INTEGER AS rank, term, round(weight, 6) AS weight FROM k WHERE rank <= 5")
def x2_tfidf(spark, sf):
    return K.top_terms(K.tfidf(terms(spark, sf), "source"), "source", 5)


GUESS = "g AS (SELECT doc_id, quality AS t, CASE WHEN length(text) >= 300 THEN 1 ELSE 0 END AS g, least(0.99, length(text) / 4000) AS p FROM documents JOIN labels USING (doc_id))"


def guesses(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("t"), F.when(F.length("text") >= 300, 1).otherwise(0).alias("g"), F.least(F.lit(0.99), F.length("text") / 4000).alias("p"))


@query(f"WITH {GUESS}, l AS (SELECT t AS label, (t = g)::INTEGER AS hit, 1 AS tr, 0 AS sa FROM g UNION ALL SELECT g, 0, 0, 1 FROM g), s AS (SELECT label, sum(hit) AS hit, sum(tr) AS support, sum(sa) AS said FROM l GROUP BY label), q AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM s) SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, support::BIGINT AS support FROM q")
def d12_classification(spark, sf):
    return A.classification(guesses(spark, sf), "t", "g")


@query(f"WITH {GUESS} SELECT round(avg(2 * (p - t) * (p - t)), 4) AS brier, round(avg(-CASE WHEN t = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(1 - greatest(p, 1e-15)) END), 4) AS log_loss FROM g")
def d13_d15_loss(spark, sf):
    return A.loss(guesses(spark, sf), F.col("t") == 1, F.col("p"))


@query(f"WITH {GUESS} SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(t), 4) AS observed FROM g GROUP BY 1")
def d14_reliability(spark, sf):
    return A.reliability(guesses(spark, sf), F.col("t") == 1, F.col("p"))


@query(f"WITH {GUESS} SELECT t, g, count(*) AS n FROM g GROUP BY ALL")
def a33_confusion(spark, sf):
    return guesses(spark, sf).groupBy("t", "g").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f13_json(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
