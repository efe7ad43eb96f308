"""Queries over texts that are made of a table's keys, so that what the rules must find in them is known beforehand.

The SQL doesn't apply the rules: it says what was planted.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import pii
from tidemark.functions import text as T
from tidemark.operators import records as P
from tidemark.operators import vectors as V
from tidemark.plans.adapters import read
from tidemark.plans.queries import query
from tidemark.sources import synthetic

# text, label, confidence, intent, severity, marker of the intent, severity of the text, span, its start, trigger, severity
SENTENCES = (
    ("The pump broke after a week.", "COMPLAINT", 0.719, "COMPLAINT", "P1", None, "P1", "pump broke after a week.", 4, "direct_defect:P1", "P1"),
    ("No redness at all, but the pump is jammed solid.", "COMPLAINT", 0.719, "PRAISE", "P3", None, "P1", "but the pump is jammed solid.", 19, "contrastive:but", "P1"),
    ("Please add a refill option.", "RECOMMENDATION", 0.668, "RECOMMENDATION", "P3", None, "P3", "", None, None, "P3"),
    ("It did not stop my irritation.", "COMPLAINT", 0.719, "COMPLAINT", "P3", None, "P3", "", None, None, "P3"),
    ("I received this product free in exchange for an honest review.", "NOISE", 0.8, "NOISE", "P3", None, "P3", "", None, None, "P3"),
    ("I got it in exchange for an honest review, amazing!", "PRAISE", 0.9, "PRAISE", "P3", None, "P3", "", None, None, "P3"),
    ("No breakouts, no redness.", "PRAISE", 0.85, "PRAISE", "P3", None, "P3", "", None, None, "P3"),
    ("Plain words only.", "NOISE", 0.8, "NOISE", "P3", None, "P3", "", None, None, "P3"),
    ("The app crashes. I want a refund, it is useless.", "COMPLAINT", 0.831, "COMPLAINT", "P0", None, "P0", "crashes.", 8, "direct_defect:P0", "P0"),
    ("My skin never felt dry. However it leaked everywhere! Then fine.", "COMPLAINT", 0.719, "PRAISE", "P3", None, "P1", "However it leaked everywhere!", 24, "contrastive:however", "P1"),
    ("Would love a bigger one, it would be great if it had a lid.", "RECOMMENDATION", 0.805, "RECOMMENDATION", "P3", None, "P3", "", None, None, "P3"),
    ("Works fine, refund was already processed.", "NOISE", 0.8, "NOISE", "P3", None, "P3", "", None, None, "P3"),
    ("It is blue but large.", "NOISE", 0.8, "COMPLAINT", "P3", "but", "P3", "but large.", 11, "contrastive:but", "P3"),
    ("Burning skin and a rash, terrible!", "COMPLAINT", 0.889, "COMPLAINT", "P0", None, "P0", "Burning skin and a rash, terrible!", 0, "direct_defect:P0", "P0"),
    ("Dr. Smith liked v2.1 too. Love this cream, so soft.", "PRAISE", 0.9, "PRAISE", "P3", None, "P3", "", None, None, "P3"),
    ("Unfortunately the seal broke; no results.", "COMPLAINT", 0.889, "COMPLAINT", "P3", "Unfortunately", "P3", "Unfortunately the seal broke; no results.", 0, "contrastive:unfortunately", "P3"),
    ("Return to the store is easy.", "NOISE", 0.8, "NOISE", "P3", None, "P3", "", None, None, "P3"),
    ("I return it immediately, broken and useless.", "COMPLAINT", 0.889, "COMPLAINT", "P1", None, "P1", "broken and useless.", 25, "direct_defect:P1", "P1"),
    ("Sadly greasy, although smooth.", "COMPLAINT", 0.719, "COMPLAINT", "P2", "Sadly", "P2", "Sadly greasy, although smooth.", 0, "contrastive:sadly", "P2"),
    ("Holy grail until the formula changed, it stings now.", "COMPLAINT", 0.719, "COMPLAINT", "P0", "until", "P0", "until the formula changed, it stings now.", 11, "contrastive:until", "P0"),
)


def literal(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::{'DOUBLE' if isinstance(x, float) else 'INTEGER'}"


PLANTED = "w(i, t, label, confidence, intent, severity, marker, tier, span, start, trigger, span_severity) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(literal, r))})" for i, r in enumerate(SENTENCES)) + "), o AS (SELECT o_orderkey, w.* FROM orders JOIN w ON o_orderkey % 20 = i)"


def planted(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*(F.lit(r[0]) for r in SENTENCES)), (F.col("o_orderkey") % 20 + 1).cast("int")).alias("t"))


@query(f"WITH {PLANTED} SELECT o_orderkey, label, confidence FROM o")
def t14_t16_planted_router(spark, sf):
    return planted(spark, sf).select("o_orderkey", T.router_intent(F.col("t")).alias("r")).select("o_orderkey", "r.*")


@query(f"WITH {PLANTED} SELECT o_orderkey, intent, severity, marker FROM o")
def t17_planted_intents(spark, sf):
    return planted(spark, sf).select("o_orderkey", T.proposition_intent(F.col("t")).alias("p")).select("o_orderkey", "p.*")


@query(f"WITH {PLANTED} SELECT o_orderkey, tier FROM o")
def t12_t13_planted_severity(spark, sf):
    return planted(spark, sf).select("o_orderkey", T.severity(F.col("t")).alias("tier"))


@query(f"WITH {PLANTED} SELECT o_orderkey, trigger IS NOT NULL AS detected, span AS text, start, start + length(span)::INTEGER AS \"end\", trigger, span_severity AS severity FROM o")
def t18_planted_spans(spark, sf):
    return planted(spark, sf).select("o_orderkey", T.complaint_span(F.col("t")).alias("s")).select("o_orderkey", "s.*")


@query(f"WITH {PLANTED} SELECT o_orderkey, CASE WHEN length(span) > 0 THEN t ELSE 'none' END AS kept FROM o WHERE substr(t, coalesce(start, 0) + 1, length(span)) = span")
def q12_planted_spans_hold(spark, sf):
    s = planted(spark, sf).withColumn("s", T.complaint_span(F.col("t")))
    holds = T.span_holds(F.col("t"), F.col("s.text"), F.col("s.start"), F.col("s.end"))
    return s.filter(holds | ~F.col("s.detected")).select("o_orderkey", F.when(holds, F.col("t")).otherwise("none").alias("kept"))


SINGLE = "len(regexp_extract_all(t, '[.!?] [A-Z]')) = 0"


@query(f"WITH {PLANTED} SELECT o_orderkey, (intent = 'COMPLAINT')::INTEGER AS n_complaint, (intent = 'RECOMMENDATION')::INTEGER AS n_recommendation, (intent = 'PRAISE')::INTEGER AS n_praise, (intent = 'NOISE')::INTEGER AS n_noise, least(CASE WHEN intent = 'COMPLAINT' THEN severity ELSE 'P3' END, CASE WHEN trigger IS NULL THEN 'P3' ELSE span_severity END) AS overall_severity, CASE WHEN intent = 'COMPLAINT' THEN t WHEN trigger IS NOT NULL THEN span ELSE t END AS primary_complaint_text FROM o WHERE {SINGLE}")
def t19_planted_telemetry(spark, sf):
    one = planted(spark, sf).filter(~F.col("t").rlike("[.!?] [A-Z]"))  # texts of one sentence
    return P.telemetry(one, "o_orderkey", "t")


@query(f"WITH {PLANTED} SELECT o_orderkey || '::P000' AS proposition_id, t AS text, 0 AS char_start, length(t)::INTEGER AS char_end, intent, severity FROM o WHERE {SINGLE}")
def p16_planted_propositions(spark, sf):
    one = planted(spark, sf).filter(~F.col("t").rlike("[.!?] [A-Z]"))
    own = P.propositions(one, "o_orderkey", "t")
    back = P.proposition_of(P.span_record(own))
    return back.join(own.select("proposition_id", "intent"), "proposition_id").select("proposition_id", "text", "char_start", "char_end", "intent", "severity")


CLAUSES = (("It smells of a rash", "CRITICAL_SAFETY", 0.05), ("but the dropper cracked.", "DEFECT", 0.15), ("Please add a lid!", "FEATURE_REQUEST", 0.65), ("My favorite one.", "PRAISE", 0.95), ("It came in May?", "NOISE", 0.5))


@query("WITH c(i, text, intent, score) AS (VALUES " + ", ".join(f"({i}, {literal(t + ',' * (i == 0))}, '{k}', {s}::DOUBLE)" for i, (t, k, s) in enumerate(CLAUSES)) + ") SELECT o_orderkey, (i - o_orderkey % 3)::INTEGER AS i, text, intent, score FROM orders JOIN c ON i >= o_orderkey % 3")
def v1_planted_clauses(spark, sf):
    whole = F.array(*(F.lit(t + "," * (i == 0)) for i, (t, _, _) in enumerate(CLAUSES)))
    o = read(spark, sf, "orders").select("o_orderkey", F.array_join(F.slice(whole, (F.col("o_orderkey") % 3 + 1).cast("int"), F.lit(9)), " ").alias("t"))
    return o.select("o_orderkey", F.posexplode(T.analysed_clauses(F.col("t"))).alias("i", "c")).select("o_orderkey", "i", "c.*")


# a card's number is 4, the key in 14 digits and the key's last digit: one of ten passes the check
CARD = "'4' || lpad(o_orderkey::VARCHAR, 14, '0') || (o_orderkey % 10)"
LUHN = "list_sum([CASE WHEN k % 2 = 1 THEN CASE WHEN n[k]::INTEGER * 2 > 9 THEN n[k]::INTEGER * 2 - 9 ELSE n[k]::INTEGER * 2 END ELSE n[k]::INTEGER END for k in range(1, 17)]) % 10 = 0"


@query(f"""WITH c AS (SELECT o_orderkey, {CARD} AS n FROM orders), d AS (SELECT *, {LUHN} AS card, o_orderkey % 2 = 0 AS order_id, o_orderkey % 3 = 0 AS phone, o_orderkey % 5 = 0 AS mail, o_orderkey % 7 = 0 AS pin, o_orderkey % 4 = 1 AS name FROM c)
 SELECT o_orderkey, 'Parcel ' || CASE WHEN order_id THEN '[REDACTED_ORDER_ID]' ELSE 'none' END || ' paid with ' || CASE WHEN card THEN '[REDACTED_PAYMENT_CARD]' ELSE n END || ' and ' || CASE WHEN phone THEN 'call me at [REDACTED_PHONE]' ELSE 'no number' END || ', ' || CASE WHEN mail THEN '[REDACTED_EMAIL]' ELSE 'no mail' END || '; ' || CASE WHEN pin THEN 'pincode: [REDACTED_PINCODE]' ELSE 'pin unknown' END || '. My name is ' || CASE WHEN name THEN '[REDACTED_NAME]' ELSE 'The boss' END || '.' AS t,
 array_to_string(list_filter([CASE WHEN order_id THEN 'ORDER_ID' END, CASE WHEN card THEN 'PAYMENT_CARD' END, CASE WHEN mail THEN 'EMAIL' END, CASE WHEN phone THEN 'PHONE' END, CASE WHEN pin THEN 'POSTAL_CODE' END, CASE WHEN name THEN 'PERSON_NAME' END], lambda x: x IS NOT NULL), ',') AS entities FROM d""")
def t1_t8_planted_redaction(spark, sf):
    k = F.col("o_orderkey")
    n = F.concat(F.lit("4"), F.lpad(k.cast("string"), 14, "0"), (k % 10).cast("string"))
    text = F.concat(
        F.lit("Parcel "), F.when(k % 2 == 0, F.concat(F.lit("ORD-"), F.lpad(k.cast("string"), 7, "0"))).otherwise("none"), F.lit(" paid with "), n, F.lit(" and "), F.when(k % 3 == 0, "call me at 555-123-4567").otherwise("no number"),
        F.lit(", "), F.when(k % 5 == 0, F.concat(F.lit("u."), k.cast("string"), F.lit("@shop.example.com"))).otherwise("no mail"), F.lit("; "), F.when(k % 7 == 0, "pincode: 560001").otherwise("pin unknown"), F.lit(". My name is "), F.when(k % 4 == 1, "Jane Doe").otherwise("The boss"), F.lit("."),
    )
    own = pii.redact(read(spark, sf, "orders").select("o_orderkey", text.alias("t")), "t")
    return own.withColumn("entities", F.array_join("entities", ","))


@query("SELECT p_partkey % 3 AS truth, count(*) AS n, 1::BIGINT AS clusters FROM part GROUP BY 1")
def c1_c2_planted_clusters(spark, sf):
    """Points around three far centres: k-means must find them, whatever it calls them."""
    k = F.col("p_partkey")
    near = (k % 97) / 1000
    own = read(spark, sf, "part").select((k % 3).alias("truth"), F.array(5.0 * (k % 3) + near, -5.0 * (k % 3) - near, near).alias("v"))
    return V.k_means(own, "v", 3)[0].groupBy("truth").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("clusters"))


@query("SELECT d.domain, 900::BIGINT AS n, 4::BIGINT AS batches, 900::BIGINT AS ids, true AS spiked, true AS rated FROM (VALUES ('cosmetics'), ('software')) d(domain)")
def s16_s17_planted_spike(spark, sf):
    """What a generated corpus must show: its rows and ids, and one cohort with far more complaints."""
    out = None
    for domain, (_, _, bad) in synthetic.DOMAINS.items():
        r = synthetic.reviews(spark, 900, domain)
        low = F.col("sentiment") == "NEGATIVE"
        own = r.agg(F.count("*").alias("n"), F.count_distinct("batch_or_version").alias("batches"), F.count_distinct("review_id").alias("ids"), (F.avg(F.when(F.col("batch_or_version") == bad, low.cast("int"))) > 2 * F.avg(F.when(F.col("batch_or_version") != bad, low.cast("int")))).alias("spiked"), F.bool_and((F.col("rating") <= 2) == low).alias("rated"))
        own = own.select(F.lit(domain).alias("domain"), "*")
        out = own if out is None else out.union(own)
    return out
