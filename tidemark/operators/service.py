"""What the routes of a review dashboard report, over two tables.

reviews: review_id, product_name, brand_name, batch, rating, sentiment, redacted_text, span_detected, entities (joined by ;).
sentences: review_id, sentence_idx, sentence_text, label, severity, confidence; label is one of INTENTS, anything else is noise.

"First" means by review_id and sentence_idx. A null rating counts as the default that each function names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import snippet, tokens
from tidemark.operators.aggregates import rate
from tidemark.operators.severity import action_columns

# Labels, thresholds, word lists and reports' limits.
INTENTS = ("COMPLAINT", "RECOMMENDATION", "PRAISE")
REASONS = (
    ("Chemical Irritation / Burn", ("burn", "redness", "allergic", "rash", "dermatitis")),
    ("Packaging / Dispenser Defect", ("leak", "pump", "broken", "cracked", "dispenser", "nozzle")),
    ("Dryness / Peeling", ("dry", "peeling", "dehydrat", "flaky")),
    ("Acne & Clogged Pores", ("acne", "breakout", "pimples", "clog")),
)
OTHER_REASON, NO_REASON = "Formula Inefficacy", "Minor Usability"
LOYALTY = (
    r"(?i)\b(used to love|used this for years|holy grail until|bought this for years|reformulat|used to be my favorite|not purchasing again|"
    r"will never repurchase|returning this|switching to another|waste of money|ruined my skin)\b"
)
NOISE_STOP = (
    "the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "with", "it", "is", "was", "my", "i", "this", "that", "of", "so", "but", "be", "as", "by",
    "have", "had", "they", "we", "you", "me", "her", "his", "she", "he", "just", "very", "too", "been", "from", "are", "were", "would", "could", "will", "when",
)
QUERY_KINDS = {
    "severe": ("p0", "p1", "worst", "defect", "severe", "critical", "harm", "burn", "crash", "danger"),
    "drift": ("drift", "quarter", "batch", "trend", "psi", "2021", "2022", "regression", "surge", "anomaly"),
    "praise": ("love", "praise", "strength", "delight", "best", "like", "positive", "favourite", "favorite"),
    "feature": ("feature", "request", "wishlist", "add", "improve", "suggestion", "recommend"),
    "action": ("action", "plan", "sprint", "fix", "priority", "jira", "recommendation", "roadmap"),
}


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words anywhere, in any case."""
    return reduce(Column.__or__, (F.lower(text).contains(w) for w in words))


def intent(label: Column) -> Column:
    return F.when(label.isin(*INTENTS), label).otherwise("NOISE")


def reason(text: Column) -> Column:
    """The first bucket of REASONS with a word in the text."""
    out = F
    for name, words in REASONS:
        out = out.when(holds(text, words), name)
    return out.otherwise(OTHER_REASON)


def per_review(reviews: DataFrame, sentences: DataFrame) -> DataFrame:
    """reviews with n_sentences, n_complaint, n_recommendation, n_praise and n_noise."""
    own = sentences.groupBy("review_id").agg(F.count("*").alias("n_sentences"), *(F.count_if(intent(F.col("label")) == x).alias(f"n_{x.lower()}") for x in (*INTENTS, "NOISE")))
    return reviews.join(own, "review_id", "left").na.fill(0, ["n_sentences", *(f"n_{x.lower()}" for x in (*INTENTS, "NOISE"))])


def intent_breakdown(sentences: DataFrame) -> DataFrame:
    """One row: sentences and distinct reviews of each intent, and the share of sentences that are actionable."""
    kind = intent(sentences.label)
    own = sentences.groupBy("review_id").agg(*(F.count_if(kind == x).alias(x) for x in (*INTENTS, "NOISE")))
    names = {x: x.lower() for x in (*INTENTS, "NOISE")}
    out = own.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in names.items()), *(F.count_if(F.col(x) > 0).alias(f"{n}_reviews") for x, n in names.items()))
    actionable = F.col("complaint") + F.col("recommendation") + F.col("praise")
    out = out.withColumns({"total_sentences": actionable + F.col("noise"), "actionable_count": actionable})
    return out.withColumn("actionable_rate_pct", F.round(F.col("actionable_count") * 100.0 / F.greatest("total_sentences", F.lit(1)), 1))


def pools(sentences: DataFrame) -> DataFrame:
    """(pool, n): the sentences routed to each pool; praise and noise make one together, and all are counted."""
    kind = intent(sentences.label)
    of = F.when(kind == "COMPLAINT", "complaints").when(kind == "RECOMMENDATION", "recommendations").otherwise("praise_noise")
    names = F.array(F.lit("total"), of, F.when(kind.isin("PRAISE", "NOISE"), F.lower(kind)))
    return sentences.select(F.explode(F.array_compact(names)).alias("pool")).groupBy("pool").agg(F.count("*").alias("n"))


def proposition_counts(sentences: DataFrame) -> DataFrame:
    """One row: the four intents, what is actionable, and all."""
    out = sentences.agg(*(F.count_if(intent(F.col("label")) == x).alias(x) for x in (*INTENTS, "NOISE")), F.count("*").alias("total"))
    return out.withColumn("actionable", F.col("COMPLAINT") + F.col("RECOMMENDATION") + F.col("PRAISE"))


def keyword_cloud(themes: DataFrame, order: str = "position", most: int = 16) -> DataFrame:
    """(place, keyword, count): the first distinct keywords of more than two letters, themes and keywords in their order."""
    words = themes.select(order, F.col("review_count"), F.posexplode("keywords").alias("k", "raw")).withColumn("keyword", F.lower(F.trim("raw"))).filter(F.length("keyword") > 2)
    first = words.groupBy("keyword").agg(F.min(F.struct(order, "k", F.col("review_count").alias("n"))).alias("at"))
    top = first.orderBy(f"at.{order}", "at.k").limit(most)
    places = top.agg(F.array_sort(F.collect_list(F.struct(F.col(f"at.{order}").alias("t"), F.col("at.k").alias("k"), "keyword", F.col("at.n").alias("n")))).alias("all"))  # at most so many rows
    return places.select(F.posexplode("all").alias("place", "w")).select((F.col("place") + 1).alias("place"), "w.keyword", F.col("w.n").alias("count"))


def product_risk(reviews: DataFrame, sentences: DataFrame, least: int = 15, top: int = 15) -> DataFrame:
    """The riskiest products: counts, mean rating (null: 3), share of reviews with a complaint, top reason, tier, a quote, cohorts.

    Only products of at least so many reviews, unless none has as many. Of reasons as frequent as each other the first to
    occur counts; the quote is the first complaint of more than 20 characters, else the beginning of the first review.
    """
    bad = sentences.filter("label = 'COMPLAINT'").select("review_id", "sentence_idx", "sentence_text")
    named = reviews.withColumn("product_name", F.coalesce("product_name", F.lit("Unknown Product")))
    own = named.join(bad.select("review_id").distinct().withColumn("hit", F.lit(True)), "review_id", "left")
    complaint = F.col("hit").isNotNull() | (F.col("sentiment") == "NEGATIVE")
    per = own.groupBy("product_name").agg(
        F.min_by(F.coalesce("brand_name", F.lit("Brand")), "review_id").alias("brand_name"), F.count("*").alias("total_reviews"), F.round(F.avg(F.coalesce("rating", F.lit(3))), 2).alias("avg_rating"),
        F.count_if(complaint).alias("complaint_count"), F.slice(F.array_sort(F.collect_set(F.when(complaint, F.col("batch")))), 1, 3).alias("cohorts"), F.min_by(F.substring("redacted_text", 1, 120), "review_id").alias("opening"),
    )
    at = F.struct("review_id", "sentence_idx")
    told = named.select("review_id", "product_name").join(bad, "review_id").withColumn("reason", reason(F.col("sentence_text")))
    quote = told.filter(F.length("sentence_text") > 20).groupBy("product_name").agg(F.min_by("sentence_text", at).alias("quote"))
    main = told.groupBy("product_name", "reason").agg(F.count("*").alias("n"), F.min(at).alias("first")).groupBy("product_name").agg(F.min_by("reason", F.struct(-F.col("n"), F.col("first"))).alias("reason"))
    few = per.agg(F.max("total_reviews").alias("largest"))
    kept = per.crossJoin(F.broadcast(few)).filter((F.col("total_reviews") >= least) | (F.col("largest") < least)).join(main, "product_name", "left").join(quote, "product_name", "left")
    defect, theme = F.round(F.col("complaint_count") * 100.0 / F.col("total_reviews"), 1), F.coalesce("reason", F.lit(NO_REASON))
    tier = F.when((defect >= 28.0) | theme.contains("Chemical Irritation"), "CRITICAL").when(defect >= 15.0, "ELEVATED").otherwise("STABLE")
    out = kept.select("product_name", "brand_name", "total_reviews", "avg_rating", "complaint_count", defect.alias("defect_rate_pct"), tier.alias("risk_tier"), theme.alias("top_defect_theme"), F.coalesce("quote", "opening").alias("sample_defect_quote"), F.array_join("cohorts", ",").alias("affected_cohorts"))
    return out.orderBy(F.when(F.col("risk_tier") == "CRITICAL", 0).when(F.col("risk_tier") == "ELEVATED", 1).otherwise(2), F.desc("defect_rate_pct"), "product_name").limit(top)


def star_divergence(reviews: DataFrame, sentences: DataFrame) -> DataFrame:
    """A row for each of 1 to 5 stars (null: 3): complaint sentences, their share of all, reviews; and the share of complaints at 4 and 5 stars."""
    own = per_review(reviews, sentences).groupBy(F.coalesce("rating", F.lit(3)).alias("star")).agg(F.sum("n_complaint").alias("c"), F.count("*").alias("n"))
    grid = reviews.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("star")).join(own, "star", "left").na.fill(0, ["c", "n"])
    # every complaint counts in the total, also of reviews without a star of 1 to 5
    total = own.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("star").isin(4, 5), F.col("c"))), F.lit(0)).alias("hidden"))
    share = lambda part: F.round(F.col(part) * 100.0 / F.greatest("all", F.lit(1)), 1)
    return grid.crossJoin(F.broadcast(total)).select("star", F.col("c").alias("complaint_count"), share("c").alias("complaint_pct"), F.col("n").alias("total_reviews"), F.col("hidden").alias("trojan_complaint_count"), share("hidden").alias("trojan_rate_pct"))


def silent_defects(reviews: DataFrame, sentences: DataFrame, least: int = 4, top: int = 50) -> DataFrame:
    """The first well rated reviews that hold a defect span or a complaint sentence."""
    hit = sentences.filter("label = 'COMPLAINT'").select("review_id").distinct().withColumn("__c", F.lit(True))
    found = reviews.filter(F.col("rating") >= least).join(hit, "review_id", "left").filter(F.col("span_detected") | F.col("__c"))
    return found.drop("__c").orderBy("review_id").limit(top)


def trojan_samples(reviews: DataFrame, sentences: DataFrame, top: int = 8) -> DataFrame:
    """Of reviews at 4 stars or more the first complaint, if it has more than 25 characters, each text once; the first of these."""
    first = sentences.filter("label = 'COMPLAINT'").groupBy("review_id").agg(F.min_by("sentence_text", "sentence_idx").alias("complaint_text")).filter(F.length("complaint_text") > 25)
    own = reviews.filter("rating >= 4").join(first, "review_id")
    once = own.groupBy("complaint_text").agg(F.min_by(F.struct("review_id", "product_name", "rating", F.concat(F.substring("redacted_text", 1, 180), F.lit("...")).alias("snippet")), "review_id").alias("r"))
    return once.select("r.review_id", "r.product_name", "r.rating", "complaint_text", "r.snippet").orderBy("review_id").limit(top)


def turncoats(reviews: DataFrame, top: int = 6) -> DataFrame:
    """The first reviews of at most 3 stars (null: 3) with a phrase of lost loyalty."""
    phrase = F.regexp_extract("redacted_text", LOYALTY, 0)
    found = reviews.filter((F.coalesce("rating", F.lit(3)) <= 3) & F.col("redacted_text").rlike(LOYALTY))
    return found.select("review_id", "product_name", "rating", phrase.alias("trigger_phrase"), F.concat(F.substring("redacted_text", 1, 160), F.lit("...")).alias("quote"), F.coalesce("batch", F.lit("Latest Batch")).alias("batch")).orderBy("review_id").limit(top)


def cohort_profile(reviews: DataFrame, sentences: DataFrame, cohort: Column) -> DataFrame:
    """Per cohort: mean rating (null: 3), shares by rating, reviews with a defect (complaint or span) and with praise, stars."""
    r = F.coalesce("rating", F.lit(3))
    own = per_review(reviews, sentences).withColumn("label", cohort).filter("label is not null")
    n = F.count("*")
    share = lambda c: F.round(F.count_if(c) * 100.0 / n, 1)
    defect, praise = (F.col("n_complaint") > 0) | F.coalesce("span_detected", F.lit(False)), F.col("n_praise") > 0
    return own.groupBy("label").agg(
        n.alias("total_reviews"), F.round(F.avg(r), 2).alias("avg_rating"), share(r >= 4).alias("positive_pct"), share(r == 3).alias("neutral_pct"), share(r <= 2).alias("negative_pct"), F.count_if(defect).alias("defect_count"), share(defect).alias("defect_rate_pct"),
        F.count_if(praise).alias("praise_count"), share(praise).alias("praise_rate_pct"), *(F.count_if(r == s).alias(f"stars_{s}") for s in range(1, 6)),
    )


def noise_summary(sentences: DataFrame) -> DataFrame:
    """One row: noise sentences, all, the share, and hours saved at two minutes each."""
    out = sentences.agg(F.count_if(intent(F.col("label")) == "NOISE").alias("total_noise_sentences"), F.count("*").alias("total_sentences"))
    n = F.col("total_noise_sentences")
    return out.withColumns({"noise_rate_pct": F.round(n * 100.0 / F.greatest("total_sentences", F.lit(1)), 1), "engineering_hours_saved": F.round(n * 2.0 / 60.0, 1)})


def noise_sentences(sentences: DataFrame, word: str | None = None) -> DataFrame:
    """Noise of more than 15 characters, and with the whole word if one is asked for."""
    out = sentences.filter((intent(F.col("label")) == "NOISE") & (F.length("sentence_text") > 15))
    return out.filter(F.col("sentence_text").rlike(rf"(?i)\b\Q{word}\E\b")) if word else out


def noise_words(sentences: DataFrame, stop: tuple[str, ...] = NOISE_STOP, top: int = 60) -> DataFrame:
    """The most frequent words of noise, ties to the lesser word."""
    words = noise_sentences(sentences).select(F.explode(tokens(F.col("sentence_text"))).alias("word")).filter(~F.col("word").isin(*stop))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def fact_table(reviews: DataFrame, sentences: DataFrame) -> DataFrame:
    """The fact row of each review: keys, clause counts, flags, entities and the redacted text; never the raw one."""
    c, p, r = (F.col(f"n_{x}") for x in ("complaint", "praise", "recommendation"))
    silent = (F.coalesce("rating", F.lit(0)) >= 4) & (F.coalesce("span_detected", F.lit(False)) | (c > 0))
    return per_review(reviews, sentences).select(
        F.col("review_id").alias("Review_ID"), F.col("product_name").alias("Product_Name"), F.col("batch").alias("Batch_or_Version"), F.col("rating").alias("Rating"), F.col("sentiment").alias("Calibrated_Sentiment"),
        F.col("n_sentences").alias("Sentence_Count"), c.alias("Complaint_Clauses"), p.alias("Praise_Clauses"), r.alias("Recommendation_Clauses"), ((c + p + r) > 0).alias("Is_Actionable"), silent.alias("Has_Silent_Defect"),
        (F.coalesce("entities", F.lit("")) != "").alias("Is_PII_Scrubbed"), F.coalesce("entities", F.lit("")).alias("PII_Entities_Detected"), F.col("redacted_text").alias("Sanitized_Verbatim"),
    )


def kpi_summary(facts: DataFrame) -> DataFrame:
    """One row of executive figures from the fact table."""
    n = F.count("*")
    pct = lambda c, places=1: rate(F.count_if(c), n, places)
    s = F.col("Calibrated_Sentiment")
    net = rate(F.count_if(s == "POSITIVE") - F.count_if(s == "NEGATIVE"), n)
    return facts.agg(
        n.alias("total_reviews"), net.alias("net_sentiment_score"), pct(s == "POSITIVE").alias("positive_rate_pct"), pct(s == "NEGATIVE").alias("negative_rate_pct"), pct(s == "NEUTRAL").alias("neutral_rate_pct"),
        pct(F.col("Complaint_Clauses") > 0).alias("defect_surge_rate_pct"), F.count_if("Has_Silent_Defect").alias("silent_defects_count"), pct(F.col("Is_Actionable")).alias("actionable_rate_pct"), pct(F.col("Is_PII_Scrubbed")).alias("redacted_pct"),
    )


def action_matrix(clusters: DataFrame, total: Column) -> DataFrame:
    """clusters (title, n, priority) with blast radius, impact, effort, points, lift and quadrant, the highest impact first."""
    out = clusters.withColumns(action_columns(F.col("title"), F.col("n"), F.col("priority"), total))
    return out.orderBy(F.desc("impact_score"), "title")


def action_totals(matrix: DataFrame, baseline: float) -> DataFrame:
    """One row: the rating that is within reach (at most 0.75 above, and 5), and how many clusters each quadrant has."""
    lift = F.least(F.coalesce(F.sum("csat_lift"), F.lit(0.0)), F.lit(0.75))
    names = {"quick_wins": "QUICK_WIN", "critical_blockers": "CRITICAL_BLOCKER", "strategic_revamp": "STRATEGIC_REVAMP", "quality_of_life": "QUALITY_OF_LIFE"}
    return matrix.agg(F.round(F.least(F.lit(baseline) + lift, F.lit(5.0)), 2).alias("projected_target_csat"), F.round(lift, 2).alias("max_potential_lift"), *(F.count_if(F.col("quadrant") == q).alias(n) for n, q in names.items()))


def briefing(reviews: DataFrame, clusters: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of figures for a one-page report. clusters: (title, severity, n)."""
    r, n = F.coalesce("rating", F.lit(3)), F.count("*")
    out = reviews.agg(n.alias("total_reviews"), F.round(F.avg(F.coalesce("rating", F.lit(4))), 2).alias("csat_score"), rate(F.count_if(r >= 4), n).alias("positive_sentiment_pct"), rate(F.count_if(r <= 2), n).alias("negative_sentiment_pct"), rate(F.count_if(r == 3), n).alias("neutral_sentiment_pct"))
    few = clusters.agg(F.count_if(F.col("severity").isin("P0", "CRITICAL")).alias("critical_clusters"), F.max_by("title", F.struct("n", "title")).alias("top_complaint"))
    return out.crossJoin(F.broadcast(few)).crossJoin(F.broadcast(alerts.agg(F.count("*").alias("active_drift_alarms"))))


def insights(alerts: DataFrame, themes: DataFrame, reviews: DataFrame) -> DataFrame:
    """(place, title, value): the first alert, the first grave theme and the share of positive reviews, as far as there are any.

    alerts: (position, message, psi); themes: (position, title, severity, negative_rate, review_count).
    """
    one = lambda df: df.orderBy("position").limit(1)
    first = one(alerts).select(F.lit(1).alias("place"), F.col("message").alias("title"), F.format_string("%.2f", F.round("psi", 2)).alias("value"))
    grave = one(themes.filter(F.col("severity").isin("CRITICAL", "HIGH")))
    second = grave.select(F.lit(2).alias("place"), F.concat(F.lit("Highest-severity cluster '"), "title", F.lit("' ("), F.col("negative_rate").cast("string"), F.lit("% negative)")).alias("title"), F.col("review_count").cast("string").alias("value"))
    share = reviews.agg(F.count("*").alias("n"), F.bround(F.count_if(F.col("sentiment") == "POSITIVE") * 100.0 / F.nullif(F.count("*"), F.lit(0))).cast("int").cast("string").alias("p")).filter("n > 0")
    third = share.select(F.lit(3).alias("place"), F.concat(F.lit("Overall product satisfaction at "), "p", F.lit("% positive sentiment")).alias("title"), F.concat("p", F.lit("%")).alias("value"))
    return first.union(second).union(third)


def drift_series(clusters: DataFrame, verbatims: DataFrame, line: DataFrame, reviews: DataFrame, cohorts: int = 12, top: int = 6) -> DataFrame:
    """(cluster_id, cohort, count, rate_pct, review_volume) of the gravest and largest clusters over the latest cohorts.

    clusters: (cluster_id, severity, sentence_count); verbatims: (cluster_id, review_id); line: (batch, review_count,
    negative_count). The count is the larger of the verbatims seen and the cluster's share of a fifth of all reviews,
    scaled to the cohort's negative reviews.
    """
    last = line.orderBy(F.desc("batch")).limit(cohorts)
    best = clusters.orderBy(F.when(F.col("severity") == "CRITICAL", 0).otherwise(1), F.desc("sentence_count"), "cluster_id").limit(top)
    seen = verbatims.join(reviews.filter("batch is not null").select("review_id", "batch"), "review_id").groupBy("cluster_id", "batch").agg(F.count("*").alias("direct"))
    grid = last.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(reviews.agg(F.count("*").alias("total")))).join(seen, ["cluster_id", "batch"], "left")
    volume = F.greatest("review_count", F.lit(1))
    estimate = F.bround(F.col("sentence_count") / F.greatest(F.col("total") * 0.2, F.lit(1.0)) * F.col("negative_count")).cast("long")
    count = F.greatest(F.coalesce("direct", F.lit(0)), estimate)
    return grid.select("cluster_id", F.col("batch").alias("cohort"), count.alias("count"), F.round(count / volume * 100, 2).alias("rate_pct"), volume.alias("review_volume"))


def with_anomaly(alerts: DataFrame, batch: str, psi: float, driver: str) -> DataFrame:
    """alerts (batch, psi, level, top_driver) with place and is_simulated: a simulated one first, in place of any before it."""
    real = without_anomaly(alerts)
    extra = alerts.sparkSession.createDataFrame([(batch, psi, "CRITICAL", driver, True)], "batch string, psi double, level string, top_driver string, is_simulated boolean")
    return real.select("batch", "psi", "level", "top_driver", "is_simulated").unionByName(extra).withColumn("place", F.when(F.col("is_simulated"), 0).otherwise(1))


def without_anomaly(alerts: DataFrame) -> DataFrame:
    """alerts as they were: the simulated ones taken out."""
    own = alerts if "is_simulated" in alerts.columns else alerts.withColumn("is_simulated", F.lit(False))
    return own.filter(~F.col("is_simulated")).drop("place")


def query_kinds(query: Column) -> Column:
    """The kinds of question that a text asks, by the words that it holds."""
    return F.array_compact(F.array(*(F.when(holds(query, words), name) for name, words in QUERY_KINDS.items())))


def ranked_evidence(reviews: DataFrame, query: str, boosted: Column, top: int = 4) -> DataFrame:
    """The reviews that share most words of more than two letters with a query, times 1.5 where boosted; without any, the first ones."""
    asked = F.array(*(F.lit(w) for w in dict.fromkeys(w for w in query.lower().split() if len(w) > 2))) if query.split() else F.array().cast("array<string>")
    words = F.array_distinct(F.regexp_extract_all(F.lower("redacted_text"), F.lit(r"(\w+)"), F.lit(1)))
    score = F.size(F.array_intersect(words, asked)) * F.when(boosted, 1.5).otherwise(1.0)
    return reviews.select("review_id", score.alias("score"), snippet(F.col("redacted_text"), 160, 160).alias("quote")).orderBy(F.desc("score"), "review_id").limit(top)


def matching(rows: DataFrame, texts: list[str], needle: str | None = None, **equal: str | None) -> DataFrame:
    """Rows whose columns equal what is asked for in any case ("ALL" or null: anything) and one of whose texts holds the needle.

    Texts may be arrays, of which any element may hold it.
    """
    out = rows
    for column, value in equal.items():
        if value and value.upper() != "ALL":
            out = out.filter(F.upper(column) == value.upper())
    if needle and needle.strip():
        kinds = dict(rows.dtypes)
        flat = [F.array_join(F.col(c), " ") if kinds[c].startswith("array") else F.col(c) for c in texts]
        out = out.filter(F.lower(F.concat_ws("\n", *flat)).contains(needle.strip().lower()))
    return out
