"""A folder of ingested reviews, by domain, and what a dashboard asks of it: one method for each group of routes.

Tables are parquet below one root, partitioned by domain: reviews, sentences, tickets, alerts. Every answer is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import embedding as E
from tidemark.functions import pii
from tidemark.functions import text as T
from tidemark.operators import aggregates as A
from tidemark.operators import clusters as C
from tidemark.operators import drift as D
from tidemark.operators import quality_gate as Q
from tidemark.operators import records as P
from tidemark.operators import service as S
from tidemark.operators import severity
from tidemark.operators import vectors as V
from tidemark.sources import artifacts, readers, sinks

TABLES = {
    "reviews": "review_id string, product_name string, brand_name string, batch string, channel string, rating int, sentiment string, created_at string, redacted_text string, entities string, span_detected boolean, span string, overall_severity string, row_index long, domain string",
    "sentences": "review_id string, sentence_idx int, sentence_text string, start int, end int, label string, confidence double, severity string, domain string",
    "tickets": "ticket_id string, title string, priority string, body string, created_at string, domain string",
    "quality": "total long, passed long, quarantined long, duplicates long, warnings long, quality_score double, domain string",
}
POOLS = {"complaints": "COMPLAINT", "requests": "RECOMMENDATION", "praise": "PRAISE"}


class Workspace:
    """encode: vectors of texts; words' hashes unless a model is given. stop: tokens that are no names."""

    def __init__(self, spark: SparkSession, root: str, encode: Callable[[Column], Column] = E.hashed_vector, stop: list[str] | None = None):
        self.spark, self.root, self.encode, self.stop = spark, root.rstrip("/"), encode, stop
        self.simulated: dict[str, tuple[str, float, str]] = {}

    def table(self, name: str, domain: str | None = None) -> DataFrame:
        """A table, or the part of a domain; empty where nothing was written yet."""
        path = f"{self.root}/{name}"
        if not artifacts.exists(self.spark, path):
            return self.spark.createDataFrame([], TABLES[name])
        out = self.spark.read.schema(TABLES[name]).option("basePath", path).parquet(path)
        return out.filter(F.col("domain") == domain) if domain else out

    def domains(self) -> list[str]:
        return sorted(r[0] for r in self.table("quality").select("domain").distinct().collect())

    def required(self, domain: str) -> str:
        """The domain, if it was ingested: none other than what is named is ever read."""
        if domain not in self.domains():
            raise ValueError(f"no domain {domain}")
        return domain

    def ingest(self, source: str | DataFrame, domain: str, label: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Reads, maps, gates, redacts and labels an upload, and replaces the domain with it; returns its quality figures.

        label: adds sentiment from redacted_text; without it the rating gives it.
        """
        raw, _ = readers.read_any(self.spark, source)
        mapped = Q.normalize(readers.indexed(raw))
        gated = Q.gate(mapped, "review_text", "row_index")
        clean = pii.redact(gated.filter("rejection_code is null"), "review_text", self.stop, entities="tags")
        own = clean.select(
            F.concat(F.lit(domain + ":"), "review_id").alias("review_id"), "product_name", F.lit(None).cast("string").alias("brand_name"), F.col("batch_or_version").alias("batch"), "channel", "rating", Q.weak_label(F.col("rating")).alias("sentiment"), "created_at",
            F.col("review_text").alias("redacted_text"), F.array_join("tags", ";").alias("entities"), "row_index",
        )
        own = label(own) if label else own
        span = T.complaint_span(F.col("redacted_text"))
        told = own.withColumn("__span", span).join(P.telemetry(own, "review_id", "redacted_text").select("review_id", "overall_severity"), "review_id")
        reviews = told.withColumns({"span_detected": F.col("__span.detected"), "span": F.col("__span.text"), "domain": F.lit(domain)})
        self.replace("reviews", reviews)
        stored = self.table("reviews", domain)
        routed = stored.select("review_id", F.posexplode(T.sentences(F.col("redacted_text"), 3)).alias("sentence_idx", "s")).withColumn("r", T.router_intent(F.col("s.text")))
        self.replace("sentences", routed.select("review_id", "sentence_idx", F.col("s.text").alias("sentence_text"), "s.start", "s.end", "r.label", "r.confidence", T.severity(F.col("s.text")).alias("severity"), F.lit(domain).alias("domain")))
        self.replace("quality", Q.manifest(gated).withColumn("domain", F.lit(domain)))
        return self.table("quality", domain)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes the part of the domain that rows are of anew."""
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(f"{self.root}/{name}")

    def both(self, domain: str) -> tuple[DataFrame, DataFrame]:
        return self.table("reviews", self.required(domain)), self.table("sentences", domain)

    def overview(self, domain: str) -> dict[str, DataFrame]:
        reviews, sentences = self.both(domain)
        line = D.timeline(reviews, theme="product_name")
        alerts = self.alerts(domain).select(F.col("place").alias("position"), F.concat(F.lit("Drift in "), "batch").alias("message"), "psi")
        themes = self.themes(domain).withColumn("position", F.col("review_count") * -1)
        return {
            "sentiment": A.sentiment_summary(reviews), "entities": S.fact_table(reviews, sentences).transform(lambda f: A.entity_summary(f, "PII_Entities_Detected")), "ratings": A.rating_distribution(reviews), "channels": A.sentiment_by(reviews, "channel"), "trend": line,
            "intents": S.intent_breakdown(sentences), "insights": S.insights(alerts, themes, reviews), "keywords": S.keyword_cloud(themes),
        }

    def themes(self, domain: str) -> DataFrame:
        """Products as themes: title, figures, severity against the corpus, first words."""
        reviews, sentences = self.both(domain)
        grave = sentences.filter("label = 'COMPLAINT'").join(reviews.select("review_id", "product_name"), "review_id").groupBy("product_name").agg(*(F.count_if(F.col("severity") == p).alias(p.lower()) for p in ("P0", "P1")))
        own = A.theme_summary(reviews, "product_name").join(grave, "product_name", "left").crossJoin(F.broadcast(reviews.agg(F.avg((F.col("sentiment") == "NEGATIVE").cast("int")).alias("base"))))
        tier = severity.theme_severity(F.col("negative_count") / F.col("review_count"), F.col("review_count"), F.col("base"), F.col("p0"), F.col("p1"))
        return own.select(F.col("product_name").alias("title"), "review_count", "negative_count", "neutral_count", "positive_count", "negative_rate", tier.alias("severity"), F.split(F.lower("product_name"), " ").alias("keywords"))

    def verbatims(self, domain: str, sentiment: str | None = None, batch: str | None = None, search: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
        """A page of redacted reviews that pass the filters."""
        rows = S.matching(self.both(domain)[0], ["redacted_text"], search, sentiment=sentiment, batch=batch)
        return A.page(Q.public_view(rows, ["review_id", "product_name", "batch", "channel", "rating", "sentiment", "created_at"], "raw_text", "redacted_text", False), ["review_id"], number, size)

    def drift(self, domain: str) -> DataFrame:
        return D.timeline(self.both(domain)[0], theme="product_name").orderBy("batch")

    def alerts(self, domain: str) -> DataFrame:
        """Alerts with place, a simulated one first."""
        reviews = self.both(domain)[0]
        found = D.alerts(D.timeline(reviews, theme="product_name"), D.attribution(D.distributions(reviews, theme="product_name"), theme="product_name"), theme="product_name").select("batch", "psi", "level", "top_driver")
        if domain in self.simulated:
            return S.with_anomaly(found, *self.simulated[domain])
        return found.withColumns({"is_simulated": F.lit(False), "place": F.lit(1)})

    def simulate(self, domain: str, batch: str, psi: float, driver: str) -> DataFrame:
        self.simulated[self.required(domain)] = (batch, psi, driver)
        return self.alerts(domain)

    def reset(self, domain: str) -> DataFrame:
        self.simulated.pop(domain, None)
        return self.alerts(domain)

    def clusters(self, domain: str, pool: str = "complaints", k: int | None = None) -> DataFrame:
        """Complaints, requests or praise as products."""
        reviews, sentences = self.both(domain)
        rows = sentences.filter(F.col("label") == POOLS[pool]).join(reviews.select("review_id", "batch"), "review_id")
        n = rows.count()
        if n == 0:
            return rows.select(F.lit(0).alias("cluster_id"), F.col("sentence_text").alias("title"))
        rows = rows.withColumns({"key": F.concat("review_id", F.lit("#"), "sentence_idx"), "vector": self.encode(F.col("sentence_text"))})
        k = min(n, k or (V.adaptive_k(n) if pool == "complaints" else C.number_of_clusters(n, 4 if pool == "requests" else 5)))
        own = V.k_means(rows, "vector", k)[0]
        names = ("cluster_id", "vector", "key", "sentence_text", T.tokens(F.col("sentence_text")))
        if pool == "complaints":
            return C.complaint_clusters(own, *names, batch="batch")
        return C.feature_requests(own, *names) if pool == "requests" else C.praise_clusters(own, *names)

    def propositions(self, domain: str, **filters) -> DataFrame:
        return P.proposition_page(self.both(domain)[1], **filters)

    def search(self, domain: str, query: str, intent: str | None = None, n: int = 10) -> DataFrame:
        """The sentences nearest to a question, of an intent or of all."""
        vector = self.spark.createDataFrame([(query,)], "q string").select(self.encode(F.col("q"))).first()[0]
        rows = self.both(domain)[1].withColumns({"key": F.concat("review_id", F.lit("#"), "sentence_idx"), "vector": self.encode(F.col("sentence_text"))})
        return E.search_by_intent(rows, list(vector), "vector", "key", intent, "label", n)

    def ask(self, domain: str, query: str, n: int = 4) -> tuple[DataFrame, DataFrame]:
        """(the kinds of question, the evidence) for a question in words."""
        kinds = self.spark.createDataFrame([(query,)], "q string").select(F.explode(S.query_kinds(F.col("q"))).alias("kind"))
        return kinds, S.ranked_evidence(self.both(domain)[0], query, F.col("sentiment") == "NEGATIVE", n)

    def facts(self, domain: str) -> DataFrame:
        return S.fact_table(*self.both(domain))

    def summary(self, domain: str) -> DataFrame:
        return S.kpi_summary(self.facts(domain))

    def drift_rows(self, domain: str) -> DataFrame:
        return D.drift_rows(self.drift(domain))

    def lenses(self, domain: str) -> dict[str, DataFrame]:
        reviews, sentences = self.both(domain)
        return {
            "silent_defects": S.silent_defects(reviews, sentences), "noise": S.noise_summary(sentences), "noise_words": S.noise_words(sentences), "products": S.product_risk(reviews, sentences), "stars": S.star_divergence(reviews, sentences), "trojans": S.trojan_samples(reviews, sentences), "turncoats": S.turncoats(reviews),
        }

    def compare(self, domain: str, a: list[str], b: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(figures of both sides, topic shifts, verdict) of two lists of cohorts."""
        reviews, sentences = self.both(domain)
        side = F.when(F.col("batch").isin(*a), "A").when(F.col("batch").isin(*b), "B")
        return S.cohort_profile(reviews, sentences, side), A.topic_shifts(reviews, side, "product_name"), A.verdict(A.cohort_stats(reviews, side))

    def action_matrix(self, domain: str) -> tuple[DataFrame, DataFrame]:
        """(clusters of complaints with impact, effort and quadrant; totals)."""
        reviews = self.both(domain)[0]
        n, mean = reviews.agg(F.count("*"), F.avg(F.coalesce("rating", F.lit(4)))).first()
        priority = F.element_at(F.create_map(*(F.lit(x) for kv in severity.AS_PRIORITY.items() for x in kv)), F.col("severity"))
        own = self.clusters(domain).select("title", F.col("sentence_count").alias("n"), priority.alias("priority"))
        matrix = S.action_matrix(own, F.lit(n))
        return matrix, S.action_totals(matrix, round(mean or 4.0, 2))

    def ticket(self, domain: str, ticket_id: str, title: str, now: str, needle: str | None = None) -> DataFrame:
        """Saves a ticket with the first five matching reviews and their batches in Markdown; returns all, the latest first."""
        found = S.matching(self.both(domain)[0], ["redacted_text"], needle).orderBy("review_id").limit(5)
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("review_id", T.markdown_escaped(T.snippet(F.col("redacted_text"), 160, 160)).alias("q")))), lambda x: F.concat(F.lit("- "), x["q"])), "\n")
        body = F.concat(F.lit(f"## {title}\n\nBatches: "), F.array_join(F.array_sort(F.collect_set("batch")), ", "), F.lit("\n\n"), lines)
        tier = F.coalesce(F.min("overall_severity"), F.lit("P3"))
        sinks.save_ticket(found.agg(F.lit(ticket_id).alias("ticket_id"), F.lit(title).alias("title"), tier.alias("priority"), body.alias("body"), F.lit(now).alias("created_at"), F.lit(domain).alias("domain")), f"{self.root}/tickets")
        return sinks.tickets(self.spark, f"{self.root}/tickets", TABLES["tickets"])

    def counts(self) -> DataFrame:
        """(name, n) of every table."""
        out = None
        for name in TABLES:
            one = self.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
            out = one if out is None else out.unionByName(one)
        return out
