import pytest
from pyspark.sql import functions as F

from tidemark.sources import synthetic
from tidemark.workspace import Workspace


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("workspace")
    own = synthetic.reviews(spark, 1200).withColumn("review_text", F.concat("review_text", F.lit(" My order ORD-1"), F.col("review_id").substr(9, 5), F.lit(" came, call 555-123-4567. Please add a refill. I love it, but it leaked.")))
    own.drop("sentiment").coalesce(1).write.option("header", True).csv(f"{top}/upload.csv")
    w = Workspace(spark, f"{top}/data")
    w.ingest(f"{top}/upload.csv", "beauty")
    w.ingest(spark.createDataFrame([("fine and good cream", 5), ("nan", 1), ("broken pump here", 1)], "text string, rating int"), "other")
    return w


def test_domains_are_apart(workspace):
    assert workspace.domains() == ["beauty", "other"]
    q = {r.domain: (r.total, r.passed) for r in workspace.table("quality").collect()}
    assert q["other"] == (3, 2) and q["beauty"][0] == 1200 and workspace.verbatims("other").count() == 2
    with pytest.raises(ValueError, match="no domain"):
        workspace.drift("none")
    assert {r.name: r.n for r in workspace.counts().collect()}["reviews"] == 2 + q["beauty"][1]


def test_nothing_raw_is_stored(workspace):
    r = workspace.table("reviews", "beauty")
    assert r.filter("redacted_text like '%ORD-1%' or redacted_text like '%555-123%'").isEmpty() and r.filter("entities != 'ORDER_ID;PHONE'").isEmpty()


def test_overview_and_drift(workspace):
    parts = {k: v.collect() for k, v in workspace.overview("beauty").items()}
    assert all(parts.values()) and parts["sentiment"][0].total == workspace.table("reviews", "beauty").count() and len(parts["ratings"]) == 5
    assert [r.batch for r in workspace.drift("beauty").collect()] == sorted({b for b in synthetic.DOMAINS["cosmetics"][1]})
    first = workspace.simulate("beauty", "B-1", 0.4, "Burning").orderBy("place").first()
    assert first.is_simulated and first.batch == "B-1" and workspace.reset("beauty").filter("is_simulated").isEmpty()


def test_clusters_and_search(workspace):
    c = workspace.clusters("beauty", k=4).collect()
    assert 1 <= len(c) <= 4 and sum(r.sentence_count for r in c) == workspace.table("sentences", "beauty").filter("label = 'COMPLAINT'").count()
    assert all(len(r.quotes) <= 100 and r.quotes[0] == r.medoid for r in c)
    assert workspace.clusters("beauty", "requests").first().vote_count > 0 and workspace.clusters("other", "requests").collect() == []
    hits = workspace.search("beauty", "please add a refill", "recommendation", 3).collect()
    assert [h.similarity_score > 0.5 for h in hits] == [True] * 3 and {h.label for h in hits} == {"RECOMMENDATION"}
    kinds, evidence = workspace.ask("beauty", "worst leak trend")
    assert {r.kind for r in kinds.collect()} == {"severe", "drift"} and evidence.count() == 4


def test_reports(workspace):
    one = workspace.summary("beauty").first()
    assert one.total_reviews == workspace.facts("beauty").count() and one.redacted_pct == 100.0
    assert all(v.count() for k, v in workspace.lenses("beauty").items() if k not in ("noise_words", "trojans", "turncoats"))
    sides, shifts, verdict = workspace.compare("beauty", ["2024-Q1", "2024-Q2"], ["2024-Q3"])
    assert {r.label for r in sides.collect()} == {"A", "B"} and shifts.count() > 0 and verdict.first().verdict == "REGRESSED"
    matrix, totals = workspace.action_matrix("beauty")
    assert matrix.count() > 0 and totals.first().projected_target_csat <= 5
    t = workspace.ticket("beauty", "T1", "Leak", "2024-01-01", "leaked")
    assert t.count() == 1 and t.first().body.startswith("## Leak\n\nBatches: 2024-Q") and workspace.ticket("beauty", "T2", "Pump", "2024-01-02").first().ticket_id == "T2"
    assert workspace.propositions("beauty", intent="praise", size=3).count() == 3 and workspace.drift_rows("beauty").count() == 4
