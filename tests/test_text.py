import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions import pii, text

TEXTS = [
    "Love this cream! But the pump broke after a week. Dr. Smith liked v2.1 too.", "No redness at all, but the pump is jammed solid.", "Please add a refill option.", "It did not stop my irritation.",
    "I received this product free in exchange for an honest review. Amazing!", "My skin never felt dry and no breakouts.", "The app crashes. I want a refund, it is useless.", "Works fine, refund was already processed.", "Plain words only.", "", "  ",
    "Café ☕ crème 🙂 leaked. Zweiter Satz! drei?", "It works, however it leaked everywhere! Then fine.",
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(2)
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_sentences_are_slices(spark):
    for t, found in zip(TEXTS, column(spark, TEXTS, text.sentences), strict=True):
        assert all(t[s.start : s.end] == s.text for s in found)
        assert [s.text for s in found] == [p.strip() for p in re.split(L.SENTENCE_END, t) if p.strip()]


def test_least_words(spark):
    assert [s.text for s in column(spark, ["One. Two words. Now three words."], lambda c: text.sentences(c, 3))[0]] == ["Now three words."]


@pytest.mark.parametrize(("sentence", "label"), [
    ("The pump broke after a week.", "COMPLAINT"), ("No redness at all, but the pump is jammed solid.", "COMPLAINT"), ("Please add a refill option.", "RECOMMENDATION"), ("It did not stop my irritation.", "COMPLAINT"),
    ("I received this product free in exchange for an honest review.", "NOISE"), ("I got it in exchange for an honest review, amazing!", "PRAISE"), ("No breakouts, no redness.", "PRAISE"), ("Plain words only.", "NOISE"), ("but however", "NOISE"), ("", "NOISE"),
])
def test_router(spark, sentence, label):
    got = column(spark, [sentence], text.router_intent)[0]
    assert got.label == label and 0 < got.confidence <= 0.95


def test_propositions_differ_from_the_router(spark):
    got = column(spark, ["It is blue but large.", "The screen broken, burning too.", "Would love a bigger one.", None], text.proposition_intent)
    assert [(g.intent, g.severity) for g in got] == [("COMPLAINT", "P3"), ("COMPLAINT", "P0"), ("RECOMMENDATION", "P3"), ("NOISE", "P3")]
    assert got[0].marker == "but"


def test_severity(spark):
    assert column(spark, ["burning skin", "pump jammed", "terrible", "fine", "no burning, but it leaked", None], text.severity) == ["P0", "P1", "P2", "P3", "P1", None]


def test_spans_are_slices(spark):
    for t, s in zip(TEXTS, column(spark, TEXTS, text.complaint_span), strict=True):
        assert not s.detected or t[s.start : s.end] == s.text
    got = column(spark, ["Nice. But the pump broke. Bye.", "It leaked. Bye.", "All good."], text.complaint_span)
    assert [(g.text, g.trigger, g.severity) for g in got] == [("But the pump broke.", "contrastive:but", "P1"), ("leaked.", "direct_defect:P1", "P1"), ("", None, "P3")]


def test_small_scalars(spark):
    assert column(spark, ["a  b c", "", None], text.word_count) == [3, 0, 0]
    assert column(spark, ["x" * 181, "x"], lambda c: F.length(text.snippet(c, 175, 180))) == [178, 1]
    df = spark.createDataFrame([(["dark spots", "dark skin", "pump"],), (["one"],)], "k array<string>")
    assert [r[0] for r in df.select(text.title_of(F.col("k"))).collect()] == ["Dark Spots & Pump", "One"]


@pytest.mark.parametrize(("raw", "clean", "tags"), [
    ("Order ORD-12345 came", "[REDACTED_ORDER_ID] came", ["ORDER_ID"]), ("I refreshed the order today", "I refreshed the order today", []),
    ("card 4111 1111 1111 1111 ok", "card [REDACTED_PAYMENT_CARD] ok", []), ("card 378282246310005 ok", "card [REDACTED_PAYMENT_CARD] ok", ["PAYMENT_CARD"]),
    ("mail a.b@example.com now", "mail [REDACTED_EMAIL] now", ["EMAIL"]), ("call me at 555-123-4567.", "call me at [REDACTED_PHONE].", ["PHONE"]), ("pincode: 560001", "pincode: [REDACTED_PINCODE]", ["POSTAL_CODE"]),
    ("My name is Jane Doe and", "My name is [REDACTED_NAME] and", ["PERSON_NAME"]), ("customer The best", "customer The best", []), (None, None, []),
])
def test_redaction(spark, raw, clean, tags):
    if raw and raw.startswith("card 4111"):
        tags = ["PAYMENT_CARD"]
    df = spark.createDataFrame([(raw,)], "t string")
    got = pii.redact(df, "t", entities="f").first()
    assert (got.t, got.f) == (clean, tags)
    assert pii.redact(spark.createDataFrame([(got.t,)], "t string"), "t").first()[0] == clean


def test_only_the_match_itself_is_replaced(spark):
    raw = "Card 4111111111111111 and key 999941111111111111117777. My name is Jane Doe, not my name is The Jane Doe"
    got = pii.redact(spark.createDataFrame([(raw,)], "t string"), "t").first()
    assert got.t == "Card [REDACTED_PAYMENT_CARD] and key 999941111111111111117777. My name is [REDACTED_NAME], not my name is The Jane Doe"


def test_surrogates_are_keyed(spark):
    import hashlib
    import hmac

    got = pii.redact(spark.createDataFrame([("x a@b.co y",)], "t string"), "t", secret=b"key").first()[0]
    assert got == f"x [REDACTED_EMAIL_{hmac.new(b'key', b'a@b.co', hashlib.sha256).hexdigest()[:8]}] y"
