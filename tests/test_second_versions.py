"""Rules held against versions of their own in plain Python, over sentences made of phrases that the rules look for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import embedding, pii, text
from tidemark.functions import lexicon as L
from tidemark.operators import records

PHRASES = [
    "The pump broke", "but it leaked", "however the app crashes", "I love it", "no redness at all", "it did not stop my irritation", "please add a refill", "would love a bigger one", "refund was processed", "I want a refund", "it is useless", "works fine",
    "my skin never felt dry", "in exchange for an honest review", "burning skin", "although greasy", "nothing to say", "Dr. Smith came", "v2.1 is out", "return to the store", "yet again", "stopped working", "it would be great if", "holy grail", "e.g. this one",
]
ENDS = [". ", "! ", "? ", ", ", "; ", " ", " - ", ".\n", " — "]


def made(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PHRASES) + rng.choice(ENDS) for _ in range(rng.randint(1, 5))).strip(" ") for _ in range(n)] + ["", "  ", "but", "Yet, no."]


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(4)
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def has(pattern, t):
    return re.search(pattern, t) is not None


def clauses_of(t):
    return [c for c in re.split(L.CLAUSE_END, t) if c.strip()]


def soft(t):
    return has(L.NEGATED, t) and not has(L.FAILED_MITIGATION, t)


def tier_of(t):
    free = [c for c in clauses_of(t) if not soft(c)]
    return next((n for n, p in (("P0", L.P0), ("P1", L.P1), ("P2", L.P2)) if any(has(p, c) for c in free)), "P3")


def confidence(n, floor):
    import math

    return round(min(0.95, floor + (0.95 - floor) * (1 - math.exp(-n / 1.5))), 3)


def routed(t):
    t = t.strip(" ")
    if not t:
        return "NOISE", 0.8
    if has(L.PROMOTION, t) and not has(L.EXPLICIT_DEFECT, t):
        return ("PRAISE", 0.9) if has(L.PRAISE, t) else ("NOISE", 0.8)
    if wishes := {m[0].lower() for m in re.finditer(L.RECOMMENDATION, t)}:
        return "RECOMMENDATION", confidence(len(wishes), 0.4)
    found, praise, mild = set(), False, False
    for c in clauses_of(t):
        failed, negated = has(L.FAILED_MITIGATION, c), has(L.NEGATED, c)
        if failed or not negated:
            found |= {m[0].lower() for m in re.finditer(L.COMPLAINT, c)} - set(L.PURE_MARKERS)
            if has(L.WEAK_TRIGGER, c) and has(L.WEAK_CONTEXT, c) and not has(L.RESOLVED, c):
                found |= {m[0].lower() for m in re.finditer(L.WEAK_TRIGGER, c)}
        praise, mild = praise or has(L.PRAISE, c), not failed and (negated or mild)
    if found:
        return "COMPLAINT", confidence(len(found), 0.5)
    return ("PRAISE", 0.9) if praise else ("PRAISE", 0.85) if mild else ("NOISE", 0.8)


def proposed(t):
    mark = re.search(L.CONTRAST, t)
    mark = mark[1] if mark else None
    if has(L.RECOMMENDATION_SIGNALS, t) or has(L.RECOMMENDATION, t):
        return "RECOMMENDATION", tier_of(t), mark
    if (tier_of(t) != "P3" or mark or has(L.COMPLAINT, t)) and not soft(t):
        return "COMPLAINT", tier_of(t), mark
    return ("PRAISE" if has(L.PRAISE, t) or soft(t) else "NOISE"), "P3", None


def spanned(t):
    def end(start):
        m = re.search(L.SPAN_END, t[start:])
        return t[start : start + m.start()].rstrip() if m else t[start:].rstrip()

    if m := re.search(L.CONTRAST, t):
        own = end(m.start())
        if not soft(own) or tier_of(own) in ("P0", "P1"):
            return own, "contrastive:" + m[1].lower(), tier_of(own)
    for name, pattern in (("P0", L.P0), ("P1", L.P1), ("P2", L.P2)):
        if m := re.search(pattern, t):
            own = end(m.start())
            context = re.search(r"(?s)(?:^|[.!?,;])([^.!?,;]*)\Z", t[: m.start()])[1] + own
            if not ((has(L.NEGATED, context) or has(L.NEGATED, own)) and not has(L.FAILED_MITIGATION, context)):
                return own, f"direct_defect:{name}", name
    return "", None, "P3"


def test_intents_spans_and_severity(spark):
    texts = made(600)
    got = column(spark, texts, lambda c: F.struct(text.router_intent(c).alias("r"), text.proposition_intent(c).alias("p"), text.complaint_span(c).alias("s"), text.severity(c).alias("t")))
    for t, x in zip(texts, got, strict=True):
        assert x.r.label == routed(t)[0] and abs(x.r.confidence - routed(t)[1]) < 1.1e-3, t
        assert (x.p.intent, x.p.severity, x.p.marker) == proposed(t), t
        assert (x.s.text, x.s.trigger, x.s.severity) == spanned(t), t
        assert x.t == tier_of(t), t
    assert {x.r.label for x in got} == {"COMPLAINT", "PRAISE", "RECOMMENDATION", "NOISE"}


def test_sentences_and_telemetry(spark):
    texts = made(300, 8)
    parts = [[(m.strip(), t.find(m.strip(), at)) for m, at in pieces(t) if m.strip()] for t in texts]
    got = column(spark, texts, text.sentences)
    assert [[(s.text, s.start) for s in x] for x in got] == parts
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = {r.i: r for r in records.telemetry(df, "i", "t").collect()}
    rank = {"P0": 4, "P1": 3, "P2": 2, "P3": 1}
    for i, (t, own) in enumerate(zip(texts, parts, strict=True)):
        kinds = [(s, *proposed(s)[:2]) for s, _ in own]
        bad = [(s, tier) for s, k, tier in kinds if k == "COMPLAINT"]
        span = spanned(t)
        grave = max([1, *(rank[x] for _, x in bad), *([rank[span[2]]] if span[1] else [])])
        assert rows[i].n_complaint == len(bad) and rows[i].n_noise == sum(k == "NOISE" for _, k, _ in kinds)
        assert rows[i].overall_severity == f"P{4 - grave}" and rows[i].primary_complaint_text == (" ".join(s for s, _ in bad) if bad else span[0] if span[1] else t)
    p = records.propositions(df, "i", "t")
    assert p.count() == sum(map(len, parts))
    again = records.proposition_of(records.span_record(p))
    assert again.exceptAll(p.select(*again.columns)).isEmpty()


def pieces(t):
    at = 0
    for m in re.finditer(L.SENTENCE_END, t):
        yield t[at : m.start()], at
        at = m.end()
    yield t[at:], at


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def redacted(t, stop):
    kinds = []

    def step(name, pattern, new):
        nonlocal t
        now = re.sub(pattern, new, t)
        if now != t:
            kinds.append(name)
        t = now

    pin = has(L.PIN, t)
    step("ORDER_ID", pii.ORDER, "[REDACTED_ORDER_ID]")
    digits = lambda m: re.sub(r"\D", "", m[0])
    step("PAYMENT_CARD", L.CARD, lambda m: "[REDACTED_PAYMENT_CARD]" if len(digits(m)) in (13, 15, 16, 19) and luhn(digits(m)) else m[0])
    was = t
    for pattern, new in ((f"(?i)({L.PHONE_LABEL.removeprefix('(?i)')})({L.PHONE_NUMBER})", r"\1[REDACTED_PHONE]"), (L.PHONE_E164, "[REDACTED_PHONE]"), (L.PHONE_TEN, "[REDACTED_PHONE]")):
        t = re.sub(pattern, new, t)
    if t != was:
        kinds.append("PHONE")
    step("EMAIL", L.EMAIL, "[REDACTED_EMAIL]")
    if pin:
        t = re.sub(L.PIN, r"\1[REDACTED_PINCODE]", t)
        kinds.append("POSTAL_CODE")

    def name(m):
        own = re.search(f"({L.NAME})$", m[0])[1]
        return m[0] if set(own.split()) & set(stop) else re.match(rf"^(.*?){L.NAME}$", m[0])[1] + "[REDACTED_NAME]"

    step("PERSON_NAME", L.NAME_FRAME + L.NAME, name)
    return t, [k for k in L.ENTITIES if k in kinds]


def test_redaction(spark):
    rng = random.Random(9)
    bits = [
        "order #ORD-12345", "ref: A1B2C3", "4111 1111 1111 1111", "4111111111111112", "378282246310005", "call me at 555-123-4567", "+4915112345678", "(555) 123-4567", "a.b@example.com", "pincode: 560001", "zip 12345", "My name is Jane Doe",
        "regards, The Team", "customer John", "12345678901234567890123", "version 1.2.3", "plain words", "OD1234567890", "phone number: 12", "x@y", "The 4111-1111-1111-1111 card", "buyer: Anna",
    ]
    stop = pii.default_stop_tokens()
    texts = [" ".join(rng.choice(bits) + rng.choice(["", ",", ".", " and"]) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    for r in pii.redact(df, "t").collect():
        assert (r.t, r.entities) == redacted(texts[r.i], stop), texts[r.i]


def test_clause_analysis(spark):
    texts = ["The pump broke, but I love it. Please add a refill! A rash came, yet nothing else", "", "Fine; however it was burning.", "So it goes."]

    def kind(p):
        return next(((n, s) for n, s, pattern in text.KINDS if re.search(pattern, p.lower())), ("NOISE", 0.5))

    for t, x in zip(texts, column(spark, texts, text.analysed_clauses), strict=True):
        assert [(c.text, c.intent, c.score) for c in x] == [(p.strip(), *kind(p)) for p in re.split(text.PARTS, t) if p.strip()]


def test_hashed_vectors(spark):
    assert embedding.murmur3(b"foo") == -156908512 and embedding.murmur3(b"foo", 42) == -1322301282
    got = column(spark, ["the cat the", "", None, "a b"], embedding.hashed_vector)
    spots = {w: abs(embedding.murmur3(w.encode())) % 384 for w in ("the", "cat")}
    assert got[0][spots["the"]] == pytest.approx(2 / 5**0.5) and got[0][spots["cat"]] == pytest.approx(1 / 5**0.5) and sum(x != 0 for x in got[0]) == 2
    assert got[1] == got[2] == got[3] == [0.0] * 384
