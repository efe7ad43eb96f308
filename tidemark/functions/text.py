"""Text operators as column expressions: sentences, clauses, severity, intent, spans, small scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L


#: White space of any kind.
SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; only the ends are looked at."""
    return F.btrim(text, F.lit(SPACE))


def plain_quotes(text: Column) -> Column:
    return F.translate(text, "’‘“”", "''\"\"")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + pattern + ")"), F.lit(1))


def clauses(text: Column) -> Column:
    return F.filter(F.split(text, L.CLAUSE_END), lambda c: strip(c) != "")


def mitigated(text: Column) -> Column:
    return text.rlike(L.NEGATED) & ~text.rlike(L.FAILED_MITIGATION)


def _finds(pattern: str):
    return lambda c: c.rlike(pattern)


def severity(text: Column) -> Column:
    """P0 to P3: the gravest signal in a clause that isn't negated or mitigated."""
    free = F.filter(clauses(text), lambda c: ~mitigated(c))
    tier = F.lit("P3")
    for name, pattern in (("P2", L.P2), ("P1", L.P1), ("P0", L.P0)):
        tier = F.when(F.exists(free, _finds(pattern)), name).otherwise(tier)
    return F.when(text.isNotNull(), tier)


#: A cheap test before the costly ones: an end mark before, white space after.
SENTENCE_GAP = r"(?<=[.?!])(?=\s)" + L.SENTENCE_END


def sentences(text: Column, least_words: int = 0) -> Column:
    """Array of (text, start, end) with text == substring(start, end - start), offsets in code points; parts of fewer words are left out."""
    whole = F.coalesce(text, F.lit(""))
    gaps = F.regexp_extract_all(whole, F.lit(f"({SENTENCE_GAP})"), F.lit(1))
    parts = F.zip_with(F.split(whole, SENTENCE_GAP, -1), gaps, lambda p, g: F.struct(p.alias("raw"), strip(p).alias("own"), (F.length(p) + F.coalesce(F.length(g), F.lit(0))).alias("n")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    # the fold carries numbers only
    starts = F.aggregate(F.transform(parts, lambda x: x["n"]), begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]

    def placed(x: Column, at: Column) -> Column:
        start = at + F.length(x["raw"]) - F.length(F.ltrim(x["raw"], F.lit(SPACE)))
        return F.struct(x["own"].alias("text"), start.alias("start"), (start + F.length(x["own"])).alias("end"))

    found = F.filter(F.zip_with(parts, starts, placed), lambda s: s["text"] != "")
    return F.filter(found, lambda s: F.size(F.split(s["text"], r"(?U)\s+")) >= least_words) if least_words else found


def evidence(n: Column, floor: float, ceiling: float = 0.95) -> Column:
    """Confidence of n distinct terms, rising from floor towards the ceiling."""
    return F.round(F.when(n <= 0, F.lit(floor)).otherwise(F.least(F.lit(ceiling), floor + (ceiling - floor) * (1 - F.exp(-n / 1.5)))), 3)


def distinct_terms(found: Column) -> Column:
    return F.size(F.array_distinct(F.transform(found, lambda x: F.lower(x))))


def router_intent(sentence: Column) -> Column:
    """(label, confidence) of a sentence: promotion, then recommendation, then complaint by clauses that aren't negated, then praise."""
    text = F.trim(plain_quotes(F.coalesce(sentence, F.lit(""))))
    out = lambda label, conf: F.struct(F.lit(label).alias("label"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("confidence"))

    def told(c: Column) -> Column:
        """What one clause has, each pattern tried once."""
        strong = F.filter(F.transform(matches(c, L.COMPLAINT), lambda x: F.lower(x)), lambda x: ~x.isin(*L.PURE_MARKERS))
        weak = F.when(c.rlike(L.WEAK_TRIGGER) & c.rlike(L.WEAK_CONTEXT) & ~c.rlike(L.RESOLVED), matches(c, L.WEAK_TRIGGER)).otherwise(F.array().cast("array<string>"))
        return F.struct(c.rlike(L.FAILED_MITIGATION).alias("failed"), c.rlike(L.NEGATED).alias("negated"), F.concat(strong, weak).alias("terms"), c.rlike(L.PRAISE).alias("praise"))

    def decided(parts: Column) -> Column:
        terms = F.flatten(F.transform(F.filter(parts, lambda c: c["failed"] | ~c["negated"]), lambda c: c["terms"]))
        mild = F.aggregate(parts, F.lit(False), lambda was, c: ~c["failed"] & (c["negated"] | was))
        return F.when(F.size(terms) > 0, out("COMPLAINT", evidence(distinct_terms(terms), 0.50))).when(F.exists(parts, lambda c: c["praise"]), out("PRAISE", 0.90)).when(mild, out("PRAISE", 0.85)).otherwise(out("NOISE", 0.80))

    wishes = matches(text, L.RECOMMENDATION)
    promotion = text.rlike(L.PROMOTION) & ~text.rlike(L.EXPLICIT_DEFECT)
    # an array of one element, so that the clauses are a bound value and not computed again for each branch
    by_clauses = F.get(F.transform(F.array(F.transform(clauses(text), told)), decided), F.lit(0))
    return (
        F.when(text == "", out("NOISE", 0.80))
        .when(promotion & text.rlike(L.PRAISE), out("PRAISE", 0.90))
        .when(promotion, out("NOISE", 0.80))
        .when(F.size(wishes) > 0, out("RECOMMENDATION", evidence(distinct_terms(wishes), 0.40)))
        .otherwise(by_clauses)
    )


def proposition_intent(sentence: Column) -> Column:
    """(intent, severity, marker) of a proposition; a contrast marker alone makes a complaint unless the sentence is mitigated."""
    tier, soft = severity(sentence), mitigated(sentence)
    marker = F.nullif(F.regexp_extract(sentence, L.CONTRAST, 1), F.lit(""))
    out = lambda label, t, m: F.struct(F.lit(label).alias("intent"), t.alias("severity"), m.alias("marker"))
    none, low = F.lit(None).cast("string"), F.lit("P3")
    return (
        F.when(sentence.rlike(L.RECOMMENDATION_SIGNALS) | sentence.rlike(L.RECOMMENDATION), out("RECOMMENDATION", tier, marker))
        .when(((tier != "P3") | marker.isNotNull() | sentence.rlike(L.COMPLAINT)) & ~soft, out("COMPLAINT", tier, marker))
        .when(sentence.rlike(L.PRAISE) | soft, out("PRAISE", low, none))
        .otherwise(out("NOISE", low, none))
    )


def before(text: Column, pattern: str) -> Column:
    """What stands before the first match; the whole text if there is none."""
    return F.element_at(F.split(text, pattern, 2), 1)


def complaint_span(text: Column) -> Column:
    """(detected, text, start, end, trigger, severity): from the first contrast marker, or else the gravest defect signal, to the sentence's end."""
    rtrim = lambda x: F.rtrim(x, F.lit(SPACE))

    def span(pattern: str, trigger: Column, tier: Column | None) -> tuple[Column, Column]:
        start = F.length(before(text, pattern))
        own = rtrim(before(F.substring(text, start + 1, F.length(text)), L.SPAN_END))
        context = F.concat(F.regexp_extract(F.substring(text, F.lit(1), start), r"(?s)(?:^|[.!?,;])([^.!?,;]*)$", 1), own)
        value = F.struct(F.lit(True).alias("detected"), own.alias("text"), start.alias("start"), (start + F.length(own)).alias("end"), trigger.alias("trigger"), (severity(own) if tier is None else tier).alias("severity"))
        soft = mitigated(own) if tier is None else (context.rlike(L.NEGATED) | own.rlike(L.NEGATED)) & ~context.rlike(L.FAILED_MITIGATION)
        return value, soft

    mark, soft = span(L.CONTRAST, F.concat(F.lit("contrastive:"), F.lower(F.regexp_extract(text, L.CONTRAST, 1))), None)
    out = F.when(text.rlike(L.CONTRAST) & (~soft | mark["severity"].isin("P0", "P1")), mark)
    for tier, pattern in (("P0", L.P0), ("P1", L.P1), ("P2", L.P2)):
        value, soft = span(pattern, F.lit(f"direct_defect:{tier}"), F.lit(tier))
        out = out.when(text.rlike(pattern) & ~soft, value)
    no = F.lit(None)
    return out.otherwise(F.struct(F.lit(False).alias("detected"), F.lit("").alias("text"), no.cast("int").alias("start"), no.cast("int").alias("end"), no.cast("string").alias("trigger"), F.lit("P3").alias("severity")))


def span_holds(source: Column, part: Column, start: Column, end: Column) -> Column:
    """0 <= start < end <= length, and the part is the slice."""
    return F.coalesce((start >= 0) & (start < end) & (end <= F.length(source)) & (F.substring(source, start + 1, end - start) == part), F.lit(False))


def word_count(text: Column) -> Column:
    own = strip(F.coalesce(text, F.lit("")))
    return F.when(own == "", 0).otherwise(F.size(F.split(own, r"(?U)\s+")))


def tokens(text: Column, least: int = 3, most: int | None = 15) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\b([a-z]{{{least},{'' if most is None else most}}})\b"), F.lit(1))


def snippet(text: Column, keep: int, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([\\`*_{}\[\]()#+!|<>])", r"\\$1"), r"[\r\n]+", " ")


def title_of(keywords: Column) -> Column:
    """The first keyword and the first after it that shares no word with it, in title case, joined by ' & '."""
    head = F.get(keywords, F.lit(0))
    other = F.get(F.filter(F.slice(keywords, 2, 100), lambda k: ~F.arrays_overlap(F.split(k, " "), F.split(head, " "))), F.lit(0))
    return F.concat_ws(" & ", F.initcap(head), F.initcap(other))


#: What the client takes for a hazard, a defect, a wish or praise, and the score of each.
PARTS = r"(?i)(?<=[.!?])\s+|(?<=[,;])\s+(?=but\b|however\b|although\b|yet\b|though\b|except\b)"
KINDS = (
    ("CRITICAL_SAFETY", 0.05, r"\b(dermatitis|chemical burn|burns|burning|allergic|rash|swelling|hospital|infection|shattered|broken glass|shards|bleeding|blister)\b"),
    ("DEFECT", 0.15, r"\b(broke|broken|cracked|leak|leaked|leaking|clog|clogged|jams|jammed|explode|exploded|defective|pump|dispenser|dropper|smell terrible|spoiled|greasy|breakout|acne|dryness|chapping)\b"),
    ("FEATURE_REQUEST", 0.65, r"\b(would love|wish|please make|please add|suggest|unscented|fragrance-free|travel-friendly|refill|bigger size|pump option|shade range)\b"),
    ("PRAISE", 0.95, r"\b(love|loved|holy grail|amazing|glow|best|hydrated|hydrating|smoothed|smooth|soothing|5 stars|repurchase|favorite|perfect|delight)\b"),
)


def analysed_clauses(text: Column) -> Column:
    """Array of (text, intent, score) of the clauses between sentence ends and turns, by the first kind of word found."""

    def told(part: Column) -> Column:
        low, intent, score = F.lower(part), F.lit("NOISE"), F.lit(0.5)
        for name, value, pattern in reversed(KINDS):
            intent, score = F.when(low.rlike(pattern), name).otherwise(intent), F.when(low.rlike(pattern), value).otherwise(score)
        return F.struct(part.alias("text"), intent.alias("intent"), score.alias("score"))

    parts = F.transform(F.split(F.coalesce(text, F.lit("")), PARTS, -1), lambda p: strip(p))
    return F.transform(F.filter(parts, lambda p: p != ""), told)
