"""Redaction of personal data as column expressions, in the order: order ids, cards, phones, e-mail, postal codes, names."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L

ORDER = rf"{L.ORDER_PREFIX}(?=[A-Z0-9\-]{{0,18}}\d)[A-Z0-9][A-Z0-9\-]{{3,18}}\b|(?<![\w])OD\d{{8,16}}\b"


def spliced(text: Column, pattern: str, new) -> Column:
    """text with each match of pattern replaced, where it stands, by new(match); a null from new leaves it."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    both = F.zip_with(F.split(text, pattern, -1), found, lambda part, x: F.concat(part, F.coalesce(new(x), x, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(both, "")).otherwise(text)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def is_card(found: Column) -> Column:
    """Whether a run of digits has a card number's length and passes the Luhn check."""
    return F.length(digits(found)).isin(13, 15, 16, 19) & F.call_function("luhn_check", digits(found))


def keyed_digest(secret: bytes, text: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal."""
    key = secret.ljust(64, b"\0")
    outer, inner = (bytes(b ^ pad for b in key) for pad in (0x5C, 0x36))
    unhexed = lambda b: F.unhex(F.lit(b.hex()))
    return F.sha2(F.concat(unhexed(outer), F.unhex(F.sha2(F.concat(unhexed(inner), text.cast("binary")), 256))), 256)


def emails(text: Column, secret: bytes | None) -> Column:
    if not secret:
        return F.regexp_replace(text, L.EMAIL, "[REDACTED_EMAIL]")
    return spliced(text, L.EMAIL, lambda x: F.concat(F.lit("[REDACTED_EMAIL_"), F.substring(keyed_digest(secret, x), 1, 8), F.lit("]")))


def default_stop_tokens() -> list[str]:
    """Capitalised English stop words: words that open a sentence rather than a name."""
    return sorted({w.capitalize() for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalpha()})


def is_name(framed: Column, stop: list[str]) -> Column:
    """Whether a frame and name hold no stop token in the name."""
    return ~F.arrays_overlap(F.split(F.regexp_extract(framed, rf"({L.NAME})$", 1), r"\s+"), F.array(*map(F.lit, stop)))


def redact(df: DataFrame, column: str, stop: list[str] | None = None, secret: bytes | None = None, entities: str = "entities") -> DataFrame:
    """df with column redacted and entities, the kinds found in canonical order; a null text stays null and has none.

    Each step is a column of its own, so that none is computed more than once.
    """
    stop = default_stop_tokens() if stop is None else stop
    labelled, framed = f"({L.PHONE_LABEL})({L.PHONE_NUMBER})", L.NAME_FRAME + L.NAME
    now, step = F.col(column), lambda c, n: F.regexp_replace(c, n, "[REDACTED_PHONE]")
    hit = lambda pattern: now.rlike(pattern)
    # all but addresses and names need a digit, and addresses a sign, which is soon looked for
    out = df.withColumns({"__digit": hit("[0-9]"), "__at": F.contains(now, F.lit("@"))})
    out = out.withColumns({"__order": F.col("__digit") & hit(ORDER), "__pin": F.col("__digit") & hit(L.PIN)})
    out = out.withColumn(column, F.when(F.col("__order"), F.regexp_replace(now, ORDER, "[REDACTED_ORDER_ID]")).otherwise(now))
    out = out.withColumn("__card", F.when(F.col("__digit") & now.rlike(L.CARD), F.exists(F.regexp_extract_all(now, F.lit(f"({L.CARD})"), F.lit(1)), is_card)).otherwise(F.lit(False)))
    out = out.withColumn(column, F.when(F.col("__card"), spliced(now, L.CARD, lambda x: F.when(is_card(x), "[REDACTED_PAYMENT_CARD]"))).otherwise(now))
    out = out.withColumn("__phone", F.col("__digit") & (hit(labelled) | hit(L.PHONE_E164) | hit(L.PHONE_TEN)))
    out = out.withColumn(column, F.when(F.col("__phone"), step(step(F.regexp_replace(now, labelled, "$1[REDACTED_PHONE]"), L.PHONE_E164), L.PHONE_TEN)).otherwise(now))
    out = out.withColumn("__email", F.col("__at") & hit(L.EMAIL))
    out = out.withColumn(column, F.when(F.col("__email"), emails(now, secret)).otherwise(now))
    out = out.withColumn(column, F.when(F.col("__pin"), F.regexp_replace(now, L.PIN, "$1[REDACTED_PINCODE]")).otherwise(now))
    out = out.withColumn("__name", F.when(hit(framed), F.exists(F.regexp_extract_all(now, F.lit(f"({framed})"), F.lit(1)), lambda x: is_name(x, stop))).otherwise(F.lit(False)))
    shown = lambda x: F.when(is_name(x, stop), F.concat(F.regexp_extract(x, rf"^(.*?){L.NAME}$", 1), F.lit("[REDACTED_NAME]")))
    out = out.withColumn(column, F.when(F.col("__name"), spliced(now, framed, shown)).otherwise(now))
    hits = ("__order", "__card", "__email", "__phone", "__pin", "__name")
    tags = F.array_compact(F.array(*(F.when(F.col(h), n) for h, n in zip(hits, L.ENTITIES, strict=True))))
    return out.withColumn(entities, F.when(now.isNull(), F.array().cast("array<string>")).otherwise(tags)).drop(*hits, "__digit", "__at")
