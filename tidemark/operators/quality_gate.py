"""Schema mapping, rating and date normalisation, quarantine, validation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions.text import strip

DEFAULTS = {"product_name": "Custom Product", "sku_or_module": "General", "batch_or_version": "Batch-Custom", "channel": "Client Upload"}


def clean_name(name: str) -> str:
    return re.sub(r"\W", "", re.sub(r"[\s\-_.]+", "_", name.strip().lower()))


def map_columns(columns: Sequence[str]) -> dict[str, tuple[str, float]]:
    """target -> (column, confidence): exact 1.0, prefix or suffix 0.85, substring 0.70; candidates in order, each column once."""
    used: set[str] = set()
    out: dict[str, tuple[str, float]] = {}
    tests = ((1.0, lambda c, k: c == k), (0.85, lambda c, k: c.startswith(k + "_") or c.endswith("_" + k)), (0.70, lambda c, k: k in c))
    for target, names in L.CANDIDATES.items():
        shut = L.TEXT_EXCLUSIONS if target == "review_text" else ()
        free = [c for c in columns if not any(re.search(x, clean_name(c)) for x in shut)]
        hit = next(((c, score) for score, test in tests for k in names for c in free if c not in used and test(clean_name(c), k)), None)
        if hit:
            out[target] = hit
            used.add(hit[0])
    if "review_text" not in out:
        raise ValueError("no column looks like review text")
    return out


def star_value(raw: Column) -> Column:
    """A rating out of a string: counted star glyphs, else a / b or a out of b as a share of 5, else the first number."""
    s = strip(raw.cast("string"))
    stars = F.length(s) - F.length(F.translate(s, "★⭐", ""))
    pair = r"(?i)(\d+(?:\.\d+)?)\s*(?:/|out\s+of)\s*(\d+(?:\.\d+)?)"
    part, of = (F.regexp_extract(s, pair, i).try_cast("double") for i in (1, 2))
    number = F.regexp_extract(s, r"\b(\d+(?:\.\d+)?)\b", 1).try_cast("double")
    return F.when(stars > 0, stars.cast("double")).when(s.rlike(pair) & (of > 0), part / of * 5).otherwise(number)


def normalize_ratings(df: DataFrame, column: str) -> DataFrame:
    """df with rating (1 to 5) from column, on the scale that its 99th percentile shows; what can't be read is 3."""
    valued = df.withColumn("__v", star_value(F.col(column)))
    scale = valued.agg(F.percentile("__v", 0.99).alias("__top"))
    v, top = F.col("__v"), F.col("__top")
    even = F.when(top > 10, 1 + v / 100 * 4).when(top > 5, 1 + (v - 1) / 9 * 4).otherwise(v)
    rating = F.when(v.isNull(), 3).otherwise(F.bround(F.least(F.greatest(even, F.lit(1.0)), F.lit(5.0))).cast("int"))
    return valued.crossJoin(F.broadcast(scale)).withColumn("rating", rating).drop("__v", "__top")


def timestamp_of(raw: Column, as_of: Column) -> tuple[Column, Column]:
    """(timestamp, whether it was readable); as_of where it wasn't."""
    s = F.trim(raw.cast("string"))
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy/MM/dd")
    found = F.coalesce(s.try_cast("timestamp"), *(F.try_to_timestamp(s, F.lit(f)) for f in formats))
    return F.coalesce(found, as_of), found.isNotNull()


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts), F.lit("-Q"), F.quarter(ts))


def weak_label(rating: Column) -> Column:
    return F.when(rating <= 2, "NEGATIVE").when(rating == 3, "NEUTRAL").when(rating >= 4, "POSITIVE")


def review_id(text: Column, stamp: Column, index: Column) -> Column:
    return F.concat(F.lit("REV-U-"), F.upper(F.substring(F.sha2(F.concat_ws("_", text, stamp, index.cast("string")), 256), 1, 12)))


def normalize(df: DataFrame, index: str = "row_index", as_of: str | None = None, stamp: str = "static_ts") -> DataFrame:
    """The ten canonical columns of a frame of any schema, with what wasn't mapped in extra_metadata. df must hold a row index.

    An unreadable date becomes as_of, by default now; mapping_figures tells how many are readable.
    """
    found = {t: c for t, (c, _) in map_columns([c for c in df.columns if c != index]).items()}
    rest = [c for c in df.columns if c not in found.values() and c != index]
    rated = normalize_ratings(df, found["rating"]) if "rating" in found else df.withColumn("rating", F.lit(3))
    raw = F.col(found["created_at"]) if "created_at" in found else F.lit(None).cast("string")
    at, _ = timestamp_of(raw, F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp())
    text = strip(F.col(found["review_text"]).cast("string"))
    pick = lambda t: F.coalesce(F.nullif(F.trim(F.col(found[t]).cast("string")), F.lit("")), F.lit(DEFAULTS[t])) if t in found else F.lit(DEFAULTS[t])
    extra = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("string") for c in rest))), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    created = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return rated.select(review_id(text, F.coalesce(raw.cast("string"), F.lit(stamp)), F.col(index)).alias("review_id"), text.alias("review_text"), F.col("rating"), *(pick(t).alias(t) for t in DEFAULTS), created.alias("created_at"), extra.alias("extra_metadata"), F.col(index).alias("row_index"))


def normal(text: Column) -> Column:
    """A text in lower case without white space at its ends, empty for null: what the gate's rules look at."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def spam(s: Column) -> Column:
    """Whether one character is three quarters of a normal text of at least 8.

    Such a character stands twice in a row somewhere, and three times in texts of more than 8, so only those that do are counted.
    """
    n = F.length(s)
    runs = lambda more: F.array_distinct(F.regexp_extract_all(s, F.lit(rf"(?s)(.)\1{more}"), F.lit(1)))
    most = F.array_max(F.transform(F.when(n == 8, runs("")).otherwise(runs(r"\1")), lambda c: n - F.length(F.replace(s, c, F.lit("")))))
    # most texts have no such run
    return F.when(s.rlike(r"(?s)(.)\1"), (n >= 8) & F.coalesce(most / n >= 0.75, F.lit(False))).otherwise(F.lit(False))


def rejection(s: Column) -> Column:
    """The first reason that a normal text is rejected for by itself, else null."""
    letters = F.length(F.trim(F.regexp_replace(s, r"(?U)[^\w\s]", "")))
    # six letters or digits are enough, and most texts begin with them
    few = F.when(s.rlike(r"(?U)(?:\w\W*+){6}"), F.lit(False)).otherwise(letters < 6)
    return F.when((s == "") | s.isin(*L.SENTINELS), "EMPTY_TEXT").when(spam(s), "REPETITIVE_CHARACTER_SPAM").when(few | s.isin(*L.FILLERS), "DEGENERATE_SHORT_TEXT")


def gate(df: DataFrame, text: str = "review_text", index: str = "row_index", most: int = 4000) -> DataFrame:
    """df with rejection_code (null: clean) and truncated; of equal texts among the otherwise clean rows the first by index is kept."""
    own = df.withColumn("__s", normal(F.col(text))).withColumn("__code", rejection(F.col("__s"))).withColumn("__key", F.md5(F.regexp_replace("__s", r"(?U)\s{2,}|[\s&&[^ ]]", " ").cast("binary")))
    # only texts that repeat are joined back, each with its first index, however many rows have it
    again = own.filter("__code is null").groupBy("__key").agg(F.min(index).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    code = F.coalesce("__code", F.when(F.col("__first") < F.col(index), "DUPLICATE_TEXT"))
    long = F.length(text) > most
    out = own.join(again, "__key", "left").withColumns({"rejection_code": code, "truncated": F.coalesce(long, F.lit(False))})
    return out.withColumn(text, F.substring(text, 1, most)).select(*df.columns, "rejection_code", "truncated")


def manifest(gated: DataFrame, warnings: Column | None = None) -> DataFrame:
    """One row: rows in, passed, quarantined and duplicate, and the quality score. warnings: a count per row, of clean rows."""
    bad, warn = F.col("rejection_code").isNotNull(), F.col("truncated").cast("int") if warnings is None else warnings
    n = F.count("*")
    out = gated.agg(n.alias("total"), F.count_if(~bad).alias("passed"), F.count_if(bad).alias("quarantined"), F.count_if(F.col("rejection_code") == "DUPLICATE_TEXT").alias("duplicates"), F.coalesce(F.sum(F.when(~bad, warn)), F.lit(0)).alias("warnings"))
    all_ = F.greatest("total", F.lit(1))
    score = 100 * (1 - (0.5 * F.col("quarantined") / all_ + 0.3 * F.col("duplicates") / all_ + 0.2 * F.col("warnings") / all_))
    return out.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2))


def validation(df: DataFrame, text: str, rating: str | None = None, date: str | None = None, label: str | None = None, short: int = 0) -> DataFrame:
    """(check, level, n_affected) of a corpus; a rating outside 1 to 5, or that isn't a number, is a warning.

    Rows that repeat a text count once less than there are of it, so it doesn't matter which of them is the first.
    """
    t = strip(F.coalesce(F.col(text), F.lit("")))
    checks: dict[str, tuple[str, Column]] = {"blank_text": ("ERROR", t == "")}
    if short:
        checks["short_text"] = ("WARNING", (t != "") & (F.length(t) < short))
    if rating:
        r = F.col(rating).cast("string").try_cast("double")
        checks["rating_range"] = ("WARNING", F.coalesce((r < 1) | (r > 5), F.lit(True)))
    if date:
        checks["unreadable_date"] = ("WARNING", F.col(date).cast("string").try_cast("timestamp").isNull())
    if label:
        checks["unknown_label"] = ("WARNING", ~F.coalesce(F.col(label), F.lit("")).isin("NEGATIVE", "NEUTRAL", "POSITIVE"))
    one = df.agg(*(F.count_if(c).alias(k) for k, (_, c) in checks.items()))
    again = df.filter(t != "").groupBy(F.sha2(F.lower(t), 256).alias("__k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_text"))
    levels = {k: level for k, (level, _) in checks.items()} | {"duplicate_text": "WARNING"}
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.lit(level).alias("level"), F.col(k).alias("n_affected")) for k, level in levels.items()))
    return one.crossJoin(F.broadcast(again)).select(F.inline(rows))


def repaired(df: DataFrame, text: str, rating: str | None = None, date: str | None = None, most: int = 4000, oldest: int = 2000, as_of: Column | None = None) -> DataFrame:
    """df with too long texts cut, ratings rounded to 1 to 5 (unreadable: 3), dates before oldest or beyond the year after as_of
    (default: now) replaced by it, and warnings, how many of these a row has."""
    now = F.current_timestamp() if as_of is None else as_of
    long = F.length(text) > most
    out, warnings = {text: F.substring(text, 1, most)}, [F.coalesce(long, F.lit(False))]
    if rating:
        r = F.col(rating).cast("string").try_cast("double")
        even = F.least(F.greatest(F.bround(r), F.lit(1.0)), F.lit(5.0)).cast("int")
        out[rating] = F.when(r.isNull() | F.isnan(r), 3).otherwise(even)
        warnings.append(~F.coalesce(r == even, F.lit(False)) | F.coalesce(F.isnan(r), F.lit(False)))
    if date:
        d = F.col(date).cast("timestamp")
        odd = F.coalesce((F.year(d) < oldest) | (F.year(d) > F.year(now) + 1), F.lit(True))
        out[date] = F.when(odd, now).otherwise(d)
        warnings.append(odd)
    total = sum((w.cast("int") for w in warnings[1:]), warnings[0].cast("int"))
    return df.withColumns({**out, "warnings": total})


def mapping_report(df: DataFrame, index: str = "row_index") -> DataFrame:
    """(target, column, confidence) of each canonical column that was found, and (null, column, null) of those that weren't used."""
    found = map_columns([c for c in df.columns if c != index])
    rest = [c for c in df.columns if c != index and c not in {c for c, _ in found.values()}]
    rows = [(t, c, score) for t, (c, score) in found.items()] + [(None, c, None) for c in rest]
    return df.sparkSession.createDataFrame(rows, "target string, column string, confidence double")


def mapping_figures(df: DataFrame, index: str = "row_index") -> DataFrame:
    """One row: how many rows, the rating scale that the 99th percentile shows, the share of readable dates."""
    found = {t: c for t, (c, _) in map_columns([c for c in df.columns if c != index]).items()}
    top = F.percentile(star_value(F.col(found["rating"])), 0.99) if "rating" in found else F.lit(None).cast("double")
    readable = F.avg(timestamp_of(F.col(found["created_at"]), F.current_timestamp())[1].cast("int")) if "created_at" in found else F.lit(0.0)
    out = df.agg(F.count("*").alias("total_rows"), top.alias("top"), F.round(readable, 4).alias("date_success_rate"))
    scale = F.when(F.col("top") > 10, "0-100").when(F.col("top") > 5, "1-10").when(F.col("top").isNotNull(), "1-5")
    return out.select("total_rows", scale.alias("rating_scale"), "date_success_rate")


def preview(normalized: DataFrame, n: int = 3) -> DataFrame:
    """The first rows of a normalised frame."""
    return normalized.orderBy("row_index").limit(n)


def public_view(df: DataFrame, allowed: Sequence[str], raw: str, redacted: str, unmask: bool) -> DataFrame:
    """Only allowed columns and display_text; never the raw text unless unmasked for a role that may see it."""
    return df.select(*(c for c in df.columns if c in allowed and c != raw), F.col(raw if unmask else redacted).alias("display_text"))
