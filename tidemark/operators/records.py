"""Records of reviews: their propositions, assembly, joins by position and time, splits without leaks, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.aggregates import page

RANK = {"P0": 4, "P1": 3, "P2": 2, "P3": 1}


def rank_of(tier: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), tier), F.lit(1))


def propositions(reviews: DataFrame, key: str, text: str) -> DataFrame:
    """(key, proposition_id, sentence_idx, text, char_start, char_end, intent, severity, marker) of each sentence."""
    s = reviews.select(key, F.posexplode(T.sentences(F.col(text))).alias("sentence_idx", "s"))
    told = s.withColumn("p", T.proposition_intent(F.col("s.text")))
    return told.select(key, F.format_string("%s::P%03d", F.col(key).cast("string"), "sentence_idx").alias("proposition_id"), "sentence_idx", F.col("s.text").alias("text"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), "p.intent", "p.severity", "p.marker")


def telemetry(reviews: DataFrame, key: str, text: str) -> DataFrame:
    """Per review how many propositions of each intent, the gravest severity of complaints and span, and the primary complaint.

    The primary complaint is all complaint sentences joined, else the span, else the text. In one pass: the sentences of a
    review are an array of its row.
    """
    s = F.transform(T.sentences(F.col(text)), lambda x: F.struct(x["text"].alias("text"), T.proposition_intent(x["text"]).alias("p")))
    own = reviews.withColumns({"__s": s, "__span": T.complaint_span(F.col(text))})
    of = lambda name: F.filter("__s", lambda x: x["p"]["intent"] == name)
    joined = F.array_join(F.transform(of("COMPLAINT"), lambda x: x["text"]), " ")
    ranks = F.transform(of("COMPLAINT"), lambda x: rank_of(x["p"]["severity"]))
    gravest = F.greatest(F.coalesce(F.array_max(ranks), F.lit(1)), F.when(F.col("__span.detected"), rank_of(F.col("__span.severity"))).otherwise(1))
    counts = {f"n_{x.lower()}": F.size(of(x)) for x in ("COMPLAINT", "RECOMMENDATION", "PRAISE", "NOISE")}
    primary = F.when(F.size(of("COMPLAINT")) > 0, joined).when(F.col("__span.detected"), F.col("__span.text")).otherwise(F.col(text))
    return own.select(key, *(c.alias(n) for n, c in counts.items()), F.concat(F.lit("P"), (4 - gravest).cast("string")).alias("overall_severity"), primary.alias("primary_complaint_text"))


def assembled(reviews: DataFrame, sentences: DataFrame, key: str, stages: list[DataFrame], rating: str = "rating", themes: DataFrame | None = None, cluster: str = "cluster_id") -> DataFrame:
    """reviews with the columns of each stage's table (by key), sku_or_module, a rating of 1 to 5 or null, theme_title and sentences.

    sentences are an array in order of sentence_idx, empty where a review has none; themes: (cluster, title), else "Cluster n".
    """
    lists = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sentence_idx", *[c for c in sentences.columns if c not in (key, "sentence_idx")]))).alias("sentences"))
    out = reviews
    for stage in stages:
        out = out.join(stage, key, "left")
    out = out.join(lists, key, "left").withColumn("sentences", F.coalesce("sentences", F.array().cast(lists.schema["sentences"].dataType)))
    if themes is not None:
        out = out.join(themes.select(cluster, F.col("title").alias("theme_title")), cluster, "left").withColumn("theme_title", F.coalesce("theme_title", F.concat(F.lit("Cluster "), F.col(cluster).cast("string"))))
    value = F.col(rating).cast("string").try_cast("double")
    return out.withColumns({"sku_or_module": F.concat_ws(" - ", "brand_name", "product_name"), rating: F.when(value.between(1, 5), value.cast("int"))})


def span_record(p: DataFrame) -> DataFrame:
    """Propositions as the older records of spans: offsets and confidence by severity."""
    return p.select("proposition_id", F.struct(F.lit(True).alias("detected"), "text", F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.col("marker").alias("trigger"), "severity").alias("span"))


def proposition_of(spans: DataFrame) -> DataFrame:
    """Back from the older records."""
    return spans.select("proposition_id", F.col("span.text").alias("text"), F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end"), F.col("span.trigger").alias("marker"), F.col("span.severity").alias("severity"))


def proposition_page(rows: DataFrame, number: int = 1, size: int = 100, intent: str | None = None, severity: str | None = None, actionable: bool | None = None, review: object = None, search: str | None = None) -> DataFrame:
    """A page of propositions that pass the filters, by review and sentence, with how many there are."""
    out = rows
    if intent:
        out = out.filter(F.col("label") == intent.upper())
    if severity:
        out = out.filter(F.col("severity") == severity.upper())
    if actionable is not None:
        out = out.filter(F.col("label").isin("COMPLAINT", "RECOMMENDATION", "PRAISE") == actionable)
    if review is not None:
        out = out.filter(F.col("review_id") == review)
    if search:
        out = out.filter(F.lower("sentence_text").contains(search.lower()))
    return page(out, ["review_id", "sentence_idx"], number, size)


def by_position(left: DataFrame, right: DataFrame, index: str, checked: tuple[str, str] | None = None, first: int = 100) -> DataFrame:
    """Rows of equal index side by side; an error if the tables have other numbers of rows, or texts of the first ones differ."""
    if (n := left.count()) != (m := right.count()):
        raise ValueError(f"{n} rows against {m}")
    both = left.join(right, index)
    if checked:
        a, b = checked
        if not both.filter((F.col(index) < first) & ~F.col(a).eqNullSafe(F.col(b))).isEmpty():
            raise ValueError(f"{a} and {b} differ among the first {first} rows")
    return both


def live_sessions(sessions: DataFrame, users: DataFrame, user: str, expires: str, now: Column) -> DataFrame:
    """Sessions that haven't expired, with their users."""
    return sessions.filter(F.col(expires) > now).join(users, user)


def cascaded(children: DataFrame, parents_left: DataFrame, key: str) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents_left.select(key).distinct(), key, "left_semi")


def leak_free_split(rows: DataFrame, text: str, groups: list[str], share: float = 0.2, seed: str = "42") -> DataFrame:
    """rows with split, train or val, by base text: per group at least one text and a share of its distinct ones are val.

    A text that is val in one group is val in all, so none is on both sides.
    """
    base = rows.withColumn("__base", F.trim(text))
    once = base.select(*groups, "__base").distinct().withColumn("__h", F.md5(F.concat(F.lit(seed), "__base").cast("binary")))
    w = W.partitionBy(*groups)
    ranked = once.withColumns({"__r": F.row_number().over(w.orderBy("__h", "__base")), "__n": F.count("*").over(w)})
    val = ranked.filter(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share))).select("__base").distinct().withColumn("__v", F.lit(True))
    return base.join(val, "__base", "left").withColumn("split", F.when(F.col("__v"), "val").otherwise("train")).drop("__base", "__v")


def harvested(sentences: DataFrame, text: str, wanted: str, unless: str | None = None, words: int = 4, chars: int = 16) -> DataFrame:
    """Sentences that match wanted and not unless, of at least so many words and characters, each text (in any case) once."""
    t = F.trim(text)
    hit = F.lower(t).rlike(wanted) & (F.size(F.split(t, r"\s+")) >= words) & (F.length(t) >= chars)
    out = sentences.filter(hit & ~F.lower(t).rlike(unless) if unless else hit)
    return out.withColumn("__k", F.lower(t)).dropDuplicates(["__k"]).drop("__k")


def sampled(rows: DataFrame, group: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each group, by a hash of their keys."""
    w = W.partitionBy(group).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def audit_list(*parts: DataFrame, keys: tuple[str, str] = ("review_id", "cluster_id")) -> DataFrame:
    """All parts together, each pair of keys once, from the first part that has it."""
    out = None
    for i, p in enumerate(parts):
        own = p.withColumn("__part", F.lit(i))
        out = own if out is None else out.unionByName(own)
    first = F.row_number().over(W.partitionBy(*keys).orderBy("__part", *[c for c in parts[0].columns if c not in keys]))
    return out.withColumn("__r", first).filter("__r = 1").drop("__r", "__part")


def column_differences(have: list[str], want: list[str]) -> tuple[list[str], list[str]]:
    """(columns that aren't wanted, wanted ones that are missing), in order."""
    return [c for c in have if c not in want], [c for c in want if c not in have]


def safe_number(x: Column) -> Column:
    """A finite double; 0 for null, NaN and infinities."""
    v = x.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(0.0)


def cell_list(x: Column) -> Column:
    """The parts of a cell between commas, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def run_summary(reviews: DataFrame, sentences: DataFrame) -> DataFrame:
    """(figure, value, n): reviews by sentiment and theme, sentences by label, and totals, in one union of small counts."""
    of = lambda df, c, name: df.groupBy(F.lit(name).alias("figure"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = lambda df, name: df.agg(F.lit(name).alias("figure"), F.lit("all").alias("value"), F.count("*").alias("n"))
    return of(reviews, "sentiment", "sentiment").unionByName(of(reviews, "batch", "batch")).unionByName(of(sentences, "label", "label")).unionByName(total(reviews, "reviews")).unionByName(total(sentences, "sentences"))
