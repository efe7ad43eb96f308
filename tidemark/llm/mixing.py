"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

The tokens of a corpus are counted per cell of source, language and topic. Each sweep scales the cells' weights to the
target share of every value of every dimension in turn; this converges to the weights that have all the target marginals
and are otherwise proportional to the corpus. A document of a cell is kept with probability weight / tokens of its cell,
scaled so that the highest is 1: so the kept tokens follow the targets as nearly as documents without copies allow. The
choice hashes the id, so it is the same on every run and machine.

Only the cells are raked. They are few (one task sweeps them, after a count that bounds them by ONE_TASK); where they
are not, the same sweeps run over hash-partitioned cells.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

ONE_TASK = 50_000
#: Topics by what their texts hold, the first that fits; patterns are common to Java and RE2.
TOPICS = (("license", "(?i)licen[sc]e|copyright"), ("contact", "@[A-Za-z0-9-]+[.]"), ("symbols", "[#$%&*]{3}|!!"))
WORD = r"[^\x20\x09-\x0D]+"
DIMS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def shares(cells: DataFrame, dim: str, targets: Mapping[str, float] | None, heat: float) -> Column:
    """The target share of the value of dim in each row of cells; values that aren't named have none."""
    own = W.partitionBy(dim)
    if targets is None:
        weight = F.pow(F.sum("tokens").over(own), F.lit(heat))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in targets.items() for x in (k, float(v)))), F.col(dim)), F.lit(0.0))
    return F.when(F.sum("tokens").over(own) > 0, weight).otherwise(0.0)


def rake(cells: DataFrame, scratch: Scratch, targets: Mapping[str, Mapping[str, float]], dims: tuple[str, ...] = DIMS, heat: float = 0.9, sweeps: int = 24, close: float = 1e-12) -> DataFrame:
    """cells (dims, tokens) with weight, of sum 1: the raked share of each cell.

    A dimension without targets gets its natural shares to the power heat. It ends after so many sweeps, or when one
    changes no weight by more than close.
    """
    few = cells.count() <= ONE_TASK
    cells = cells.coalesce(1) if few else cells
    for d in dims:
        cells = cells.withColumn(f"raw_{d}", shares(cells, d, targets.get(d), heat))
        cells = cells.withColumn(f"n_{d}", F.row_number().over(W.partitionBy(d).orderBy(*dims)))
    # one row of totals, whatever the number of cells
    sums = cells.agg(F.sum("tokens").alias("all"), *(F.sum(F.when(F.col(f"n_{d}") == 1, F.col(f"raw_{d}"))).alias(f"sum_{d}") for d in dims))
    total = {f"goal_{d}": F.col(f"raw_{d}") / F.nullif(F.col(f"sum_{d}"), F.lit(0)) for d in dims}
    begun = cells.crossJoin(F.broadcast(sums)).withColumns({**total, "weight": F.coalesce(F.col("tokens") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0))})
    now = scratch.save(begun.select(*dims, "tokens", *total, "weight").withColumn("moved", F.lit(1.0)), "cells")
    for _ in range(0, sweeps, 3):
        step = now.coalesce(1) if few else now
        for n in range(3):
            step = step.withColumn("old", F.col("weight")) if n == 2 else step
            for d in dims:
                have = F.sum("weight").over(W.partitionBy(d))
                step = step.withColumn("weight", F.when(have > 0, F.col("weight") * F.coalesce(F.col(f"goal_{d}"), F.lit(0.0)) / have).otherwise(0.0))
        new = scratch.save(step.withColumn("moved", F.abs(F.col("weight") - F.col("old"))).drop("old"), "cells")
        scratch.drop(now)
        now = new
        if (now.agg(F.max("moved")).first()[0] or 0) <= close:
            break
    return now.select(*dims, "tokens", "weight")


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", heat: float = 0.9, seed: str = "mix", topic_col: str | None = None) -> DataFrame:
    """docs with topic, n_tokens, rate (the probability of a document, rounded to 9 digits) and sampled beside them.

    targets: weights of values of "source", "lang" and "topic"; values without weight are never sampled. topic_col: where a
    corpus has topics of its own, their column; without one they are told by TOPICS. A null source or
    language is the value "". A null or empty text has no tokens and the rate of its cell, which is 0 if the cell has no
    tokens. Rows of one id are sampled together; a null id hashes as "". Of docs, extra columns are kept and columns
    named like the new ones are replaced. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col(text_col)
    named = {"__source": F.coalesce(F.col(source_col), F.lit("")), "__lang": F.coalesce(F.col(lang_col), F.lit("")), "__topic": F.coalesce(F.col(topic_col).cast("string"), F.lit("")) if topic_col else topic_of(F.coalesce(text, F.lit("")))}
    n_tokens = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    cells = docs.select(named["__source"].alias("source"), named["__lang"].alias("lang"), named["__topic"].alias("topic"), n_tokens.alias("n")).groupBy(*DIMS).agg(F.sum("n").alias("tokens"))
    counts = scratch.save(cells, "counts")
    raked = rake(counts, scratch, targets or {}, heat=heat)
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    rates = scratch.save(raked.select(*(F.col(d).alias(f"__{d}") for d in DIMS), factor.alias("factor")), "factors")
    scratch.drop(*(x for x, _ in list(scratch.paths.values()) if x is not rates))
    top = rates.agg(F.max("factor")).first()[0] or 1.0
    rates = rates.select(*(f"__{d}" for d in DIMS), F.round(F.col("factor") / F.lit(top), 9).alias("__rate"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    out = docs.withColumns({**named, "__n": n_tokens}).join(rates, [f"__{d}" for d in DIMS])
    new = {"topic": F.col("__topic"), "n_tokens": F.col("__n"), "rate": F.col("__rate"), "sampled": drawn < F.col("__rate")}
    return out.withColumns(new).select(*(c for c in docs.columns if c not in new), *new)


def mix_sql(heat: float = 0.9, seed: str = "mix", sweeps: int = 24) -> str:
    """mix over documents, without targets, in DuckDB's SQL."""
    cases = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{name}'" for name, p in TOPICS)
    steps, last = [], "c0"
    for i in range(sweeps):
        for d in DIMS:
            new = f"{d[0]}{i + 1}"
            steps.append(f"{new} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * goal_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {last})")
            last = new
    goals = ", ".join(f"m_{d}.raw / m_{d}.total AS goal_{d}" for d in DIMS)
    marginals = ", ".join(f"m_{d} AS (SELECT {d}, raw, sum(raw) OVER () AS total FROM (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {heat}) ELSE 0 END AS raw FROM cells GROUP BY {d}))" for d in DIMS)
    joins = " ".join(f"JOIN m_{d} USING ({d})" for d in DIMS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {cases} ELSE 'prose' END AS topic,
                  coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
{marginals},
c0 AS MATERIALIZED (SELECT cells.*, tokens / sum(tokens) OVER () AS w, {goals} FROM cells {joins}),
{", ".join(steps)},
f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS factor FROM {last}),
r AS (SELECT source, lang, topic, round(factor / max(factor) OVER (), 9) AS rate FROM f)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, rate,
       CAST('0x' || substr(md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13) AS BIGINT) / {float(16**13)} < rate AS sampled
FROM d JOIN r USING (source, lang, topic)"""
