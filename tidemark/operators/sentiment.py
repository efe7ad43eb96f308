"""A sentiment model: TF-IDF, class-weighted logistic regression, probabilities calibrated by a sigmoid."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight n / (classes * n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(counts.crossJoin(total)), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def split(rows: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with held_out for about a share of them, by a hash of the key: within each label as well, and without a sort."""
    return rows.withColumn("held_out", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)


def fit(rows: DataFrame, text: str, label: str, features: int = 1 << 16, reg: float = 1e-3) -> PipelineModel:
    stages = [
        StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}\p{N}]+"), NGram(n=2, inputCol="__w", outputCol="__b"),
        SQLTransformer(statement="SELECT *, concat(__w, __b) AS __t FROM __THIS__"),
        HashingTF(inputCol="__t", outputCol="__f", numFeatures=features), IDF(inputCol="__f", outputCol="__x", minDocFreq=1),
        LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="weight", regParam=reg, standardization=False, probabilityCol="__p", predictionCol="__g", rawPredictionCol="__r"),
    ]
    return Pipeline(stages=stages).fit(class_weights(rows, label))


def predict(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """rows with prediction and the probability of each label."""
    labels = model.stages[0].labels
    out = rows
    for stage in model.stages[1:]:
        out = stage.transform(out)
    p = vector_to_array("__p")
    best = F.element_at(F.array(*map(F.lit, labels)), F.array_position(p, F.array_max(p)).cast("int"))
    return out.select(*rows.columns, best.alias("prediction"), F.map_from_arrays(F.array(*map(F.lit, labels)), p).alias("probabilities"))


def platt(scored: DataFrame, p: str, truth: str, steps: int = 25) -> tuple[float, float]:
    """(a, b) of the sigmoid 1 / (1 + exp(a s + b)) over log odds s, by Newton's method, one aggregate for each step."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    rows = scored.select(F.ln(q / (1 - q)).alias("s"), F.col(truth).cast("double").alias("y")).persist()
    a, b = -1.0, 0.0
    for _ in range(steps):
        g = 1 / (1 + F.exp(a * F.col("s") + b))
        d, w = g - F.col("y"), g * (1 - g)
        r = rows.agg(F.sum(-d * F.col("s")).alias("ga"), F.sum(-d).alias("gb"), F.sum(w * F.col("s") ** 2).alias("haa"), F.sum(w * F.col("s")).alias("hab"), F.sum(w).alias("hbb")).first()
        if not r or r.hbb is None:
            break
        haa, hbb = r.haa + 1e-6, r.hbb + 1e-6
        det = haa * hbb - r.hab * r.hab
        da, db = (r.ga * hbb - r.gb * r.hab) / det, (r.gb * haa - r.ga * r.hab) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    rows.unpersist()
    return a, b
