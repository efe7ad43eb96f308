from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans import queries as q

TEXTS = ["The app crashes. I want a refund, it is useless.", "Please add a refill option.", "Plain words only.", "The screen broken, burning too.", "", None]


def test_intents_of_every_turn(spark, tmp_path):
    rows = [(c, turn, TEXTS[(c + turn) % len(TEXTS)]) for c in range(5) for turn in range(8)] + [(None, None, TEXTS[0])]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in q.t14_intents(spark, str(tmp_path)).collect()]
    expected = []
    for t in TEXTS:  # each text by itself
        own = spark.createDataFrame([(t,)], "t string").select(text.router_intent(F.col("t")).alias("r"), text.proposition_intent(F.col("t")).alias("p")).first()
        expected += [(c, turn, own.r.label, own.r.confidence, own.p.intent, own.p.severity, own.p.marker) for c, turn, x in rows if x == t]
    assert len(got) == len(rows) and sorted(got, key=repr) == sorted(expected, key=repr)
    assert len({r[2] for r in got}) > 1
