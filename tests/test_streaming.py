from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import ingest


def test_stream_is_cleaned_counted_and_compared(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(days=d, minutes=i), f"A text number {d} {i}.", "xyz"[0 if d == 2 and i % 2 else i % 3]) for d in range(4) for i in range(60)]
    rows += [(rows[0][0] + timedelta(seconds=1), rows[0][1], "x"), (start, "nan", "x"), (start, "aaaaaaaaaa", "y"), (start + timedelta(days=9), "The last text.", "x")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, t string, theme string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    clean = ingest.clean(ingest.read_stream(spark, src, schema), "t", "ts")
    counts = ingest.windowed(clean, "ts", "theme")
    q = counts.writeStream.outputMode("append").foreachBatch(ingest.drift_sink(out, "theme")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    now = spark.read.parquet(f"{out}/counts")
    assert {r.day: r.n for r in now.groupBy(F.dayofmonth(F.col("cohort").cast("timestamp")).alias("day")).agg(F.max("n").alias("m"), F.sum("n").alias("n")).collect()}[1] == 60
    drift = {r.cohort[:10]: r.status for r in ingest.read_drift(spark, out).collect()}
    assert drift["2024-01-02"] == "STABLE" and drift["2024-01-03"] in ("MODERATE_DRIFT", "CRITICAL_DRIFT") and "2024-01-01" not in drift


def test_a_late_batch_moves_its_cohort_and_the_next_only(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = ingest.drift_sink(out, "theme")
    rows = lambda *own: spark.createDataFrame([(c, t, n) for c, t, n in own], "cohort string, theme string, n long")
    sink(rows(("1", "x", 50), ("1", "y", 50), ("2", "x", 50), ("2", "y", 50), ("3", "x", 50), ("3", "y", 50), ("4", "x", 50), ("4", "y", 50)), 0)
    before = {r.cohort: r.psi for r in ingest.read_drift(spark, out).collect()}
    assert before == {"2": 0.0, "3": 0.0, "4": 0.0}
    sink(rows(("2", "x", 500)), 1)
    sink(rows(), 2)
    after = {r.cohort: r.psi for r in ingest.read_drift(spark, out).collect()}
    assert after["2"] > 0.5 and after["3"] > 0.5 and after["4"] == 0.0
    whole = {r.cohort: r.psi for r in ingest.drift_of(spark.read.parquet(f"{out}/counts").withColumn("cohort", F.col("cohort").cast("string")).groupBy("cohort", "theme").agg(F.max("n").alias("n")), "theme").collect()}
    assert whole == after
