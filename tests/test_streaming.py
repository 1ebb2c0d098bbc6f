"""The streaming extension drains a folder of event files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessella.streaming.events import read_events, windowed_counts


def test_windowed_counts(spark: SparkSession, tmp_path: object) -> None:
    rows = [(k, f"2024-01-01 0{k % 3}:10:00", k % 2, "ab"[k % 2], 1.0) for k in range(12)]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "CAST(t AS TIMESTAMP) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/in")
    q = windowed_counts(read_events(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 12
