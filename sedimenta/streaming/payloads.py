"""Payload reports on streams. Every report is row-local, so it runs unchanged on readStream; clusters keep state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimenta.operators import fingerprints, threats
from sedimenta.operators.rowwise import per_payload
from sedimenta.session import ship

SCHEMA = "source string, payload_id long, payload string"


def payload_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New JSON-lines files of payloads, as they arrive."""
    ship(spark)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def report_stream(payloads: DataFrame, report: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """A report of every payload, appended as Parquet exactly once."""
    return report(payloads).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def threat_counts(events: DataFrame, time_col: str = "ts", late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Payloads by window of event time and severity; what is later than the watermark is left out."""
    rules = threats.matched_rules(F.col("payload"))
    risk = F.least(F.lit(100), F.aggregate(rules, F.lit(0), lambda s, r: s + r["weight"]))
    rows = events.where("payload is not null").withWatermark(time_col, late).select(F.col(time_col).alias("ts"), threats.severity(risk).alias("severity"))
    return rows.groupBy(F.window("ts", every), "severity").agg(F.count(F.lit(1)).alias("payloads"))


def cluster_stream(payloads: DataFrame, folder: str, checkpoint: str, threshold: float = 0.85) -> StreamingQuery:
    """Leader clusters kept over batches: each batch is clustered after the leaders of the earlier ones.

    The leaders (hash and first id) are a table in folder, rewritten whole under a new name by each batch, so a batch that is
    run again after a failure starts from the same leaders. Batches are in order of payload_id within themselves.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        prints = per_payload(batch.where("payload is not null and payload_id is not null"), fingerprints.hex_aware(F.col("payload")), "bits long", lambda r: (fingerprints.signed(fingerprints.simhash_of(r)),))
        new = prints.select(F.lit(number + 1).alias("batch"), "payload_id", "bits")
        if number:
            new = new.unionByName(spark.read.parquet(f"{folder}/leaders-{number - 1}"))
        new.write.mode("overwrite").parquet(f"{folder}/input-{number}")
        rows = spark.read.parquet(f"{folder}/input-{number}")
        placed = fingerprints.cluster_prints(rows.select((F.col("batch") * 10**14 + F.col("payload_id")).alias("idx"), "bits"), threshold=threshold)
        placed.where(F.col("idx") >= (number + 1) * 10**14).select((F.col("idx") % 10**14).alias("payload_id"), (F.col("leader") % 10**14).alias("leader_id")).write.mode("overwrite").parquet(f"{folder}/clusters/batch={number}")
        led = placed.where("idx = leader").select("idx")
        rows.withColumn("idx", F.col("batch") * 10**14 + F.col("payload_id")).join(led, "idx", "left_semi").select("batch", "payload_id", "bits").write.mode("overwrite").parquet(f"{folder}/leaders-{number}")

    return payloads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
