"""Streams of new mentions against a registry of facts whose ids stay stable, and running counts of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tracemill.functions import text as T
from tracemill.operators import matching, pipeline


def register_batch(new: DataFrame, registry: DataFrame, *, threshold: float | None = 0.70) -> tuple[DataFrame, DataFrame]:
    """(links, fresh): every new mention with its fact_id, and the facts that were not registered yet.

    A mention whose normalised text stands in the registry takes that fact. Of the others, those that a search among
    the registered texts at the threshold finds, and the rule of ``pipeline.identify`` calls the same, take the closest
    fact; without a threshold there is no search. What is left makes a fact from its text, so repeated runs give the
    same ids.
    """
    keyed = new.withColumn("made", T.make_fact_id(F.col("text")))
    known = registry.select(F.col("fact_id").alias("made")).distinct().withColumn("known", F.lit(True))
    links = matching.kept(keyed.join(known, "made", "left").select("mention_id", "text", "made", "known"), "links")
    near = links.sparkSession.createDataFrame([], "mention_id string, near string")
    if threshold is not None:
        said = pipeline.identify(matching.registry_pairs(links.where("known is null"), registry, threshold=threshold))
        near = matching.registry_links(said.withColumnRenamed("relation", "label")).withColumnRenamed("fact_id", "near")
    links = links.join(near, "mention_id", "left")
    fresh = links.where("known is null and near is null and made is not null").groupBy(F.col("made").alias("fact_id")).agg(F.min("text").alias("canonical_text"))
    return links.select("mention_id", F.coalesce("near", "made").alias("fact_id")), fresh


def run_registry(spark: SparkSession, mentions: DataFrame, registry_path: str, links_path: str, checkpoint: str, *, threshold: float | None = 0.70) -> StreamingQuery:
    """Each micro-batch is linked and its new facts appended, keyed by the batch id so that a replay overwrites itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        registry = spark.read.schema("fact_id string, canonical_text string, batch long").parquet(registry_path).where(F.col("batch") != batch_id)
        links, fresh = register_batch(batch.dropDuplicates(["mention_id"]), registry, threshold=threshold)
        links.write.mode("overwrite").parquet(f"{links_path}/batch={batch_id}")
        fresh.write.mode("overwrite").parquet(f"{registry_path}/batch={batch_id}")

    return mentions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def turn_counts(records: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Output records by execution and window of event time; rows later than the watermark are dropped."""
    return records.where("channel = 'output'").withWatermark(time, late).groupBy(F.window(time, window), "execution_id").agg(F.count("*").alias("turns"))
