"""Results of costly calls, kept by the content of what was asked; calls over a table with failures as rows; their accounts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.runtime import Scratch

RESULT = "key string, value string, error string"


def request_key(*columns: str) -> Column:
    """SHA-256 of the columns as JSON by name, so that the order in which they are given doesn't matter; nulls count."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def called(items: DataFrame, fn: Callable[[dict], Any], *, concurrency: int | None = None, tolerate: bool = True) -> DataFrame:
    """(key, value, error) of items(key, ...): the function's answer as JSON, or what it raised.

    So many calls run at once as there are partitions. Without ``tolerate`` the first failure ends the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                key = row.pop("key")
                try:
                    out.append((key, json.dumps(fn(row), sort_keys=True, default=str, ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001
                    if not tolerate:
                        raise
                    out.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["key", "value", "error"])

    return (items.repartition(concurrency, "key") if concurrency else items).mapInPandas(run, RESULT)


class ResultCache:
    """A folder of results by key. Failures are not kept, so the next run asks again; a run that was cut short goes on where it ended."""

    def __init__(self, spark: SparkSession, path: str, *, enabled: bool = True):
        self.spark, self.path, self.enabled = spark, path, enabled
        self.usage = {"calls": 0, "hits": 0, "failures": 0}

    def known(self) -> DataFrame:
        """(key, value), each key once."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not self.enabled or not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], "key string, value string")
        return self.spark.read.schema("key string, value string").parquet(self.path).groupBy("key").agg(F.min("value").alias("value"))

    def get_or_call(self, items: DataFrame, fn: Callable[[dict], Any], *, columns: list[str], concurrency: int | None = None) -> DataFrame:
        """items with value (JSON) and error. Equal requests are asked once, known ones not at all."""
        keyed = items.withColumn("key", request_key(*columns))
        asked = keyed.select("key", *columns).dropDuplicates(["key"])
        known = self.known()
        new = Scratch(self.spark, "calls").keep(called(asked.join(known, "key", "left_anti"), fn, concurrency=concurrency))
        count = new.agg(F.count("*").alias("calls"), F.count("error").alias("failures")).first()
        self.usage["calls"] += count.calls
        self.usage["failures"] += count.failures
        self.usage["hits"] += asked.join(known, "key", "left_semi").count()
        answers = known.withColumn("error", F.lit(None).cast("string")).unionByName(new)
        out = keyed.join(answers, "key", "left").drop("key")
        if self.enabled:
            out = Scratch(self.spark, "answers").keep(out)
            new.where("error is null").select("key", "value").write.mode("append").parquet(self.path)
        return out
