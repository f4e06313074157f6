"""Streams run over all that is there, each beside the SQL of its batch form; checkpoints and results lie in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import dates
from quillon.plans.registry import ORACLE, query
from quillon.session import shared_dir
from quillon.sources.domain import table
from quillon.streaming import stateful

c = F.col


def stream(spark, d, name: str) -> DataFrame:
    """A stored table as a stream of its files; the pattern lets a table be one file as well as a folder."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def run_out(rows: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream until it has no more input, and read what it has written; with ``update`` rows also the number of their batch."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure takes the place of its first attempt
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    started = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(rows.schema.add("batch", "integer")).parquet(f"{folder}/rows")


@query("al04_stream_levels", ORACLE["al04_new_levels"])
def al04_stream(spark, d):
    """Deadline alerts sent by a stream of checks that remembers each key's last level."""
    level = dates.submission_level(F.lit("2024-01-20").cast("timestamp"), c("ts").cast("timestamp"))
    checks = stream(spark, d, "events").select(c("user_id").alias("key"), c("event_id").alias("check_id"), c("ts").cast("timestamp").alias("at"), level.alias("level"))
    sent = run_out(stateful.new_levels(checks), "al04", "append")
    return sent.select(c("key").alias("user_id"), c("check_id").alias("event_id"), "level")


@query("a22_stream_registry", ORACLE["a22_learning_registry"])
def a22_stream(spark, d):
    """The learning registry kept by a stream of sightings: what is known of each parameter in the end, and whether it was ever promoted."""
    seen = stream(spark, d, "part").select(c("p_brand").alias("parameter"), c("p_type").alias("category"), c("p_name").alias("example"), c("p_partkey").alias("at"))
    rows = run_out(stateful.learned(seen), "a22", "update")
    last = F.max_by(F.struct("frequency", "categories", "examples"), "batch").alias("l")
    known = rows.groupBy("parameter").agg(last, F.max(c("event") == "promoted").alias("promoted"))
    return known.select("parameter", "l.frequency", "l.categories", "promoted", F.array_join("l.examples", "|").alias("examples"))
