"""Files of the sinks as they lie on disk, versions under retries, and streams against batch."""

import glob

from pyspark.sql import functions as F

from quillon.sinks import tables
from quillon.streaming import alerts


def test_csv_has_a_mark_quotes_and_line_ends(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "y", z'), ("b", ""), ("c", "two\nlines")], "Section string, Value string").coalesce(1)
    tables.to_csv(rows, str(tmp_path / "out"))
    raw = open(glob.glob(f"{tmp_path}/out/part-*.csv")[0], "rb").read()
    assert raw == "﻿Section,Value\r\na,\"x \"\"y\"\", z\"\r\nb,\r\nc,\"two\r\nlines\"\r\n".encode()


def test_versions_count_on_and_fail_on_a_taken_number(spark, tmp_path):
    rows = spark.range(3)
    path = str(tmp_path / "t")
    assert [tables.append_version(rows, path) for _ in range(3)] == [1, 2, 3]
    (tmp_path / "t" / "version=4").mkdir()  # a writer that has begun and not ended
    (tmp_path / "t" / "version=4" / "part-0").touch()
    assert tables.append_version(rows, path) == 5 and tables.versions(spark, path) == [1, 2, 3, 5]
    assert tables.read_version(spark, path).count() == 3 and tables.read_version(spark, str(tmp_path / "none")) is None


def test_upserts_keep_the_last_of_a_key_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "u")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    tables.upsert(frame([("a", 1), ("b", 2), (None, 3)]), path, ["k"], "v")
    tables.upsert(frame([("a", 5), ("a", 4), (None, 9), ("c", 7)]), path, ["k"], "v")
    assert {(r.k, r.v) for r in tables.read_version(spark, path).collect()} == {("a", 5), ("b", 2), (None, 9), ("c", 7)}


def _run(spark, stream, name, mode):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    return spark.table(name)


def test_streams_give_what_batch_gives(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = _run(spark, alerts.sightings(stream.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts"), "sightings", "complete")
    want = events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).count()
    assert {(r.event_type, r.start, r.frequency) for r in got.collect()} == {(r.event_type, r.w.start, r["count"]) for r in want.collect()}
