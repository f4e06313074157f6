"""Files as a source: their kinds by name, and only those whose content was not loaded before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.sinks import keyed

#: A file above this size is not read into a row.
MOST_BYTES = 256 << 20


def files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, pattern: str = "*") -> DataFrame:
    """(path, name, modified, size, kind, content, content_hash) of the files below a folder, kinds by their names.

    Content of a file above ``most_bytes`` is null, and so is its hash: it is listed and left to a reader of streams. Empty files hold
    nothing and are not listed. The size and time filters reach the listing, so large files are not opened.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    small = found.where(F.col("length") <= most_bytes)
    large = found.where(F.col("length") > most_bytes).select("path", "modificationTime", "length").withColumn("content", F.lit(None).cast("binary"))
    both = small.unionByName(large)
    name = F.element_at(F.split("path", "/"), -1)
    return both.select("path", name.alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), tx.file_type(F.lit(""), name).alias("kind"), "content", F.sha2("content", 256).alias("content_hash"))


def load_new(found: DataFrame, path: str, buckets: int = keyed.BUCKETS) -> DataFrame:
    """Files whose content is not among the hashes stored below ``path``; of several with equal content the first by path.

    Only the buckets of the hashes at hand are read. ``remember`` stores them once what was loaded is safe.
    """
    spark = found.sparkSession
    first = found.where("content_hash is not null").groupBy("content_hash").agg(F.min("path").alias("path"))
    new = found.join(first, ["content_hash", "path"], "left_semi")
    seen = keyed.read(spark, path, ["content_hash"], first, buckets)
    return new if seen is None else new.join(seen, "content_hash", "left_anti")


def remember(loaded: DataFrame, path: str, buckets: int = keyed.BUCKETS) -> int:
    """Store the hashes of loaded files, so that later loads leave them out."""
    return keyed.replace(loaded.select("content_hash", "path", "modified"), path, ["content_hash"], buckets)
