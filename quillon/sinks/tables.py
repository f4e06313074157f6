"""Tables on plain folders: replace by key, upsert, versions, daily snapshots, incremental loads and exports.

``upsert`` and ``append_version`` write a new version beside the old ones; it is read at its highest complete version, so readers never
see half of a write and a lost executor or driver leaves the old version in place. ``replace_by_key`` overwrites partitions where they
are, for keys that are few; ``keyed`` replaces any number of keys beside the old table.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DYNAMIC = "dynamic"


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Write ``df`` partitioned by ``key``: partitions of the keys it holds are replaced, all others stay."""
    df.repartition(F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", DYNAMIC).partitionBy(key).parquet(path)


def versions(spark: SparkSession, path: str, complete: bool = True) -> list[int]:
    """Versions of a table, in order: the complete ones, or also those that were begun."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = [n for n in names if n.startswith("version=") and (not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))]
    return sorted(int(n.split("=")[1]) for n in found)


def append_version(df: DataFrame, path: str, retries: int = 5, wait: float = 0.04) -> int:
    """Write ``df`` as the next version and return its number.

    A number counts as taken once a writer has begun it, finished or not. One that finds its number taken meanwhile tries the
    next, up to ``retries`` times with growing waits.
    """
    for attempt in range(1, retries + 1):
        number = max(versions(df.sparkSession, path, complete=False), default=0) + 1
        try:
            df.write.mode("errorifexists").parquet(f"{path}/version={number}")
            return number
        except AnalysisException as error:
            if attempt == retries or "PATH_ALREADY_EXISTS" not in str(error):
                raise
            time.sleep(wait * attempt)
    raise RuntimeError("no version was free")


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """A version of a table, the latest where none is named; None where the table has none."""
    number = number or max(versions(spark, path), default=None)
    return None if number is None else spark.read.parquet(f"{path}/version={number}")


def upsert(df: DataFrame, path: str, keys: list[str], order: str) -> int:
    """Insert or replace rows by their natural keys, null keys being keys like others; of several new rows of a key the last in ``order`` counts.

    The rows of unchanged keys come from the latest version. The result is a new version, whose number is returned.
    """
    names = [c for c in df.columns if c not in keys]
    new = df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(order, *names)).alias("_v")).select(*keys, "_v.*")
    old = read_version(df.sparkSession, path)
    if old is not None:
        fresh = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        new = old.join(fresh, same, "left_anti").unionByName(new, allowMissingColumns=True)
    return append_version(new, path)


def unseen(df: DataFrame, content: str, seen: DataFrame) -> DataFrame:
    """Rows whose content is not yet among the hashes (content_hash) of ``seen``, with their hash: an incremental load."""
    return df.withColumn("content_hash", F.sha2(F.col(content), 256)).join(seen.select("content_hash"), "content_hash", "left_anti")


def to_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed, quotes doubled, lines ended by CR LF, and a byte order mark before the header of every file.

    Line ends inside values become CR LF as well.
    """
    first, *others = df.columns
    marked = df.toDF("﻿" + first, *others)
    marked.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def to_json(df: DataFrame, path: str) -> None:
    """A JSON object a line, missing values as nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
