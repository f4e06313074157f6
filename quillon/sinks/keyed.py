"""Tables replaced by key at the scale of documents: hash buckets, written anew beside the old ones.

Keys fall into a fixed number of buckets. A change writes new files for the buckets it touches, and then a manifest that names the
folder of every bucket; the manifest's own commit is the moment at which readers change over. Until then, and if the writer dies,
readers see the old table whole. A hot key's rows spread over the files of its bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sinks import tables

BUCKETS, ROWS_A_FILE = 256, 4_000_000


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each bucket in the latest complete version; the driver sees one line a bucket."""
    latest = tables.read_version(spark, f"{path}/manifest")
    return {} if latest is None else {r["bucket"]: r["folder"] for r in latest.collect()}


def read(spark: SparkSession, path: str, keys: list[str] | None = None, wanted: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame | None:
    """The table's rows; with ``wanted``, of its keys alone, from their buckets alone. None where nothing was written."""
    folders = manifest(spark, path)
    if wanted is not None:
        own = {r[0] for r in wanted.select(_bucket(keys, buckets)).distinct().collect()}
        folders = {b: f for b, f in folders.items() if b in own} or dict(list(folders.items())[:1])
    if not folders:
        return None
    rows = spark.read.parquet(*sorted(set(folders.values())))
    return rows if wanted is None else rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def replace(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Delete all rows of the keys in ``df``, insert its rows, and return the number of the new version.

    Only buckets with such keys are written. Null keys are keys like others. The number of buckets is the table's for good.
    """
    spark = df.sparkSession
    old = manifest(spark, path)
    new = df.withColumn("_bucket", _bucket(keys, buckets))
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    held = [old[b] for b in touched if b in old]
    rows = new
    if held:
        fresh = df.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        kept = spark.read.parquet(*sorted(set(held))).join(fresh, same, "left_anti")
        rows = kept.withColumn("_bucket", _bucket(keys, buckets)).unionByName(new, allowMissingColumns=True)
    batch = f"{path}/data/{uuid.uuid4().hex}"
    # rebalancing splits a bucket that a hot key fills and joins small ones
    rows.hint("rebalance", "_bucket").write.option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("_bucket").parquet(batch)
    lines = {**old, **{b: f"{batch}/_bucket={b}" for b in touched}}
    return tables.append_version(spark.createDataFrame(sorted(lines.items()), "bucket int, folder string").coalesce(1), f"{path}/manifest")


def snapshot(df: DataFrame, path: str, summary_type: str, period: str) -> int:
    """One snapshot of a kind for a period: a later one takes the place of the earlier, whole, when its version is complete."""
    tagged = df.withColumns({"summary_type": F.lit(summary_type), "period": F.lit(period)})
    return replace(tagged, path, ["summary_type", "period"], buckets=16)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete batches that the latest version does not name, once no reader needs older ones; the folders deleted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    system = folder.getFileSystem(conf)
    used = {f.rsplit("/", 2)[1] for f in manifest(spark, path).values()}
    gone = [s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName() not in used] if system.exists(folder) else []
    for name in gone:
        system.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/data/{name}"), True)
    return sorted(gone)
