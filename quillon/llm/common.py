"""What several operators share: the word pattern, shared storage for intermediate tables, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import shared_dir

#: A word: a run without the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting by which the shuffle files of a query are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialize(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The table survives the loss of any executor, is columnar and compressed, and gives the planner
    true sizes, which decide whether a later join may broadcast. Shuffle files of the write go once it has ended.
    A table with a ``key`` is bucketed by it, so that later joins by the key leave its rows where they are; ``df`` should
    come from a join or grouping by the key, or each task writes a file for each bucket.
    """
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    path, named = f"{shared_dir(spark)}/quillon/{name}-{unique}", f"{name.replace('-', '_')}_{unique}" if key else None
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        if named:
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.bucketBy(parts, key).format("parquet").option("path", path).saveAsTable(named)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.table(named) if named else spark.read.schema(df.schema).parquet(path)
    table.stored_at, table.stored_as = path, named
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once everything that reads them has been written in turn."""
    for table in tables:
        if table.stored_as:
            table.sparkSession.sql(f"drop table {table.stored_as}")
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, own: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named c0, c1, ... beside the columns ``own`` that an operator works on.

    So a caller's columns may have any names. Also returns the new names, in the caller's order.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.select(*[column(c).alias(n) for c, n in zip(docs.columns, names)], *[c.alias(n) for n, c in own.items()]), names


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, root), root being the least node of the component.

    ``edges`` has the long columns ``a`` and ``b``. Each round lets every node take the least root among
    its own and its neighbours', then jumps to that root's root, so long paths shrink by halves. Each
    round is a table in the shared folder; sums of roots tell when nothing moves any more. Isolated
    nodes don't appear. Null ends are ignored; an empty input gives an empty result.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    edges = materialize(edges.select("e.*").distinct(), "cc-edges")
    roots = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "cc-0")
    total = None
    for k in range(max_rounds):
        new = roots.agg(F.sum(F.col("root").cast("decimal(38,0)")).alias("s")).first()["s"]
        if new is None or new == total:
            discard(edges)
            return roots
        total = new
        near = edges.join(roots, edges.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        low = roots.join(near, roots.node == near.a, "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        up = low.select(F.col("node").alias("root"), F.col("root").alias("above"))
        spent, roots = roots, materialize(low.join(up, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root")), f"cc-{k + 1}")
        discard(spent)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
