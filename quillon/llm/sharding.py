"""Resharding by minimum-cost flow.

Old shard sizes and new capacities form a small transport network in which a byte that stays costs nothing
and a byte that moves costs one. The flow says how many bytes go from each old shard to each new one; blocks
of documents carry them, and only a block that a boundary cuts is divided, between documents. The network
and the table of blocks are bounded by the numbers of shards and blocks, whatever the size of the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import column, materialize, numbered

#: Bytes a document takes in a shard beside its text.
OVERHEAD = 16
#: Rows that one window sorts, about, and the least and most blocks an old shard is dealt into.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 500_000, 64, 16_384


def document_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def equal_capacities(total: int, shards: int) -> list[int]:
    """Capacities that add up to ``total`` and differ by one at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost=None) -> list[dict[int, int]]:
    """Bytes to send from each old shard i to each new shard j, all supply placed at the least cost.

    ``cost(i, j)`` is the price of a byte, by default 0 where i = j and else 1. Successive shortest paths
    with potentials; the network has len(supply) + len(capacity) + 2 nodes.
    """
    cost = cost or (lambda i, j: int(i != j))
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones")
    flow: list[dict[int, int]] = [{} for _ in supply]
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    while any(left):
        far = [float("inf")] * (n + m)
        came = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                far[i] = -potential[i]
                heapq.heappush(heap, (far[i], i))
        best, end = float("inf"), -1
        done = [False] * (n + m)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < n:
                steps = [(n + j, cost(u, j)) for j in range(m)]
            else:
                if room[u - n] and d + potential[u] < best:
                    best, end = d + potential[u], u
                steps = [(i, -cost(i, u - n)) for i in range(n) if flow[i].get(u - n)]
            for v, c in steps:
                reach = d + c + potential[u] - potential[v]
                if reach < far[v]:
                    far[v], came[v] = reach, u
                    heapq.heappush(heap, (reach, v))
        for v in range(n + m):
            if done[v]:
                potential[v] += far[v]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        push = min(left[path[0]], room[end - n])
        for u, v in zip(path, path[1:]):
            if v < n:  # a step back along flow[v][u]
                push = min(push, flow[v][u - n])
        for u, v in zip(path, path[1:]):
            i, j, add = (u, v - n, push) if u < n else (v, u - n, -push)
            flow[i][j] = flow[i].get(j, 0) + add
        left[path[0]] -= push
        room[end - n] -= push
    return [{j: b for j, b in row.items() if b} for row in flow]


def _cuts(flow: list[dict[int, int]], blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(old shard, block, first byte, [(upper end, new shard), ...]) of each (old shard, block, bytes), in order."""
    out, at, shard = [], 0, None
    for i, b, size in sorted(blocks):
        if i != shard:
            shard, at, ends = i, 0, []
            upto = 0
            for j in sorted(flow[i], key=lambda j: (j != i, j)):
                upto += flow[i][j]
                ends.append((upto, j))
        reached = [(e, j) for k, (e, j) in enumerate(ends) if e > at and (k == 0 or ends[k - 1][0] < at + size)] or ends[-1:]
        out.append((i, b, at, reached))
        at += size
    return out


def reshard(rows: DataFrame, capacities: list[int] | int, size: str = "size", old: str = "old_shard", key: tuple[str, ...] = ("doc_id",), blocks: int | None = None) -> DataFrame:
    """``rows`` with shard and slot, moving the fewest bytes from the old shards to the new capacities.

    ``rows`` has the old shard (int from 0, null: 0) and the size of each row; ``capacities`` is a list, or
    a number of shards of near equal sizes. A shard's bytes differ from its capacity by one document
    at most at each boundary. Slots run from 0 without gaps in each shard. Rows of a block are ordered by all of
    ``key``; repeated rows take slots of their own. An empty table gives an empty result. The driver sees
    one line a block: old shards times ``blocks``, by default so many that the fullest shard has about ``BLOCK_ROWS``
    rows a block, from ``LEAST_BLOCKS`` to ``MOST_BLOCKS``. Columns named shard or slot are replaced,
    all others stay, whatever their names.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    keys = [f"k{i}" for i in range(len(key))]
    inner, names = numbered(rows, {"old": F.coalesce(column(old).cast("int"), F.lit(0)), "size": column(size), **{k: column(c) for k, c in zip(keys, key)}})
    if blocks is None:
        fullest = inner.groupBy("old").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-fullest // BLOCK_ROWS)))
    inner = inner.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    sizes = [(r[0], r[1], r[2]) for r in inner.groupBy("old", "block").agg(F.sum("size").cast("long")).collect()]
    supply = [0] * (1 + max((i for i, _, _ in sizes), default=-1))
    for i, _, s in sizes:
        supply[i] += s
    if isinstance(capacities, int):
        capacities = equal_capacities(sum(supply), capacities)
    plan = _cuts(min_cost_flow(supply, capacities), sizes)
    cuts = spark.createDataFrame(plan, "old int, block int, base long, ends array<struct<upto:bigint,shard:int>>")
    # at most old shards x blocks rows, by construction
    placed = inner.join(F.broadcast(cuts), ["old", "block"])
    group = Window.partitionBy("old", "block").orderBy(*keys, "size")
    start = F.col("base") + F.coalesce(F.sum("size").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = F.filter("ends", lambda e: e["upto"] > F.col("middle"))
    placed = placed.withColumn("middle", start + F.floor(F.col("size") / 2)).withColumn("shard", F.coalesce(F.try_element_at(hit, F.lit(1)), F.element_at("ends", -1))["shard"])
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("old", "block", "shard").orderBy("middle", *keys)) - 1)
    at = rows.columns.index(old)
    kept = [n for i, n in enumerate(names) if i != at]
    placed = materialize(placed.select(*kept, "old", "block", "shard", "place"), "reshard")
    counts = sorted((r["shard"], r["old"], r["block"], r["n"]) for r in placed.groupBy("shard", "old", "block").agg(F.count("*").alias("n")).collect())
    bases, first, shard = [], 0, None
    for j, i, b, n in counts:
        first, shard = (0, j) if j != shard else (first, shard)
        bases.append((j, i, b, first))
        first += n
    base = spark.createDataFrame(bases, "shard int, old int, block int, base long")
    # one row a block and piece of a block: bounded as above, and by twice the number of flows
    out = placed.join(F.broadcast(base), ["shard", "old", "block"])
    return out.select(*[F.col("old" if i == at else n).alias(c) for i, (n, c) in enumerate(zip(names, rows.columns))], "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def finish_rewrite(spark: SparkSession, path: str) -> list[int]:
    """Put staged shards in place and delete those that have emptied; the shards written anew, none where nothing is staged whole.

    Every step may be repeated, so a rewrite whose driver has died is finished by calling this again.
    """
    staging = f"{path.rstrip('/')}.resharding"
    if not _exists(spark, f"{staging}/rows/_SUCCESS"):
        if _exists(spark, staging):  # nothing of ``path`` has been touched yet
            _delete(spark, staging)
        return []
    affected = sorted(r[0] for r in spark.read.parquet(f"{staging}/shards").collect())
    staged = spark.read.parquet(f"{staging}/rows")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    filled = {r[0] for r in staged.select("shard").distinct().collect()}
    for j in set(affected) - filled:  # all its rows have left
        _delete(spark, f"{path}/shard={j}")
    _delete(spark, staging)
    return affected


def rewrite_affected(spark: SparkSession, path: str, capacities: list[int] | int, key: tuple[str, ...] = ("doc_id",)) -> list[int]:
    """Reshard the table stored as ``path``/shard=N and rewrite only shards that gain or lose rows.

    Returns the shards written anew. The new rows are staged whole in ``path``.resharding before any old file is replaced.
    Until they are in place a reader may see a row in its old and its new shard; if the driver dies there,
    the next call, or ``finish_rewrite``, finds the staging and finishes from it. Lost executors only repeat tasks.
    """
    finish_rewrite(spark, path)
    stored = spark.read.parquet(path).withColumnRenamed("shard", "old_shard")
    keep = [c for c in stored.columns if c != "old_shard"]
    new = reshard(stored.withColumn("_size", document_size(F.col("text"))), capacities, size="_size", key=key)
    moved = [(r[0], r[1]) for r in new.where("shard <> old_shard").select("old_shard", "shard").distinct().collect()]
    affected = sorted({x for pair in moved for x in pair})
    if not affected:
        return []
    staging = f"{path.rstrip('/')}.resharding"
    spark.createDataFrame([(j,) for j in affected], "shard int").write.mode("overwrite").parquet(f"{staging}/shards")
    new.where(F.col("shard").isin(affected)).select(*keep, "shard").write.partitionBy("shard").parquet(f"{staging}/rows")
    return finish_rewrite(spark, path)
