"""Resharding with the fewest moved bytes, by minimum-cost flow.

The flow network is small whatever the data: old shards with their sizes on one side, new
shards with their capacities on the other. Its solution says how many bytes each old shard
sends where. Rows follow it in a fixed order: each old shard is cut into ``BLOCKS`` blocks by the hash
of the id, block sizes give every block its offset, and a running sum inside the block gives
every row its offset in the old shard; the transfer into whose interval the row's middle falls
takes it. Rows over 1 / ``LARGE`` of a shard would blur such intervals; there are at most
``LARGE`` times the number of shards of them, so they are placed one by one beforehand.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.blocks import ready
from papyra.session import materialize, new_path

BLOCKS = 4096
LARGE = 200
OVERHEAD = 8  # bytes that a row takes besides its text


def transfers(old: list[int], new: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Bytes that go from each old to each new shard at the least total cost.

    ``cost(i, j)`` is the price of a byte; by default 0 where a shard keeps it and 1 elsewhere.
    Both lists must have the same sum. Successive shortest augmenting paths with potentials.
    """
    if sum(old) != sum(new):
        raise ValueError("old sizes and new capacities differ in total")
    price = cost or (lambda i, j: int(i != j))
    n, m = len(old), len(new)
    left, room = list(old), list(new)
    flow: dict[tuple[int, int], int] = {}
    height = [0.0] * (n + m)
    while any(left):
        far, back = [float("inf")] * (n + m), [-1] * (n + m)
        heap = [(0.0, i) for i in range(n) if left[i]]
        for _, i in heap:
            far[i] = 0.0
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            if u < n:
                steps = [(n + j, price(u, j)) for j in range(m)]
            else:
                steps = [(i, -price(i, u - n)) for i in range(n) if flow.get((i, u - n))]
            for v, c in steps:
                reach = d + c + height[u] - height[v]
                if reach < far[v] - 1e-12:
                    far[v], back[v] = reach, u
                    heapq.heappush(heap, (reach, v))
        goal = min((n + j for j in range(m) if room[j]), key=lambda v: far[v])
        path, v = [], goal
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        amount = min([left[v], room[goal - n], *[flow[b, a - n] for a, b in path if a >= n]])
        for a, b in path:
            arc, sign = ((a, b - n), 1) if a < n else ((b, a - n), -1)
            flow[arc] = flow.get(arc, 0) + sign * amount
        left[v] -= amount
        room[goal - n] -= amount
        for v in range(n + m):
            height[v] += min(far[v], far[goal])
    return {arc: x for arc, x in flow.items() if x}


def place_large(rows: list[tuple[int, int]], quota: dict[tuple[int, int], int]) -> list[int]:
    """Targets of single rows ``(old shard, size)``, largest first, each into the most room left; shrinks ``quota``."""
    targets = []
    for old, size in rows:
        arcs = [arc for arc in quota if arc[0] == old]
        arc = max(arcs, key=lambda a: (quota[a], a[0] == a[1], -a[1]))
        quota[arc] -= size
        targets.append(arc[1])
    return targets


def numbered(rows: DataFrame, limit: int) -> DataFrame:
    """Place ``at`` of each row in its block, and the bytes ``run`` of the rows up to ``limit`` before it.

    Rows alike in id, checksum and size may swap places; nothing depends on which is which.
    """
    inside = Window.partitionBy("old_shard", "block").orderBy("doc_id", "crc", "size")
    light = F.when(F.col("size") <= limit, F.col("size")).otherwise(0)
    run = F.sum(light).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - light
    return rows.withColumn("at", F.row_number().over(inside)).withColumn("run", run)


def reshard(docs: DataFrame, old, capacities: int | list[int], key: str = "doc_id", text: str = "text", path: str | None = None, cost=None) -> str:
    """Write the rows into new shards and return the folder, with one sub-folder ``shard=i`` each.

    ``old`` is a column with the old shard (0, 1, ...; null counts as 0), ``capacities`` the number
    of new shards of nearly equal sizes, or a list with the proportion of each. Written columns:
    ``doc_id``, ``text``, ``size``, ``old_shard``, ``slot`` (gapless from 0 in the new shard) and
    ``shard``. A null text takes no bytes and stays null; null ids come first. Repeated rows are
    rows like others. Other columns are not read. An empty table gives an empty folder.
    """
    spark = ready(docs)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard"), size.alias("size"))
    rows = rows.withColumn("crc", F.crc32(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("block", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(BLOCKS)).cast("int"))
    sizes = dict(rows.groupBy("old_shard").agg(F.sum("size")).collect())  # one row per old shard
    total = sum(sizes.values())
    weights = capacities if isinstance(capacities, list) else [1] * capacities
    edges = [sum(weights[:i]) for i in range(len(weights) + 1)]
    room = [total * b // edges[-1] - total * a // edges[-1] for a, b in zip(edges, edges[1:], strict=False)]
    quota = transfers([sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)], room, cost)
    limit = total // (LARGE * len(room)) + 1
    is_small = F.col("size") <= limit

    meta = materialize(numbered(rows.drop("text"), limit).select("old_shard", "block", "at", "run", "size"), "places")
    large = [tuple(r) for r in meta.filter(~is_small).select("old_shard", "size", "block", "at").collect()]  # at most LARGE a shard
    large.sort(key=lambda r: (-r[1], r))
    targets = place_large([r[:2] for r in large], quota)
    placed = spark.createDataFrame([(o, b, a, t) for (o, _, b, a), t in zip(large, targets, strict=True)], "old_shard int, block int, at int, target int")

    # what is left of each transfer takes its share of the small rows
    light = meta.groupBy("old_shard", "block").agg(F.sum(F.when(is_small, F.col("size")).otherwise(0)).alias("bytes"))
    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = materialize(light.select("old_shard", "block", (F.sum("bytes").over(before) - F.col("bytes")).alias("start"), "bytes"), "block_starts")
    plan = []
    for i, amount in starts.groupBy("old_shard").agg(F.sum("bytes")).collect():
        arcs = sorted((a for a in quota if a[0] == i), key=lambda a: (a[0] != a[1], a[1]))
        kept = [max(0, quota[a]) for a in arcs]
        kept = kept if sum(kept) else [1] * len(arcs)
        plan.append((i, [amount * sum(kept[: n + 1]) / sum(kept) for n in range(len(kept))], [a[1] for a in arcs]))
    plan = spark.createDataFrame(plan, "old_shard int, ends array<double>, targets array<int>")

    def dealt(table: DataFrame) -> DataFrame:
        # all three tables have a fixed bound: shards, shards * BLOCKS and shards * LARGE rows
        found = table.join(F.broadcast(plan), "old_shard").join(F.broadcast(starts.drop("bytes")), ["old_shard", "block"])
        found = found.join(F.broadcast(placed), ["old_shard", "block", "at"], "left")
        middle = F.col("start") + F.col("run") + F.col("size") / 2
        taken = F.least(F.size(F.filter("ends", lambda e: e <= middle)), F.size("ends") - 1)
        return found.withColumn("shard", F.coalesce("target", F.get("targets", taken))).drop("ends", "targets", "start", "target")

    counts = dealt(meta).groupBy("shard", "old_shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select("shard", "old_shard", "block", (F.sum("rows").over(ahead) - F.col("rows")).alias("base"))
    bases = materialize(bases, "bases")

    within = Window.partitionBy("old_shard", "block", "shard").orderBy("at")
    moved = dealt(numbered(rows, limit)).withColumn("rank", F.row_number().over(within) - 1)
    moved = moved.join(F.broadcast(bases), ["shard", "old_shard", "block"])  # at most one row for each transfer and block
    out = path or new_path(spark, "shards")
    moved.select("doc_id", "text", "size", "old_shard", (F.col("base") + F.col("rank")).alias("slot"), "shard").write.partitionBy("shard").parquet(out)
    return out


SHARD_FILES = "doc_id long, text string, size long, old_shard int, slot long, shard int"


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARD_FILES).parquet(path)
