"""Resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities. A flow from old to new shards that moves the fewest bytes says how many
bytes each old shard sends where; bytes that stay under the same number cost nothing. Each old shard is then laid out
in one order and cut into consecutive blocks, one for each of its transfers. The driver solves the flow over shard sizes
alone; rows are placed by two-level running sums on executors, so no task holds a whole shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import durable

SLICE_ROWS = 50_000  # rows of one slice of an old shard, about
EXTRA_BYTES = 8  # added to the size of every row
MOST_SHARDS = 1_024  # the flow has a node for each shard, on the driver


def minimum_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts (i, j) -> flow that meet ``demand`` from ``supply`` (equal sums) at the least total ``cost(i, j)``.

    Successive shortest paths with node potentials over the complete bipartite graph.
    """
    n, m = len(supply), len(demand)
    left, need = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    up, down = [0] * n, [0] * m  # potentials
    while any(left):
        best = [0 if left[i] else None for i in range(n)] + [None] * m
        before: list[int | None] = [None] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        end = None
        while queue:
            d, x = heapq.heappop(queue)
            if d > best[x]:
                continue
            if x >= n and need[x - n]:
                end = x
                break
            if x < n:
                steps = ((n + j, cost(x, j) + up[x] - down[j]) for j in range(m))
            else:
                steps = ((i, -cost(i, x - n) - up[i] + down[x - n]) for i in range(n) if flow.get((i, x - n)))
            for y, length in steps:
                if best[y] is None or d + length < best[y]:
                    best[y], before[y] = d + length, x
                    heapq.heappush(queue, (d + length, y))
        far = best[end]
        for x, d in enumerate(best):
            near = far if d is None else min(d, far)
            if x < n:
                up[x] += near
            else:
                down[x - n] += near
        path = [end]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        path.reverse()
        amount = min(left[path[0]], need[end - n])
        for a, b in zip(path, path[1:]):
            if a >= n:
                amount = min(amount, flow[(b, a - n)])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[(a, b - n)] = flow.get((a, b - n), 0) + amount
            else:
                flow[(b, a - n)] -= amount
        left[path[0]] -= amount
        need[end - n] -= amount
    return {k: v for k, v in sorted(flow.items()) if v}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def reshard(rows: DataFrame, old_shard: Column, shards: int, capacities: list[int] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``old_shard``, ``shard`` and ``slot`` (gapless from 0 in each shard) to rows with doc_id and size.

    ``size`` is a row's bytes, at least 1; ``old_shard`` numbers the old shards from 0, and null means shard 0. The new
    shards hold equal bytes unless ``capacities`` (shares of the total) say otherwise; a shard is off by at most the size of
    the rows that stand on its block borders. Repeated rows and null ids are rows like others; other columns pass through;
    an empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("old_shard", F.coalesce(old_shard, F.lit(0)).cast("int"))
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "sized")
    # slices are classes of a row hash: their number follows the rows, and every old shard is spread over all of them
    slices = 8 * max(1, -(-rows.count() // slice_rows))
    draw = F.xxhash64("_row")
    rows = rows.withColumns({"_draw": draw, "_slice": F.pmod(draw, F.lit(slices))})

    sums = rows.groupBy("old_shard", "_slice").agg(F.sum("size").alias("_bytes"))
    shard_order = Window.partitionBy("old_shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("old_shard", "_slice", F.coalesce(F.sum("_bytes").over(shard_order), F.lit(0)).alias("_start"))
    sizes = {r.old_shard: r.b for r in rows.groupBy("old_shard").agg(F.sum("size").alias("b")).collect()}
    old = max(sizes, default=-1) + 1
    if max(old, shards) > MOST_SHARDS:
        raise ValueError(f"the flow is solved over at most {MOST_SHARDS} shards")
    blocks = spark.createDataFrame(transfers([sizes.get(k, 0) for k in range(old)], shards, capacities), "old_shard int, _from long, _to long, shard int")

    inside = Window.partitionBy("old_shard", "_slice").orderBy("_draw", "_row")
    run = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(starts, ["old_shard", "_slice"]).withColumn("_at", F.col("_start") + F.coalesce(run, F.lit(0)))
    # a row belongs to the block that holds its middle byte; at most old + new transfers, so the blocks are broadcast
    middle = F.col("_at") + F.floor(F.col("size") / 2)
    on = (placed["old_shard"] == blocks["old_shard"]) & (middle >= blocks["_from"]) & (middle < blocks["_to"])
    placed = placed.join(F.broadcast(blocks), on).drop(blocks["old_shard"]).drop("_from", "_to", "_start", "_at")
    return slotted(placed, "shard").drop("_draw", "_slice", "_row")


def transfers(sizes: list[int], shards: int, capacities: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """(old shard, from byte, to byte, new shard): each old shard cut into blocks by the flow that moves the fewest bytes."""
    total = sum(sizes)
    wanted = equal_capacities(total, shards)
    if capacities:
        whole, wanted, done = sum(capacities), [], 0
        for k in range(shards):
            upto = total * sum(capacities[: k + 1]) // whole
            wanted.append(upto - done)
            done = upto
    flow = minimum_cost_flow(sizes, wanted, lambda i, j: int(i != j)) if total else {}
    blocks, at = [], [0] * len(sizes)
    for (i, j), amount in flow.items():
        blocks.append((i, at[i], at[i] + amount, j))
        at[i] += amount
    return blocks


def slotted(rows: DataFrame, shard: str) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: rows are counted by slice first, then numbered inside slices."""
    rows = durable(rows, "placed")
    counts = rows.groupBy(shard, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(shard).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "_slice", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_first"))
    number = F.row_number().over(Window.partitionBy(shard, "_slice").orderBy("_draw", "_row"))
    return rows.join(first, [shard, "_slice"]).withColumn("slot", F.col("_first") + number - 1).drop("_first")


def document_sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8; a null text has none), text_crc32 and what else is asked for."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + EXTRA_BYTES
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), *more)


def rewrite(rows: DataFrame, folder: str) -> list[int]:
    """Writes the shards whose rows changed as parquet below ``folder``, one directory each, and returns their numbers.

    A shard that neither sent nor received a row keeps its files, and the directory of one that gave all its rows away is
    removed once the others stand. ``rows`` has old_shard, shard and slot, and does not read from ``folder``.
    """
    moved = rows.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    numbers = sorted(r.shard for r in moved.collect())  # at most MOST_SHARDS
    if not numbers:
        return numbers
    changed = rows.where(F.col("shard").isin(numbers))
    (changed.repartition("shard", F.floor(F.col("slot") / SLICE_ROWS)).sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder))
    filled = {r.shard for r in changed.select("shard").distinct().collect()}
    context = rows.sparkSession.sparkContext
    for number in sorted(set(numbers) - filled):
        path = context._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/shard={number}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return numbers
