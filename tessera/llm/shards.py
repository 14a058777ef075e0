"""Sharding by Karmarkar-Karp differencing.

Rows with equal texts form one indivisible group (so that copies meet in one
shard); a group weighs the bytes of its rows. Differencing keeps a set of
partial partitions, each of ``shards`` parts; it repeatedly takes the two
with the largest spread (largest minus smallest part) and combines them in
opposite order, the largest part of one with the smallest of the other.

It runs in levels. Groups are dealt by the hash of their text over tasks; each
task differences its own groups into one partial partition. The tasks' partial
partitions, one row of ``shards`` sums a task, are then differenced by the same
rule. Only that last step is in one place, and its input is one row for each
task of the first level, not data.

Hot groups: the bytes of a group are summed map-side before the shuffle, and
the join that gives rows their group's shard spreads each group over ``SALT``
keys. A group itself is never divided, so one that outweighs a shard's fair
part makes that shard larger by as much.

Defined cases: a null text weighs 1, has crc null, and null texts form one
group, apart from empty texts; repeated rows are rows like others; a null
doc_id comes first in a shard's slot order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved, shuffle_parts

#: Keys over which the rows of one group are spread in the join back.
SALT = 16


def difference(weights: list[list[int]], shards: int) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions (each of ``shards`` sums) into one.

    Returns, for each input, the final part of each of its parts, and the
    final sums. Ties of spread go by input order, so the result is determined.
    """
    if not weights:
        return [], [0] * shards
    # An entry is (-spread, order, sums, tree); the sums are descending and
    # tree says which part of which input or earlier pair lies where.
    heap = []
    trees: list = []
    for i, w in enumerate(weights):
        order = sorted(range(shards), key=lambda p: (-w[p], p))
        sums = [w[p] for p in order]
        trees.append(("leaf", i, order))
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [x[p] + y[shards - 1 - p] for p in range(shards)]
        order = sorted(range(shards), key=lambda p: (-both[p], p))
        sums = [both[p] for p in order]
        trees.append(("pair", a, b, order))
        heapq.heappush(heap, (sums[-1] - sums[0], len(trees) - 1, sums))
    places: list[list[int]] = [[0] * shards for _ in weights]
    todo = [(heap[0][1], list(range(shards)))]
    while todo:
        t, to = todo.pop()  # to[p]: final part of this entry's p-th largest part
        if trees[t][0] == "leaf":
            _, i, order = trees[t]
            for p, own in enumerate(order):
                places[i][own] = to[p]
        else:
            _, a, b, order = trees[t]
            of_a = [0] * shards
            for p, own in enumerate(order):
                of_a[own] = to[p]
            todo.append((a, of_a))
            todo.append((b, of_a[::-1]))
    return places, heap[0][2]


def _within_tasks(groups: DataFrame, shards: int) -> DataFrame:
    """Each task's groups with their part (kind 0), and the task's sums (kind 1)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(frames) or [pd.DataFrame()])
        if not len(own):
            return
        own = own.sort_values(["bytes", "text_key", "text_check"], ascending=[False, True, True])
        rest = [0] * (shards - 1)
        places, _ = difference([[int(b), *rest] for b in own["bytes"]], shards)
        own["part"] = [p[0] for p in places]
        task = int(own["task"].iloc[0])
        yield own[["task", "text_key", "text_check", "part"]].assign(kind=0, bytes=0)
        sums = own.groupby("part")["bytes"].sum()
        yield pd.DataFrame({"task": task, "text_key": 0, "text_check": 0, "part": range(shards), "kind": 1,
                            "bytes": [int(sums.get(p, 0)) for p in range(shards)]})

    return groups.withColumn("task", F.spark_partition_id()).mapInPandas(
        run, "task int, text_key long, text_check long, part int, kind int, bytes long")


def _across_tasks(sums: DataFrame, shards: int) -> DataFrame:
    """(task, part, shard): where each task's parts go. One row a task comes in."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="task", columns="part", values="bytes").sort_index()
        places, _ = difference([[int(v) for v in r] for r in table.to_numpy()], shards)
        return pd.DataFrame([(int(t), p, s) for t, row in zip(table.index, places) for p, s in enumerate(row)],
                            columns=["task", "part", "shard"])

    return sums.withColumn("all_tasks", F.lit(0)).groupBy("all_tasks").applyInPandas(run, "task int, part int, shard int")


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", order_by: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` (without the text) with size, text_crc32, shard and slot.

    ``size`` is the UTF-8 bytes of the text plus 1; ``slot`` counts a shard's
    rows from 0 without gaps, in the order of ``order_by``.
    """
    body = F.col(f"`{text}`")
    made = ["size", "text_crc32", "shard", "slot", text]
    keep = [c for c in docs.columns if c not in made]
    rows = saved(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_row"), F.col(f"`{order_by}`").alias("order_value"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        # a group's key has 96 bits; null texts have a key of their own
        F.when(body.isNotNull(), F.xxhash64(body)).otherwise(F.lit(0)).alias("text_key"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(-1)).alias("text_check")), "shard-rows")
    groups = rows.groupBy("text_key", "text_check").agg(F.sum("size").alias("bytes"))
    placed = saved(_within_tasks(groups, shards), "shard-groups")
    to = _across_tasks(placed.where("kind = 1").select("task", "part", "bytes"), shards)
    # ``to`` has one row for each task and shard, whatever the data: safe to broadcast
    group_shard = placed.where("kind = 0").join(F.broadcast(to), ["task", "part"]).select(
        F.col("text_key").alias("g_key"), F.col("text_check").alias("g_check"), "shard",
        F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("g_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("order_value", "size"), F.lit(SALT)))
    out = salted.join(group_shard, (F.col("text_key") == F.col("g_key")) & (F.col("text_check") == F.col("g_check"))
                      & (F.col("salt") == F.col("g_salt"))).select("kept_row", "order_value", "size", "text_crc32", "shard")
    return with_slots(out).select("kept_row.*", "size", "text_crc32", "shard", "slot")


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without a task that holds a shard.

    Rows are range-partitioned by (shard, order); each partition numbers its
    own stretch, and the stretch's first number is the count of the shard's
    rows in earlier partitions (a table of one row per partition and shard).
    """
    order = ["shard", "order_value", "text_crc32", "size"]
    ranged = saved(rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).withColumn("stretch", F.spark_partition_id()), "shard-slots")
    counts = ranged.groupBy("stretch", "shard").agg(F.count(F.lit(1)).alias("stretch_rows"))
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("stretch", "shard", F.coalesce(F.sum("stretch_rows").over(before), F.lit(0)).alias("stretch_start"))
    inner = Window.partitionBy("stretch", "shard").orderBy(*order)
    return (ranged.withColumn("place", F.row_number().over(inner)).join(F.broadcast(starts), ["stretch", "shard"])
            .withColumn("slot", (F.col("place") - 1 + F.col("stretch_start")).cast("long")).drop("stretch", "place", "stretch_start"))
