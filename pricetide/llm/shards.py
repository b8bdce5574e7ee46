"""Sharding by longest processing time: groups by size, largest first, each to the least-loaded shard.

Groups (equal texts) of one size are interchangeable for the heap, so it is given sizes and how many groups
have each, not groups. Sizes that differ add up to at least 1 + 2 + .. + d bytes, so a corpus of b bytes has
at most sqrt(2 b) of them: 14 million at 100 TB, streamed to the driver in order and a part at a time, while
the heap holds the loads of the shards. The answer for a size is how many of its groups each shard takes.

Which group is meant, and the number of a row in its shard, come from ranks, made in two steps: counts per
cell of a hash, sums over the (few) cells, and a rank within the cell. So neither a size shared by very many
groups, nor a text with very many copies, nor a shard, meets in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import text_key
from pricetide.session import scratch_path, stage

SHARDS = 8
# Parts in which rows or groups that share a key are ranked.
CELLS = 256
# Sizes written at once by the driver.
CHUNK = 100_000


class Heap:
    """Loads of the shards, least first; equal loads by shard number."""

    def __init__(self, shards: int):
        self.loads = [(0, s) for s in range(shards)]
        heapq.heapify(self.loads)

    def take(self, size: int, count: int) -> list[int]:
        """Give ``count`` groups of ``size`` to the least-loaded shards one by one; how many each got.

        Whole rounds and runs to one shard are given at once, so the steps don't grow with ``count``.
        """
        given = [0] * len(self.loads)
        while count:
            load, shard = self.loads[0]
            if count >= len(given) and max(self.loads)[0] - load < size:
                rounds = count // len(given)
                # The order of the loads stays as it is, so this is still a heap.
                self.loads = [(x + rounds * size, s) for x, s in self.loads]
                for _, s in self.loads:
                    given[s] += rounds
                count -= rounds * len(given)
                continue
            following = min(self.loads[1:3]) if len(given) > 1 else None
            run = count if following is None else max(1, min(count, (following[0] - load) // size))
            heapq.heapreplace(self.loads, (load + run * size, shard))
            given[shard] += run
            count -= run
        return given


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For (size, number of groups) with falling sizes: size, groups of it for each shard."""
    heap = Heap(shards)
    for size, count in sizes:
        yield size, heap.take(size, count)


def _ranked(df: DataFrame, within: list[str], cell: Column, order: list[Column], name: str) -> DataFrame:
    """``name``: the rank from 0 of each row among those equal in ``within``, by cell, then ``order``.

    ``within`` is not null. ``df`` is read twice and should be a written table.
    """
    df = df.withColumn("_cell", cell)
    counts = df.groupBy(*within, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*within, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*within, "_cell").orderBy(*order)) - 1
    ranked = df.withColumn("_own", own).join(starts, [*within, "_cell"])
    return ranked.withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_cell", "_start", "_own")


def _write_schedule(spark, sizes: DataFrame, shards: int) -> DataFrame:
    """size, given array<long>: the heap's answer, written by the driver in chunks."""
    path = scratch_path(spark, "shard-sizes")
    schema = "size long, given array<long>"
    chunk: list = []

    def flush():
        if chunk:
            frame = pd.DataFrame({"size": [s for s, _ in chunk], "given": [g for _, g in chunk]})
            spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(path)
            chunk.clear()

    spark.createDataFrame([], schema).write.parquet(path)
    ordered = ((int(r[0]), int(r[1])) for r in sizes.orderBy(F.desc("size")).toLocalIterator())
    for answer in schedule(ordered, shards):
        chunk.append(answer)
        if len(chunk) == CHUNK:
            flush()
    flush()
    return spark.read.schema(schema).parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 1. Rows with equal texts share a shard; a null text counts
    as empty. ``slot`` numbers a shard's rows from 0 without gaps. Null ids stay null; repeated rows are rows
    of their own; an empty table gives no rows; other columns are ignored. With fewer groups than shards some
    shards stay empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_key(text).alias("key"),
        ).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))),
        "shard-rows",
    )
    # A text with very many copies has at most CELLS rows here.
    parts = rows.groupBy("key", "salt").agg(F.sum("size").alias("size"))
    groups = stage(parts.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    plan = _write_schedule(docs.sparkSession, groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups")), shards)
    cell = F.pmod(F.xxhash64("key"), F.lit(CELLS))
    ranked = _ranked(groups, ["size"], cell, [F.col("key")], "rank").join(plan, "size")
    # The shard whose share of this size holds the rank.
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("given", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    placed = ranked.select("key", F.size(F.filter(ends, lambda e: e <= F.col("rank"))).alias("shard"))
    salted = placed.join(parts.select("key", "salt"), "key")
    out = stage(rows.join(salted, ["key", "salt"]).select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    return _ranked(out, ["shard"], F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(16 * CELLS)), [F.col("doc_id"), F.col("text_crc32")], "slot")
