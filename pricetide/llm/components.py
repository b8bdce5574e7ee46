"""Connected components of a graph of links, by rounds of hooking on the least neighbour; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.session import stage

MOST_ROUNDS = 100
# Links that a task holds at once.
MOST_LINKS = 1 << 19


def forest(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each node of the links a - b that is not the least of its component, and that least node."""
    coded = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    own = np.arange(len(order))
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = own
    at = rank[coded.indices.to_numpy()]
    x, y, root = at[: len(a)], at[len(a) :], own.copy()
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    nodes, above = coded.dictionary.take(order), np.flatnonzero(root != own)
    return nodes.take(pa.array(above)), nodes.take(pa.array(root[above]))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (a above b) with the components of the links a - b of a task, of MOST_LINKS links at a time.

    If the rows come by a, all links of an a are in one star.
    """

    def told() -> pa.RecordBatch:
        a, b = (pa.concat_arrays([batch.column(c) for batch in held]) for c in ("a", "b"))
        return pa.RecordBatch.from_arrays(list(forest(a, b)), names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= MOST_LINKS:
            stars, last = told(), batch.column("a")[-1]
            yield stars
            # More links of the last node may come: its star's link stands for those so far.
            at = pc.index(stars.column("a"), last).as_py()
            held = [stars.slice(at, 1)] if at >= 0 else []
    if held:
        yield told()


def _met(stars: DataFrame) -> DataFrame:
    """``stars`` contracted where all links of a node to lesser ones meet.

    A task sends one link of a node for each MOST_LINKS it reads, so few meet even if very many led to it.
    """
    return stars.repartition("a").sortWithinPartitions("a").mapInArrow(contract, stars.schema)


def components(links: DataFrame, name: str = "components", contracted: bool = False) -> DataFrame:
    """node, root: the least node of each linked node's component. ``links`` has the columns a and b.

    Links are contracted inside tasks (small star); ``contracted`` says that ``contract`` has made them. While they are no
    stars yet, each round the larger neighbours of a node go to its least neighbour (large star), links are contracted
    again and written to the shared folder. Rounds grow with the logarithm of the longest path; no node's neighbours are
    gathered, only their minimum is.
    """
    stars = links if contracted else links.where("a <> b").select("a", "b").mapInArrow(contract, links.select("a", "b").schema)
    links = stage(_met(stars), name)
    for _ in range(MOST_ROUNDS):
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("lesser")), F.struct(F.col("b").alias("node"), F.lit(None).alias("lesser")))
        ended = links.select(F.explode(ends).alias("end")).groupBy(F.col("end.node").alias("node"))
        least = ended.agg(F.min("end.lesser").alias("low"), F.max("end.lesser").alias("high"), F.max(F.col("end.lesser").isNull()).alias("above"))
        # A node of stars is either above one other node or below others.
        least = stage(least.select("node", F.coalesce("low", "node").alias("root"), (F.col("low").isNotNull() & ((F.col("low") < F.col("high")) | F.col("above"))).alias("open")), name)
        if not least.where("open").count():
            return least.select("node", "root")
        lower = links.join(least.select(F.col("node").alias("b"), "root"), "b").select("a", F.col("root").alias("b"))
        links = stage(_met(lower.mapInArrow(contract, lower.schema)), name)
    raise RuntimeError("components did not settle")
