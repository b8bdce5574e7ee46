"""Exact Jaccard join of shingle sets in the metric space of 1 - J, for the components of its links.

Two documents link when 100 |x & y| >= percent |x | y|, that is at a distance of at most t = 1 - percent / 100. Sets are of
runs of ``shingle`` words. The defaults, 4 and 85, are those of op8_jaccard; the pipeline gives its own.

Voronoi regions by single shingles. The first pivots are sets of one shingle: a document of n shingles lies at
1 - 1/n from each of its own shingles and at 1 from all others, so its nearest pivots are its shingles, ordered by a
fixed rank to break the tie. The triangle inequality makes the window: a linked document lacks at most the share t of
them, so each document is replicated to its first n - ceil((1 - t) n) + 1 pivots and linked documents meet in a region.
The rank puts shingles that a bounded sample finds frequent last. It decides the cost, never the
result. Most regions hold one document and end there.

Windows inside a region. A document's distances to coarse pivots, classes of shingles, are how many of its shingles fall
into each (``profile``). By the triangle inequality these differ by no more than the sets do, so two documents of
a region whose sizes or profiles are farther apart than linked ones can be are not neighbours, nor are those that have
too much before the region's shingle in the rank, if it is the first they share. Documents that meet none by size and rank, nearly all,
end there. The others of a region go beside the least of them, their hub, get their profiles, and are compared in one task, so
pairs are never written. Only a region or hub of more than MOST_COMPARED documents is not compared: there each is a neighbour of the
next one by size, unless the step in size alone rules out a link across it, and those so connected are linked with the least of them. Documents
that neighbours connect form one region from here on, so that each document goes to one region, once, and linked
documents stay together.

Recursion by documents. Inside a region documents are the pivots: distances to a few of them split it into Voronoi
cells, a document is also put into every cell whose pivot is at most 2 t farther than its nearest, and the cells are
joined alike. A cell that is small, or that its windows don't split, is joined exactly: a document's
distances to all others come from the postings of its shingles. Documents of the largest component found so far
need not be taken as pivots: a link between components has an end outside the largest. A region with more than
MOST_SHINGLES is cut into blocks and every two blocks are joined by a task of their own, so a task's memory is bounded.

Equal sets are one class from the start. Links leave a task as a forest, not as pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import Words, may_be_in, mix, small_batches, text_key, words_of
from pricetide.llm.components import components, contract
from pricetide.session import stage

SHINGLE = 4
PERCENT = 85
# Documents whose shingles decide which are frequent, at most (in the mean), and how many are remembered.
SAMPLE_DOCS = 40_000
MOST_FREQUENT = 500_000
SAMPLE_COPIES = 2
# Shingles of a block of a region (8 bytes each).
MOST_SHINGLES = 1_500_000
# Documents of a region, or beside a hub, whose pairs are all looked at; in longer ones, pairs that are not connected yet.
# Beyond MOST_COMPARED they are chained by size.
MOST_LISTED = 128
MOST_COMPARED = 8192
SMALL_CELL = 400
PIVOTS = 8
_CLASS = ("f1", "f2", "n")
# Numbers that profiles are compared by at once; bytes of a region that are held, or it is chained.
_CELLS = 1 << 20
_REGION_BYTES = 32 << 20


def sets_of(words: Words, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, rising; a text of fewer than ``k`` words has one for all of them."""
    grams, first = words.grams(k)
    short: dict[int, dict[int, np.uint64]] = {}
    counts = np.diff(words.first)
    for n in range(1, k):
        if (counts == n).any():
            hashes, at = words.grams(n)
            short[n] = {int(i): hashes[at[i]] for i in np.flatnonzero(counts == n)}
    for i in range(len(words)):
        n = int(counts[i])
        if 0 < n < k:
            yield np.array([short[n][i]], np.uint64)
        else:
            yield np.unique(grams[first[i] : first[i + 1]])


def window(n: int, percent: int = PERCENT) -> int:
    """How many of its first pivots a set of ``n`` is replicated to."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest over the positions of ``sets`` with the components of all their links."""
    parent = list(range(len(sets)))
    size = [1] * len(sets)
    out: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            if size[a] < size[b]:
                a, b = b, a
            parent[b] = a
            size[a] += size[b]
            out.append((i, j))

    counts = np.array([len(s) for s in sets], np.int64)
    values, each = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
    owner = np.repeat(np.arange(len(sets)), counts)
    # Postings: the sets of each shingle.
    order = np.argsort(each, kind="stable")
    postings = owner[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(each, minlength=len(values)))])
    bounds = np.concatenate([[0], np.cumsum(counts)])

    def shared(i: int, inside: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sets that share a shingle with set ``i``, and how many."""
        own = each[bounds[i] : bounds[i + 1]]
        own = own[start[own + 1] - start[own] > 1]
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = start[own + 1] - start[own]
        at = np.arange(size.sum()) + np.repeat(start[own] - (np.cumsum(size) - size), size)
        total = np.bincount(postings[at], minlength=len(sets))
        near = np.flatnonzero(total) if inside is None else inside[total[inside] > 0]
        return near, total[near]

    def exact(cell: np.ndarray) -> None:
        inside = None if len(cell) == len(sets) else cell
        largest = int(cell[0])
        for i in cell.tolist():
            root = find(i)
            if size[root] > size[find(largest)]:
                largest = root
            if i != cell[0] and root == find(largest):
                continue
            near, both = shared(i, inside)
            linked = near[100 * both >= percent * (counts[i] + counts[near] - both)]
            for j in linked.tolist():
                join(i, j)
        # Those that were passed over because they were in what was the largest component then.
        top = find(largest)
        for i in cell.tolist():
            if find(i) != top:
                near, both = shared(i, inside)
                for j in near[100 * both >= percent * (counts[i] + counts[near] - both)].tolist():
                    join(i, j)

    limit = 2 * (1 - percent / 100) + 1e-9
    todo = [np.arange(len(sets))] if len(sets) > 1 else []
    while todo:
        cell = todo.pop()
        if len(cell) <= SMALL_CELL:
            exact(cell)
            continue
        # Pivots spread over the cell; all distances to them.
        pivots = cell[:: max(1, len(cell) // PIVOTS)][:PIVOTS]
        distance = np.ones((len(pivots), len(cell)))
        for k, p in enumerate(pivots.tolist()):
            near, both = shared(p, cell)
            distance[k, np.searchsorted(cell, near)] = 1 - both / (counts[p] + counts[near] - both)
            for j in near[100 * both >= percent * (counts[p] + counts[near] - both)].tolist():
                join(p, j)
        least = distance.min(axis=0)
        cells = [cell[row <= least + limit] for row in distance]
        if max(map(len, cells)) > 0.6 * len(cell):
            exact(cell)
        else:
            todo += [c for c in cells if len(c) > 1]
    return out


def profile(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of m classes, m a power of two near n / 8."""
    m = 32
    while m * 8 < len(s):
        m *= 2
    return np.minimum(np.bincount((mix(s) & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8)


def may_link(a: np.ndarray, b: np.ndarray, n: int, percent: int = PERCENT) -> bool:
    """Can sets with these profiles and ``n`` shingles together link?"""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) < len(b):
        if a.max(initial=0) == 255 or b.max(initial=0) == 255:
            return True
        b = b.reshape(-1, len(a)).sum(axis=0)
    apart = int(np.abs(a.astype(np.int64) - b).sum())
    return apart * (100 + percent) <= n * (100 - percent)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(s):
        return 0, 0
    a, b = mix(s), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int((a.sum(dtype=np.uint64) ^ np.uint64(len(s))).view(np.int64)), int(np.bitwise_xor.reduce(b).view(np.int64))


def _frequent(rows: DataFrame, shingle: int) -> np.ndarray:
    """Hashes, rising, of shingles that several documents of a sample hold; at most MOST_FREQUENT."""
    total = rows.count()
    share = min(0.25, SAMPLE_DOCS / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1_000_003)) / 1_000_003 < share)

    def run(batches):
        for batch in batches:
            for words in words_of(batch.column("text"), lower=True):
                found = [s for s in sets_of(words, shingle)]
                if found:
                    value, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    counted = sample.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counted = stage(counted.where(F.col("n") >= SAMPLE_COPIES), "jaccard-frequent")
    # The lowest count above which there are no more than MOST_FREQUENT shingles. Different counts add up to at least
    # half their number squared, so there are few of them.
    sizes = counted.groupBy("n").count().toPandas().sort_values("n", ascending=False)
    within = sizes["n"][sizes["count"].cumsum() <= MOST_FREQUENT]
    if not len(within):
        return np.zeros(0, np.uint64)
    return np.sort(counted.where(F.col("n") >= int(within.min())).select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


def _sketched(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, key, f1, f2, n, pivots, profile: the set's fingerprint and size, its nearest pivots within the window, its profile."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, shingle))

    def run(batches):
        often = frequent.value
        for batch in batches:
            f1, f2, n, pivots, profiles = [], [], [], [], []
            for words in words_of(batch.column("text"), lower=True):
                for s in sets_of(words, shingle):
                    a, b = _fingerprint(s)
                    rank = mix(s)
                    if len(often) and len(s):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        common = often[at] == s
                    else:
                        common = np.zeros(len(s), bool)
                    order = np.lexsort((rank, common))[: window(len(s), percent)]
                    f1.append(a)
                    f2.append(b)
                    n.append(len(s))
                    pivots.append(s[order].view(np.int64))
                    profiles.append(profile(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int64()), pa.array(pivots, pa.list_(pa.int64())), pa.array(profiles, pa.binary())],
                names=["doc_id", "key", "f1", "f2", "n", "pivots", "profile"],
            )

    return rows.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key binary, f1 long, f2 long, n long, pivots array<long>, profile binary")


def near_sizes(n: np.ndarray, at: np.ndarray, i: np.ndarray, k: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Can rows ``i`` and ``k`` of a region link, if its pivot is the first in order that they share?

    ``n`` are their sizes, ``at`` how many of their shingles come before the pivot: the other one has none of those.
    """
    both = np.minimum(n[i] - at[i], n[k] - at[k])
    either = np.maximum(np.maximum(n[i] + at[k], n[k] + at[i]), n[i] + n[k] - both)
    return 100 * both >= percent * either


class Profiles:
    """The profiles of some rows, as a matrix for each length."""

    def __init__(self, profiles: list[bytes]):
        self.length = np.array([len(x) for x in profiles], np.int64)
        self.slot = np.zeros(len(profiles), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for m in np.unique(self.length).tolist():
            rows = np.flatnonzero(self.length == m)
            self.slot[rows] = np.arange(len(rows))
            self.of[m] = np.frombuffer(b"".join([profiles[r] for r in rows.tolist()]), np.uint8).reshape(-1, m)

    def near(self, n: np.ndarray, i: np.ndarray, k: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """``may_link`` of the rows ``i`` and ``k``, of sizes ``n``."""
        out = np.zeros(len(i), bool)
        kinds = self.length[i] * (1 << 32) + self.length[k]
        for kind in np.unique(kinds).tolist():
            x, y = kind >> 32, kind & ((1 << 32) - 1)
            every = np.flatnonzero(kinds == kind)
            for low in range(0, len(every), max(1, _CELLS // max(x, y))):
                at = every[low : low + max(1, _CELLS // max(x, y))]
                a, b = (self.of[m][self.slot[j[at]]].astype(np.int32) for m, j in ((x, i), (y, k)))
                full = np.zeros(len(at), bool) if x == y else (a.max(axis=1) == 255) | (b.max(axis=1) == 255)
                m = min(x, y)
                apart = np.abs(a.reshape(len(at), -1, m).sum(axis=1) - b.reshape(len(at), -1, m).sum(axis=1)).sum(axis=1)
                out[at] = full | (apart * (100 + percent) <= (n[i[at]] + n[k[at]]) * (100 - percent))
        return out


def connected(size: int, near: Callable[[int], np.ndarray]) -> np.ndarray:
    """For each of ``size`` rows one row of its component; ``near`` gives the neighbours of a row, which is not asked for rows of what is the largest component."""
    label = np.arange(size)
    largest, passed = -1, []

    def join(i: int) -> bool:
        labels = np.unique(label[np.append(near(i), i)])
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]
        return len(labels) > 1

    for i in range(size):
        if label[i] == largest:
            passed.append(i)
        elif join(i):
            largest = int(np.bincount(label).argmax())
    # Those that were passed over because they were in what was the largest component then.
    for i in passed:
        if label[i] != label[largest]:
            join(i)
    return label


def _pairs(region: np.ndarray, of: np.ndarray, listed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """i, k: all pairs of rows of a region, for whole regions in order, of those rows of which ``of`` holds."""
    ends = np.searchsorted(region, region, "right")
    left = np.where(of, ends - np.arange(len(region)), 0)
    for lag in range(1, listed):
        i = np.flatnonzero(left > lag)
        if not len(i):
            break
        yield i, i + lag


def _sizes(region: np.ndarray) -> np.ndarray:
    """For each row how many its region has."""
    starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    sizes = np.diff(np.append(starts, len(region)))
    return np.repeat(sizes, sizes)


def meeting(pivot: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, listed: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """hub, node: those of a region that may link to another one of it by ``near_sizes``, beside the least of them.

    For whole regions in the order of (pivot, n). In regions of over ``listed`` rows all count.
    """
    keep = _sizes(pivot) > listed
    for i, k in _pairs(pivot, ~keep, listed):
        near = near_sizes(n, at, i, k, percent)
        keep[i[near]] = keep[k[near]] = True
    pivot, node = pivot[keep], node[keep]
    if not len(node):
        return node, node
    starts = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
    return np.repeat(np.minimum.reduceat(node, starts), np.diff(np.append(starts, len(node)))), node


def chained(region: np.ndarray, node: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """node, least: rows that follow each other by size, without a step too long for a link across it, beside the least of them."""
    starts = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (100 * n[:-1] < percent * n[1:])]))
    least = np.repeat(np.minimum.reduceat(node, starts), np.diff(np.append(starts, len(node))))
    return node[node != least], least[node != least]


def neighbours(hub: np.ndarray, node: np.ndarray, n: np.ndarray, profiles: Profiles, listed: int, compared: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """a, b: links with the components of those beside a hub that may link by size and profile, for whole hubs in the order of (hub, n).

    Beside a hub of over ``compared`` rows those are linked that ``chained`` gives.
    """
    sizes = _sizes(hub)
    out = [(node[:0], node[:0])]
    for i, k in _pairs(hub, sizes <= listed, listed):
        near = 100 * n[i] >= percent * n[k]
        i, k = i[near], k[near]
        near = profiles.near(n, i, k, percent)
        out.append((node[i[near]], node[k[near]]))
    first = np.flatnonzero((sizes > listed) & (sizes <= compared))
    while len(first):
        low, high = int(first[0]), int(first[0] + sizes[first[0]])
        own = n[low:high]

        def near_to(x: int, low: int = low, own: np.ndarray = own) -> np.ndarray:
            k = np.arange(np.searchsorted(own, -(-percent * own[x] // 100)), np.searchsorted(own, 100 * own[x] // percent, "right"))
            return k[profiles.near(n, np.full(len(k), low + x), low + k, percent)]

        label = connected(high - low, near_to)
        rest = np.flatnonzero(label != np.arange(len(label)))
        out.append((node[low + label[rest]], node[low + rest]))
        first = first[first >= high]
    long = sizes > compared
    if long.any():
        out.append(chained(hub[long], node[long], n[long], percent))
    return tuple(np.concatenate([o[x] for o in out]) for x in range(2))


def _whole_regions(batches: Iterator[pa.RecordBatch], by: str, most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows in the order of ``by``, whole regions at a time; of a region of over ``most`` rows a part, and True.

    The last row of such a part comes again at the head of the next one.
    """
    rest, hot = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        region = rows.column(by).to_numpy()
        open_at = int(np.searchsorted(region, region[-1]))
        hot_to = 0 if hot is None else min(open_at, int(np.searchsorted(region, hot, "right")))
        for low, high in ((0, hot_to), (hot_to, open_at)):
            if low < high:
                yield rows.slice(low, high - low), low < hot_to
        rest = rows.slice(open_at)
        if region[-1] != hot:
            hot = None
        if rest.num_rows > most or rest.nbytes > _REGION_BYTES:
            hot = region[-1]
            yield rest, True
            rest = rest.slice(rest.num_rows - 1)
    if rest is not None:
        yield rest, hot is not None


def _neighbours(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: links with the components of the neighbours of all regions."""
    listed, compared = MOST_LISTED, MOST_COMPARED
    numbers = lambda rows, *names: [rows.column(c).to_numpy().astype(np.int64) for c in names]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hot in _whole_regions(batches, "pivot", compared):
            pivot, node, n, at = numbers(rows, "pivot", "node", "n", "at")
            a, b = chained(pivot, node, n, percent) if hot else meeting(pivot, node, n, at, listed, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], names=["a", "b", "sure"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hot in _whole_regions(batches, "hub", compared):
            hub, node, n = numbers(rows, "hub", "node", "n")
            a, b = chained(hub, node, n, percent) if hot else neighbours(hub, node, n, Profiles(rows.column("profile").to_pylist()), listed, compared, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    spread = classes.select(F.posexplode("pivots").alias("at", "pivot"), "node", "n")
    spread = spread.repartition("pivot").sortWithinPartitions("pivot", "n", "node")
    # A family meets in many regions, in most of them beside the same hub: it gets its profiles once.
    met = stage(spread.mapInArrow(meet, "a long, b long, sure boolean").distinct(), "jaccard-meeting")
    beside = met.where("not sure").select(F.col("a").alias("hub"), F.col("b").alias("node")).join(classes.select("node", "n", "profile"), "node")
    beside = beside.repartition("hub").sortWithinPartitions("hub", "n", "node")
    # Contracted by the same worker, so that a task has one.
    return beside.mapInArrow(lambda batches: contract(near(batches)), "a long, b long").union(met.where("sure").select("a", "b"))


def _regions(classes: DataFrame, percent: int) -> DataFrame:
    """node, root: classes that neighbours connect. ``node`` is a class's number."""
    return components(_neighbours(classes, percent), "jaccard-regions", contracted=True)


def _units(members: DataFrame) -> DataFrame:
    """node, key, holder, region, unit: the tasks a class's set goes to. ``members`` has node, key, holder, n, region."""
    sizes = members.groupBy("region").agg(F.ceil(F.sum("n") / F.lit(MOST_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    # Every two blocks meet in one unit; a region of one block is one unit.
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    unit = F.explode(F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.filter(other, lambda u: u["i"] != u["j"])))
    return placed.select("node", "key", "holder", "region", unit.alias("unit"))


def _linked(rows: DataFrame, units: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b: a forest of each unit's links."""
    # One row's text for each class, by id and text: copies of a text under other ids are not read.
    wanted = units.select("key", "holder").distinct()
    # Other texts, nearly all, are not shuffled.
    held = may_be_in(rows, [F.col("key"), F.col("doc_id")], wanted, ["key", "holder"]).where("_in").select(F.col("key").alias("_key"), "doc_id", "text")
    texts = wanted.join(held, (F.col("key") == F.col("_key")) & F.col("holder").eqNullSafe(F.col("doc_id"))).groupBy("key").agg(F.first("text").alias("text"))
    with_text = units.join(texts, "key").select("region", F.col("unit.i").alias("i"), F.col("unit.j").alias("j"), "node", "text")
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets = [], []
        for batch in batches:
            nodes += batch.column("node").to_pylist()
            for words in words_of(batch.column("text"), lower=True):
                sets += list(sets_of(words, shingle))
        found = links(sets, percent)
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], schema=kind)

    return with_text.groupBy("region", "i", "j").applyInArrow(run, "a long, b long")


def _known(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and of each class its node, its component's root and least doc_id."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(F.col("text")).alias("key"))
    sketched = stage(_sketched(rows, shingle, percent), "jaccard-sketches")
    grouped = sketched.where("n > 0").groupBy(*_CLASS).agg(F.min("doc_id").alias("least"), F.min(F.struct("key", "doc_id")).alias("first"), F.min("pivots").alias("pivots"), F.min("profile").alias("profile"))
    # The row whose text stands for the class.
    grouped = grouped.withColumns({"key": F.col("first.key"), "holder": F.col("first.doc_id")}).drop("first")
    classes = stage(grouped.withColumn("node", F.xxhash64("f1", "f2", "n")), "jaccard-classes")
    regions = stage(_regions(classes, percent), "jaccard-regions")
    members = classes.join(regions, "node").select("node", "key", "holder", "n", F.col("root").alias("region"))
    units = stage(_units(members), "jaccard-units")
    found = stage(_linked(rows, units, shingle, percent), "jaccard-links")
    joined = components(found, "jaccard-components")
    named = classes.select("node", "least").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stage(classes.select(*_CLASS, "node").join(named.select("node", "root"), "node").join(names, "root").select(*_CLASS, "node", "root", "component_id"), "jaccard-known")
    return sketched, known


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row.

    ``component_id`` is the least doc_id that links reach, the row's own included; ``class_id`` numbers equal sets.
    Null and empty texts have an empty set and are linked with nothing. Rows without an id link like others, but
    give no component its name; a component of such rows alone has a null one. Repeated rows have equal
    sets. An empty table gives none; other columns are ignored.
    """
    sketched, known = _known(docs, shingle, percent)
    out = sketched.select("doc_id", *_CLASS).join(known, list(_CLASS), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("node").alias("class_id"))


def survivors(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (``text_key``), kept, copies: one row for every id and text with words; ``copies`` rows of ``docs`` have them.

    ``kept`` is the least of its component by (id is missing, id, key), so one of each, also among rows without an id.
    """
    sketched, known = _known(docs, shingle, percent)
    each = sketched.where("n > 0").groupBy("doc_id", "key", *_CLASS).agg(F.count(F.lit(1)).alias("copies"))
    each = each.join(known.select(*_CLASS, "root"), list(_CLASS)).withColumn("order", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    each = stage(each.select("doc_id", "key", "copies", "root", "order"), "jaccard-rows")
    # Written first, so that Spark can split the tasks of a large component in the join.
    least = stage(each.groupBy("root").agg(F.min("order").alias("least")), "jaccard-least")
    return each.join(least, "root").select("doc_id", "key", F.col("order").eqNullSafe(F.col("least")).alias("kept"), "copies")
