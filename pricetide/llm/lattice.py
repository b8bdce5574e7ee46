"""Near duplicates among embeddings by lattice hashing, verified by cosine.

Vectors that are equal entry by entry are one class from the start.

Cells. A table of the index projects a class's unit vector on BLOCKS random groups of eight directions, and each group's
eight numbers, scaled and shifted, are decoded to the nearest point of the lattice E8. The points together name the
class's cell. Its neighbouring cells are probed too: from a lattice point the 240 shortest lattice vectors lead to its
neighbours, and the nearest combinations are taken, PROBES cells for each of TABLES tables. Two classes meet where they
share a cell. With cosine 0.95 a table misses two in five such pairs, all tables together one in some hundred; from cosine
0.97 on one in a million. Unrelated vectors share a cell once in some hundred thousand pairs.

Verification. Cells with one class are dropped before any vector moves. The classes of the others are compared, by
cosine in doubles, in a task per cell, or, in a cell of more than CELL classes, in a task for every two blocks of it. No
pair leaves a task: it gives how many vectors each of its classes is linked with, and a link of each class to the
first one of its part. A pair that shares several cells counts in the first of them alone (the least cell number), which
both classes' lists of cells tell without asking elsewhere.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import mix, small_batches
from pricetide.llm.components import components
from pricetide.session import stage

COSINE = 0.95
TABLES = 6
BLOCKS = 3
PROBES = 8
# Lattice steps to a unit of the projected vector (which has about sqrt(8 BLOCKS) entries of size 1).
STEP = 0.5
CELL = 1024
# Vectors whose cells are worked out at once.
ROWS = 512
_TABLE_BITS = 8


def _roots() -> np.ndarray:
    """The shortest vectors of E8: two entries of 1 or -1, or all of a half with an even number of minus signs."""
    two = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(two + halves, float)


ROOTS = _roots()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest whole points whose entries add up to an even number."""
    near = np.rint(y)
    gap = y - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(gap[odd]).argmax(axis=1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8: whole points with an even sum, or those moved by a half in every entry."""
    whole = _nearest_even(y)
    half = _nearest_even(y - 0.5) + 0.5
    nearer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


class Tables:
    """The fixed random projections of all tables for vectors of ``d`` entries."""

    def __init__(self, d: int):
        self.d = d
        random = np.random.default_rng([8, d])
        n = 8 * BLOCKS
        self.turns, self.moves, self.marks = [], [], []
        for _ in range(TABLES):
            turn = random.normal(size=(max(d, n), n))
            turn = np.linalg.qr(turn)[0] * np.sqrt(d) if d >= n else turn[:d]
            self.turns.append(turn * STEP)
            self.moves.append(random.uniform(0, 2, n))
            self.marks.append(random.integers(1, 1 << 62, (BLOCKS, 8)).astype(np.uint64))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cells of each unit vector, a row of TABLES x PROBES numbers, rising; the upper bits are the table's."""
        out = []
        for t in range(TABLES):
            y = unit @ self.turns[t] + self.moves[t]
            cost, names = np.zeros((len(unit), 1)), np.full((len(unit), 1), self.d, np.uint64)
            for k in range(BLOCKS):
                block = y[:, 8 * k : 8 * k + 8]
                point = decode(block)
                # A neighbour by v is farther by 2 - 2 (y - point) v.
                along = (block - point) @ ROOTS.T
                best = np.argpartition(-along, PROBES - 2, axis=1)[:, : PROBES - 1]
                far = np.hstack([np.zeros((len(unit), 1)), 2 - 2 * np.take_along_axis(along, best, axis=1)])
                points = np.concatenate([point[:, None], point[:, None] + ROOTS[best]], axis=1)
                named = (np.rint(2 * points).astype(np.int64).view(np.uint64) * self.marks[t][k]).sum(axis=2, dtype=np.uint64)
                cost = (cost[:, :, None] + far[:, None, :]).reshape(len(unit), -1)
                names = (mix(names)[:, :, None] + named[:, None, :]).reshape(len(unit), -1)
                near = np.argpartition(cost, PROBES - 1, axis=1)[:, :PROBES]
                cost, names = np.take_along_axis(cost, near, axis=1), np.take_along_axis(names, near, axis=1)
            numbers = (mix(names) >> np.uint64(_TABLE_BITS)).astype(np.int64)
            out.append(numbers + (np.int64(t) << np.int64(64 - _TABLE_BITS)))
        return np.sort(np.hstack(out), axis=1)


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector as doubles; None where it is null, empty, zero or holds a null or non-finite entry."""
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)
    if flat.null_count:
        bad |= flat.is_null().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    wrong, filled = np.append(0, np.cumsum(bad)), np.append(0, np.cumsum(~bad & (values != 0)))
    starts = ends - lengths
    good = (wrong[ends] == wrong[starts]) & (filled[ends] > filled[starts])
    return [values[a:b] if g else None for a, b, g in zip(starts.tolist(), ends.tolist(), good.tolist(), strict=True)]


def units(rows: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length as unit vectors."""
    m = np.stack(rows)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _keyed(embeddings: DataFrame) -> DataFrame:
    """vec_id, key, embedding; ``key`` is 128 bits of the entries as doubles, null for what links with nothing."""

    def run(batches):
        for batch in batches:
            keys = [None if v is None else blake2b((v + 0.0).tobytes(), digest_size=16).digest() for v in vectors(batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), batch.column("embedding")], names=["vec_id", "key", "embedding"])

    kind = embeddings.schema["embedding"].dataType.simpleString()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, f"vec_id long, key binary, embedding {kind}")


def _signed(classes: DataFrame) -> DataFrame:
    """key, copies, cells, embedding."""

    def run(batches):
        tables: dict[int, Tables] = {}
        for batch in batches:
            rows = vectors(batch.column("embedding"))
            lengths = np.array([len(v) for v in rows])
            cells = np.zeros((len(rows), TABLES * PROBES), np.int64)
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                table = tables.setdefault(d, Tables(d))
                for at in range(0, len(own), ROWS):
                    some = own[at : at + ROWS]
                    cells[some] = table.cells(units([rows[i] for i in some]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), lists, batch.column("embedding")], names=["key", "copies", "cells", "embedding"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("key", "copies", "embedding").mapInArrow(run, f"key binary, copies long, cells array<long>, embedding {kind}")


def _tasks(signed: DataFrame) -> DataFrame:
    """key, cell, i, j, block: the tasks that a class goes to. A cell of one class has none."""
    placed = signed.select("key", F.explode("cells").alias("cell"))
    # Written first, so that Spark can split the tasks of a large cell in the join.
    shared = stage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lattice-cells")
    blocks = F.ceil(F.col("n") / F.lit(CELL)).cast("int")
    placed = placed.join(shared.select("cell", blocks.alias("blocks")), "cell")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key", F.lit(13)), F.col("blocks")).cast("int"))
    # Every two blocks meet in one task, and each has one for itself.
    two = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return placed.select("key", "cell", "block", F.explode(two).alias("t")).select("key", "cell", "t.i", "t.j", "block")


def _earlier(cells: np.ndarray, cell: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows share a cell before ``cell``; ``cells`` has a rising list in each row."""
    before = cells < cell
    ids, numbers = np.unique(cells[before], return_inverse=True)
    if not len(ids):
        return np.zeros(len(left), bool)
    numbered = np.full(cells.shape, -1, np.int64)
    numbered[before] = numbers
    often = np.bincount(numbers, minlength=len(ids)) > 1
    where = np.cumsum(often) - 1
    holds = np.zeros((len(cells), int(often.sum())), bool)
    row, _ = np.nonzero(before)
    kept = often[numbers]
    holds[row[kept], where[numbers[kept]]] = True
    bits = np.packbits(holds, axis=1)
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), 1 << 16):
        some = slice(at, at + (1 << 16))
        out[some] = (bits[left[some]] & bits[right[some]]).any(axis=1)
    return out


def compared(keys: list, copies: np.ndarray, cells: np.ndarray, rows: list[np.ndarray], second: np.ndarray | None, cell: int, cosine: float) -> tuple[list, list[int], list]:
    """key, linked vectors, first key of its part: for each class with a link in a task that is counted here.

    ``second`` says which classes are of the task's second block, None if it has one: only pairs across are compared.
    """
    order = sorted(range(len(keys)), key=lambda i: (second is not None and bool(second[i]), keys[i]))
    unit = units([rows[i] for i in order])
    if second is None:
        left, right = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    else:
        cut = len(order) - int(second.sum())
        left, right = np.nonzero(unit[:cut] @ unit[cut:].T >= cosine)
        right = right + cut
    if not len(left):
        return [], [], []
    new = ~_earlier(cells[order], cell, left, right)
    left, right = left[new], right[new]
    if not len(left):
        return [], [], []
    weight = copies[order].astype(float)
    links = np.bincount(left, weight[right], len(order)) + np.bincount(right, weight[left], len(order))
    # The least position that a class is linked with, followed until nothing changes.
    root = np.arange(len(order))
    while True:
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        low = low[low]
        if (low == root).all():
            break
        root = low
    found = np.flatnonzero(links)
    return [keys[order[i]] for i in found], links[found].astype(np.int64).tolist(), [keys[order[root[i]]] for i in found]


def _linked(signed: DataFrame, cosine: float) -> DataFrame:
    """key, links, root: of each task, its classes with links."""
    tasks = stage(_tasks(signed), "lattice-tasks")
    full = tasks.join(signed, "key").select("cell", "i", "j", "block", "key", "copies", "cells", "embedding")
    names = ("cell", "i", "j")
    out = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def told(rows: pa.Table) -> pa.RecordBatch:
        """All tasks of ``rows``, which are in their order."""
        ids = np.stack([rows.column(c).to_numpy() for c in names], axis=1)
        starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
        keys, copies = rows.column("key").to_pylist(), rows.column("copies").to_numpy()
        cells = rows.column("cells").combine_chunks().flatten().to_numpy().reshape(-1, TABLES * PROBES)
        side = rows.column("block").to_numpy()
        of = vectors(rows.column("embedding").combine_chunks())
        found: list[list] = [[], [], []]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            for d in {len(v) for v in of[a:b]}:
                own = [i for i in range(a, b) if len(of[i]) == d]
                if len(own) > 1:
                    cell, low, high = ids[a].tolist()
                    parts = compared([keys[i] for i in own], copies[own], cells[own], [of[i] for i in own], None if low == high else side[own] == high, cell, cosine)
                    for have, more in zip(found, parts, strict=True):
                        have += more
        return pa.RecordBatch.from_arrays([pa.array(f, kind.type) for f, kind in zip(found, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            last = [rows.column(c)[-1].as_py() for c in names]
            same = np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(names, last, strict=True)])
            open_at = int(same.argmax())
            if open_at:
                yield told(rows.slice(0, open_at))
            rest = rows.slice(open_at)
        if rest is not None:
            yield told(rest)

    ordered = full.repartition(*names).sortWithinPartitions(*names)
    return ordered.mapInArrow(run, "key binary, links long, root binary")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept, class_id for every row.

    ``n_links`` counts the other rows at a cosine of ``cosine`` or more, ``component_id`` is the least vec_id that links reach,
    ``kept`` says that this is the row's own, ``class_id`` is the key of equal vectors. Vectors that are null, empty, zero
    or hold a null or non-finite entry link with nothing and have no class; vectors of different lengths never link.
    Rows without an id link like others, give no component its name and are not kept; a component of such rows alone
    has a null name. Repeated rows are linked with each other. An empty table gives none; other columns are ignored.
    """
    small_batches(embeddings.sparkSession)
    rows = stage(_keyed(embeddings), "lattice-rows")
    grouped = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = stage(grouped, "lattice-classes")
    signed = stage(_signed(classes), "lattice-signed")
    found = stage(_linked(signed, cosine), "lattice-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct(), "lattice-components")
    known = classes.join(links, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    known = stage(known.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")), "lattice-known")
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stage(known.join(names, "root").select("key", "n_links", "component_id"), "lattice-named")
    # Written, so that Spark can split the tasks of a vector with very many copies.
    out = rows.select("vec_id", "key").join(known, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(component == F.col("vec_id"), F.lit(False))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"), F.hex("key").alias("class_id"))


def sql() -> str:
    """The same by all pairs, for a table that is small enough."""
    return f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
                embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
            FROM embeddings),
        linked AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
            WHERE a.ok AND b.ok AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= {COSINE}),
        reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN linked l ON l.a = r.b),
        named AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
        counted AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
        SELECT v.vec_id, coalesce(c.n, 0) AS n_links, m.component_id, m.component_id = v.vec_id AS kept
        FROM v JOIN named m ON m.a = v.vec_id LEFT JOIN counted c ON c.a = v.vec_id"""
