"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards.

Index. A pass over all documents gives how often each holds the terms asked for, and its length; the sums over all
documents are the statistics of the score. Each task then turns the documents it reads into shards. A shard
has a list of postings for each term, in the order of the ids, cut into blocks. A block is compressed (steps between documents and frequencies in the fewest bits they need) and has, beside its first and
last document, the greatest part that it can add to a score. A shard is a row of the index; nothing is shuffled.

Search. A shard is searched for all items. The terms of an item are ordered by the bounds of their lists; those whose bounds
together stay below the least score that still counts are non-essential: a document that holds no other term can't be
among the best. So candidates come from the essential lists alone, a range of documents at a time. The block maxima of the
non-essential lists are added to a candidate's score first, and only blocks of candidates that pass are
decompressed, from the highest bound down, each after the candidates have been checked again. The 50 best of a shard, with
the least id first among equals, are kept as the range goes on, and raise the least score.

Shards are searched in two rounds: the best found in a part of them (one in eight, by a hash) are merged, and the last of an
item's best is a score that the other shards must reach, which leaves them little to unpack and almost
nothing to return. The results of both rounds are merged. All numbers are whole, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import BASE, INVERSE, _LOWER, as_bytes, mix, pieces, powers, small_batches
from pricetide.session import stage

BEST = 50
# Terms (8 bytes each) that are looked for in one pass over the documents.
MOST_TERMS = 500_000
# The score's constants.
UNIT, STEEP, LENGTH, FLAT = 1_000_000_000, 1000, 20, 50



@dataclass(frozen=True)
class Layout:
    """Sizes of the index, which change the cost alone.

    A shard has at most ``docs`` documents and is closed above so many ``postings``; a block has ``block`` postings; candidates
    come ``span`` documents at a time; one shard in ``seeds`` is searched first.
    """

    docs: int = 1 << 15
    postings: int = 1 << 21
    block: int = 128
    span: int = 1 << 13
    seeds: int = 8


_OPEN = np.zeros(256, bool)
_OPEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, term hashes and where each text's terms begin, a few texts at a time.

    A term is a run of ASCII letters and digits and of all characters beyond ASCII, whose bytes are 0x80 or more.
    """
    data, offsets = as_bytes(texts)
    for low, high in pieces(offsets):
        own = offsets[low : high + 1] - offsets[low]
        part = data[offsets[low] : offsets[high]]
        n = len(part)
        term = _OPEN[part]
        begins = np.zeros(n + 1, bool)
        begins[own] = True
        opens, closes = term.copy(), term.copy()
        opens[1:] &= ~term[:-1] | begins[1:-1]
        closes[:-1] &= ~term[1:] | begins[1:-1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * powers(INVERSE, n + 1)[starts])
        yield slice(low, high), hashes.view(np.int64), np.searchsorted(starts, own)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: once each."""

    def run(batches):
        for batch in batches:
            ids = batch.column("item_id").to_numpy(zero_copy_only=False)
            for rows, hashes, first in terms_of(batch.column("text")):
                owner = np.repeat(ids[rows], np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(hashes)], names=["item_id", "term"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, term long").distinct()


def counted(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, n, terms, counts: length in terms, and those of ``terms`` (rising) that it holds, of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        asked = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, hashes, first in terms_of(batch.column("text")):
                n = np.diff(first)
                where = np.minimum(np.searchsorted(asked, hashes), max(len(asked) - 1, 0))
                hit = np.flatnonzero(asked[where] == hashes) if len(asked) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(n)), n)[hit]
                pair, times = np.unique(owner * max(len(asked), 1) + where[hit], return_counts=True)
                each = np.searchsorted(pair, np.arange(len(n) + 1) * max(len(asked), 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(each), pa.array(v.astype(np.int64))) for v in ((asked[pair % len(asked)] if len(asked) else pair), times)]
                out = pa.RecordBatch.from_arrays([ids.slice(rows.start, rows.stop - rows.start), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<long>, counts array<long>")


def length_terms(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """m of documents of ``n`` terms: Python's numbers where 64 bits are too few."""
    if int(n.max(initial=0)) * FLAT * docs < 1 << 62:
        return 100 - FLAT + FLAT * n * docs // max(length, 1)
    return np.array([100 - FLAT + FLAT * int(k) * docs // length for k in n], np.int64)


def parts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds for each of its weight."""
    return UNIT * counts // (STEEP * counts + LENGTH * m)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bits that hold each: the number of bits, then the bits."""
    width = int(values.max(initial=0)).bit_length()
    bits = (values[:, None] >> np.arange(width)) & 1
    return bytes([width]) + np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpacked(data: memoryview, count: int) -> tuple[np.ndarray, int]:
    """The numbers, and the bytes they took."""
    width = data[0]
    size = (width * count + 7) // 8
    bits = np.unpackbits(np.frombuffer(data[1 : 1 + size], np.uint8), count=width * count).reshape(count, width)
    return bits @ (np.int64(1) << np.arange(width, dtype=np.int64)), 1 + size


def compressed(docs: np.ndarray, counts: np.ndarray) -> bytes:
    """A block: how many postings, steps between documents from its first one, frequencies less 1."""
    return bytes([len(docs) - 1]) + packed(np.diff(docs) - 1) + packed(counts - 1)


def decompressed(data: memoryview, first: int) -> tuple[np.ndarray, np.ndarray]:
    n = data[0] + 1
    steps, size = unpacked(data[1:], n - 1)
    docs = np.full(n, first, np.int64)
    docs[1:] += np.cumsum(steps + 1)
    return docs, unpacked(data[1 + size :], n)[0] + 1


# A shard: its documents (ids and m) and, for each block of each list, in the order of term and first document, its term, first
# and last document (their places in the shard), greatest part and end in the bytes of all blocks. Arrays are bytes of 64-bit numbers.
_SHARD = ("ids", "m", "terms", "firsts", "lasts", "maxima", "ends")
SHARD_SCHEMA = "docs int, " + ", ".join(f"{c} binary" for c in _SHARD) + ", blocks binary"


def shard(ids: np.ndarray, m: np.ndarray, each: np.ndarray, terms: np.ndarray, counts: np.ndarray, block: int = Layout.block) -> pa.RecordBatch:
    """A row of the index from documents and their postings; ``each`` is how many a document has."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    owner = np.repeat(place, each)
    by_term = np.lexsort((owner, terms))
    owner, terms, counts = owner[by_term], terms[by_term], counts[by_term]
    m = m[order]
    value = parts(counts, m[owner])
    opens = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    inside = np.arange(len(terms)) - np.repeat(opens, np.diff(np.append(opens, len(terms))))
    starts = np.flatnonzero(inside % block == 0)
    ends = np.append(starts[1:], len(terms)) if len(starts) else starts
    blocks = [compressed(owner[a:b], counts[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    maxima = np.maximum.reduceat(value, starts) if len(starts) else starts
    arrays = (ids[order], m, terms[starts], owner[starts], owner[ends - 1], maxima, np.cumsum([len(b) for b in blocks], dtype=np.int64))
    columns = [pa.array([len(ids)], pa.int32()), *[pa.array([np.ascontiguousarray(a, np.int64).tobytes()], pa.binary()) for a in arrays], pa.array([b"".join(blocks)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["docs", *_SHARD, "blocks"])


def build_index(counts: DataFrame, docs: int, length: int, layout: Layout) -> DataFrame:
    """Shards (SHARD_SCHEMA) of the documents of ``counted`` that hold a term, for ``docs`` documents of ``length`` terms in all."""

    def run(batches):
        held: list[tuple] = []
        rows = postings = 0

        def closed():
            return shard(*[np.concatenate(c) for c in zip(*held, strict=True)], layout.block)

        for batch in batches:
            each = np.diff(batch.column("terms").offsets.to_numpy())
            ids, n = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            terms, times = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            bounds = np.append(0, np.cumsum(each))
            low = 0
            while low < len(ids):
                fits = int(np.searchsorted(bounds, bounds[low] + layout.postings - postings, "right")) - 1
                high = min(low + layout.docs - rows, len(ids), max(fits, low + 1))
                held.append((ids[low:high], length_terms(n[low:high], docs, length), each[low:high], terms[bounds[low] : bounds[high]], times[bounds[low] : bounds[high]]))
                rows, postings, low = rows + high - low, postings + int(bounds[high] - bounds[low]), high
                if rows >= layout.docs or postings >= layout.postings:
                    yield closed()
                    held, rows, postings = [], 0, 0
        if rows:
            yield closed()

    return counts.where("size(terms) > 0 and doc_id is not null").mapInArrow(run, SHARD_SCHEMA)


@dataclass
class Work:
    """What a search did: blocks unpacked, blocks there were in the items' lists, candidates, and those given up by block maxima."""

    unpacked: int = 0
    blocks: int = 0
    candidates: int = 0
    rejected: int = 0


@dataclass
class Shard:
    """A row of the index, unpacked block by block as far as it is needed; blocks unpacked once are kept for the next item."""

    row: dict
    span: int = Layout.span
    work: Work = field(default_factory=Work)

    def __post_init__(self):
        for name in _SHARD:
            setattr(self, name, np.frombuffer(self.row[name], np.int64))
        self.data = memoryview(self.row["blocks"])
        self.begin = np.append(0, self.ends[:-1])
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, term: int) -> tuple[int, int]:
        return int(np.searchsorted(self.terms, term)), int(np.searchsorted(self.terms, term, "right"))

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and parts of a block's postings."""
        have = self.kept.get(k)
        if have is None:
            docs, counts = decompressed(self.data[int(self.begin[k]) : int(self.ends[k])], int(self.firsts[k]))
            have = self.kept[k] = docs, parts(counts, self.m[docs])
            self.work.unpacked += 1
        return have

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, best: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``best`` documents whose score is at least ``least``; equal scores by the least id."""
        lists = [(*self.list_of(int(t)), int(w)) for t, w in zip(terms, weights, strict=True) if w > 0]
        lists = [(a, b, w, w * int(self.maxima[a:b].max())) for a, b, w in lists if b > a]
        lists.sort(key=lambda x: x[3])
        self.work.blocks += sum(b - a for a, b, _, _ in lists)
        bounds = np.cumsum([x[3] for x in lists])
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = max(least, 1)
        for low in range(0, len(self.ids), self.span):
            high = min(low + self.span, len(self.ids))
            # Lists before this one can't reach the least score together.
            split = int(np.searchsorted(bounds, least))
            if split == len(lists):
                break
            total = np.zeros(high - low, np.int64)
            for a, b, w, _ in lists[split:]:
                for k in range(a + int(np.searchsorted(self.lasts[a:b], low)), a + int(np.searchsorted(self.firsts[a:b], high))):
                    docs, value = self.block(k)
                    if docs[0] < low or docs[-1] >= high:
                        inside = (docs >= low) & (docs < high)
                        docs, value = docs[inside], value[inside]
                    total[docs - low] += w * value
            near = np.flatnonzero(total)
            self.work.candidates += len(near)
            score, places = total[near], near + low
            # For each other list, the block that could hold each candidate, and what it can add at most.
            waiting = []
            for a, b, w, _ in lists[:split]:
                k = a + np.searchsorted(self.lasts[a:b], places)
                there = k < b
                k = np.minimum(k, b - 1)
                there &= self.firsts[k] <= places
                waiting.append((k, there, w * np.where(there, self.maxima[k], 0), w))
            hope = score + sum((x[2] for x in waiting), np.zeros(len(near), np.int64))
            alive = hope >= least
            self.work.rejected += int((~alive).sum())
            while waiting:
                k, there, most, w = waiting.pop()
                where = np.flatnonzero(alive & there)
                for block in np.unique(k[where]).tolist():
                    docs, value = self.block(block)
                    own = where[k[where] == block]
                    at = np.minimum(np.searchsorted(docs, places[own]), len(docs) - 1)
                    score[own] += np.where(docs[at] == places[own], w * value[at], 0)
                hope = score + sum((x[2] for x in waiting), np.zeros(len(near), np.int64))
                alive &= hope >= least
            ids, scores = np.append(ids, self.ids[places[alive]]), np.append(scores, score[alive])
            if len(ids) > best:
                order = np.lexsort((ids, -scores))[:best]
                ids, scores = ids[order], scores[order]
            if len(ids) == best:
                least = max(least, int(scores.min()))
        return ids, scores


def _searched(index: DataFrame, queries, best: int, layout: Layout) -> DataFrame:
    """item_id, doc_id, score: the best of each shard; ``queries`` has (item, terms, weights, least score) for each item."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                one = Shard(row, layout.span)
                found = [(item, *one.search(terms, weights, least, best)) for item, terms, weights, least in shared.value]
                items = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def _merged(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _blocks_of_items(items: DataFrame, most: int) -> Iterator[dict[int, np.ndarray]]:
    """The items' terms, as many items at a time as hold ``most`` terms."""
    now: dict[int, np.ndarray] = {}
    size = 0
    for r in items.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("item_id").toLocalIterator():
        if size and size + len(r["terms"]) > most:
            yield now
            now, size = {}, 0
        now[r["item_id"]] = np.array(r["terms"], np.int64)
        size += len(r["terms"])
    if now:
        yield now


def search(docs: DataFrame, items: DataFrame, best: int = BEST, most_terms: int = MOST_TERMS, layout: Layout = Layout()) -> DataFrame:  # noqa: B008
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0, equal scores by the least id.

    Items (the query set) are worked off in blocks of at most ``most_terms`` terms, a pass over the documents for each. Items or documents
    without a term, with a null text or a null id give nothing (documents without an id still count in the statistics). Repeated
    rows are documents like others and may give equal rows; items that share an id are one item. Empty tables give
    none; other columns are ignored. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = stage(item_terms(items), "ranked-items")
    results = []
    for block in _blocks_of_items(asked, most_terms):
        terms = np.unique(np.concatenate(list(block.values())))
        counts = stage(counted(docs, terms), "ranked-counts")
        sums = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
        number, length = sums["docs"], int(sums["length"] or 0)
        held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df = {r["term"]: r["df"] for r in held.toLocalIterator()}
        index = stage(build_index(counts, number, length, layout), "ranked-index")
        weight = {t: int(np.floor(1000 * np.log((2 * number + 2) / (2 * n + 1)))) for t, n in df.items()}

        def queries(least: dict[int, int], block=block, weight=weight) -> list[tuple]:
            found = [(item, [t for t in terms.tolist() if t in weight]) for item, terms in block.items()]
            return [(item, np.array(terms, np.int64), np.array([weight[t] for t in terms], np.int64), least.get(item, 1)) for item, terms in found]

        # By what the shard holds, so that a shard is in the same round when a task runs again.
        first = F.pmod(F.xxhash64("ids", "ends"), F.lit(layout.seeds)) == 0
        early = stage(_merged(_searched(index.where(first), queries({}), best, layout), best), "ranked-first")
        least = {r["item_id"]: r["score"] for r in early.where(F.col("rank") == best).select("item_id", "score").toLocalIterator()}
        late = _searched(index.where(~first), queries(least), best, layout)
        results.append(early.drop("rank").union(late))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return _merged(out, best).select("item_id", "rank", "doc_id", "score")


def sql() -> str:
    """The same over all pairs of a term's postings and items."""
    split = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
        WITH words AS (SELECT doc_id, unnest({split.format("text")}) AS term FROM documents WHERE text IS NOT NULL),
        lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lengths),
        counts AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY term, doc_id),
        weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term, docs),
        asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({split.format("text")}) AS term FROM benchmark)),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(w * (({UNIT} * tf) // ({STEEP} * tf + {LENGTH} * (100 - {FLAT} + ({FLAT} * n * docs) // length)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), total
            GROUP BY item_id, doc_id),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}"""
