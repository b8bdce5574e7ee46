"""Lines of later documents that stand in an earlier one, by patience alignment of overlapping documents.

Documents are ordered by (doc_id, text hash), those without an id last. A line is what stands between line ends,
without outer white space; lines without a word are never removed. Every line shared by documents points each
later document to the first one that holds it, so a line in a million documents gives a million pairs, not half a
trillion, and needs no cutoff; the rarest shared line of a pair is kept with it. A block of short lines may have its lines
from several documents, so the shortest runs of lines from each line, forward and backward, that have MIN_WORDS words point
to their first holder too: every line of a block that long is in one of them. Each pair is aligned on its own:
lines that are unique in both, in the longest common order, are anchors; before, between and after anchors
neighbouring equal lines join them, and the parts between are treated alike. A part without such a line, whose shared
lines are repeated on a side, is aligned by the heaviest common subsequence of these, in words, and then in the
fewest blocks. Aligned blocks of MIN_WORDS words or more are deleted from the later document. A removed line still stands in the earlier document as long as
that one, in turn, did not lose it to a still earlier one, whose line is the same.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import BASE, INVERSE, WORD, mix, powers, small_batches, unused
from pricetide.session import stage

MIN_WORDS = 8
# Places where two equal lines meet that are kept at once; a part with more is halved.
MOST_PLACES = 2_000_000
_ID = ("none", "doc_id", "key")


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of lines unique in both lists, in the longest order common to both."""
    in_a, in_b = Counter(a), Counter(b)
    at_b = {x: j for j, x in enumerate(b) if in_b[x] == 1}
    pairs = [(i, at_b[x]) for i, x in enumerate(a) if in_a[x] == 1 and x in at_b]
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k : k + 1] = [j]
        ends[k : k + 1] = [n]
        back.append(ends[k - 1] if k else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _chains(rows: list[tuple[int, np.ndarray]], width: int, keep: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Best scores up to each of ``width`` columns, and with ``keep`` the matches (row, column) of the best one.

    ``rows`` are the weight of a line and the columns it may be matched with. A match scores its weight, and a chain loses
    one for every match that does not follow the one before in the next row and column (a row of no columns parts too).
    """
    best, who = np.zeros(width + 1, np.int64), np.full(width + 1, -1, np.int64)
    last, last_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, columns, backs, scores, total = [0], [], [], [], 0
    for weight, at in rows:
        if not len(at):
            last, last_at = at, at
            first.append(total)
            continue
        score, back = best[at] - 1, who[at]
        if len(last_at):
            k = np.minimum(np.searchsorted(last_at, at - 1), len(last_at) - 1)
            joins = (last_at[k] == at - 1) & (last[k] >= score)
            score, back = np.where(joins, last[k], score), np.where(joins, first[-2] + k, back)
        score = score + weight
        raised = best.copy()
        raised[at + 1] = np.maximum(raised[at + 1], score)
        raised = np.maximum.accumulate(raised)
        if keep:
            new = (score == raised[at + 1]) & (score > best[at + 1])
            source = np.zeros(width + 1, np.int64)
            source[at[new] + 1] = np.flatnonzero(new) + total + 1
            source = np.maximum.accumulate(source)
            who = np.where(raised > best, source - 1, who)
            columns.append(at)
            backs.append(back)
        best, last, last_at = raised, score, at
        total += len(at)
        first.append(total)
    if not keep or who[-1] < 0:
        return best, []
    column, back, starts = np.concatenate(columns), np.concatenate(backs), np.array(first)
    out, n = [], int(who[-1])
    while n >= 0:
        out.append((int(np.searchsorted(starts, n, "right")) - 1, int(column[n])))
        n = int(back[n])
    return best, out[::-1]


def heaviest(a: list, b: list, weights: list[int]) -> list[tuple[int, int]]:
    """Matches of the heaviest common subsequence (``weights``: of the lines of ``a``; those of weight 0 don't count)."""
    posted: dict = {}
    for j, x in enumerate(b):
        posted.setdefault(x, []).append(j)
    places = {x: np.array(p, np.int64) for x, p in posted.items()}
    none = np.zeros(0, np.int64)
    # One match is worth more than all the places where a chain may part.
    unit = len(a) + 1
    rows = [(w * unit, places.get(x, none) if w else none) for x, w in zip(a, weights, strict=True)]
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        part = [(w, at[np.searchsorted(at, b0) : np.searchsorted(at, b1)] - b0) for w, at in rows[a0:a1]]
        if a1 - a0 == 1 or sum(len(at) for _, at in part) <= MOST_PLACES:
            out += [(a0 + i, b0 + j) for i, j in _chains(part, b1 - b0, True)[1]]
            continue
        half = (a1 - a0) // 2
        above = _chains(part[:half], b1 - b0, False)[0]
        below = _chains([(w, b1 - b0 - 1 - at[::-1]) for w, at in part[:half - 1 : -1]], b1 - b0, False)[0]
        cut = int(np.argmax(above + below[::-1]))
        todo += [(a0, a0 + half, b0, b0 + cut), (a0 + half, a1, b0 + cut, b1)]
    return sorted(out)


def align(a: list[int | None], b: list[int | None], words: list[int] | None = None) -> list[tuple[int, int]]:
    """Matched positions of two lists of lines, rising in both (``words``: per line of ``a``, else 1 each)."""
    words = [1] * len(a) if words is None else words
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        found = anchors(a[a0:a1], b[b0:b1])
        if not found and not set(a[a0:a1]).isdisjoint(b[b0:b1]):
            found = heaviest(a[a0:a1], b[b0:b1], words[a0:a1])
        last = (a0, b0)
        for i, j in found:
            todo.append((last[0], a0 + i, last[1], b0 + j))
            out.append((a0 + i, b0 + j))
            last = (a0 + i + 1, b0 + j + 1)
        if found:
            todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def blocks(matched: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Matches that follow each other without a gap in both lists."""
    run: list[tuple[int, int]] = []
    for i, j in matched:
        if run and (run[-1][0] + 1, run[-1][1] + 1) != (i, j):
            yield run
            run = []
        run.append((i, j))
    if run:
        yield run


def common_lines(later: list[int | None], earlier: list[int | None], words: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Lines of ``later`` in aligned blocks that have ``min_words`` words together (``words``: per line of it)."""
    out: list[int] = []
    for run in blocks(align(later, earlier, words)):
        if sum(words[i] for i, _ in run) >= min_words:
            out += [i for i, _ in run if words[i]]
    return out


def _identity(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in _ID])


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.split(text, "\n").alias("l"))
    words = F.transform("l", lambda x: F.regexp_count(x, F.lit(WORD)))
    hashes = F.transform("l", lambda x: F.xxhash64(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")))
    return rows.select(*_ID, hashes.alias("lines"), words.alias("words"))


def runs(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive lines that have ``min_words`` words: the number of their document, and a hash.

    From each line with words but fewer than that, the shortest run that begins and the shortest that ends with it.
    Document i has the lines from ``first[i]`` to ``first[i + 1]``.
    """
    n = len(hashes)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.flatnonzero((words > 0) & (words < min_words))
    own, low, high = owner[at], at, np.searchsorted(total, total[at] + min_words)
    inside = high <= first[own + 1]
    back_high = at + 1
    back_low = np.searchsorted(total, total[back_high] - min_words, "right") - 1
    back_inside = (total[back_high] - min_words >= 0) & (back_low >= first[own])
    doc = np.concatenate([own[inside], own[back_inside]])
    low, high = np.concatenate([low[inside], back_low[back_inside]]), np.concatenate([high[inside], back_high[back_inside]])
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes) * powers(BASE, n), out=summed[1:])
    found = mix((summed[high] - summed[low]) * powers(INVERSE, n + 1)[low] + (high - low).astype(np.uint64))
    return doc, found


def _keys(lines: DataFrame, min_words: int) -> DataFrame:
    """doc, keys: hashes of the lines with words of each document, and of its runs of short lines."""

    def run(batches):
        for batch in batches:
            hashes, words = (batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c) for c in ("lines", "words"))
            first = hashes.offsets.to_numpy().astype(np.int64)
            first -= first[0]
            value = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            count = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc, found = runs(value, count, first, min_words)
            filled = count > 0
            doc = np.concatenate([np.repeat(np.arange(len(first) - 1), np.diff(first))[filled], doc])
            found = np.concatenate([value[filled], found])
            order = np.argsort(doc, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(first) - 1))])
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), keys], names=["doc", "keys"])

    return lines.select(_identity().alias("doc"), "lines", "words").mapInArrow(run, "doc struct<none: boolean, doc_id: long, key: long>, keys array<long>")


def _deletions(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, key, gone: line numbers to delete, for the documents that lose any."""
    lines = stage(_lines(docs), "line-hashes")
    # Written, so that the two branches below don't make the runs twice.
    held = stage(_keys(lines, min_words), "line-keys").select("doc", F.explode(F.array_distinct("keys")).alias("line"))
    # Repeated rows are one document here. Written first, so that Spark can split the tasks of a frequent line in the join.
    first = stage(held.groupBy("line").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("documents")).where("documents > 1"), "line-firsts")
    pairs = held.join(first, "line").where(F.col("doc") != F.col("first"))
    pairs = pairs.groupBy("doc", "first").agg(F.min("documents").alias("rarest"))
    mine = lines.dropDuplicates(list(_ID)).select(_identity().alias("doc"), F.col("lines").alias("later"), "words")
    theirs = mine.select(F.col("doc").alias("first"), F.col("later").alias("earlier"))
    joined = pairs.join(theirs, "first").join(mine, "doc").select("doc", "later", "words", "earlier")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                later, words, earlier = (part.column(c).to_pylist() for c in ("later", "words", "earlier"))
                gone = [common_lines(*x, min_words) for x in zip(later, earlier, words, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(gone, pa.list_(pa.int32()))], names=["doc", "gone"])

    found = joined.mapInArrow(run, "doc struct<none: boolean, doc_id: long, key: long>, gone array<int>").where(F.size("gone") > 0)
    each = found.select("doc", F.explode("gone").alias("line")).groupBy("doc").agg(F.collect_set("line").alias("gone"))
    return each.select(F.col("doc.doc_id").alias("_doc_id"), F.col("doc.key").alias("_key"), "gone")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without its deleted lines; new: n_lines, n_removed and words_left.

    A null text stays null, without lines removed. Rows equal in id and text are one document and lose the same
    lines. Rows without an id count as the last ones. An empty table gives none. Columns of ``docs`` that are named
    like the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    gone = stage(_deletions(docs, min_words), "line-deletions")
    docs = docs.drop("n_lines", "n_removed", "words_left")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own, other, other_key, lost_lines = unused(docs.columns, "_own", "_doc_id", "_key", "_gone")
    gone = gone.toDF(other, other_key, lost_lines)
    joined = docs.withColumn(own, key).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.col(own) == F.col(other_key)), "left")
    kept = joined.withColumn("text", F.col("text").cast("string")).drop(other, other_key, own)
    names = [c for c in kept.columns if c != lost_lines]
    schema = kept.drop(lost_lines).withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "words_left": F.lit(True)}).schema

    def run(batches):
        for batch in batches:
            texts, lost = batch.column("text").to_pylist(), batch.column(lost_lines).to_pylist()
            out, n, less = [], [], []
            for text, gone in zip(texts, lost, strict=True):
                parts = [] if text is None else text.split("\n")
                drop = set(gone or ())
                n.append(len(parts))
                less.append(len(drop))
                out.append(text if not drop else "\n".join([x for i, x in enumerate(parts) if i not in drop]))
            left = np.array([x is None or not d or bool(x.strip(" \t\n\x0b\x0c\r")) for x, d in zip(out, less, strict=True)], bool)
            new = {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([*(new.get(c, batch.column(c)) for c in names), pa.array(n, pa.int64()), pa.array(less, pa.int64()), pa.array(left)], names=[*names, "n_lines", "n_removed", "words_left"])

    return kept.select(*[F.col(f"`{c}`") for c in names], lost_lines).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
