"""Substring duplicates by relative Lempel-Ziv factoring against the indexed blocks of all documents.

A window is WINDOW consecutive words of one document. A word is a duplicate if a window that covers it begins
anywhere else too, in the same document or in another.

Blocks. Every window has an anchor: its gram of GRAM words with the least hash (the first of equals). Equal windows
have equal anchors at the same place. Windows that follow each other and share an anchor form a block, a
stretch of at most WINDOW - 1 + STEP words, STEP = WINDOW - GRAM + 1. A document is cut into its blocks by its own words alone,
so documents that share a passage share the blocks inside it, wherever the passage stands.

Reference. Anchors are counted over all documents (a row per block, less than a tenth of the rows that windows
would give; equal ones are added up before they are shuffled). Where an anchor stands twice, its blocks are the
indexed reference: every block is indexed with the number and the least of its places, its source.

Factoring. A document is factored greedily from the left: a block that the index knows twice opens a factor, which
copies the reference from the block's source, and every following block (and window, see below) whose source
goes on where the factor's copy ends extends it. A block found once under an anchor that has no
other block is literal text. What is left is a block found once whose anchor has other blocks too: there a factor
begins or ends within the block. These boundary blocks, and the source of each other block under the same
anchor, are taken apart into their windows, and the windows are counted: a window found twice extends the factor beside
it word by word, or opens one. Factors of WINDOW words and more are all there are, and those that touch make one span.
So every window that begins twice is found, and no two documents are ever paired.

Windows, anchors and blocks are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import BASE, INVERSE, Words, mix, powers, small_batches, words_of
from pricetide.session import stage

WINDOW = 35
GRAM = 10

_BLOCK = "anchor long, block long, doc_id long, key long, first int, windows int"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every ``width`` consecutive values, the first of equals."""
    best, have = np.arange(len(values)), 1
    while have < width:
        by = min(have, width - have)
        left, right = best[: len(best) - by], best[by:]
        best = np.where(values[left] <= values[right], left, right)
        have += by
    return best


def blocks(words: Words, window: int = WINDOW, gram: int = GRAM):
    """anchor, block, text number, first window of the block in its text, number of windows, for all texts."""
    grams, gram_first = words.grams(gram)
    windows, window_first = words.grams(window)
    counts = np.diff(window_first)
    n = int(window_first[-1])
    if not n:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    text = np.repeat(np.arange(len(words)), counts)
    within = np.arange(n) - window_first[text]
    # Grams of a text that has a window stand without gaps, so its windows see only its own grams.
    at = gram_first[text] + within
    best = _sliding_least(grams, window - gram + 1)[at]
    new = np.ones(n, bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    # The words of a block are given by its first and last window and the number of windows between them.
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(windows * powers(BASE, n), out=total[1:])
    block = mix((total[first + size] - total[first]) * powers(INVERSE, n)[first] + size.astype(np.uint64))
    return grams[best[first]], block, text[first], within[first], size


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def _anchors(rows: DataFrame) -> DataFrame:
    """anchor, n: equal anchors of a batch are added up at once."""

    def run(batches):
        for batch in batches:
            parts = [blocks(w)[0] for w in words_of(batch.column("text"))]
            if parts:
                anchor, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(anchor), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return rows.select("text").mapInArrow(run, "anchor long, n long")


def _placed(rows: DataFrame) -> DataFrame:
    """Every block of every document with its place."""

    def run(batches):
        for batch in batches:
            doc_id, key = batch.column("doc_id"), batch.column("key")
            for words in words_of(batch.column("text")):
                anchor, block, text, first, size = blocks(words)
                row = pa.array(text + words.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor), _signed(block), doc_id.take(row), key.take(row), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["anchor", "block", "doc_id", "key", "first", "windows"],
                )

    return rows.select("doc_id", "key", "text").mapInArrow(run, _BLOCK)


def parse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of every document under anchors that stand at two places or more, with what the index knows of them; the index.

    ``twice``: the block is found twice or more. ``apart``: its anchor also has a block that is found once. ``source``:
    the least place of the block.
    """
    # Written first, so that Spark can split the tasks of a frequent anchor in the join.
    often = stage(_anchors(rows).groupBy("anchor").agg(F.sum("n").alias("places")).where("places > 1").select("anchor"), "substring-anchors")
    placed = stage(_placed(rows).join(often, "anchor"), "substring-blocks")
    counted = placed.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "first", "windows")).alias("source"))
    # Both written, for the same reason: an anchor may have very many blocks.
    counted = stage(counted, "substring-counts")
    least = stage(counted.groupBy("anchor").agg(F.min("n").alias("least")), "substring-least")
    index = stage(counted.join(least, "anchor").select("anchor", "block", (F.col("n") > 1).alias("twice"), (F.col("least") == 1).alias("apart"), "source"), "substring-index")
    return stage(placed.join(index, ["anchor", "block"]), "substring-factors"), index


def _windows(blocks_of: DataFrame, rows: DataFrame) -> DataFrame:
    """window, doc_id, key, at, weight of the windows of blocks that are taken apart (column ``parts`` of a document)."""

    def run(batches):
        for batch in batches:
            doc_id, key, parts = batch.column("doc_id"), batch.column("key"), batch.column("parts")
            for words in words_of(batch.column("text")):
                hashes, first = words.grams(WINDOW)
                own = parts.slice(words.rows.start, len(words)).to_pylist()
                text = np.array([i for i, p in enumerate(own) for _ in p], np.int64)
                low = np.array([b["first"] for p in own for b in p], np.int64)
                size = np.array([b["windows"] for p in own for b in p], np.int64)
                twice = np.array([b["twice"] for p in own for b in p], bool)
                each = np.repeat(np.arange(len(text)), size)
                at = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                row = pa.array(text[each] + words.rows.start)
                weight = np.where(twice[each], 2, 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_signed(hashes[first[text[each]] + at]), doc_id.take(row), key.take(row), pa.array(at.astype(np.int32)), pa.array(weight)],
                    names=["window", "doc_id", "key", "at", "weight"],
                )

    joined = _with_texts(blocks_of, rows)
    return joined.select("doc_id", "key", "parts", "text").mapInArrow(run, "window long, doc_id long, key long, at int, weight int")


def _with_texts(found: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of documents with what was found for their (doc_id, key)."""
    f = found.withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    return rows.join(f, rows["doc_id"].eqNullSafe(f["_doc"]) & (rows["key"] == f["_key"]), how).drop("_doc", "_key")


def _runs(p: Column, joins: Callable[[Column, Column], Column]) -> Column:
    """first, last: the ends of every longest run of elements of ``p`` that each join the one before."""
    starts = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | ~joins(F.get(p, i - 1), x), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(p)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(F.get(p, s).alias("first"), F.get(p, e - 1).alias("last")))


def factors(rows: DataFrame) -> DataFrame:
    """doc_id, key, factors, spans of documents with duplicates.

    ``factors``: [low, high, source_id, source_key, source_low], words low to high - 1 copy the words from source_low on of the
    source, which may be the place itself. ``spans``: [low, high], factors that overlap or touch are one span. Both are in order.
    ``rows`` has doc_id, text and key, a hash of the text.
    """
    marked, index = parse(rows)
    # Blocks found once, and of the others under such an anchor the source. Equal rows are places of their own,
    # so a block found once is in a row that has no equal.
    once = marked.where("apart and not twice").select("doc_id", "key", "first", "windows", "twice")
    copies = index.where("apart and twice").select("source.*", "twice")
    apart = once.union(copies).groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "windows", "twice")).alias("parts"))
    windows = stage(_windows(apart, rows), "substring-windows")
    known = windows.groupBy("window").agg(F.sum("weight").alias("n"), F.min(F.struct("doc_id", "key", F.col("at").alias("first"))).alias("source")).where("n > 1")

    def piece(first: Column, windows: Column) -> Column:
        source = [F.col(f"source.{c}").alias(f"source_{c}") for c in ("doc_id", "key", "first")]
        return F.struct(first.alias("first"), windows.alias("windows"), *source).alias("piece")

    # All windows of the pieces of a document are different, so an order by the first is one by the last too.
    single = windows.where("weight = 1").join(known.select("window", "source"), "window").select("doc_id", "key", piece(F.col("at"), F.lit(1)))
    whole = marked.where("twice").select("doc_id", "key", piece(F.col("first"), F.col("windows")))
    pieces = whole.union(single).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("piece")).alias("p"))

    def extends(a: Column, b: Column) -> Column:
        same = a["source_doc_id"].eqNullSafe(b["source_doc_id"]) & (a["source_key"] == b["source_key"])
        return same & (a["first"] + a["windows"] == b["first"]) & (a["source_first"] + a["windows"] == b["source_first"])

    high = lambda x: x["first"] + x["windows"] + (WINDOW - 1)
    factor = lambda r: F.struct(
        r["first"]["first"].alias("low"),
        high(r["last"]).alias("high"),
        r["first"]["source_doc_id"].alias("source_id"),
        r["first"]["source_key"].alias("source_key"),
        r["first"]["source_first"].alias("source_low"),
    )
    span = lambda r: F.struct(r["first"]["first"].alias("low"), high(r["last"]).alias("high"))
    return pieces.select(
        "doc_id",
        "key",
        F.transform(_runs(F.col("p"), extends), factor).alias("factors"),
        F.transform(_runs(F.col("p"), lambda a, b: b["first"] <= high(a)), span).alias("spans"),
    )


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans, n_factors for every row: the words outside the spans, joined by a blank.

    Null and empty texts have no words and keep an empty text. Repeated rows are places of their own, so their long
    texts go entirely. Rows with a null id stay, with a null id. Texts of fewer than WINDOW words stay
    whole (but for their white space). An empty table gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    found = factors(rows).select("doc_id", "key", "spans", F.size("factors").cast("long").alias("n_factors"))
    spans = stage(found, "substring-spans")

    def run(batches):
        for batch in batches:
            found = batch.column("spans").to_pylist()
            n_words, n_removed, kept = [], [], []
            for words in words_of(batch.column("text")):
                data = words.data.tobytes()
                for i in range(len(words)):
                    low, high = int(words.first[i]), int(words.first[i + 1])
                    own = found[words.rows.start + i] or []
                    keep = np.ones(high - low, bool)
                    for s in own:
                        keep[s["low"] : s["high"]] = False
                    chosen = np.flatnonzero(keep) + low
                    n_words.append(high - low)
                    n_removed.append(high - low - len(chosen))
                    kept.append(b" ".join([data[a:b] for a, b in zip(words.starts[chosen].tolist(), words.ends[chosen].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("spans"), pc.fill_null(batch.column("n_factors"), 0)],
                names=["doc_id", "n_words", "n_removed", "kept_text", "spans", "n_factors"],
            )

    return _with_texts(spans, rows, "left").select("doc_id", "text", "spans", "n_factors").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<low:int,high:int>>, n_factors long"
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.size(F.coalesce("spans", F.array().cast("array<struct<low:int,high:int>>"))).cast("long").alias("n_spans"), "n_factors")
