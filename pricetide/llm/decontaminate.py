"""Benchmark passages in documents, found by spaced seeds and verified with substitutions.

A seed is the hash of the tokens that a fixed mask selects from a window of at most SPAN tokens, so a replaced word at an
ignored position changes nothing. Together the masks hit every passage of 12 to 20 tokens of which MIN_PERCENT are equal,
wherever the others stand (a test enumerates them). Seeds of test items and of documents are joined by their hash. A
hit says that an item and a document may be aligned with some offset. Every such (document, item, offset) is then
verified over the item's whole length: of all stretches that are equal in MIN_PERCENT of their tokens, the one with
most equal tokens must have MIN_TOKENS of them, or MIN_PERCENT of the item's.

All of it is DataFrame functions. The benchmark's seeds are broadcast only after they are counted; above
MOST_BROADCAST seeds the join is shuffled. Hits are reduced to one row per alignment before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import unused
from pricetide.session import stage

TOKEN = r"[\p{L}\p{N}]+"
# Which of the tokens of a window count, 1 or 0.
MASKS = ("111111", "111000111", "111000000111", "11011011", "1101100011")
SPAN = 12
# Positions whose seeds are made together.
BLOCK = 8
MIN_TOKENS = 12
MIN_PERCENT = 80
MOST_BROADCAST = 500_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(f"({TOKEN})"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _seeds(rows: DataFrame, keys: list[str], short: list[int]) -> DataFrame:
    """``keys``, seed, at: all masks at all positions of the array column ``words``.

    Token hashes are cut into blocks of BLOCK positions, and the seeds of a block are expressions over its tokens, so
    they are compiled and not interpreted element by element. ``short`` are the lengths of test items with
    fewer than SPAN tokens; windows of those lengths are hashed whole.
    """
    width = BLOCK + SPAN - 1
    hashed = F.transform("words", lambda w: F.xxhash64(w))

    def cut(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(BLOCK))
        return F.transform(starts, lambda i: F.struct(i.alias("from"), F.slice(h, i + 1, F.lit(width)).alias("t")))

    blocks = rows.select(*keys, F.explode(_let(hashed, cut)).alias("_b"))
    blocks = blocks.select(*keys, F.col("_b.from").alias("_from"), *[F.get("_b.t", F.lit(k)).alias(f"_t{k}") for k in range(width)])
    chosen = [[k for k, c in enumerate(mask) if c == "1"] for mask in MASKS]
    whole = lambda p, n, seed: F.when(F.col(f"_t{p + n - 1}").isNotNull(), seed)
    seeds = [whole(p, ks[-1] + 1, F.xxhash64(F.lit(m), *[f"_t{p + k}" for k in ks])) for p in range(BLOCK) for m, ks in enumerate(chosen)]
    found = [blocks.select(*keys, "_from", F.posexplode(F.array(*seeds)).alias("_p", "seed")).select(*keys, "seed", (F.col("_from") + F.floor(F.col("_p") / len(MASKS))).cast("int").alias("at"))]
    for n in short:
        of = [whole(p, n, F.xxhash64(F.lit(100 + n), *[f"_t{p + k}" for k in range(n)])) for p in range(BLOCK)]
        found.append(blocks.select(*keys, "_from", F.posexplode(F.array(*of)).alias("_p", "seed")).select(*keys, "seed", (F.col("_from") + F.col("_p")).cast("int").alias("at")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.where("seed is not null")


def _overlap(mine: Column, item: Column, offset: Column) -> Column:
    """Of the item laid on the document at ``offset``: struct of equal tokens and length of the best stretch.

    With the k-th equal token at place p, 100 k - MIN_PERCENT p says how far the tokens up to it are above the share. A
    stretch from the k-th to the m-th has the share if the value of m, its last token counted in, is not below that of k; for
    each m the first such k is among the k whose values are less than all before, which are carried along.
    """
    same = lambda j: (j + offset >= 0) & F.coalesce(F.get(mine, j + offset) == F.get(item, j), F.lit(False))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(item) - 1, F.lit(0))), same)

    def step(a: Column, p: Column) -> Column:
        value = 100 * a["k"] - MIN_PERCENT * p
        here = F.array(F.struct(value.alias("value"), a["k"].alias("k"), p.alias("at")))
        lows = F.when((F.size(a["lows"]) == 0) | (value < F.element_at(a["lows"], -1)["value"]), F.concat(a["lows"], here)).otherwise(a["lows"])
        first = F.get(F.filter(lows, lambda x: x["value"] <= value + 100 - MIN_PERCENT), F.lit(0))
        found = F.struct((a["k"] - first["k"] + 1).alias("equal"), (p - first["at"] + 1).alias("length"))
        return F.struct((a["k"] + 1).alias("k"), lows.alias("lows"), F.when(found["equal"] > a["best"]["equal"], found).otherwise(a["best"]).alias("best"))

    none = F.struct(F.lit(0).alias("equal"), F.lit(0).alias("length"))
    empty = F.array().cast("array<struct<value: int, k: int, at: int>>")
    zero = F.struct(F.lit(0).alias("k"), empty.alias("lows"), none.alias("best"))
    # Too few equal tokens altogether: no stretch has enough.
    few = lambda at: (F.size(at) < MIN_TOKENS) & (100 * F.size(at) < MIN_PERCENT * F.size(item))
    return _let(at, lambda at: F.when(few(at), none).otherwise(F.aggregate(at, zero, step, lambda a: a["best"])))


def _checked(docs: DataFrame, benchmark: DataFrame, most_broadcast: int) -> DataFrame:
    """doc_id, key, item_id, offset, item_tokens, o (``_overlap``): every alignment with enough equal tokens; ``key`` is of the text."""
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item"))
        .where(F.size("item") > 0)
        .distinct()
    )
    items = stage(items, "benchmark-tokens")
    short = sorted(r["n"] for r in items.select(F.size("item").alias("n")).where(F.col("n") < SPAN).distinct().collect())
    keyed = items.withColumn("item_key", F.xxhash64("item"))
    seeds = _seeds(keyed.withColumnRenamed("item", "words"), ["item_id", "item_key"], short)
    seeds = stage(seeds.withColumnRenamed("at", "item_at"), "benchmark-seeds")
    few = seeds.count() <= most_broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.withColumn("key", F.xxhash64("text"))
    found = _seeds(rows.select("doc_id", "key", tokens(F.col("text")).alias("words")), ["doc_id", "key"], short)
    hits = found.join(F.broadcast(seeds) if few else seeds, "seed")
    aligned = hits.select("doc_id", "key", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    # Written, so that the next join is planned on its size, and the texts are not hashed again.
    aligned = stage(aligned, "benchmark-alignments")
    # Texts without an alignment are left out where they are read, before the others are shuffled.
    holders = stage(aligned.select(F.col("doc_id").alias("_holder"), F.col("key").alias("_holder_key")).distinct(), "benchmark-holders")
    held = F.broadcast(holders) if holders.count() <= most_broadcast else holders
    rows = rows.join(held, F.col("doc_id").eqNullSafe(F.col("_holder")) & (F.col("key") == F.col("_holder_key")), "left_semi")
    placed = aligned.join(F.broadcast(keyed) if few else keyed, ["item_id", "item_key"])
    same = placed["doc_id"].eqNullSafe(F.col("r.doc_id")) & (placed["key"] == F.col("r.key"))
    checked = placed.join(rows.alias("r"), same).select(placed["doc_id"], placed["key"], "item_id", "offset", F.size("item").alias("item_tokens"), _let(tokens(F.col("r.text")), lambda mine: _overlap(mine, F.col("item"), F.col("offset"))).alias("o"))
    enough = (F.col("o.equal") >= MIN_TOKENS) | (100 * F.col("o.equal") >= MIN_PERCENT * F.col("item_tokens"))
    return checked.where(enough)


def leaks(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, item_id, start, equal_tokens, overlap_tokens, item_tokens, text_key: one row for each document and item found in it.

    A document is an id and a text (``text_key`` is its hash), so different texts under one id, or without one, give rows of their
    own. ``start`` is the token of the document on which the item's first token lies, at the best alignment (then the
    first). Null and empty texts hold nothing; items without a token are found nowhere; rows with a null id give
    rows with a null id; repeated rows (of documents or items) give one row; empty tables give none; other
    columns are ignored.
    """
    best = F.max(F.struct(F.col("o.equal").alias("equal"), (-F.col("offset")).alias("back"), F.col("o.length").alias("length"), "item_tokens")).alias("b")
    return (
        _checked(docs, benchmark, most_broadcast)
        .groupBy("doc_id", "key", "item_id")
        .agg(best)
        .select("doc_id", "item_id", (-F.col("b.back")).alias("start"), F.col("b.equal").alias("equal_tokens"), F.col("b.length").alias("overlap_tokens"), F.col("b.item_tokens").alias("item_tokens"), F.col("key").alias("text_key"))
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no item was found; rows that share an id, or have none, are told apart by their text."""
    leaking, key = unused(docs.columns, "_leaking", "_key")
    found = _checked(docs, benchmark, MOST_BROADCAST).select(F.col("doc_id").alias(leaking), F.col("key").alias(key)).distinct()
    found = stage(found, "benchmark-leaking")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(leaking)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    return docs.join(found, F.col("text").isNotNull() & same, "left_anti")
