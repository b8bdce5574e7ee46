"""Shared helpers: columns of a document table, document keys, whole words as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that are worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 1 << 19

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Punctuation that may follow a word.
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,!?;:$%&*#|")] = True
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
_powers: dict[int, np.ndarray] = {}
# Bits of a filter that is broadcast, at most; 64 of them are a row.
MOST_BITS = 1 << 25


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each made longer until no column has it (Spark ignores case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark) -> None:
    """Arrow batches of about 8 MB, so that long texts don't fill a worker's memory."""
    for name, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", str(8 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def text_key(text: Column) -> Column:
    """128 bits of SHA-256; a missing text counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def may_be_in(rows: DataFrame, values: list[Column], keys: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with a column ``_in``, false only where no row of ``keys`` has the ``values`` in its ``columns`` (of the same types).

    A Bloom filter of one hash: bits by hash, 16 or more for a row of ``keys`` up to MOST_BITS, are broadcast, so that rows are told
    where they are read and only those that may be in a small table are shuffled to be joined with it. Missing values are
    like others. Beyond MOST_BITS / 16 rows of ``keys`` more rows are told wrongly that they may be in them.
    """
    bits = min(MOST_BITS, 1 << max(10, (16 * keys.count()).bit_length()))
    bit = lambda place: place.bitwiseAND(63).cast("int")
    place = lambda of: F.pmod(F.xxhash64(*of), F.lit(bits))
    found = keys.select(place(columns).alias("_place"))
    words = found.groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("_place")))).alias("_bits"))
    placed = rows.withColumn("_place", place(values))
    told = placed.join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_word"), "left")
    return told.withColumn("_in", F.coalesce(F.getbit("_bits", bit(F.col("_place"))) == 1, F.lit(False))).drop("_place", "_word", "_bits")


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1) modulo 2 ** 64, kept for the worker's next chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some whole texts: byte ranges, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice, lower: bool):
        self.rows, self.data, self.offsets = rows, data, offsets
        n = len(data)
        token = ~_SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        opens = token.copy()
        opens[1:] &= ~token[:-1] | begins[1:-1]
        closes = token.copy()
        closes[:-1] &= ~token[1:] | begins[1:-1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        values = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=total[1:])
        self._total = total
        self.hashes = self.spans(self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.first) - 1

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self._total[ends] - self._total[starts]) * powers(INVERSE, len(self._total))[starts])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words, and per text where its first one stands.

        Text i has max(0, words - k + 1) of them; texts follow each other without gaps.
        """
        n = len(self.hashes)
        counts = np.maximum(np.diff(self.first) - k + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if n < k:
            return np.zeros(0, np.uint64), bounds
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * powers(BASE, n), out=total[1:])
        every = mix((total[k:] - total[: n - k + 1]) * powers(INVERSE, n + 1)[: n - k + 1] + np.uint64(k))
        at = np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], counts)
        return every[at], bounds


def as_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column and its offsets; missing texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``most`` bytes together, or one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def words_of(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Words]:
    """Words of whole texts, a few megabytes of text at a time."""
    data, offsets = as_bytes(texts)
    for low, high in pieces(offsets):
        own = offsets[low : high + 1]
        yield Words(data[own[0] : own[-1]], own - own[0], slice(low, high), lower)


def tail_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the punctuation at the end of each word begins, if a letter or digit stands before it; else the word's end."""
    if not len(starts):
        return ends
    other = np.where(_PUNCTUATION[data], 0, np.arange(1, len(data) + 1))
    tail = np.maximum.accumulate(other)[ends - 1]
    last = data[np.maximum(tail - 1, 0)]
    before = data[np.maximum(tail - 2, 0)]
    latin = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    return np.where((tail > starts) & (_ALNUM[last] | latin), tail, ends)
