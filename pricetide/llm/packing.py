"""Packing by concatenate and cut: two passes, prefix sums over partition totals, boundary records.

Pass 1 tokenizes every text once and writes its ids with the partition it was written from and the number
of ids before it in that partition. Pass 2 adds the total of all earlier partitions, so each document knows
its place in the one long stream, and cuts the stream into windows of ``length`` ids. Every window but the
last is full, so there is no padding but the last window's, and documents continue from one to the next.
A boundary record (a piece) says which ids of a document lie in which window, and where.

The only thing that meets in one place is one row per partition of the written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricetide.llm.common import Words, as_bytes, pieces, small_batches, tail_starts
from pricetide.session import stage

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
# Units whose ids a worker remembers at most; beyond that it starts anew.
MEMORY_UNITS = 600_000

# Documents cut at once.
ROWS = 512

_ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
)
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


class Encoder:
    """Ids of whole texts.

    This tokenizer never joins characters across a blank, line end or tab, nor a letter or digit with the
    punctuation after it, and it lowers letters. So a text is cut into such units, and only units not met
    before by this worker are encoded, 64 to a call. A text with "<|" may spell a special token and is
    encoded as it is, as is every text with ``by_unit=False``, for tokenizers of which this does not hold.
    """

    def __init__(self, name: str, by_unit: bool = True):
        self.tokenizer, self.by_unit = _tokenizer(name), by_unit
        self.closes = np.array([t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])])
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit."""
        one = [i for i, u in enumerate(units) if u.isalpha() and u.lower().isalpha() and is_normalized("NFC", u)]
        rest = sorted(set(range(len(units))) - set(one))
        out: list = [None] * len(units)
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        lines = [one[k : k + 64] for k in range(0, len(one), 64)]
        joined = [" ".join([units[i] for i in line]) for line in lines]
        for line, found in zip(lines, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = found.ids
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(line):
                for i, low, high in zip(line, [0, *ends.tolist()], ends.tolist(), strict=False):
                    out[i] = ids[low:high]
            else:  # a unit that is not one run of letters for the tokenizer
                for i in line:
                    out[i] = self.ids(units[i])
        return out

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        found = self._encode(units)
        size = np.array([len(x) for x in found], np.int64)
        flat = np.array([x for ids in found for x in ids], np.uint32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def texts(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For one chunk: all ids, and where each text's ids begin."""
        data, starts, ends = words.data, words.starts, words.ends
        tail = tail_starts(data, starts, ends)
        split = np.flatnonzero((tail > starts) & (tail < ends))
        # Units in order: a split word gives two.
        slot = np.arange(len(starts)) + np.concatenate([[0], np.cumsum((tail > starts) & (tail < ends))])[:-1] if len(starts) else np.zeros(0, np.int64)
        low, high = np.empty(len(starts) + len(split), np.int64), np.empty(len(starts) + len(split), np.int64)
        low[slot], high[slot] = starts, ends
        high[slot[split]] = tail[split]
        low[slot[split] + 1], high[slot[split] + 1] = tail[split], ends[split]
        first = np.concatenate([slot, [len(low)]])[words.first]
        keys, some, each = np.unique(words.spans(low, high), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MEMORY_UNITS:
            self.forget()
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[where] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            text = bytes(data)
            self._learn(keys[new], [text[a:b].decode() for a, b in zip(low[some[new]].tolist(), high[some[new]].tolist(), strict=True)])
        where = np.searchsorted(self.keys, keys)[each]
        size = self.size[where]
        bounds = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.arange(bounds[-1]) + np.repeat(self.at[where] - bounds[:-1], size)]
        return ids, bounds[first]


@lru_cache(maxsize=2)
def _encoder(name: str, by_unit: bool) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(name, by_unit)


def _ids_of(encoder: Encoder, texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Ids of each text, a chunk at a time."""
    data, offsets = as_bytes(texts)
    for low, high in pieces(offsets, 1 << 18):
        own = offsets[low : high + 1] - offsets[low]
        chunk = data[offsets[low] : offsets[high]]
        if encoder.by_unit:
            ids, first = encoder.texts(Words(chunk, own, slice(low, high), True))
            out = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            special = np.flatnonzero((chunk[:-1] == ord("<")) & (chunk[1:] == ord("|")))
            odd = np.unique(np.searchsorted(own, special, "right") - 1).tolist()
        else:
            out, odd = [None] * (high - low), range(high - low)
        for i in odd:
            out[i] = np.array(encoder.ids(bytes(chunk[own[i] : own[i + 1]]).decode()), np.uint32)
        yield out


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, by_unit: bool = True) -> DataFrame:
    """doc_id, part, before, n, ids: the ids of every text plus ``end_id``, numbered within the partition."""

    def run(batches):
        encoder, before = _encoder(tokenizer, by_unit), 0
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        for batch in batches:
            at_row = 0
            for ids in _ids_of(encoder, batch.column("text")):
                n = np.array([len(x) + 1 for x in ids], np.int64)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                flat = pa.array([np.concatenate([x, end]).astype("<u4").tobytes() for x in ids], pa.binary())
                some = batch.column("doc_id").slice(at_row, len(ids))
                at_row += len(ids)
                yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(n), part)), pa.array(at), pa.array(n), flat], schema=_ENCODED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part long, before long, n long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit ids; joining the pieces of a sequence in the order of
    ``offset`` gives the sequence. Null or empty texts hold ``end_id`` alone; a null doc_id stays null;
    repeated rows are packed as often as they come; an empty table gives no piece; other columns of
    ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)
    encoded = stage(encode(docs, tokenizer, end_id), "packing-ids")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("_total"))
    # One row per partition of the written table.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    origins = stage(totals.select("part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_origin")), "packing-origins")
    # Written, so that Spark plans this join on its real size.
    placed = encoded.join(origins, "part").select("doc_id", (F.col("_origin") + F.col("before")).alias("at"), "n", "ids")

    def cut(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
            first, last = at // length, (at + n - 1) // length
            parts = last - first + 1
            row = np.repeat(np.arange(len(n)), parts)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.maximum(sequence * length, at[row])
            stop = np.minimum((sequence + 1) * length, (at + n)[row])
            ids = batch.column("ids")
            data, offsets = _binary(ids)
            low = offsets[row] + 4 * (start - at[row])
            high = low + 4 * (stop - start)
            cuts = [bytes(data[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start - at[row]), pa.array(stop - start), pa.array(cuts, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(start - sequence * length)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(cut, _PIECES)


def _binary(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return memoryview(data) if data is not None else memoryview(b""), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def digests(pieces: DataFrame) -> DataFrame:
    """``ids_crc32`` (unsigned) instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences; a group has at most ``length`` pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
