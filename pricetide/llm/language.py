"""Language by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 4 characters (code points of the text in lower case; what is no letter is a blank) per language, in
a table of 2 ** BITS columns, and the languages themselves for their priors. The log-probabilities (languages x 2 ** BITS
single floats, 1 MB at 4 languages; the languages are few and counted before) go to the executors as a broadcast
variable.

Scoring multiplies a sparse matrix (texts x columns, an entry for each n-gram) with that table: the rows of the
table that the n-grams of a piece of text name are added up per text. A piece has at most PIECE characters, a longer text
is several, and languages are taken AT_ONCE at a time, so a task's memory depends on neither.

Learning is fitted on a bounded sample of labelled rows: TRAIN_ROWS rows, chosen by a hash of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import as_bytes, pieces, small_batches

BITS = 16
GRAMS = (1, 2, 3, 4)
# Characters of a piece, languages that are scored together.
PIECE = 1 << 15
AT_ONCE = 16
# Labelled rows that the model is fitted on, at most (in the mean: rows are chosen by a hash).
TRAIN_ROWS = 20_000
# Languages with a table in memory, at most.
MOST_LANGUAGES = 1_000
UNKNOWN = "und"
_BLANK = 0x20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point, made once for a worker."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    more = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    value = np.where(more > 0, lead & (0x3F >> more), lead)
    for k in (1, 2, 3):
        far = np.flatnonzero(more >= k)
        value[far] = value[far] << 6 | data[at[far] + k] & 0x3F
    return value, at


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """Pieces of some whole texts: the first row, where each text begins and ends, characters repeated, characters.

    A piece that goes on repeats the last characters of the one before, as many as an n-gram may reach back.
    """
    data, offsets = as_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for low, high in pieces(offsets, 1 << 18):
        value, at = code_points(data[offsets[low] : offsets[high]])
        value = np.where(_is_letter()[value], value, _BLANK).astype(np.uint64)
        bounds = np.searchsorted(at, offsets[low : high + 1] - offsets[low])
        for begin in range(0, len(value), PIECE):
            end = min(begin + PIECE, len(value))
            first, last = int(np.searchsorted(bounds, begin, "right")) - 1, int(np.searchsorted(bounds, end))
            back = min(max(GRAMS) - 1, begin - int(bounds[first]))
            own = np.clip(bounds[first : last + 1], begin - back, end) - (begin - back)
            yield low + first, own, back, value[begin - back : end]


def columns(value: np.ndarray, bounds: np.ndarray, back: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the column of every n-gram of a piece and which of its texts it is of, in order.

    N-grams that end in the first ``back`` characters are left out: the piece before has them.
    """
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # How many characters of its own text stand up to each one.
    reach = np.arange(len(value)) - bounds[:-1][text] + 1
    key = np.zeros(len(value), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        # The n-gram that ends here: the one before, shorter by a character, and this one.
        key = np.append(np.zeros(1, np.uint64), key[:-1]) if n > 1 else key
        key = (key + value + np.uint64(n)) * _SPREAD
        if n in GRAMS:
            keep = np.flatnonzero(reach[back:] >= n) + back
            yield (key[keep] >> np.uint64(64 - BITS)).astype(np.int64), text[keep]


def held_out(doc_id: Column, mod: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and their log-probabilities (languages x columns) with add-one smoothing; a last column has the log priors.

    ``docs`` has text and lang; rows without either don't count. Without any row there is no language.
    """
    known = docs.where("text is not null and lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(r["lang"] for r in sizes)
    total = sum(r["count"] for r in sizes)
    if not names:
        return [], np.zeros((0, (1 << BITS) + 1), np.float32)
    # Rare languages keep more of their rows.
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(train_rows / total, train_rows / len(names) / r["count"] / 2))])
    chosen = known.where((F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1_000_003)) / 1_000_003) < share[F.col("lang")])

    def count(batches):
        found = np.zeros((len(names), 1 << BITS), np.int64)
        for batch in batches:
            lang = np.array([names.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for first, bounds, back, value in _texts(batch.column("text")):
                for column, owner in columns(value, bounds, back):
                    np.add.at(found.ravel(), lang[first + owner] << BITS | column, 1)
        at = np.flatnonzero(found)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000]), pa.array(found.ravel()[at[k : k + 100_000]])], names=["at", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    table = np.ones((len(names), 1 << BITS))
    for r in counts.toLocalIterator():
        table.flat[r["at"]] += r["n"]
    rows = {r["lang"]: r["count"] for r in sizes}
    prior = np.log([[(rows[x] + 1) / (total + len(names))] for x in names])
    return names, np.hstack([np.log(table / table.sum(axis=1, keepdims=True)), prior]).astype(np.float32)


def log_likelihoods(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """Rows x languages, without the priors; ``model`` has a row for each column of n-grams."""
    logs = np.zeros((len(column), model.shape[1]))
    for first, bounds, back, value in _texts(column):
        for at, owner in columns(value, bounds, back):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            for k in range(0, model.shape[1] if len(starts) else 0, AT_ONCE):
                logs[first + owner[starts], k : k + AT_ONCE] += np.add.reduceat(model[at, k : k + AT_ONCE], starts, axis=0, dtype=np.float64)
    return logs


def predict(docs: DataFrame, names: list[str], table: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and lang_pred, score (the language's posterior probability).

    A null text, one without a letter, or a model without languages gives "und" with score 0. Of equal languages the
    first in order is taken.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))

    def run(batches):
        model, prior = shared.value[:-1], shared.value[-1] if len(names) else None
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            if names and letters.any():
                logs = log_likelihoods(batch.column("text"), model) + prior
                score = np.where(letters, 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1), 0)
                best = np.where(letters, logs.argmax(axis=1), -1)
            pred = pa.array([*names, UNKNOWN], pa.string()).take(pa.array(np.where(best < 0, len(names), best)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pred, pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from the rows that are not held out.

    Repeated rows and null ids are rows like others (a null id is never held out); an empty table gives none;
    other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).withColumn("held_out", held_out(F.col("doc_id")))
    names, table = fit(rows.where(~F.col("held_out")), train_rows)
    return predict(rows, names, table, ["doc_id", "held_out"])
