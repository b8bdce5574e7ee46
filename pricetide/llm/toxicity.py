"""Toxic passages by maximum-scoring segments over token log-odds.

Training counts features of tokens (the lower-cased token without the punctuation after it, and its first 4, 5
and 6 bytes) in toxic and clean labelled texts, and weighs them by log-odds with an informative Dirichlet
prior: every feature's prior counts are in proportion to its frequency in both classes. Features with clear
evidence for toxic texts (z-score) are kept, at most MOST_FEATURES (a feature counts once per text, equal texts once); any other token has the same small
negative score. A text's segments are found in one pass over its scores (Ruzzo and Tompa), all of them, not the
best alone. By extreme-value theory the number of segments that reach s in a clean text of n tokens is about
K n exp(-lambda s); lambda solves the usual equation for the clean token scores, K is fitted on clean training
texts. What a text's segments exceed that level by is summed, and a logistic curve turns the sum into a score.

The model is fitted on a bounded sample of labelled rows: TRAIN_ROWS per label, chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import Words, mix, small_batches, tail_starts, words_of
from pricetide.llm.language import held_out
from pricetide.session import stage

# Labelled rows of each label that the model is fitted on, at most (in the mean).
TRAIN_ROWS = 20_000
# Features with a weight, at most; the ones with the strongest evidence stay.
MOST_FEATURES = 200_000
PRIOR_TOKENS = 1_000.0
MIN_Z = 2.0
MIN_ODDS = 4.0
# A gap between toxic tokens costs at least this much for each token.
MIN_GAP = 0.05
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
BOTH, TOXIC, CLEAN = 0, 1, 2


@dataclass
class Model:
    """Hashed features (rising) with their log-odds, the score of other tokens, and the calibration."""

    keys: np.ndarray
    weights: np.ndarray
    other: float = -MIN_GAP
    scale: float = 1.0
    density: float = 1.0
    slope: float = 1.0
    shift: float = 0.0


def features(words: Words) -> list[np.ndarray]:
    """Per token: hashes of the whole token, then of its prefixes (0 where it isn't longer than that)."""
    ends = tail_starts(words.data, words.starts, words.ends)
    out = [words.spans(words.starts, ends)]
    for k in PREFIXES:
        cut = words.starts + k
        out.append(np.where(cut < ends, words.spans(words.starts, np.minimum(cut, ends)) ^ np.uint64(k), np.uint64(0)))
    return out


def segments(at: np.ndarray, scores: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, token after the last, score), in one pass.

    ``at`` and ``scores`` are the tokens with a positive score; the others have ``other`` < 0.
    """
    found: list[tuple[int, int, float, float]] = []  # first, end, total before, total after
    total, previous = 0.0, 0
    for i, s in zip(at.tolist(), scores.tolist(), strict=True):
        before = total + other * (i - previous)
        total, previous = before + s, i + 1
        first, low, high = i, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
        found.append((first, i + 1, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


def _token_scores(words: Words, model: Model) -> np.ndarray:
    """The weight of each token's most specific known feature, or 0."""
    out = np.zeros(len(words.starts))
    if not len(model.keys):
        return out
    # Lowest first: longer prefixes and then the whole token overrule.
    whole, *prefixes = features(words)
    for keys in (*prefixes, whole):
        where = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
        out = np.where(model.keys[where] == keys, model.weights[where], out)
    return out


def _passages(texts, model: Model) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Row, number of tokens, segments: for every text, in order."""
    for words in words_of(texts, lower=True):
        scores = _token_scores(words, model)
        at = np.flatnonzero(scores > 0)
        bounds = np.searchsorted(at, words.first)
        for i in range(len(words)):
            own = at[bounds[i] : bounds[i + 1]]
            n = int(words.first[i + 1] - words.first[i])
            yield words.rows.start + i, n, segments(own - words.first[i], scores[own], model.other) if len(own) else []


def _excess(n: int, found: list, model: Model) -> float:
    """What the significant segments exceed the clean level by, in all; 0 without one."""
    level = np.log(max(model.density * n, 1e-12))
    return sum(max(0.0, model.scale * s - max(level, 0.0)) for _, _, s in found)


def _score(excess: float, model: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.slope * excess + model.shift, -30, 30))))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, toxic of at most about ``rows`` documents of each label."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id"), 3, 1))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic"), F.lit(rows / max(n.get(True, 0), 1))).otherwise(F.lit(rows / max(n.get(False, 0), 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003 < share)
    # At most about 2 x rows ids of 8 bytes.
    return docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic").dropDuplicates(["text"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows that are not held out.

    Without toxic or without clean texts every text scores the same.
    """
    sample = _sample(docs, labels, train_rows)

    def count(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for words in words_of(batch.column("text"), lower=True):
                row = np.repeat(np.arange(len(words), dtype=np.uint64), np.diff(words.first))
                own = toxic[words.rows][row.astype(np.int64)]
                for kind, column in enumerate(features(words)):
                    # Once per text, so that a word repeated in one text is no evidence.
                    some = np.unique(mix(column ^ mix(row + np.uint64(1))), return_index=True)[1]
                    some = some[column[some] != 0]
                    keys, each = np.unique(column[some], return_inverse=True)
                    bad = np.bincount(each, own[some], len(keys)).astype(np.int64)
                    good = np.bincount(each, ~own[some], len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(bad), pa.array(good)], names=["kind", "key", "bad", "good"])

    counts = sample.mapInArrow(count, "kind int, key long, bad long, good long").groupBy("kind", "key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = stage(counts, "toxicity-counts")
    sums = counts.where("kind = 0").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    nb, ng = float(sums["bad"] or 0), float(sums["good"] or 0)
    if not nb or not ng:
        return Model(np.zeros(0, np.uint64), np.zeros(0), shift=5.0 if nb else -5.0)
    prior = F.lit(PRIOR_TOKENS / (nb + ng)) * (F.col("bad") + F.col("good"))
    bad, good = F.col("bad") + prior, F.col("good") + prior
    odds = F.log(bad / (F.lit(nb + PRIOR_TOKENS) - bad)) - F.log(good / (F.lit(ng + PRIOR_TOKENS) - good))
    z = odds / F.sqrt(1 / bad + 1 / good)
    # Rare in clean texts both by count and by evidence; z alone is small where clean texts have none at all.
    strong = F.greatest(z, F.sqrt(F.col("bad")) - F.sqrt(F.lit(nb / ng) * F.col("good") * 9 + 1))
    kept = counts.select("kind", "key", odds.alias("odds"), strong.alias("z"), "bad", "good").where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "kind", "key").limit(MOST_FEATURES)
    rows = kept.toPandas()
    rows = rows[rows["odds"] > MIN_ODDS]
    order = np.argsort(rows["key"].to_numpy().view(np.uint64), kind="stable")
    rows = rows.iloc[order]
    whole = rows[rows["kind"] == 0]
    model = Model(rows["key"].to_numpy().view(np.uint64), rows["odds"].to_numpy(float))
    p, q = whole["good"].to_numpy(float) + PRIOR_TOKENS * whole["bad"].to_numpy(float) / (nb + ng), whole["bad"].to_numpy(float)
    p, q = p / (ng + PRIOR_TOKENS), q / nb
    model.other = min(float(np.log(max(1 - q.sum(), 1e-9) / max(1 - p.sum(), 1e-9))), -MIN_GAP)
    model.scale = _scale(p, whole["odds"].to_numpy(float), model.other)
    return _calibrate(sample, model)


def _scale(p: np.ndarray, scores: np.ndarray, other: float) -> float:
    """lambda > 0 with sum of p exp(lambda score) = 1 over all tokens of clean texts."""
    low, high = 1e-3, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        value = float((p * np.exp(np.minimum(mid * scores, 600))).sum() + (1 - p.sum()) * np.exp(mid * other))
        low, high = (mid, high) if value < 1 else (low, mid)
    return low


def _calibrate(sample: DataFrame, model: Model) -> Model:
    """Fit K on the clean sample, then the logistic curve on all of it (a row per sampled text)."""
    schema = "toxic boolean, n long, best double, sum double, found long"

    def scan(batches):
        for batch in batches:
            rows = list(_passages(batch.column("text"), model))
            best = [max((s for *_, s in found), default=0.0) for _, _, found in rows]
            total = [sum(s for *_, s in found) for _, _, found in rows]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for _, n, _ in rows], pa.int64()), pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array([len(f) for *_, f in rows], pa.int64())], names=["toxic", "n", "best", "sum", "found"])

    seen = sample.mapInArrow(scan, schema).toPandas()
    clean = seen[~seen["toxic"].astype(bool)]
    least = float(model.weights.min()) if len(model.weights) else 1.0
    # Segments in clean texts, one more for those not met, over what lambda alone would allow at the least score.
    model.density = min(1.0, (float(clean["found"].sum()) + 1) / max(float(clean["n"].sum()) * np.exp(-model.scale * least), 1.0))
    level = np.maximum(np.log(np.maximum(model.density * seen["n"].to_numpy(float), 1e-12)), 0)
    x = np.maximum(0, model.scale * seen["sum"].to_numpy(float) - level * np.maximum(seen["found"].to_numpy(float), 1))
    y = seen["toxic"].to_numpy(float)
    # A small ridge keeps the curve finite where the labels part cleanly.
    w = np.full(len(y), 1 / len(y))
    a, b = 1.0, -3.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 1e-4 * a, (w * (p - y)).sum() + 1e-4 * b])
        r = w * p * (1 - p)
        h = np.array([[(r * x * x).sum() + 1e-4, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-4]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    model.slope, model.shift = max(a, 1e-3), b
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (first token, token after the last, score) for every row.

    A null or empty text, or one without a toxic token, gets the curve's lowest score and no passage. Null ids
    and repeated rows are rows like others; an empty table gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            rows = list(_passages(batch.column("text"), model))
            scores = [_score(_excess(n, found, model), model) for _, n, found in rows]
            level = [max(np.log(max(model.density * n, 1e-12)), 0) for _, n, _ in rows]
            found = [[{"first": a, "end": b, "score": s} for a, b, s in f if model.scale * s > x] for (_, _, f), x in zip(rows, level, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, passages array<struct<first: long, end: long, score: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every row of ``docs``, learned from ``labels``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = score(docs, fit(docs, labels, train_rows))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
