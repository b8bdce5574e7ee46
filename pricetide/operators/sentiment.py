"""Text polarity from a word list, daily means, and event flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BREAK = "[\\t\\n\\f\\r ]+"


def polarity(posts: DataFrame, lexicon: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Mean score of the lexicon words in each whole text, 0.0 where none occurs.

    ``lexicon`` has one (word, score) row per word; ``keys`` name a post. While the list is below
    Spark's broadcast threshold, words are looked up where they are read and only one partial result
    per post is shuffled; a larger list is joined by shuffle, where Spark splits frequent words.
    """
    words = posts.select(*keys, F.explode_outer(F.split(F.lower(text), WORD_BREAK)).alias("word"))
    scored = words.join(lexicon.select("word", "score"), "word", "left")
    return scored.groupBy(*keys).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("sentimento"))


def daily_means(posts: DataFrame) -> DataFrame:
    return posts.groupBy("ativo", "data").agg(F.avg("sentimento").alias("media_sentimento"))


def with_text_key(posts: DataFrame, text: str) -> DataFrame:
    """Add a digest of the text: equal texts compare and shuffle as 64 characters."""
    return posts.withColumn("text_key", F.sha2(F.col(text), 256))


def with_daily_sentiment(df: DataFrame, means: DataFrame, day: str, key: str = "symbol") -> DataFrame:
    """Attach the mean of the asset's day, 0 on days without posts; ``means`` has one row per asset and day."""
    by_day = means.select(F.col("ativo").alias(key), F.to_date("data").alias(day), "media_sentimento")
    joined = df.join(by_day, [key, day], "left")
    return joined.withColumn("media_sentimento", F.coalesce("media_sentimento", F.lit(0.0)))


def with_event_flags(df: DataFrame, calendar: DataFrame, day: str, kinds: Sequence[str], key: str = "symbol") -> DataFrame:
    """One 0/1 column ``evento_<kind>`` per kind: does the calendar have it for the asset on that day.

    One row per asset and date is left after the aggregation, so the join never multiplies rows.
    """
    flags = [F.max((F.col("evento") == k).cast("int")).alias(f"evento_{k}") for k in kinds]
    dates = calendar.groupBy(F.col("ativo").alias(key), F.to_date("data").alias(day)).agg(*flags)
    joined = df.join(dates, [key, day], "left")
    return joined.withColumns({f"evento_{k}": F.coalesce(f"evento_{k}", F.lit(0)) for k in kinds})
