"""Posts as a stream: JSON lines in, posts that the table lacks stored, day means kept up to date.

Every batch is one entry of a ledger. It is entered when all that the batch writes is written; a batch that comes again
after that (a restart, or another run of the same feed under the same name) adds nothing, and one that broke off before
writes its own directories again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide import schemas
from pricetide.operators.sentiment import polarity, with_text_key
from pricetide.session import scratch, stage
from pricetide.sources.aggregates import add_batch
from pricetide.sources.readers import read_if_exists, read_posts
from pricetide.sources.tables import insert_if_absent
from pricetide.sources.versions import mark, marked

FEED = T.StructType(
    [
        T.StructField("ativo", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("created_utc", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
MALFORMED = "_malformed"
KEYS = ("ativo", "data", "text_key")
BATCH = "batch"
# Posts as they are stored: a directory for each batch, and in it one for each day.
STORED = T.StructType([*schemas.POSTS, T.StructField("seq", T.LongType()), T.StructField("text_key", T.StringType()), T.StructField(BATCH, T.StringType())])
DAY_KEYS = T.StructType(schemas.SENTIMENT.fields[:2])


def post_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Landed JSON lines as a stream (FEED); a line that is no such record has its text in ``_malformed``, and NULLs."""
    schema = T.StructType([*FEED, T.StructField(MALFORMED, T.StringType())])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).json(path)


def stored_posts(spark: SparkSession, path: str) -> DataFrame:
    return read_if_exists(spark, f"{path}/posts", STORED)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_if_exists(spark, f"{path}/malformed", T.StructType([T.StructField("line", T.StringType()), T.StructField(BATCH, T.StringType())]))


def post_sink(path: str, lexicon: DataFrame, feed: str) -> Callable[[DataFrame, int], None]:
    """A batch writer of posts, malformed lines and day sums below ``path``; ``feed`` names the stream in the ledger.

    Of equal posts (asset, day, text) the first stays: the one already stored, else the least ``seq`` of the batch. Stored
    posts are read for the batch's days alone.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, entry = batch.sparkSession, f"{feed}-{batch_id}"
        if marked(spark, f"{path}/ledger", entry):
            return
        with scratch(spark):
            lines = stage(batch, "lines")
            bad = lines.where(F.col(MALFORMED).isNotNull()).select(F.col(MALFORMED).alias("line"))
            bad.write.mode("overwrite").parquet(f"{path}/malformed/{BATCH}={entry}")
            posts = stage(with_text_key(read_posts([lines.where(F.col(MALFORMED).isNull()).drop(MALFORMED)]), "texto_original"), "posts")
            first, last = posts.agg(F.min("data"), F.max("data")).first()
            near = F.col("data").between(F.lit(first), F.lit(last)) & (F.col(BATCH) != entry)
            fresh = stage(insert_if_absent(read_if_exists(spark, f"{path}/posts", STORED, near), posts, KEYS, ["seq"]), "fresh")
            scores = polarity(fresh, lexicon, "texto_original", KEYS)
            scored = stage(fresh.join(scores, list(KEYS)).select("ativo", "texto_original", "sentimento", "seq", "text_key", "data"), "scored")
            scored.write.mode("overwrite").partitionBy("data").parquet(f"{path}/posts/{BATCH}={entry}")
            add_batch(scored, "sentimento", DAY_KEYS.names, f"{path}/means/feed={feed}", batch_id)
        mark(spark, f"{path}/ledger", entry)

    return write
