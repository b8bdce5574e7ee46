"""Tables that are replaced as a whole: a directory for every version, and a pointer that is switched in one step.

A version is written beside the others and checked before anybody can see it. It becomes the current one when its
pointer is made, an empty file whose name is the number: making a file that must not exist yet succeeds for one
writer alone, and readers that opened the version before go on reading its files. A write that breaks off leaves a
directory without a pointer, which no reader looks at and the next writer passes over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.sources.readers import read_if_exists

POINTERS, DATA = "_current", "data"


class DuplicateKeys(ValueError):
    """A table that must be unique on its key is not."""


class LostRace(RuntimeError):
    """Another writer has published the same version number first."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """Numbers in the names of what is in a folder, rising."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, rising; the last one is current."""
    return _numbers(spark, f"{path}/{POINTERS}")


def version_path(path: str, version: int) -> str:
    return f"{path}/{DATA}/v={version}"


def parquet_writer(by: Sequence[str] = ()) -> Callable[[DataFrame, str], None]:
    """Plain parquet, in a directory for every value of ``by``."""

    def write(df: DataFrame, place: str) -> None:
        (df.write.partitionBy(*by) if by else df.write).parquet(place)

    return write


def replace_table(df: DataFrame, path: str, unique: Sequence[str] = (), by: Sequence[str] = (), writer: Callable[[DataFrame, str], None] | None = None) -> int:
    """Publish ``df`` as the table's next version and return its number.

    ``df`` may read the table itself: it reads the version that was current when it was made. With ``unique``, a version
    in which a key occurs twice is never published. ``writer`` lays the files out; the default is ``parquet_writer(by)``.
    """
    spark = df.sparkSession
    # Directories of broken writes count, too.
    version = max([0, *versions(spark, path), *_numbers(spark, f"{path}/{DATA}", "v=")]) + 1
    place = version_path(path, version)
    (writer or parquet_writer(by))(df, place)
    if unique:
        twice = spark.read.schema(df.schema).parquet(place).groupBy(*unique).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        if twice.head(1):
            files, written = _files(spark, place)
            files.delete(written, True)
            raise DuplicateKeys(f"{path}: rows repeat on {list(unique)}")
    publish(spark, path, version)
    return version


def mark(spark: SparkSession, path: str, name: str) -> None:
    """Enter a name in a ledger, an empty file; entering it again changes nothing."""
    files, place = _files(spark, f"{path}/{name}")
    files.create(place, True).close()


def marked(spark: SparkSession, path: str, name: str) -> bool:
    files, place = _files(spark, f"{path}/{name}")
    return files.exists(place)


def publish(spark: SparkSession, path: str, version: int) -> None:
    """Make a written version the current one. A file system makes a file once, so of two writers one fails."""
    files, place = _files(spark, f"{path}/{POINTERS}/{version}")
    try:
        files.create(place, False).close()
    except Exception as e:
        if not files.exists(place):
            raise
        raise LostRace(f"{path}: version {version} is taken") from e


def read_version(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None, condition: Column | None = None) -> DataFrame:
    """A version of the table, the current one unless another is named; an empty frame where there is none.

    The frame is bound to that version's files: a later replacement doesn't change what it reads. ``condition`` reaches the scan.
    """
    if version is None:
        published = versions(spark, path)
        version = published[-1] if published else 0
    return read_if_exists(spark, version_path(path, version), schema, condition)


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` published versions, and what broken writes before them left; the numbers that went.

    For the time when no reader of an older version is left.
    """
    published = versions(spark, path)
    first = published[-keep] if len(published) >= keep else (published[0] if published else 0)
    gone = [v for v in _numbers(spark, f"{path}/{DATA}", "v=") if v < first]
    for v in gone:
        for old in (f"{path}/{POINTERS}/{v}", version_path(path, v)):
            files, place = _files(spark, old)
            files.delete(place, True)
    return gone
