"""Session helpers of the text operators: shared scratch tables, words, tables by name."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import shipping

__all__ = ["SPACES", "SPACE_RUN", "delete", "drop_table", "in_few_files", "lean", "let", "materialize", "partitions", "scratch", "ship", "table", "word_count", "word_list"]

#: The separators of a word, for SQL functions: space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch between the JVM and Python, where the session doesn't set them.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Scratch folders by application, where the session names none.
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """The package for executors, and batches of few bytes: with whole texts 10,000 rows may be any size."""
    shipping.ship(spark)
    if not spark._jsparkSession.sessionState().conf().contains(_BATCHES):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Unset on a local master it becomes a temporary folder; unset on a cluster it is put beside the warehouse.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if sc.applicationId not in _own:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="scratch-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own[sc.applicationId]


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the session has ended; nothing is left to delete with
        return


#: Partitions of a shuffle that share a file, once there are more than two files a core.
PARTITIONS_A_FILE = 16


def in_few_files(df: DataFrame) -> DataFrame:
    """`df` for a writer, its partitions one after another in fewer tasks; no row moves and what stands before a shuffle is as parallel as it was.

    Hadoop's local file system starts processes for each file, which share an executor's memory until they have begun.
    """
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, partitions(spark) // PARTITIONS_A_FILE))


def materialize(df: DataFrame, label: str, codec: str = "zstd", few: bool = False) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back: a lineage cut that survives lost executors.

    `few`: in few files, for tables of ids, links and counts.  The table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    df = in_few_files(df) if few else df
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    if path := getattr(df, "_scratch_path", None):
        delete(df.sparkSession, path)


def _release() -> None:
    """Give freed memory back to the system, so that a worker that is kept for later tasks is small meanwhile."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        return


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a function on a task's batches, that gives freed memory back when the task ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _release()

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_list(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, however often the body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)
