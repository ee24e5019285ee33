"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.ordering import shared_folder

#: Rows and bytes of one Arrow batch at most, unless one row alone has more: documents can be long.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20

#: The blanks that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch sizes, so that a batch of long texts fits a worker.

    A plan takes them up when it is run, which is after the operator has returned: they stay lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, as spark.checkpoint.dir names it.

    Where it is unset, a local session uses its warehouse; a cluster has to name one.
    """
    return shared_folder(spark)


def materialise(frame: DataFrame, label: str, *, codec: str = "zstd", **options: int) -> DataFrame:
    """Write the rows to a new Parquet table in the shared folder, by the writer's options, and read them back.

    That cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.options(compression=codec, **options).parquet(path)
    _MADE.append(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Tables that this process has written.
_MADE: list[str] = []


def discard(frame: DataFrame) -> None:
    """Delete a table that ``materialise`` has returned; nothing may read it any more."""
    files = frame.inputFiles()
    for path in [x for x in _MADE if any(f"/{x.rsplit('/', 1)[-1]}/" in f for f in files[:1])]:
        _MADE.remove(path)
        gone = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(gone, True)


def remove_intermediates(spark: SparkSession) -> int:
    """Delete the tables that ``materialise`` has written so far; results that read them have to be done."""
    made = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        made += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return made


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n
