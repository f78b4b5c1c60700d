"""What the text operators share: tables, work folders, row sources for tests of nulls."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import work_path

#: White space of every rule on texts, as a class of regular expressions (fixed by the contracts).
SPACE = r"[\x20\x09-\x0D]"
#: Removes shuffle files once the job that needed them is over.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python at a time while a frame is written: whole texts travel, and a batch is held several times over on either side.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
#: The same in bytes, for all frames of a session: Python's texts take several times the bytes they travel as.
_BATCH_SIZE, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame to the shared work folder and read it back; the lineage ends there.  ``options`` are those of the writer."""
    spark = df.sparkSession
    path = work_path(spark, name)
    given = int(spark.conf.get(_BATCH))
    with tidy_shuffles(spark), _set(spark, _BATCH, str(min(given, BATCH_ROWS) if given > 0 else BATCH_ROWS)):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``saved`` made and no later plan reads."""
    for frame in frames:
        spark = frame.sparkSession
        files = frame.inputFiles()
        if files:
            jvm = spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bound_batches(spark: SparkSession) -> None:
    """From now on a batch that goes to Python ends at ``BATCH_BYTES``, unless the session has a lower bound: also in
    frames that the caller writes, whose rows ``saved`` does not bound."""
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SIZE))
    if not 0 < given <= BATCH_BYTES:
        spark.conf.set(_BATCH_SIZE, str(BATCH_BYTES))


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def tidy_shuffles(spark: SparkSession):
    return _set(spark, _TIDY, "true")
