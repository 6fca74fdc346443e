"""What several of the operators share."""

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import SETTINGS, ship_package

# A word: no space, tab, line feed, vertical tab, form feed or carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
# Long texts go to Python in small batches, so that a batch stays in memory.
TEXT_BATCH = 64
NUMBER_BATCH = 20_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Session settings and code that the tasks need."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set(_BATCH, str(TEXT_BATCH))
    ship_package(spark)


@contextmanager
def batches(spark: SparkSession, rows: int):
    """Rows in a batch for the jobs that run inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def words_of(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda word: word != "")
