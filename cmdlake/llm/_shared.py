"""Helpers that every operator of this subpackage uses: the shared folder,
tables written there to cut lineage, and the word separators of the contracts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII separators 0x20 and 0x09-0x0D, as a Java class and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: The session's setting that removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Where it is unset, a session of one process (tests) gets a temporary folder; on a cluster that is an
    error, as each machine would write to a disk of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cmdlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _where(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, removed when the session's JVM ends if not before."""
    path = f"{shared_dir(spark)}/cmdlake-{name}-{uuid.uuid4().hex}"
    files, where = _where(spark, path)
    files.deleteOnExit(where)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of new_path() that nothing reads any more."""
    files, where = _where(spark, path)
    files.delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings changed for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from Parquet files in the shared folder: they are computed once
    and survive the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # The shuffle files of this write go with it; nothing else reads them, as its rows are on disk.
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Removes the files of tables of written(); no plan that still has to run may read them."""
    for df in tables:
        if df is not None:
            removed(df.sparkSession, df.written_at)


def released(spark: SparkSession) -> None:
    """Frees what finished writes still hold in the driver: Spark drops their broadcast tables and the state of their
    shuffles only once a whole collection has found that nothing names them, and until then the heap grows."""
    gc.collect()  # first the Python names of the plans
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; a plain reference inside a lambda
    would be inlined there by the optimizer and computed once an element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; empty for a null text or one of separators only."""
    cut = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(cut), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(cut, SPACE + "+"))


def n_words(text: Column) -> Column:
    """How many words a text has (0 for null)."""
    cut = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(cut), F.lit(0)) == 0, 0).otherwise(F.size(F.split(cut, SPACE + "+"))).cast("long")


def id_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by
