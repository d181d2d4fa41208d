"""What the operators of this subpackage share: tables, words, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one (spark.checkpoint.dir).

    Where the session names none, as in tests on one machine, a temporary folder is set as such.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="trailmark-"))
            held = spark.sparkContext.getCheckpointDir()
        base = held
    return f"{base.rstrip('/')}/trailmark-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "t") -> DataFrame:
    """df written as Parquet in the shared folder and read again: work is done once and lineage is cut."""
    path = f"{shared_dir(df.sparkSession)}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of tables that are written meanwhile go when the write ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def removed(df: DataFrame) -> None:
    """Remove the files of a table that written() made, once nothing will read them again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/trailmark-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, as long; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, although the optimizer inlines projections."""
    return F.transform(F.array(value), body)[0]
