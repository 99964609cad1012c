"""Shared helpers: the cluster's shared folder, materialised tables, files that executors write, words."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Within, Spark deletes an execution's shuffle files when it has ended: its result is on disk by then."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Within, ``key`` has another value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with dropping_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing lazy reads them any more."""
    for table in tables:
        jvm, jsc = table.sparkSession._jvm, table.sparkSession._jsc
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def heavy_values(counts: DataFrame, key: str, n: str, most: int = 256) -> list[int]:
    """Values of ``key`` (long, one row each) that hold over one part in ``most`` of the sum of ``n``: fewer than ``most``."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > F.lit(total // most + 1)).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, on: list[str], heavy: list[int], by: Column, salts: int = 256) -> DataFrame:
    """Inner join in which rows of ``left`` whose last key is one of ``heavy`` are dealt over ``salts`` copies of the right row by ``by``."""
    if not heavy:
        return left.join(right, on)
    hot = F.col(on[-1]).isin(heavy)
    dealt = left.withColumn("_salt", F.when(hot, F.pmod(by, F.lit(salts))).otherwise(0).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*on, "_salt"]).drop("_salt")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared-folder URI and the path within it."""
    return pafs.FileSystem.from_uri(uri)


def words_column(text: Column) -> Column:
    """Words of a text as a native array; null gives an empty one."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")
