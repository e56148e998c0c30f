"""Shared plumbing: shipping the package, staged tables, words, fold keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is, for Python's ``re`` and for Java's regular expressions alike.
WORD = "[^\\x20\\x09-\\x0D]+"
WORDS = re.compile(WORD)
#: White space to ``str.split`` that is part of a word here.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ``str.translate`` table that lower-cases A-Z and nothing else.
LOWER_ASCII = {ord(c): c.lower() for c in UPPER}


def words(text: str) -> list[str]:
    """All words of a text."""
    return WORDS.findall(text) if OTHER_SPACE.search(text) else text.split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make this package importable by Python workers and bound their Arrow batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if getattr(sc, "_planwright_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):  # not itself inside a shipped archive
        folder = os.path.realpath(tempfile.mkdtemp(prefix="planwright-"))
        archive = os.path.join(folder, "planwright_src.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for at, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(at, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(archive)
    sc._planwright_shipped = True


def give_back() -> None:
    """What this process has freed goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


#: What a worker process keeps from task to task, by name.
KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """A worker's store of this name; tasks that are not said to use it empty it."""
    return KEPT.setdefault(name, {})


def forget(uses: str = "") -> None:
    """Empty every store but this one."""
    left = [store for name, store in KEPT.items() if store and name != uses]
    for store in left:
        store.clear()
    if left:
        give_back()


def tidied(run, uses: str = ""):
    """A task's generator that gives memory back when it ends: Python workers are kept for other tasks.

    ``uses``: the store that its tasks fill for each other; what other operators left in a worker goes.
    """

    def wrapped(batches):
        forget(uses)
        yield from run(batches)
        give_back()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="planwright-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Removes a query's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back, with its path: lineage is cut, any executor may be lost.

    The shuffles of the write are not needed once the table stands, so their files go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planwright/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*(partition_by or [])).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``stage`` for tables that are kept."""
    return stage(df, name, partition_by)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables (or some of their partitions) once all that is made of them is written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))
