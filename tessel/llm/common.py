"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of the characters that separate words: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast up to so many bytes, counted before the join; beyond, it is shuffled.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only in a local session, as in tests, may that be unset; a
    folder under /tmp is taken then.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "/tmp/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at.rstrip("/")


#: Folders of intermediate tables of this driver, in the order in which they were written.
WRITTEN: list[str] = []


def clean(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the intermediate tables written so far, from number ``since`` on, but for those of ``keep``.

    Results that were not yet read or stored are lost with them.
    """
    for at in [x for x in WRITTEN[since:] if x not in keep]:
        _delete(spark, at)


def _delete(spark: SparkSession, at: str) -> None:
    WRITTEN.remove(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Where the tables that ``written`` gave lie.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def used_up(*tables: DataFrame) -> None:
    """Deletes the tables of these frames, which ``written`` gave: all that was computed from them is stored."""
    for x in tables:
        at = _PLACES.pop(x, None)
        if at in WRITTEN:
            _delete(x.sparkSession, at)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new intermediate table in the shared folder."""
    path = f"{shared_dir(spark)}/tessel-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    This runs the plan once, cuts the lineage and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def released(spark: SparkSession) -> None:
    """The driver collects its garbage: what plans that have run left there, broadcasts and shuffle files go, and its free
    heap goes back to the system.  Left alone, a heap of little content grows to its limit over many plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` by checkpoint(): as ``written``, and the partitions stay as they are."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        WRITTEN.append(file.get())
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(a: Column, b: Column) -> Column:
    """Equality that takes two nulls as equal."""
    return a.eqNullSafe(b)


def bounded(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` rows are within ``BROADCAST_BYTES``, else as it is."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


def hot_join(rows: DataFrame, side: DataFrame, keys: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` (one row a key): its ``hot`` rows, few by their definition, by broadcast, the others
    by a shuffle that hot rows take no part in."""
    few = F.broadcast(side.filter(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(side.filter(~hot), keys, how)
    return rows.join(few, keys, "left_semi" if how == "left_semi" else "inner").unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What a worker keeps from task to task: functions that drop it.
KEPT: list[Callable[[], None]] = []


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 1000, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that a worker holds the Python objects of few rows.

    Workers live on, and an executor's limit holds for all of them: unless ``keep`` is said, what tasks of other
    operators left for later ones goes first, and at the end free memory goes back to the system.
    """
    if not keep:
        for drop in KEPT:
            drop()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)
