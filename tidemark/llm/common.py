"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only in local mode, where that setting may be missing (tests), a temporary folder is made and set for the rest
    of the session; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext.getCheckpointDir()
        if not own and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = own.rsplit("/", 1)[0] if own else tempfile.mkdtemp(prefix="spark-")
        if not own:
            spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders that this driver has written to the shared folder.
_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_stored(spark: SparkSession) -> None:
    """Deletes all that ``stored`` has written for this driver. Results that read it must have been saved before."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for small tables inside iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that deals both sides by the key, whatever Spark takes their sizes for.

    Spark estimates a stored table by its files, and what is made of it (keys of a fingerprint, values of a sketch) by the same bytes: 0.6 MB of fingerprints have 190 MB of keys.
    Beneath ``spark.sql.autoBroadcastJoinThreshold`` such a side would pass the driver whole.
    """
    return df.hint("merge")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores before it until no name of ``taken`` equals it, whatever the case."""
    low = {n.lower() for n in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(column: str) -> Column:
    """A text as bytes, null as empty; Python then sees the stored bytes undecoded."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def with_text(docs: DataFrame, names: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The columns ``names`` of ``docs`` with a text, and where the text is: ``text_at`` takes it out. A string column that is kept anyway is not sent twice."""
    kept = [F.col(f"`{c}`") for c in names]
    if text_col in names and docs.schema[text_col].dataType == StringType():
        return docs.select(*kept), names.index(text_col)
    return docs.select(*kept, utf8(text_col).alias(free_name("text", names))), len(names)


def text_at(batch: pa.RecordBatch, at: int) -> Iterator[str]:
    """The texts of a column, null as empty; bytes that are not UTF-8 become the replacement character."""
    column = batch.column(at)
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())  # the same buffers, undecoded
    return ((value.as_py() or b"").decode("utf-8", "replace") for value in column)


def small_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices Arrow batches so that very long texts do not pile up in one step."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


_slot: list = [None, None]


def worker_slot(key: tuple, make: Callable[[], Any] = lambda: None) -> Any:
    """What a Python worker keeps between tasks: one operator's caches at a time.

    Workers outlive stages. Whoever asks with another key lets go of what the operator before had there.
    """
    if _slot[0] != key:
        _slot[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        _slot[:] = [key, make()]
    return _slot[1]
