"""The stored tables: scans, the registry, unions of sources, legacy imports, versioned snapshots."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import KNOWN_PORTALS, slug
from ..operators.lifecycle import insert_missing, orphans


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder ``spark.checkpoint.dir``, without its lineage.

    Only in local mode, where that setting may be missing, a temporary folder is made.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def scan(spark: SparkSession, path: str, condition: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; condition and columns reach the scan."""
    df = spark.read.parquet(path)
    df = df if condition is None else df.where(condition)
    return df.select(*columns) if columns else df


def enabled_portals(registry: DataFrame) -> DataFrame:
    return registry.where("enabled")


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Feeds as one; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def first_sources(index: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` entries of an index (pages or organisations of an incremental run)."""
    return index.orderBy(*order).limit(n)


def legacy_import(current: DataFrame, legacy: DataFrame, portal_name: str, known: dict[str, str] | None, keys: list[str]) -> DataFrame:
    """Legacy rows under the slug of their portal's name; keys that exist already stay as they are."""
    return insert_missing(current, legacy.withColumn("portal", slug(F.col(portal_name), known)).select(current.columns), keys)


#: ``batch`` is the last batch of a table's change feed (``sources/feed.py``) that its folder holds, -1 for none.
POINTER = "number long, tables array<struct<name:string,schema:string,folder:string,batch:long>>"


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(file system, path) for calls that Spark's readers and writers do not have."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names of what stands in a folder, none where there is no folder."""
    files, path = hadoop_path(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def current(spark: SparkSession, root: str) -> Row | None:
    """The published pointer with the greatest number, None before the first one. Only that file is read, and one without content is passed over."""
    for name in reversed(names_in(spark, f"{root}/pointers")):
        row = spark.read.schema(POINTER).json(f"{root}/pointers/{name}").first()
        if row and row["number"] is not None:
            return row
    return None


def _publish(spark: SparkSession, root: str, entries: list[dict]) -> int:
    """Readers see all tables change at once. A pointer's file is created only if there is none of its number: of two writers one fails."""
    before = current(spark, root)
    number = (before["number"] if before else 0) + 1
    named = {e["name"]: e for e in ([t.asDict() for t in before["tables"]] if before else [])} | {e["name"]: e for e in entries}
    files, path = hadoop_path(spark, f"{root}/pointers/{number:012d}.json")
    out = files.create(path, False)
    out.write((json.dumps({"number": number, "tables": list(named.values())}) + "\n").encode())
    out.close()
    return number


def write_version(spark: SparkSession, root: str, tables: dict[str, DataFrame], batch: int = -1) -> int:
    """Writes tables into a new folder, then publishes them; other tables stay as they are. Returns the version's number.

    ``batch`` is the last batch of their change feeds that the tables hold already.
    """
    entries = []
    for name, df in tables.items():
        folder = f"{root}/v-{uuid.uuid4().hex}/{name}"
        df.write.parquet(folder)
        entries.append({"name": name, "schema": df.schema.json(), "folder": folder, "batch": batch})
    return _publish(spark, root, entries)


def published(spark: SparkSession, root: str, name: str) -> Row:
    """The pointer's entry of a table."""
    pointer = current(spark, root)
    for entry in pointer["tables"] if pointer else []:
        if entry["name"] == name:
            return entry
    raise ValueError(f"{root} has no published table {name}")


def read_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A published table, without its change feed."""
    entry = published(spark, root, name)
    return spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["folder"])


def export_snapshot(tables: dict[str, DataFrame], folder: str, keys: dict[str, list[str]] | None = None, at: datetime | None = None) -> tuple[str, dict[str, int]]:
    """Every table as JSON with its schema beside it, in a new folder named by the time; returns that folder and the rows of each table, counted while writing.

    Tables with ``keys`` are written in their order: files by their names and rows inside of them ascend, by a range partitioning.
    """
    from pyspark.sql import Observation

    out = f"{folder}/{(at or datetime.now(timezone.utc)).strftime('%Y-%m-%dT%H-%M-%S-%f')}"
    counts = {}
    for name, df in tables.items():
        seen, own = Observation(f"rows of {name}"), (keys or {}).get(name)
        ordered = df.orderBy(*own) if own else df
        ordered.observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", False).json(f"{out}/{name}")
        df.sparkSession.createDataFrame([(json.dumps(df.schema.jsonValue()),)], "value string").coalesce(1).write.text(f"{out}/_schemas/{name}")
        counts[name] = seen.get["n"]
    return out, counts


def exports(spark: SparkSession, folder: str) -> list[str]:
    """The exports of a folder, the newest last."""
    return [f"{folder}/{name}" for name in names_in(spark, folder)]


def restore_snapshot(spark: SparkSession, folder: str, names: list[str], confirm: bool = False) -> dict[str, DataFrame]:
    """Tables of an export, read by their own schemas; missing ones are skipped. Needs ``confirm``."""
    if not confirm:
        raise ValueError("restoring replaces all tables: pass confirm=True")
    out = {}
    for name in names:
        try:
            schema = StructType.fromJson(json.loads(spark.read.text(f"{folder}/_schemas/{name}").first()["value"]))
            out[name] = spark.read.schema(schema).json(f"{folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def publish_snapshot(spark: SparkSession, folder: str, root: str, names: list[str], references: list[tuple[str, str, str, str]], confirm: bool = False) -> dict[str, int]:
    """Restores the tables of an export and publishes them as one version; returns the rows of each.

    ``references`` are (child, its key, parent, its key). A child without its parent is an error, and nothing is published then.
    """
    tables = restore_snapshot(spark, folder, names, confirm)
    for child, child_key, parent, parent_key in references:
        if child in tables and parent in tables and not orphans(tables[child], tables[parent], child_key, parent_key).isEmpty():
            raise ValueError(f"{child} has rows whose {parent} is missing")
    write_version(spark, root, tables)
    return {name: df.count() for name, df in tables.items()}


def registry(spark: SparkSession, disabled: tuple[str, ...] = ("ireps",)) -> DataFrame:
    """(key, name, enabled) of the known portals."""
    rows = [(key, name, key not in disabled) for name, key in KNOWN_PORTALS.items()]
    return spark.createDataFrame(rows, "key string, name string, enabled boolean")


def registered(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """``rows`` with their portal's name and whether it is enabled, looked up by key; null for keys that the registry lacks."""
    return rows.join(known.select(F.col("key").alias(key), F.col("name").alias("portal_name"), "enabled"), key, "left")
