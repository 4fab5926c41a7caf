"""Corpora as flat token files.

A corpus is a folder of parts. ``<part>.ids`` holds token ids as little-endian unsigned
integers without a header, ``<part>.docs`` the ids of its documents as 64-bit integers, and
``<part>.offsets`` one more 64-bit number than it has documents: where each begins within the
part. The manifest (a Parquet table) lists the parts in order with their bases,
which are prefix sums of the counts of the parts before, so the place of a document in the whole
corpus is its part's base plus its offset. Readers map the files into memory where the file
system is local and read ranges elsewhere.

A task writes under a name of its own attempt and only names in the manifest count:
repeated, lost and speculative attempts leave no trace in a result.
"""

from __future__ import annotations

import mmap
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shared_dir, small_batches, utf8
from .tokens import encoder, valid_texts


#: Ids that a reader holds at once, but for a longer document.
READ_IDS = 1 << 20


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or a local path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_corpus(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the corpus in ascending order of its ids and returns its manifest.

    Null texts count as empty; every document ends with ``end_id``. Rows that repeat an
    id follow each other in the order of their texts; null ids come first and are written as the
    least 64-bit number. Columns of the manifest: part, folder, name, width, n_docs, n_tokens,
    base_docs, base_tokens. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tidemark/tokens-{uuid.uuid4().hex}"
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), utf8(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        enc = encoder(tokenizer_path, kind, end_id)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        ids, offsets, written = [], [np.zeros(1, np.int64)], 0
        with fs.open_output_stream(f"{path}/{name}.ids") as out:
            for batch in small_batches(batches):
                flat, ends = enc.encode(valid_texts(batch.column(1)))
                out.write(flat.tobytes())
                offsets.append(ends + written)
                written += len(flat)
                ids.append(batch.column(0).to_numpy())
        if ids:
            for kind_of, values in (("docs", np.concatenate(ids)), ("offsets", np.concatenate(offsets))):
                with fs.open_output_stream(f"{path}/{name}.{kind_of}") as out:
                    out.write(values.astype("<i8").tobytes())
            row = {"part": part, "name": name, "width": enc.dtype.itemsize, "n_docs": sum(map(len, ids)), "n_tokens": written}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
        else:
            fs.delete_file(f"{path}/{name}.ids")

    # One row for a part; bases are exclusive prefix sums over the parts.
    parts = cut(rows.mapInArrow(run, "part int, name string, width int, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(f"n_{x}").over(before), F.lit(0)).alias(f"base_{x}") for x in ("docs", "tokens")]
    return cut(parts.select("part", F.lit(folder).alias("folder"), "name", "width", "n_docs", "n_tokens", *bases))


class _Numbers:
    """A file of numbers: mapped into memory where the file system is local, read range by range elsewhere."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        if isinstance(fs, pafs.LocalFileSystem):
            with open(path, "rb") as f:
                self.whole = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), self.dtype)
        else:
            self.whole, self.file = None, fs.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.whole is not None:
            return self.whole[part]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * size, part.start * size), self.dtype)


def read_corpus(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files alone.

    start counts the tokens of all documents before; ids_crc32 is of the ids as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_folder(row["folder"])
                stem = f"{path}/{row['name']}"
                docs, offsets, ids = _Numbers(fs, f"{stem}.docs", "<i8"), _Numbers(fs, f"{stem}.offsets", "<i8"), _Numbers(fs, f"{stem}.ids", f"<u{row['width']}")
                at = 0
                while at < row["n_docs"]:
                    bounds = offsets[at : min(at + 1024, row["n_docs"]) + 1]
                    # At least one document, and no more than a bounded number of ids at once.
                    n = max(1, int(np.searchsorted(bounds[1:], bounds[0] + READ_IDS, side="right")))
                    bounds, some = bounds[: n + 1], slice(at, at + n)
                    at += n
                    flat = ids[int(bounds[0]) : int(bounds[-1])].astype("<u4")
                    own = np.split(flat, bounds[1:-1] - bounds[0])
                    columns = [pa.array(docs[some]), pa.array(bounds[:-1] + row["base_tokens"]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    parts = max(1, manifest.count())
    return manifest.repartition(parts, "part").mapInArrow(run, schema)
