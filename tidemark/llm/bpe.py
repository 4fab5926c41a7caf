"""Byte-level BPE through a global distinct-word shuffle.

Encoding explodes documents into pre-tokens with their positions and shuffles the distinct
words: every word belongs to one shard, and the task of that shard merges it once. The ids
go back to where the word stood, and documents are put together by position.

Rows of single words would cost more than the words. So documents are gathered into
blocks of a bounded size; a block numbers its distinct words by their frequency, sends each shard the
words that are the shard's in one compressed row, and keeps its positions as one compressed
sequence of word numbers. A word that stands everywhere is one entry for each block, so no word is hot.
The number of shards follows the bytes of text.

Decoding looks every id up in the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8, worker_slot
from .tokens import BETWEEN, chunks, gathered, single_tokens, valid_texts

#: Text bytes that a block gathers before the next one begins.
BLOCK_BYTES = 16 << 20
#: Pre-tokens that are put together at once.
SLICE_WORDS = 1 << 19
#: Text bytes for each shard of words, and the fewest and most shards.
SHARD_BYTES, SHARDS = 128 << 20, (64, 8192)
#: The pre-token pattern of byte-level vocabularies; texts under another one are not cut before it is applied.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of unsigned 32-bit numbers, as byte planes, and raw bytes, each with its size, compressed."""
    out = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        out += [len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def numbers(raw: bytes) -> np.ndarray:
    """The array that ``pack`` stored as byte planes."""
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def pre_tokens(texts: list[bytes], pattern: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of texts, the number of the one at each position, and how many each text has.

    Texts are cut into chunks of whole pre-tokens first, and only distinct chunks that hold several meet the pattern.
    """
    import regex

    find = regex.compile(pattern).findall
    cut = (chunks(texts, "byte") if pattern == BYTE_PATTERN else pa.array([x for t in texts for x in (t, BETWEEN)], pa.binary())).dictionary_encode()
    listed = cut.dictionary.to_pylist()
    single = single_tokens(cut.dictionary, "byte").tolist() if pattern == BYTE_PATTERN else [False] * len(listed)
    number: dict[bytes, int] = {}
    flat, sizes = array("q"), array("q")
    for chunk, whole in zip(listed, single, strict=True):
        found = (chunk,) if whole else () if chunk == BETWEEN else [w.encode() for w in find(chunk.decode())]
        for w in found:
            flat.append(number.setdefault(w, len(number)))
        sizes.append(len(found))
    size, place = np.array(sizes), cut.indices.to_numpy()
    every, ends = gathered(np.array(flat), (np.cumsum(size) - size)[place], size[place])
    stops = ends[place == listed.index(BETWEEN)]
    return list(number), every, np.diff(stops, prepend=0)


def explode_words(docs: DataFrame, pattern: str, shards: int, id_col: str, text_col: str) -> DataFrame:
    """(block, shard, head, payload) rows: the words of a block that belong to a shard, or its head.

    A head holds the ids of the block's documents, their numbers of pre-tokens, and at each
    position the number of the word that stands there. Heads are dealt evenly over the shards, which only pass them on.
    """

    def block(name: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        words, every, counts = pre_tokens(texts, pattern)
        order = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        shard = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards
        rows = [(name, zlib.crc32(name.to_bytes(8, "little")) % shards, True, pack(np.array(ids, "<i8").tobytes(), counts, rank[every]))]
        grouped = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[grouped], np.arange(shards + 1))
        for k in np.unique(shard).tolist():
            own = grouped[bounds[k] : bounds[k + 1]]
            own = own[np.argsort(rank[own])]
            mine = [words[i] for i in own]
            # Ascending numbers as differences, which compress to a byte or less.
            rows.append((name, k, False, pack(np.diff(rank[own].astype(np.int64), prepend=0), np.array(list(map(len, mine))), b"".join(mine))))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["block", "shard", "head", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_slot(("bpe-words",))
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), valid_texts(batch.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text) + 64
                if held >= BLOCK_BYTES:
                    yield block(part << 32 | made, ids, texts)
                    made, ids, texts, held = made + 1, [], [], 0
        if ids:
            yield block(part << 32 | made, ids, texts)

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), utf8(text_col).alias("text"))
    return source.mapInArrow(run, "block long, shard int, head boolean, payload binary")


@lru_cache(maxsize=1)
def _merger(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, decoded binary]) of every row; ``decoded`` looks the ids up again, as ``decode`` does, in the same task.

    A null text counts as empty and has no ids. Repeated rows are rows of their own; null document ids
    stay null. Other columns are ignored.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_slot(("bpe-merge",))
        piece = _merger(ranks_path, pattern)._encode_single_piece
        # Ids of word number n: flat[starts[n] : starts[n + 1]]. A shard's words stay until the task ends.
        number: dict[bytes, int] = {}
        flat, starts = array("I"), array("q", [0])
        for batch in batches:
            out = []
            for head, payload in zip(batch.column("head").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if not head:
                    which, sizes, raw = unpack(payload)
                    ends = np.cumsum(numbers(sizes)).tolist()
                    words = [raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                    for w in words:
                        if w not in number:
                            number[w] = len(number)
                            # A pre-token is one match of the pattern, so its bytes are merged as they are.
                            flat.extend(piece(w))
                            starts.append(len(flat))
                    place = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    first = np.frombuffer(starts, np.int64)
                    size = first[place + 1] - first[place]
                    payload = pack(numbers(which), size, gathered(np.frombuffer(flat, np.uint32), first[place], size)[0])
                    del first  # the array may grow again
                out.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("head"), pa.array(out, pa.binary())], ["block", "head", "payload"])

    def assemble(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_slot(("bpe-assemble",))
        which, sizes, flat = [], [], []
        for batch in group:
            for head, payload in zip(batch.column("head").to_pylist(), batch.column("payload"), strict=True):
                if head:
                    raw_ids, raw_counts, raw_places = unpack(payload.as_py())
                    documents, counts, word = np.frombuffer(raw_ids, "<i8"), numbers(raw_counts), numbers(raw_places)
                else:
                    for own, raw in zip((which, sizes, flat), unpack(payload.as_py()), strict=True):
                        own.append(numbers(raw))
        order = np.concatenate([*(np.cumsum(x, dtype=np.int64) for x in which), np.zeros(0, np.int64)])
        listed = np.concatenate([*sizes, np.zeros(0, "<u4")]).astype(np.int64)
        tokens = np.concatenate([*flat, np.zeros(0, "<u4")]).astype(np.int32)
        # Ids of word k begin at first[k]; the ids of a position are copied from there.
        first, length = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        first[order], length[order] = np.cumsum(listed) - listed, listed
        begin = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        # A bounded number of positions at once, but for a longer document.
        at = 0
        while at < len(documents):
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + SLICE_WORDS, side="right")) - 1)
            own = word[begin[at] : begin[to]]
            ids, ends = gathered(tokens, first[own], length[own])
            bounds = np.concatenate([[0], ends])[begin[at : to + 1] - begin[at]]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            columns = [pa.array(documents[at:to], mask=documents[at:to] == -(1 << 63)), lists]
            if decoded:
                raw, stops = looked_up(ids, ranks_path)
                stops = np.concatenate([[0], stops])[bounds].astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(stops), pa.py_buffer(raw)]))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
            at = to

    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    shards = min(max(SHARDS[0], size // SHARD_BYTES), SHARDS[1])
    words = explode_words(docs, pattern, shards, id_col, text_col)
    merged = words.repartitionById(shards, F.col("shard")).mapInArrow(merge, "block long, head boolean, payload binary")
    return merged.groupBy("block").applyInArrow(assemble, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of its ids, looked up in the token-byte table.

    Null ids give null bytes, an id that the table lacks is an error. A column ``decoded`` of its own is replaced.
    """
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_slot(("bpe-decode",))
        for part in small_batches(batches, 2 << 20):
            out = []
            for own in part.column(ids_col):
                if not own.is_valid:
                    out.append(None)
                    continue
                out.append(looked_up(own.values.to_numpy(zero_copy_only=False), ranks_path)[0].tobytes())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(out, pa.binary())], [*(names[i] for i in kept), "decoded"])

    kept = [i for i, n in enumerate(names) if n.lower() != "decoded"]
    dtypes = [x for x in encoded.dtypes if x[0].lower() != "decoded"]
    given = "".join(f"`{n}` {t}, " for n, t in dtypes)
    return encoded.mapInArrow(run, f"{given}decoded binary")


@lru_cache(maxsize=1)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = {rank: token for token, rank in ranks(path).items()}
    every = [table.get(i, b"") for i in range(max(table) + 1)]
    sizes = np.array([len(t) for t in every], np.int64)
    return np.frombuffer(b"".join(every), np.uint8), np.cumsum(sizes) - sizes, sizes


def looked_up(ids: np.ndarray, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ids one after the other, and where each ends."""
    tokens, starts, sizes = _token_bytes(ranks_path)
    each = sizes[ids]
    if (each == 0).any():
        raise ValueError("an id is not in the token-byte table")
    return gathered(tokens, starts[ids], each)
