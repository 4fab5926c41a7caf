"""SimHash near-duplicates found through Golay-code keys.

The 64 fingerprint bits are cut into three segments (22, 21 and 21 bits, each
padded with zeros to the 23 bits of the binary Golay code). ``decode`` maps a
segment to the 12-bit index of the one codeword within distance 3. Decoding a
segment together with all its one-bit variations gives the *near keys* of the
segment: a perfect code leaves only a handful of distinct indices, and any
segment value that differs in at most one bit decodes to one of them.

If two fingerprints differ in at most three bits, drop the segment with most
errors; the other two then hold at most (1, 1) errors, and (1, 1) happens only
when every segment holds exactly one. So the following joins find every pair:

* One error each: left side (near keys of A and C, index of B), right side
  (indices of A and C, near keys of B).
* {A, C} and {B, C}, and {A, B}, one error in one of them: left side (exact value,
  near keys), right side (exact value, index).

Candidates are verified by the Hamming distance inside the join condition.

Copies never meet in a join: all work is on distinct fingerprints, each standing
for its smallest document. Groups of near copies are contracted before the
pairwise step: every key bucket first links its members to one representative,
and the join then pairs only fingerprints that are not yet connected, which
loses no connection.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut, small_batches, stored, utf8, worker_slot
from .components import connected_components

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width)
MAX_DISTANCE = 3
SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a UTF-8 text over hashed word shingles; 0 for a text without words."""
    found = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    total, step = len(found) - words + 1, 1 << 16
    ones = np.zeros(64, np.int64)
    for at in range(0, total, step):
        part = found[at : at + step + words - 1]
        grams = zip(*(part[i:] for i in range(words)), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in map(b" ".join, grams)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long) of every row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_slot(("simhash",))
        for batch in small_batches(batches):
            prints = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return source.mapInArrow(run, "id long, fp long")


@lru_cache(maxsize=1)
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte in its three places, and the error pattern of each syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    by_bit = [remainder(1 << bit) for bit in range(23)] + [0]
    by_byte = np.zeros((3, 256), np.int64)
    for place in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1:
                    by_byte[place, value] ^= by_bit[8 * place + bit]
    errors = np.zeros(2048, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                bits = {a, b, c}
                syndrome = 0
                for bit in bits:
                    syndrome ^= by_bit[bit]
                errors[syndrome] = sum(1 << bit for bit in bits)
    return by_byte, errors


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    by_byte, errors = _decoder()
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    return (words ^ errors[syndrome]) >> 11


def near_keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for the distinct codeword indices of each word and its one-bit variations."""
    flips = np.concatenate([[0], 1 << np.arange(width)])
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(first)
    return row, found[row, column]


def keys(prints: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the left and of the right side of the candidate join.

    A key holds the family in its top bits, so families never meet.
    """
    bits = prints.view(np.uint64)
    parts = [(bits >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    index = [decode(p) for p in parts]
    near = [near_keys(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    every = np.arange(len(prints))
    left, right = [], []
    # All pairs of a near key of A and one of C.
    (row, key), (other_row, other) = near[0], near[2]
    size = np.bincount(other_row, minlength=len(prints))
    each = size[row]
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    at = np.repeat((np.cumsum(size) - size)[row], each) + nth
    row, key = np.repeat(row, each), np.repeat(key, each)
    left.append((row, key << 24 | index[1][row] << 12 | other[at]))
    row, key = near[1]
    right.append((row, index[0][row] << 24 | key << 12 | index[2][row]))
    for family, (exact, loose) in enumerate(((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)), start=1):
        tag = family << 36
        row, key = near[loose]
        left.append((row, tag | parts[exact][row] << 12 | key))
        right.append((every, tag | parts[exact] << 12 | index[loose]))
    return tuple(tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in (left, right))  # type: ignore[return-value]


def key_rows(nodes: DataFrame, side: int) -> DataFrame:
    """(key, columns of ``nodes``): the keys of each fp, left side 0 or right side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row, key = keys(part.column("fp").to_numpy(zero_copy_only=False))[side]
                yield pa.RecordBatch.from_arrays([pa.array(key), *part.take(pa.array(row)).columns], ["key", *part.schema.names])

    return nodes.mapInArrow(run, f"key long, {', '.join(f'{n} {t}' for n, t in nodes.dtypes)}")


def near_components(prints: DataFrame) -> DataFrame:
    """(fp, node, component) of the distinct fingerprints of ``prints`` (id, fp).

    node is the smallest id that has the fingerprint, component the smallest id
    reachable through links of at most three differing bits.
    """
    nodes = stored(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "simhash-nodes")
    close = "bit_count(a.fp ^ b.fp) <= 3"
    # One representative per bucket first: linear in the number of keys.
    right = key_rows(nodes, 1)
    least = right.groupBy("key").agg(F.min_by(F.struct("node", "fp"), "node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    star = right.alias("a").join(by_key(least.alias("r")), "key").where("a.node <> r.hub.node and bit_count(a.fp ^ r.hub.fp) <= 3")
    star = star.select(F.col("hub.node").alias("src"), F.col("a.node").alias("dst")).distinct()
    first = connected_components(star)
    labelled = nodes.join(first, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("label"))
    labelled = stored(labelled, "simhash-labels")
    pairs = key_rows(labelled, 0).alias("a").join(by_key(key_rows(labelled, 1).alias("b")), "key")
    pairs = pairs.where(f"a.label <> b.label and {close}")
    links = pairs.select(F.least("a.label", "b.label").alias("src"), F.greatest("a.label", "b.label").alias("dst")).distinct()
    merged = connected_components(links).select(F.col("node").alias("label"), F.col("component").alias("merged"))
    return labelled.join(merged, "label", "left").select("fp", "node", F.coalesce("merged", "label").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Every row's id, fingerprint and component.

    A null text counts as empty and has fingerprint zero, which links like any
    other. Rows that repeat an id stay rows of their own; a row without an id
    keeps its fingerprint and gets the component of that fingerprint, null where no row with an
    id shares it. Other columns are ignored, so their names cannot clash.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    groups = near_components(prints).select("fp", "component")
    joined = prints.join(groups, "fp", "left")
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
