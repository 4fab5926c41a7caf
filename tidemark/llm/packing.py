"""Packing of tokenised documents into sequences: dominance reduction, then best fit.

Documents longer than a sequence are cut; all other pieces stay whole. How many pieces there
are of each length is all that a packing depends on, and there are at most as many lengths
as a sequence has tokens. So the plan is made on that histogram: first the reduction of
Martello and Toth fixes sequences whose set of pieces provably dominates every
alternative, then the remainder goes best fit, longest first. A plan is a list of *patterns*
(pieces of given lengths, and how many equal sequences hold them), whose number the histogram
bounds too. Spark then numbers the pieces of each length and looks up
the sequence and the offset that the plan gives to that number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches, stored, utf8
from .tokens import encoder, valid_texts


@dataclass(frozen=True)
class Pattern:
    """``sequences`` equal sequences, each with the pieces ``lengths`` = ((length, how many), ...)."""

    sequences: int
    lengths: tuple[tuple[int, int], ...]


def reduce_by_dominance(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Fixes sequences that some optimal packing must allow; takes their pieces out of ``left``.

    For pieces of a length w, with r = capacity - w: if nothing else fits, w is alone; a partner of
    exactly r dominates every other set; if no two other pieces fit together into r, the longest one that
    fits dominates; and if no three fit, the longest fitting piece dominates when it is at least as long as
    the longest fitting pair. The exact-fit rule holds for every length; the others are tried from the longest
    length down, past lengths that they do not settle, as long as no three of the shortest pieces fit beside one.
    """
    fixed = []

    def fix(count: int, *lengths: int) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        for x, n in need.items():
            left[x] -= n * count
            if not left[x]:
                del left[x]
        fixed.append(Pattern(count, tuple(sorted(need.items(), reverse=True))))

    if left.get(capacity):
        fix(left[capacity], capacity)
    for w in sorted(left, reverse=True):
        other = capacity - w
        if w > other and left.get(w) and left.get(other):
            fix(min(left[w], left[other]), w, other)
        elif w == other and left.get(w, 0) > 1:
            fix(left[w] // 2, w, w)

    def settle(w: int, lengths: list[int]) -> bool:
        """Fixes the pieces of length ``w`` if some set with one of them dominates all others with one."""
        room = capacity - w
        others = [x for x in lengths if x != w or left[w] > 1]
        fits = others[: bisect_right(others, room)]
        if not fits:
            fix(left[w], w)
            return True
        best = fits[-1]
        if 2 * fits[0] <= room:
            partners = ((x, fits[bisect_right(fits, room - x) - 1]) for x in fits if room - x >= fits[0])
            if best < max((x + y for x, y in partners if x != y or left[x] > 1 + (x == w)), default=0):
                return False
        if best == w:
            fix(max(1, left[w] // 2), w, w)
        else:
            fix(min(left[w], left[best]), w, best)
        return True

    changed = True
    while changed and left:
        changed, lengths = False, sorted(left)
        for w in reversed(lengths):
            # Shorter pieces leave more room: none of them is settled once three of the shortest fit.
            if 3 * lengths[0] <= capacity - w:
                break
            if settle(w, lengths):
                changed = True
                break
    return fixed


def best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit of a histogram, longest pieces first: each goes where the least room stays."""
    bins: dict[int, list[list]] = {}  # room -> [[sequences, lengths], ...]
    rooms: list[int] = []

    def put(room: int, entry: list) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append(entry)

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * w, [full, ((w, each),)])
                if rest:
                    put(capacity - rest * w, [1, ((w, rest),)])
                break
            room = rooms[at]
            sequences, lengths = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            # The piece makes its sequence the tightest one, so the next equal piece follows it.
            each = room // w
            full = min(sequences, n // each)
            if full:
                put(room - each * w, [full, (*lengths, (w, each))])
                n -= full * each
            rest = sequences - full
            if rest and n and n < each:
                put(room - n * w, [1, (*lengths, (w, n))])
                n, rest = 0, rest - 1
            if rest:
                put(room, [rest, lengths])
    return [Pattern(s, lengths) for room in rooms for s, lengths in bins[room]]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold exactly the pieces of ``histogram`` (length -> count, lengths 1 to capacity)."""
    left = {w: n for w, n in histogram.items() if n}
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


class Slots:
    """Where the plan puts the k-th piece of each length."""

    def __init__(self, patterns: list[Pattern]):
        by_length: dict[int, list[tuple[int, int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        base = 0
        for p in patterns:
            offset = 0
            for w, each in p.lengths:
                begin = taken.get(w, 0)
                by_length.setdefault(w, []).append((begin, each, base, offset, w))
                taken[w] = begin + each * p.sequences
                offset += w * each
            base += p.sequences
        self.sequences = base
        self.table = {w: np.array(rows, np.int64) for w, rows in by_length.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for w in np.unique(length).tolist():
            mine = np.nonzero(length == w)[0]
            t = self.table[w]
            row = t[np.searchsorted(t[:, 0], rank[mine], side="right") - 1]
            nth = rank[mine] - row[:, 0]
            sequence[mine] = row[:, 2] + nth // row[:, 1]
            offset[mine] = row[:, 3] + nth % row[:, 1] * w
        return sequence, offset


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, kind: str = "word", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every row, with the task that made them and their place among its pieces of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, kind, end_id)
        made: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in small_batches(batches):
            out: list[list] = [[] for _ in range(9)]
            flat, ends = enc.encode(valid_texts(batch.column(1)))
            flat, begin = flat.astype("<u4"), 0
            for doc_id, stop in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                ids, begin = flat[begin:stop], stop
                for k, at in enumerate(range(0, len(ids), capacity)):
                    some = ids[at : at + capacity]
                    n = len(some)
                    nth = made[n] = made.get(n, -1) + 1
                    for column, value in zip(out, (doc_id, k, at, n, zlib.crc32(some), part, nth, some if with_ids else None), strict=False):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"][: 7 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(out, kinds, names, strict=False)], names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return source.mapInArrow(run, f"{PIECE}, part int, nth long" + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, kind: str = "word", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there (and its ids, if asked for).

    A null text counts as empty: its only token is ``end_id``. Repeated rows and null ids are pieces of
    their own. Offsets of a sequence leave no gap. An empty table gives no rows.
    """
    made = stored(pieces(docs, tokenizer_path, end_id, capacity, kind, id_col, text_col, with_ids), "packing-pieces")
    counts = cut(made.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = docs.sparkSession.sparkContext.broadcast(Slots(plan(histogram, capacity)))
    # The number of a piece among all of its length: those of earlier tasks, then its place in its own task.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    given = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return given.mapInArrow(place, PIECE + ", ids array<long>" * with_ids + ", sequence_id long, offset long")
