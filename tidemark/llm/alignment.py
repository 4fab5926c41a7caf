"""Which tokens of one vocabulary stand where tokens of another do, and how often over a whole corpus.

A is a byte-level vocabulary, B one of pieces with byte fallback. Both encode a text with a space before it; byte offsets where tokens of
both end cut it into groups. Most groups hold one token of each with the same bytes: for these a table from A's ids to B's
is computed first, and a document adds to a vector as long as A's vocabulary. Only the other groups' pairs are counted by a shuffle,
and not a document's own but those of a *block* of documents: a block sends each of its distinct pairs once, with its number of
documents, and gets the pair's count in the corpus back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, utf8, worker_slot
from .tokens import VISIBLE, Encoder, gathered, valid_texts

#: Bytes of text, and distinct pairs of its documents, after which a block ends.
BLOCK_BYTES, BLOCK_PAIRS = 8 << 20, 2_000_000
#: Links of a group, beyond which its distinct ids meet and their times are multiplied.
LONG_GROUP = 1_000_000
#: Chunks of text whose pieces a worker remembers.
CACHE_CHUNKS = 500_000

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
PACKED = ["regular", "regular_times", "pairs", "pair_times", "own_regular", "own_regular_docs", "own_pairs", "own_pair_docs"]
ROW = f"block long, at int, id long, {' long, '.join(COUNTS)} long, groups_sha256 string, {' binary, '.join(PACKED)} binary"


class Pieces:
    """Ids of vocabulary B for texts that begin with a space, each distinct chunk once.

    No piece has a space after anything else, so a text's ids are those of its chunks, which begin where a space follows another character.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space after another character: texts cannot be cut there")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes, self.whole = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def learn(self, words: list[bytes]) -> None:
        """Encodes chunks, and notes whether their pieces' bytes are theirs."""
        # The model puts a space before what it gets, but not before nothing.
        ids = self.model.encode([w[1:].decode() for w in words], num_threads=1)
        ids = [x if len(w) > 1 else [self.space] for w, x in zip(words, ids, strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.number.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
        piece = self.bytes.__getitem__
        self.whole = np.append(self.whole, np.fromiter((b"".join(map(piece, x)) == w for w, x in zip(words, ids, strict=True)), bool, len(words)))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, where each text's end, and whether their bytes are the text's."""
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        blank = data == 0x20
        cut = np.empty(len(data), bool)
        cut[0], cut[1:] = True, blank[1:] & ~blank[:-1]
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.number) + len(words) > CACHE_CHUNKS:
            self.forget()
        known = self.number
        new = [w for w in words if w not in known]
        if new:
            self.learn(new)
        place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        ids, stops = gathered(self.flat, self.starts[place], self.sizes[place])
        first = np.searchsorted(starts, np.append(0, ends[:-1]))
        return ids, stops[np.append(first[1:], len(starts)) - 1], np.logical_and.reduceat(self.whole[place], first)


class Aligner:
    """Both vocabularies, and the table from A's ids to B's ids of the same bytes (-1 for none)."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Encoder(path_a, "byte", 0, plain=True)
        self.b = Pieces(path_b)
        self.bytes_a = token_bytes(self.a.tokenizer)
        if self.a.tokenizer.normalizer is not None or not {bytes([x]) for x in range(256)} <= set(self.bytes_a):
            raise ValueError("the tokens of A must have the bytes of any text")
        by_bytes = {piece: i for i, piece in enumerate(self.b.bytes)}  # a piece of its own rather than a byte of fallback
        self.same = np.array([by_bytes.get(t, -1) for t in self.bytes_a], np.int64)
        self.long_a, self.long_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.b.bytes))
        self.n_a, self.n_b = len(self.bytes_a), len(self.b.bytes)
        # Each id in decimal and the sign after it, as one row of bytes: A's ids before , and |, B's before , and ;.
        written = [f"{i}{sign}".encode() for size, signs in ((self.n_a, ",|"), (self.n_b, ",;")) for sign in signs for i in range(size)]
        self.digits = np.fromiter(map(len, written), np.int64, len(written))
        wide = int(self.digits.max())
        self.written = np.frombuffer(b"".join(w.ljust(wide, b" ") for w in written), np.uint8).reshape(-1, wide)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(texts' numbers, A's ids, where each text's end, B's ids, where each text's end) of the texts that have tokens: those whose tokens' bytes are the text's, with a space before it."""
        spaced = [b" " + t for t in texts]
        (a, ends_a), (b, ends_b, whole) = self.a.encode(spaced), self.b.encode(spaced)
        keep = whole & (np.fromiter(map(len, texts), np.int64, len(texts)) > 0)
        numbers = np.flatnonzero(keep)
        starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
        size_a, size_b = (ends_a - starts_a - 1)[numbers], (ends_b - starts_b)[numbers]  # the encoder ends each text by an id
        a, ends_a = gathered(a, starts_a[numbers], size_a)
        b, ends_b = gathered(b, starts_b[numbers], size_b)
        return numbers, a.astype(np.int64), ends_a, b.astype(np.int64), ends_b

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of A and of B, from 0; texts one after the other end groups, as both end there."""
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        cut_a, cut_b = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x for x, y in ((ends_a, ends_b), (ends_b, ends_a)))
        return np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b

    def digests(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[str]:
        """The SHA-256 of each text's groups as text."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + np.where(last_a, self.n_a, 0)
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * self.n_a + b + np.where(last_b, self.n_b, 0)
        sizes = self.digits[order]
        text = self.written[order][np.arange(self.written.shape[1]) < sizes[:, None]].tobytes()
        stops = np.cumsum(sizes)[ends_a + ends_b - 1].tolist()
        return [hashlib.sha256(memoryview(text)[at : stop - 1]).hexdigest() for at, stop in zip([0, *stops[:-1]], stops, strict=True)]


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; an added token stands for its string."""
    value = {c: b for b, c in enumerate(VISIBLE)}
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    return [added.get(i) or bytes(map(value.__getitem__, tokenizer.id_to_token(i))) for i in range(tokenizer.get_vocab_size())]


def irregular_links(a: np.ndarray, b: np.ndarray, doc_a: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, irregular: np.ndarray, wide: int, long_group: int = LONG_GROUP) -> tuple[np.ndarray, np.ndarray]:
    """(document and pair, times): all pairs of a token of A and one of B of the same group, for the groups that are ``irregular``.

    A pair is A's id times the size of B's vocabulary, and B's; a document's number times ``wide`` is added. Long groups repeat their ids: their distinct ones meet.
    """
    n_a, n_b = np.bincount(group_a, minlength=len(irregular)), np.bincount(group_b, minlength=len(irregular))
    size_b = wide // WIDE_A
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    long = irregular & (n_a * n_b > long_group)
    own = np.flatnonzero((irregular & ~long)[group_a])
    each = n_b[group_a[own]]
    partner, _ = gathered(b, (stop_b - n_b)[group_a[own]], each)
    keys, times = np.unique(np.repeat(doc_a[own] * wide + a[own] * size_b, each) + partner, return_counts=True)
    found = [(keys, times)]
    for g in np.flatnonzero(long).tolist():
        (x, nx), (y, ny) = (np.unique(ids[stop[g] - n[g] : stop[g]], return_counts=True) for ids, stop, n in ((a, stop_a, n_a), (b, stop_b, n_b)))
        found.append(((doc_a[stop_a[g] - 1] * wide + x[:, None] * size_b + y).ravel(), (nx[:, None] * ny).ravel()))
    return found[0] if len(found) == 1 else summed(*map(np.concatenate, zip(*found, strict=True)))


#: More than A's ids: documents' numbers stand above all pairs.
WIDE_A = 1 << 20


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct key with the sum of its times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


class Block:
    """Documents one after the other: a row for each, and one with what all of them hold and add to the corpus's counts."""

    def __init__(self, number: int):
        self.number, self.bytes, self.n_pairs, self.n_docs = number, 0, 0, 0
        self.rows: list[pa.RecordBatch] = []
        self.regular: list[tuple[np.ndarray, np.ndarray]] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, texts: list[bytes], tool: Aligner) -> None:
        first, count = self.n_docs, len(texts)
        self.n_docs += count
        self.bytes += sum(map(len, texts))
        table, digests = np.zeros((4, count), np.int64), [""] * count
        numbers, a, ends_a, b, ends_b = tool.encode(texts)
        if len(numbers):
            wide = WIDE_A * tool.n_b
            group_a, group_b = tool.groups(a, b)
            last = group_a[ends_a - 1]  # of each document
            n_groups = int(last[-1]) + 1
            doc = np.repeat(numbers + first, np.diff(last, prepend=-1))  # of each group
            n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
            alone = (n_a == 1) & (n_b == 1)
            ones_a, ones_b = a[alone[group_a]], b[alone[group_b]]
            # Groups of one token each have the same bytes; several ids may have them, too, as bytes of fallback have.
            plain = tool.same[ones_a] == ones_b
            irregular = ~alone
            irregular[np.flatnonzero(alone)[~plain]] = True
            self.regular.append(np.unique(doc[alone][plain] * WIDE_A + ones_a[plain], return_counts=True))
            self.pairs.append(irregular_links(a, b, doc[group_a], group_a, group_b, irregular, wide))
            self.n_pairs += len(self.pairs[-1][0])
            starts = np.append(0, last[:-1] + 1)
            table[:, numbers] = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0), np.diff(last, prepend=-1), np.add.reduceat(n_a * n_b, starts)
            for n, d in zip(numbers.tolist(), tool.digests(a, b, group_a, group_b, ends_a, ends_b), strict=True):
                digests[n] = d
        place = [pa.array(np.full(count, self.number)), pa.array(np.arange(first, self.n_docs, dtype=np.int32))]
        self.rows.append(batch_of([*place, ids, *map(pa.array, table), pa.array(digests, pa.string()), *[pa.nulls(count, pa.binary())] * len(PACKED)]))

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or self.n_pairs >= BLOCK_PAIRS

    def batches(self, tool: Aligner) -> Iterator[pa.RecordBatch]:
        yield from self.rows
        wide = WIDE_A * tool.n_b
        none = (np.empty(0, np.int64),) * 2
        regular, pairs = (tuple(map(np.concatenate, zip(*x, strict=True))) if x else none for x in (self.regular, self.pairs))  # documents come in order
        own = np.unique(regular[0] % WIDE_A, return_counts=True)
        # A pair that a document has in a regular group, too, counts once.
        pair, a = pairs[0] % wide, pairs[0] % wide // tool.n_b
        namesake = np.flatnonzero(tool.same[a] == pair % tool.n_b)
        twice = np.isin(pairs[0][namesake] // wide * WIDE_A + a[namesake], regular[0])
        own_pairs = np.unique(np.delete(pair, namesake[twice]), return_counts=True)
        last = [pa.array([packed(x)], pa.binary()) for part in (regular, pairs, own, own_pairs) for x in part]
        yield batch_of([pa.array([self.number]), *[pa.nulls(1, t) for t in (pa.int32(), *[pa.int64()] * 5, pa.string())], *last])


def batch_of(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROW.split(", ")])


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes; ascending ones as differences, which compress."""
    import zstandard

    wide = x.astype("<i8")
    return zstandard.compress(np.concatenate([wide[:1], np.diff(wide)]).tobytes(), 1) if len(wide) else b""


def unpacked(x: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.decompress(x), "<i8")) if x else np.empty(0, np.int64)


def aligner(path_a: str, path_b: str) -> Aligner:
    return worker_slot(("alignment", path_a, path_b), lambda: Aligner(path_a, path_b))


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row of every document (``at``, its number in its block, and its counts), and one of each block (without ``at``) with the columns of ``PACKED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        block = Block(TaskContext.get().partitionId() << 40)
        for batch in small_batches(batches, 1 << 20):
            block.add(batch.column(0), valid_texts(batch.column(1)), tool)
            if block.full():
                yield from block.batches(tool)
                block = Block(block.number + 1)
        yield from block.batches(tool)

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(run, ROW)


def _listed(rows: DataFrame, keys: str, values: str, names: tuple[str, str]) -> DataFrame:
    """(block, key, value) of two packed columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, k, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key, value = unpacked(k), unpacked(v)
                for at in range(0, len(key), 100_000):
                    part = key[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(value[at : at + 100_000])], ["block", *names])

    return rows.select("block", keys, values).mapInArrow(run, f"block long, {names[0]} long, {names[1]} long")


def pair_counts(rows: DataFrame, same: np.ndarray, n_b: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The irregular pairs of each block with their counts (block, pair, n); and two vectors over A's ids: the count of an id with its namesake of B, and its greatest with any.

    Vectors are as long as the vocabulary, whatever the corpus.
    """
    ends = rows.where("at is null")
    vector = np.zeros(len(same), np.int64)
    for r in _listed(ends, "own_regular", "own_regular_docs", ("a", "docs")).groupBy("a").agg(F.sum("docs").alias("n")).collect():
        vector[r["a"]] = r["n"]
    own = stored(_listed(ends, "own_pairs", "own_pair_docs", ("pair", "docs")), "alignment-pairs")
    spark = rows.sparkSession
    # What regular groups add to pairs that irregular groups have, too.
    known = spark.createDataFrame(pa.table({"pair": np.flatnonzero(same >= 0) * n_b + same[same >= 0], "regular": vector[same >= 0]}))
    irregular = own.groupBy("pair").agg(F.sum("docs").alias("n")).join(F.broadcast(known), "pair", "left")
    total = stored(irregular.select("pair", (F.col("n") + F.coalesce("regular", F.lit(0))).alias("n"), F.col("regular").isNotNull().alias("namesake")), "alignment-counts")
    best, best_of = vector.copy(), total.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("most"), F.max(F.when(F.col("namesake"), F.col("n"))).alias("same"))
    for r in best_of.collect():
        best[r["a"]] = max(best[r["a"]], r["most"])
        vector[r["a"]] = r["same"] or vector[r["a"]]
    return own.select("block", "pair").join(total.select("pair", "n"), "pair"), vector, best


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A link is a token of A and one of B in the same group; an id pair's count is the number of rows that hold it linked. n_best are a row's links whose
    count is the highest of their A id, ties included; count_sum adds up the counts of all links. Null and empty texts and those that B's normaliser
    changes have no tokens: zeros and an empty digest. Rows that repeat an id, and rows without one, count each. Other columns are ignored. Only
    a group's distinct pairs are held in memory, however long the group.
    """
    rows = stored(blocks(docs, path_a, path_b, id_col, text_col), "alignment-blocks")
    tool = Aligner(path_a, path_b)
    n_b, wide = tool.n_b, WIDE_A * tool.n_b
    counts, vector, best = pair_counts(rows, tool.same, n_b)
    shared = docs.sparkSession.sparkContext.broadcast((vector, best))
    del tool
    out = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        vector, best = shared.value
        at = left.column("at").combine_chunks()
        ends, left = left.filter(at.is_null()), left.filter(at.is_valid())
        regular, times, pairs, pair_times = (unpacked(ends.column(c)[0].as_py()) for c in PACKED[:4])
        known, n = (right.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(known)
        known, n = np.append(known[order], -1), np.append(n[order], 0)
        a, pair = regular % WIDE_A, pairs % wide
        # A pair that only stands beside a regular one of the same document is not among the block's.
        found = np.searchsorted(known[:-1], pair)
        count = np.where(known[found] == pair, n[found], vector[pair // n_b])
        where, size = np.append(regular // WIDE_A, pairs // wide), left.num_rows
        each, of = np.append(times, pair_times), np.append(vector[a], count)
        top = of == np.append(best[a], best[pair // n_b])
        total, n_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(total, where, each * of)
        np.add.at(n_best, where, each * top)
        mine = left.column("at").to_numpy()
        whole = [left.column(c) for c in ("id", *COUNTS)]
        return pa.Table.from_arrays([*whole, pa.array(n_best[mine]), pa.array(total[mine]), left.column("groups_sha256")], [c.split()[0] for c in out.split(", ")])

    found = rows.select("block", "at", "id", *COUNTS, "groups_sha256", *PACKED[:4]).groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(settle, out)
    return found.withColumnRenamed("id", id_col)
