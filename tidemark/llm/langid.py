"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces, which a
forward pass adds up, so segmentations are never chosen. A text's score is the sum of the logarithms
of its words, divided by the root of their number: words are far from independent, so the evidence
counts as that of fewer. Piece probabilities come from expectation-maximisation (forward-backward
expected counts) over the words of a bounded, documented sample of the training rows.
A character outside the vocabulary is a piece of its own with a small probability.

Pieces and parts of words are compared by 64-bit hashes (polynomials of mixed code points), so all
pieces and all characters of the vocabulary count, however long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, stored, text_at, utf8, with_text, worker_slot

#: Runs of letters; everything else carries no language and separates words.
WORD = regex.compile(r"\p{L}+")
MARK = "▁"  # begins a word in the vocabulary
#: The most training rows of each language that a fit reads (those with the least hashes of id and text), and their characters.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 6_000_000
#: Distinct words that a Python worker remembers at once; beyond that it starts anew.
CACHE_WORDS = 300_000
#: Bytes of text whose words a Python worker holds at once; as strings they take about ten times as much.
BATCH_BYTES = 2 << 20
#: Words up to this length share array operations, longer ones are passed one by one in logarithms.
SHARED_LENGTH = 64
UNKNOWN = 1e-7
#: Each character multiplies a probability by this, so that products of up to ``SHARED_LENGTH`` characters stay in range.
SCALE = 1e3
BASE = 0x9E3779B97F4A7C15


def letter_codes(points: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point (the finalizer of splitmix64)."""
    x = points.astype(np.uint64) + np.uint64(BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes_of(words: list[str]) -> np.ndarray:
    """(words, 1 + length) letter codes of words of one length, with the mark before them."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    return letter_codes(np.concatenate([np.full((len(words), 1), ord(MARK), np.uint32), points], axis=1))


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def piece_key(piece: str) -> int:
    codes = letter_codes(np.array([ord(c) for c in reversed(piece)])).tolist()
    return sum(c * pow(BASE, n, 1 << 64) for n, c in enumerate(codes)) % (1 << 64)


class Pieces:
    """The vocabulary as sorted keys, with the length of each piece."""

    def __init__(self, pieces: list[str]):
        known = sorted((piece_key(p), len(p)) for p in set(pieces) if p)
        self.keys = np.array([k for k, _ in known], np.uint64)
        self.sizes = np.array([n for _, n in known], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        self.hint = np.zeros(1 << 20, bool)
        self.hint[self.keys >> np.uint64(44)] = True

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key, and the number of keys for none."""
        out = np.full(key.shape, len(self.keys), np.int32)
        some = np.flatnonzero(self.hint[key >> np.uint64(44)])
        at = np.searchsorted(self.keys, key.ravel()[some])
        own = at < len(self.keys)
        own[own] = self.keys[at[own]] == key.ravel()[some][own]
        out.ravel()[some[own]] = at[own]
        return out

    def scaled(self, p: np.ndarray) -> np.ndarray:
        """Probabilities times ``SCALE`` for each character, and a last row of zeros for no piece."""
        return np.concatenate([p * SCALE ** self.sizes[:, None], np.zeros((1, p.shape[1]))])


class Lattice:
    """Which pieces of a vocabulary end where, for many words of one length at once."""

    def __init__(self, codes: np.ndarray, pieces: Pieces):
        self.words, self.length = codes.shape
        self.arcs: list[list[np.ndarray]] = []  # [end - 1][length - 1]: piece numbers
        for end in range(1, self.length + 1):
            key = np.zeros(self.words, np.uint64)
            own = []
            for n in range(1, min(pieces.longest, end) + 1):
                key = key + codes[:, end - n] * power(n - 1)
                own.append(pieces.find(key))
            self.arcs.append(own)

    def forward(self, p: np.ndarray) -> list[np.ndarray]:
        """alpha[i]: scaled probability of the first i characters, summed over segmentations."""
        alpha = [np.ones((self.words, p.shape[1]))]
        for end, own in enumerate(self.arcs, start=1):
            total = alpha[end - 1] * (UNKNOWN * SCALE)
            for n, piece in enumerate(own, start=1):
                total += alpha[end - n] * p[piece]
            alpha.append(total)
        return alpha

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by forward-backward."""
        alpha = self.forward(p)
        beta = [np.zeros_like(alpha[0]) for _ in alpha]
        beta[-1] = counts / alpha[-1]
        found = np.zeros_like(p)
        for end in range(self.length, 0, -1):
            beta[end - 1] += beta[end] * (UNKNOWN * SCALE)
            for n, piece in enumerate(self.arcs[end - 1], start=1):
                flow = beta[end] * p[piece]
                beta[end - n] += flow
                flow *= alpha[end - n]
                for lang in range(p.shape[1]):
                    found[:, lang] += np.bincount(piece, flow[:, lang], len(p))
        return found


def long_word(codes: np.ndarray, pieces: Pieces, p: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The same for one word of any length, in logarithms: its scaled log probability, or with ``counts`` the expected uses."""
    length, width = len(codes), pieces.longest
    arcs = np.full((length + 1, width), len(pieces.keys), np.int32)  # [end][n - 1]
    key = np.zeros(length, np.uint64)
    for n in range(1, min(width, length) + 1):
        key = key[-(length - n + 1) :] + codes[: length - n + 1] * power(n - 1)  # parts that end at n, n + 1, ...
        arcs[n:, n - 1] = pieces.find(key)
    unknown = UNKNOWN * SCALE
    alpha = np.full((width + length + 1, p.shape[1]), -np.inf)  # log of alpha, after ``width`` empty places
    alpha[width] = 0.0
    for end in range(1, length + 1):
        at = width + end
        step = np.exp(alpha[at - width : at][::-1] - alpha[at - 1]) * p[arcs[end]]
        alpha[at] = alpha[at - 1] + np.log(step.sum(axis=0) + unknown)
    if counts is None:
        return alpha[-1]
    beta = np.full((length + 1 + width, p.shape[1]), -np.inf)
    beta[length] = 0.0
    # [start][n - 1]: the piece of n characters from there on.
    ahead = np.full((length + 1, width), len(pieces.keys), np.int32)
    for n in range(1, min(width, length) + 1):
        ahead[: length - n + 1, n - 1] = arcs[n:, n - 1]
    for start in range(length - 1, -1, -1):
        step = np.exp(beta[start + 1 : start + 1 + width] - beta[start + 1]) * p[ahead[start]]
        beta[start] = beta[start + 1] + np.log(step.sum(axis=0) + unknown)
    found = np.zeros_like(p)
    for n in range(1, min(width, length) + 1):
        flow = np.exp(alpha[width : width + length - n + 1] + beta[n : length + 1] - alpha[-1]) * p[arcs[n:, n - 1]] * counts
        for lang in range(p.shape[1]):
            found[:, lang] += np.bincount(arcs[n:, n - 1], flow[:, lang], len(p))
    return found


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, letter codes) of words of one length, at most 16,384 at once, and one at once above ``SHARED_LENGTH``."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        step = 1 << 14 if n < SHARED_LENGTH else 1
        for at in range(0, len(rows), step):
            yield rows[at : at + step], codes_of([words[i] for i in rows[at : at + step]])


@dataclass
class Model:
    """A vocabulary and the scaled probability of its pieces in each of ``langs``."""

    langs: list[str]
    pieces: Pieces
    probability: np.ndarray
    priors: np.ndarray
    row: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"row": {}, "table": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log of each word's probability in each language, over all segmentations."""
        found = np.zeros((len(words), len(self.langs)))
        for rows, codes in by_length(words):
            shared = codes.shape[1] <= SHARED_LENGTH
            logs = np.log(Lattice(codes, self.pieces).forward(self.probability)[-1]) if shared else long_word(codes[0], self.pieces, self.probability)
            found[rows] = logs - codes.shape[1] * np.log(SCALE)
        return found

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each language, number of words) of each text; rows without words are uniform."""
        words = [WORD.findall(t.lower()) for t in texts]
        if self.table is None or len(self.row) > CACHE_WORDS:
            self.row, self.table = {}, np.zeros((0, len(self.langs)))
        new = list({w for own in words for w in own if w not in self.row})
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.word_scores(new)])
        size = np.array([len(own) for own in words])
        total = np.array([self.table[np.fromiter(map(self.row.__getitem__, own), np.int64, len(own))].sum(axis=0) for own in words]).reshape(-1, len(self.langs))
        score = total / np.sqrt(np.maximum(size, 1))[:, None] + self.priors
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True), size


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.lower() for p in map(model.id_to_piece, kept)})


def expected_uses(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (rows) in each language over words with ``counts`` (words, languages)."""
    found = np.zeros((len(pieces.keys) + 1, counts.shape[1]))
    for rows, codes in by_length(words):
        if codes.shape[1] <= SHARED_LENGTH:
            found += Lattice(codes, pieces).expected(p, counts[rows])
        else:
            found += long_word(codes[0], pieces, p, counts[rows[0]])
    return found[:-1]


def sample(docs: DataFrame, keep: Column, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) of a bounded sample of the rows that ``keep`` admits and that have a text and a language; and all rows of each language.

    Each language is drawn by itself: the rows with the least hashes of id and text, at most ``SAMPLE_ROWS`` of them, as many as
    have ``SAMPLE_CHARS`` characters together. Rows that repeat an id and its text count once, and cost others nothing. Texts that alone are longer are left out. Ties of the hash are broken by the id.
    """
    rows = docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spread = rows.withColumn("spread", F.xxhash64("id", "text"))
    counted = spread.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("spread").alias("different")).collect()
    sizes, different = ({r["lang"]: r[c] for r in counted} for c in ("n", "different"))
    spread = spread.where(F.length("text") <= SAMPLE_CHARS)
    # Four times the rows that may stay, by the hash alone, so that few are ranked.
    share = F.create_map(*[F.lit(x) for lang, n in different.items() for x in (lang, min(1.0, 4 * SAMPLE_ROWS / n))]) if sizes else F.lit(None)
    spread = spread.where(F.col("spread") / 2.0**64 + 0.5 <= share[F.col("lang")]) if sizes else spread
    order = Window.partitionBy("lang").orderBy("spread", "id")
    # Only hashes and lengths are ranked, and each task keeps no more than ``SAMPLE_ROWS`` of a language before the shuffle.
    ranked = spread.select("lang", "spread", "id", F.length("text").alias("chars")).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_ROWS)
    held = ranked.withColumn("sum", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= SAMPLE_CHARS)
    last = held.groupBy("lang").agg(F.max("spread").alias("last"))
    return spread.join(F.broadcast(last), "lang").where("spread <= last").select("lang", "id", "text").distinct().select("lang", "text"), sizes


def train(docs: DataFrame, keep: Column, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = 4, smooth: float = 0.05) -> Model:
    """Fits on a bounded sample (see ``sample``) by EM; all words of the sample count.

    Spark counts the words and adds up the expected uses of each round; the driver holds the vocabulary's
    probabilities alone. Without any training row it is an error.
    """
    rows, sizes = sample(docs, keep, id_col, text_col, lang_col)
    if not sizes:
        raise ValueError("no training row has a language")
    langs = sorted(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            found: Counter[tuple[int, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = langs.index(lang)
                found.update((k, w) for w in WORD.findall(text.as_py().decode("utf-8", "replace").lower()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    words = rows.select("lang", utf8("text").alias("text")).mapInArrow(count, "lang int, word string, n long")
    each = F.array(*[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).cast("double") for k in range(len(langs))])
    words = stored(words.groupBy("word").agg(each.alias("counts")), "langid-words")
    pieces = Pieces(vocabulary(vocabulary_path))
    spark = docs.sparkSession
    probability = np.full((len(pieces.keys), len(langs)), 1.0 / max(1, len(pieces.keys)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, pieces.scaled(probability)))

        def uses(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, p = shared.value
            found = np.zeros((len(own.keys), p.shape[1]))
            for batch in batches:
                counts = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
                found += expected_uses(batch.column(0).to_pylist(), counts, own, p)
            piece, lang = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(found[piece, lang])], ["piece", "lang", "n"])

        got = words.mapInArrow(uses, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        found = np.full(probability.shape, smooth)
        found[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
        probability = found / found.sum(axis=0)
    share = np.array([sizes[lang] for lang in langs], float)
    return Model(langs, pieces, pieces.scaled(probability), np.log(share / share.sum()))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """``keep_cols`` plus lang_pred and score, the posterior of the predicted language.

    A null text or one without letters gets ``und`` and 0. Ties go to the language that comes
    first in the alphabet. Kept columns named lang_pred or score are replaced.
    """
    names = [c for c in keep_cols or [] if c.lower() not in ("lang_pred", "score")]
    source, at = with_text(docs, names, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_slot(("langid",))
        model = shared.value
        for batch in small_batches(batches, BATCH_BYTES):
            found, size = model.texts(list(text_at(batch, at)))
            best = found.argmax(axis=1)
            langs = [model.langs[k] if n else "und" for k, n in zip(best.tolist(), size.tolist(), strict=True)]
            scores = np.where(size > 0, found[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    given = "".join(f"`{n}` {t}, " for n, t in source.dtypes[: len(names)])
    return source.mapInArrow(run, f"{given}lang_pred string, score double")
