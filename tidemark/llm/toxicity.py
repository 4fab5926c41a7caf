"""Toxicity by multiple-instance learning with a noisy-or over sentences.

A document is a bag of sentences. A sentence's probability is a logistic
function of the words and word beginnings in it, the document's is
``1 - prod(1 - p)`` over its sentences, and only documents have labels. The
gradient of the document's likelihood reaches each sentence in proportion to
what that sentence contributes to the noisy-or, so the weights learn which
sentences are to blame, and the model can point at them afterwards.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_at, with_text, worker_slot

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"\w+")
PREFIX = 4
#: The most labelled rows that a fit reads; which ones follows from a hash of the text alone.
SAMPLE_ROWS = 12_000
#: Characters of the sample's texts that a fit may hold at once; the row bound shrinks so that it holds.
SAMPLE_CHARS = 40_000_000


def features(sentence: str) -> list[str]:
    """Lower-cased words of a sentence and, marked by ``^``, the beginnings of longer ones."""
    words = WORD.findall(sentence.lower())
    return [*words, *{"^" + w[:PREFIX] for w in words if len(w) > PREFIX}]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def sentence(self, text: str) -> float:
        """log(1 - p) of a sentence: minus the softplus of its logit, repeated features once."""
        get = self.weights.get
        words = set(WORD.findall(text.lower()))
        z = self.bias + sum(get(w, 0.0) for w in words) + sum(get(p, 0.0) for p in {"^" + w[:PREFIX] for w in words if len(w) > PREFIX})
        return -(z + log1p(exp(-z)) if z > 0 else log1p(exp(z)))

    def document(self, text: str) -> tuple[float, list[float]]:
        """Probability of a text, and of each of its sentences in order."""
        each = [self.sentence(s) for s in SENTENCE.split(text)]
        return 1.0 - exp(sum(each)), [1.0 - exp(x) for x in each]


def fit(texts: Sequence[str], labels: np.ndarray, least_docs: int = 5, most_features: int = 20_000, rounds: int = 100, sparse: float | None = None) -> Model:
    """Trains on whole texts with full-batch Adam; deterministic.

    Features need ``least_docs`` documents; of more than ``most_features`` those stay whose
    presence tells most about the label. ``sparse`` documents' worth of evidence are taken off every
    weight (an L1 penalty; by default 3, and less for few toxic documents), so words that toxic documents
    hold by chance fall to zero. Without both labels every score is the base rate.
    """
    base = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(float(np.log(base / (1 - base))), {})
    sparse = min(3.0, max(0.3, int(labels.sum()) / 200)) if sparse is None else sparse
    number: dict[str, int] = {}
    seen = (array("i"), array("i"))  # documents of each label that hold feature n
    for text, y in zip(texts, labels.tolist(), strict=True):
        for f in {f for s in SENTENCE.split(text) for f in features(s)}:
            n = number.setdefault(f, len(number))
            if n == len(seen[0]):
                seen[0].append(0)
                seen[1].append(0)
            seen[y][n] += 1
    totals = np.array([np.sum(labels == 0), np.sum(labels == 1)]) + 1.0
    names = [f for f, n in number.items() if seen[0][n] + seen[1][n] >= least_docs]
    counts = np.array([[seen[0][number[f]], seen[1][number[f]]] for f in names], float).reshape(-1, 2)
    tell = np.abs(np.log((counts[:, 1] + 0.5) / totals[1]) - np.log((counts[:, 0] + 0.5) / totals[0])) * np.sqrt(counts.sum(axis=1))
    order = np.argsort(-tell, kind="stable")[:most_features]
    column = {names[i]: j for j, i in enumerate(order)}
    del seen, number, names, counts
    index, sizes, bag = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in SENTENCE.split(text):
            own = {column[f] for f in features(s) if f in column}
            index.extend(own)
            sizes.append(len(own))
            bag.append(d)
    n = len(bag)
    col, row, bags = np.array(index), np.repeat(np.arange(n, dtype=np.int32), np.array(sizes)), np.array(bag)
    del index, sizes, bag
    y = labels.astype(float)

    def summed(to: np.ndarray, values: np.ndarray, which: np.ndarray, size: int) -> np.ndarray:
        """Sums of ``values[which]`` by ``to``, in slices that bound the memory."""
        out = np.zeros(size)
        for at in range(0, len(to), 1 << 20):
            part = slice(at, at + (1 << 20))
            out += np.bincount(to[part], values[which[part]], size)
        return out

    def descend(col: np.ndarray, row: np.ndarray, w: np.ndarray, b: float, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        size, rate = len(texts), 0.15
        for t in range(1, rounds + 1):
            z = b + summed(row, w, col, n)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            quiet = np.bincount(bags, np.log1p(-np.minimum(p, 1 - 1e-12)), size)  # log of no toxic sentence
            whole = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-9)
            # d loss / d z of a sentence: p for clean documents, -p (1 - P) / P for toxic ones.
            g = p * np.where(y[bags] == 1, -(1 - whole[bags]) / whole[bags], 1.0)
            gw, gb = summed(col, g, row, len(w)) / size + penalty / size * np.sign(w), float(g.sum()) / size
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        return w, b

    w, b = descend(col, row, np.zeros(len(column)), -4.0, sparse, rounds)
    # Once more with the features that are left, hardly shrunk.
    chosen = np.abs(w) > 0.2
    held = chosen[col]
    w, b = descend(col[held], row[held], np.where(chosen, w, 0.0), b, sparse / 30, rounds)
    w[~chosen] = 0.0
    weights = {f: float(w[j]) for f, j in column.items() if abs(w[j]) > 0.2}
    return Model(float(b), weights)


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """A bounded sample (text, label) of the labelled rows that ``keep`` admits.

    It holds the rows with the least hashes of id and text, as many as keep both bounds, so it does not
    depend on partitions or on the order of rows. Rows that repeat an id and its text count once, and cost others nothing. Texts longer than ``SAMPLE_CHARS`` are left out. Ids with contradicting labels, null ids and null labels are left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("top")).where("label = top")
    own = docs.where(keep).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Only lengths, and then only the sampled texts, take part in a join. Copies of a text enter on their own by their ids.
    own = own.withColumn("spread", F.shiftrightunsigned(F.xxhash64("id", "text"), 1)).where(F.length("text") <= SAMPLE_CHARS)
    drawn = own.select("id", "spread", F.length("text").alias("chars")).distinct().join(known, "id").select("spread", "chars")
    first = drawn.orderBy("spread").limit(SAMPLE_ROWS + 1).toArrow()
    spread, chars = first.column("spread").to_numpy(), first.column("chars").to_numpy().astype(np.int64)
    fit_in = min(SAMPLE_ROWS, int(np.searchsorted(np.cumsum(chars), SAMPLE_CHARS, side="right")))
    if fit_in < len(spread):
        # Rows that share the hash of the first one left out stay out too.
        own = own.where(F.col("spread") < int(spread[fit_in]))
    return own.select("id", "text").distinct().join(known, "id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits a model on a bounded sample; the result is never larger than ``most_features`` of ``fit``."""
    rows = training_rows(docs, labels, keep, id_col, text_col, label_col).toArrow().sort_by([("text", "ascending"), ("label", "ascending")])
    return fit(Texts(rows.column("text").combine_chunks()), rows.column("label").to_numpy())


class Texts(Sequence):
    """Texts that stay in Arrow memory and become strings one at a time."""

    def __init__(self, column: pa.StringArray):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, at: int) -> str:
        return self.column[at].as_py()


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """``docs`` columns ``keep_cols`` plus ``score`` (0 to 1) and ``sentences``, the offending ones.

    sentences holds (start, end, score) in code points for every sentence with p >= 0.5.
    Null and empty texts get the score of one empty sentence. Kept columns named score or sentences are replaced.
    """
    names = [c for c in keep_cols or [] if c.lower() not in ("score", "sentences")]
    source, at = with_text(docs, names, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def spans(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        for m in SENTENCE.finditer(text):
            yield at, m.start()
            at = m.end()
        yield at, len(text)

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_slot(("toxicity",))
        model = shared.value
        for batch in small_batches(batches):
            scores, found = [], []
            for text in text_at(batch, at):
                whole, each = model.document(text)
                scores.append(min(max(whole, 0.0), 1.0))
                found.append([{"start": a, "end": z, "score": p} for (a, z), p in zip(spans(text), each, strict=True) if p >= 0.5] if max(each) >= 0.5 else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64()), pa.array(found, kind)], [*names, "score", "sentences"])

    given = "".join(f"`{n}` {t}, " for n, t in source.dtypes[: len(names)])
    return source.mapInArrow(run, f"{given}score double, sentences array<struct<start:int,end:int,score:double>>")
