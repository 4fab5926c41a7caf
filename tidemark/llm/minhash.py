"""Near copies by bottom-k sketches of one hash function.

A text's sketch are the k least hashes of its shingles. The least hashes of a union of two sets are a random sample of the union, and those
of them that both sets have stand in both sketches; so sets at a similarity of J share about J * k values, and fewer than ``least_shared`` with
a probability below ``MISS``. Small sets are their own sketches, where the bound is exact. The values are ordered by how many sets have them,
rarest first: sets that share t of k values share one of the first k - t + 1 in any common order, so only those of a sketch enter the inverted lists, and
values that stand everywhere hardly do.

Sketches of ``SKETCH`` values of all texts find those that may have a near copy at all. Only these get sketches of ``WIDE`` values, which for most texts are
their whole sets: the fifth of its values that a near copy may lack holds what sets a text apart from its relatives, so texts of one family that
differ by more meet in no list.

Texts with equal sets are one node. In each list all nodes first meet one hub, and nodes that a link connects are not paired again: a group
of near copies costs one comparison a member. What stays apart is then paired. Pairs whose union sketch has too few common values go; the others are
verified by their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, small_batches, stored, utf8, worker_slot
from .components import connected_components

#: Values of the first and of the second sketch, and the probability that a pair at the threshold shares too few of them.
SKETCH, WIDE, MISS = 64, 1024, 2e-6
#: Rounds of hubs at most, as long as so large a share of their pairs are links and the pairs left exceed this many for each list entry.
HUB_ROUNDS, LINKED, PAIRS_EACH = 8, 0.2, 4
SEED = 42
#: Words a Python worker remembers the hash of.
CACHED_WORDS = 200_000


def least_shared(similarity: float, k: int = SKETCH, miss: float = MISS) -> int:
    """The greatest t such that fewer than t of k sampled values are common with a probability of at most ``miss``."""
    total = 0.0
    for t in range(k + 1):
        total += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if total > miss:
            return max(t, 1)
    return k


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int, cache: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as sorted hashes; a text of fewer words is one shingle."""
    found = text.lower().split()
    hashes = np.empty(len(found), np.uint64)
    for i, word in enumerate(found):
        known = cache.get(word)
        if known is None:
            known = xxhash.xxh64_intdigest(word, SEED)
            if len(cache) < CACHED_WORDS:
                cache[word] = known
        hashes[i] = known
    length = min(words, len(found))
    if not length:
        return hashes
    out = np.full(len(found) - length + 1, length, np.uint64)
    for i in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(found) - length + 1 + i]
    return np.unique(_mixed(out))


def set_of(text: bytes, words: int, cache: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a text as ascending 63-bit hashes."""
    return (shingles(text, words, cache) >> np.uint64(1)).view(np.int64)


def digest(grams: np.ndarray) -> int:
    """What stands for a set: equal ones alone have it; 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), SEED) if len(grams) else 0


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, set, n, sketch) of every row: digest and size of its shingle set (both of an empty one are 0), and its least values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_slot(("minhash",), dict)
        for batch in small_batches(batches):
            found = [set_of(text.as_py(), words, cache) for text in batch.column(1)]
            digests = [digest(x) for x in found]
            ends = np.cumsum([0, *[min(len(x), SKETCH) for x in found]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[:SKETCH] for x in found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array([len(x) for x in found], pa.int64()), lists], ["id", "set", "n", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(run, "id long, set long, n long, sketch array<long>")


def inverted_lists(nodes: DataFrame, least: tuple[int, int], k: int) -> DataFrame:
    """(value, set, n, at, fame, node): of each sketch of ``k`` values the rarest ones that a near copy must share one of, as far as another sketch has them, too.

    ``at`` is the value's place in the sketch, rarest first, from 0. ``fame`` is greater the more of its values a set shares, which a text has that others are copies of. Values of one set only make no list.
    """
    share = least[0] / least[1]
    entries = nodes.select("set", F.explode("sketch").alias("value"))
    several = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = entries.join(by_key(several), "value").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))  # at most k
    size = F.least(F.col("n"), F.lit(k))
    needed = F.when(F.col("n") <= math.floor(k * share), F.ceil(F.col("n") * least[0] / least[1])).otherwise(least_shared(share, k))
    # Values of no other set come first in the order; what they leave of the prefix is shared.
    room = (size - needed + 1 - (size - F.size("held"))).cast("int")
    fame = F.struct(F.size("held").alias("shared"), F.aggregate("held", F.lit(0.0), lambda s, x: s + F.log2(x["df"].cast("double"))).alias("weight"))
    found = nodes.join(by_key(held), "set").where(room > 0).select("set", "n", "node", fame.alias("fame"), (size - F.size("held")).alias("alone"), F.posexplode(F.slice("held", F.lit(1), room)).alias("i", "h"))
    found = stored(found.select(F.col("h.value").alias("value"), "set", "n", (F.col("alone") + F.col("i")).alias("at"), "fame", "node"), "minhash-entries")
    lists = found.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("value")
    return stored(found.join(by_key(lists), "value"), "minhash-lists")


def may_match(least: tuple[int, int], k: int) -> str:
    """Whether sets ``a`` and ``b`` that meet in a list can be near copies: by their sizes, and, if they are their own sketches, by how many values each has from its place in the list on.

    Of near copies' common values the rarest one passes; others may not.
    """
    low, high = least
    sizes = f"{high} * least(a.n, b.n) >= {low} * greatest(a.n, b.n)"
    return f"{sizes} and (greatest(a.n, b.n) > {k} or least(a.n - a.at, b.n - b.at) * {low + high} >= {low} * (a.n + b.n))"


def enough(least: tuple[int, int], common, union):
    return least[1] * common >= least[0] * union


def whole_sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(set, grams) of the sets of ``nodes``, from the texts that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_slot(("minhash",), dict)
        for batch in small_batches(batches, 1 << 20):
            found = [set_of(text.as_py(), words, cache) for text in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([digest(x) for x in found], np.uint64).view(np.int64)), lists], ["set", "grams"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    # Rows that repeat an id may bring sets that nobody asked for.
    texts = source.join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    return texts.mapInArrow(run, "set long, grams array<long>").dropDuplicates(["set"]).join(by_key(nodes.select("set")), "set", "left_semi")


def confirmed(pairs: DataFrame, nodes: DataFrame, grams: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(src, dst) of those ``pairs`` (a, b, src, dst) that are similar: first by the sketch of the union, then by the whole sets.

    A pair of two sets that are their own sketches needs no more than these.
    """
    side = nodes.select("set", "n", "sketch")
    both = pairs.join(side.toDF("a", "n", "x"), "a").join(side.toDF("b", "m", "y"), "b")
    common = F.array_intersect("x", "y")
    sure = (F.col("n") <= WIDE) & (F.col("m") <= WIDE)
    # Of the union's WIDE least values so many are common. Both arrays are computed once, before the values are tested.
    least_of_both = F.slice(F.sort_array(F.array_union("x", "y")), 1, WIDE)
    among = F.size(F.array_intersect(least_of_both, common))
    seen = F.when(sure, enough(least, F.size(common), F.col("n") + F.col("m") - F.size(common))).otherwise(among >= least_shared(least[0] / least[1], WIDE))
    likely = stored(both.where(seen).select("a", "b", "src", "dst", sure.alias("sure")), "minhash-likely")
    met = likely.where("not sure").join(grams.toDF("a", "x"), "a").join(grams.toDF("b", "y"), "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    exact = met.where(enough(least, F.col("common"), F.size("x") + F.size("y") - F.col("common"))).select("src", "dst")
    return stored(likely.where("sure").select("src", "dst").unionAll(exact).distinct(), "minhash-links")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    merged = connected_components(links).select(F.col("node").alias("label"), F.col("component").alias("merged"))
    return labels.join(merged, "label", "left").select("set", F.coalesce("merged", "label").alias("label"))


def components(sketched: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: tuple[int, int], proposed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(set, label): each shingle set that a row with an id has, and the smallest id of its group.

    ``proposed`` may give pairs (a, b, src, dst: two sets and their nodes) of the nodes (set, node) that may have a near copy, by another method. They are verified with
    the first hubs, and what they link is not paired again.
    """
    nodes = stored(sketched.where("id is not null and n > 0").groupBy("set").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "minhash-nodes")
    near = inverted_lists(nodes, least, SKETCH).select("set").distinct()
    close = stored(nodes.select("set", "node", "n").join(by_key(near), "set", "left_semi"), "minhash-close")
    grams = stored(whole_sets(close, docs, id_col, text_col, words), "minhash-grams")
    wide = stored(close.join(grams, "set").select("set", "node", "n", F.slice("grams", 1, WIDE).alias("sketch")), "minhash-wide")
    shared = inverted_lists(wide, least, WIDE)
    labels = stored((wide if proposed else shared).select("set", F.col("node").alias("label")).distinct(), "minhash-labels")
    possible = may_match(least, WIDE)
    for round_ in range(HUB_ROUNDS):
        labelled = shared.join(by_key(labels), "set")
        if round_:
            spread = labelled.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"))
            left, size = spread.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), F.sum("all")).first()
            if not left or left <= PAIRS_EACH * size:
                break
        order = F.struct("fame", -F.col("node")) if round_ == 0 else F.xxhash64(F.lit(round_), "set")
        hubs = labelled.groupBy("value").agg(F.max_by(F.struct("set", "n", "at", "label"), order).alias("b"))
        met = labelled.alias("a").join(by_key(hubs), "value").where("a.set <> b.set and a.label <> b.label").where(possible)
        # Of all hubs in its lists, the one that a node shares most of them with.
        overlap = met.groupBy(F.col("a.set").alias("a"), F.col("b.set").alias("b"), F.col("a.label").alias("src"), F.col("b.label").alias("dst")).agg(F.count(F.lit(1)).alias("c"))
        pairs = overlap.groupBy("a").agg(F.max_by(F.struct("b", "src", "dst"), F.struct("c", "b")).alias("p")).select("a", "p.*")
        if proposed and not round_:
            pairs = pairs.unionByName(proposed(close.select("set", "node"))).distinct()
        pairs = stored(pairs, "minhash-hubs")
        links = confirmed(pairs, wide, grams, least)
        labels = stored(relabelled(labels, links), "minhash-labels")
        if links.count() < LINKED * pairs.count():
            break
    labelled = stored(shared.join(by_key(labels), "set"), "minhash-labelled")
    pairs = labelled.alias("a").join(by_key(labelled.alias("b")), "value").where("a.set < b.set and a.label <> b.label").where(possible)
    pairs = pairs.select(F.col("a.set").alias("a"), F.col("b.set").alias("b"), F.col("a.label").alias("src"), F.col("b.label").alias("dst")).distinct()
    labels = stored(relabelled(labels, confirmed(stored(pairs, "minhash-pairs"), wide, grams, least)), "minhash-labels")
    return nodes.join(labels, "set", "left").select("set", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """Every row's ``id, n_shingles, component_id, kept``.

    Rows are linked where ``least[1]`` times the common shingles of their sets are at least ``least[0]`` times those of both; component_id is the smallest id that
    can be reached. Texts of fewer words are one shingle; null and empty texts have none and are linked with nothing. Rows that repeat an id
    stay rows of their own, each with its text's component; a row without an id gets the component of rows with an equal set, else null, and its ``kept`` is
    null. Other columns are ignored.
    """
    sketched = stored(sketches(docs, id_col, text_col, words), "minhash-sketches")
    groups = components(sketched, docs, id_col, text_col, words, least)
    rows = sketched.select("id", "set", "n").join(groups, "set", "left")
    component = F.coalesce("label", "id")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
