"""Near copies by bottom-k sketches against brute force."""

import random
import re

import pytest

from tidemark.llm.minhash import SKETCH, least_shared, near_duplicates

WORDS = [f"w{i}" for i in range(4000)]


def shingle_set(text, n=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def by_hand(docs):
    sets = [(i, shingle_set(t)) for i, t in docs if i is not None]
    label = {i: i for i, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


def corpus(seed):
    """Stars around a base, chains of copies of copies, texts that share half with each other, short texts, exact copies."""
    rng = random.Random(seed)
    texts = []
    for size in (12, 60, 300, 900):
        base = rng.choices(WORDS, k=size)
        texts += [base] + [edited(rng, base, max(1, size // 60)) for _ in range(25)]
        chain = rng.choices(WORDS, k=size)
        for _ in range(12):
            texts.append(chain)
            chain = edited(rng, chain, max(1, size // 50))
        passage = rng.choices(WORDS, k=size)
        texts += [passage + rng.choices(WORDS, k=size) for _ in range(20)]
        texts += [passage + rng.choices(WORDS, k=max(1, size // 6)) for _ in range(20)]
    texts += [["one"], ["One"], ["one", "two"], ["one", "two", "three"], ["a"] * 30, ["a"] * 5000]
    lines = [" ".join(t) for t in texts]
    lines += [lines[0]] * 40 + [lines[60].upper(), lines[60].replace(" ", "\x0b\n")]
    rng.shuffle(lines)
    return [(7 * n + 1, t) for n, t in enumerate(lines)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    docs = corpus(seed)
    found = near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, set int").repartition(5), words=4).collect()
    assert {r.doc_id: r.component_id for r in found} == by_hand(docs)
    assert all(r.n_shingles == len(shingle_set(t)) for r in found for i, t in docs if i == r.doc_id)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_edges(spark):
    long = " ".join(random.Random(3).choices(WORDS, k=60_000))
    docs = [(1, None), (2, ""), (3, " \t"), (4, "x y z q"), (4, "x y z q"), (4, "other words stand here"), (None, "x y z q"), (None, "nobody has this one"), (None, None), (9, long), (10, long + " end"), (11, " ")]
    found = near_duplicates(spark.createDataFrame([(*d, 5, "k") for d in docs], "doc_id long, text string, n int, kept string"), words=4).collect()
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr)
    sizes = [len(shingle_set(t)) for t in (long, long + " end")]
    assert rows == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (4, 1, 4, True), (None, 1, 4, None), (None, 1, None, None), (None, 0, None, None), (9, sizes[0], 9, True), (10, sizes[1], 9, False), (11, 1, 11, True)], key=repr)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bound_of_a_sketch():
    rng = random.Random(5)
    t = least_shared(0.8)
    assert t == 35 and least_shared(1.0) == SKETCH and least_shared(0.8, 1024) < 819
    assert all(sum(rng.random() < 0.8 for _ in range(SKETCH)) >= t for _ in range(3000))
