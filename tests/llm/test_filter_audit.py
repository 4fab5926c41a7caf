"""The filter audit against a count by hand over all orders."""

import re
from collections import Counter
from itertools import permutations

import pytest

from tidemark.llm.filter_audit import audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def by_hand(docs, labels):
    marks = {m: {i for i, *qt in labels if i is not None and qt[k] == 1} for k, m in enumerate(("good", "toxic"))}
    failing = []
    for n, (i, text, part) in enumerate(docs):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and any((t or "") == text and j is not None and j < i for j, t, _ in docs) else set()
        failing.append((part or "", fails, i in marks["good"], i in marks["toxic"]))
    out = {}
    for part in {f[0] for f in failing}:
        own = [f for f in failing if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                hit = [x for x in own if f in x[1] and not x[1] & gone]
                fails = [x for x in own if f in x[1]]
                gone |= {f}
                shapley[f] += len(hit)
                out[part, "".join(order), step] = [len([x for x in own if not x[1] & gone]), len(hit), len(fails) - len(hit), len([x for x in own if x[1] == {f}]), sum(x[2] for x in hit), sum(x[3] for x in hit)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [
    (1, LONG, "de"), (2, LONG, "en"), (2, LONG, "en"), (3, None, "de"), (4, "", None), (5, "SHOUT # it", "de"), (6, "w " * 400, "en"), (7, "W " * 400 + "|", "en"),
    (None, LONG, "de"), (None, "x", None), (8, "a b\x0bc d", ""), (9, LONG + " $", "de"), (10, "word " * 200_000, "en"), (11, LONG.upper(), "de"), (11, "again", "de"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, None, 1), (None, 1, 1), (9, 1, 0), (11, 1, 1), (99, 1, 1)]


def test_counts_of_every_order(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, lang string, n string, gone int").repartition(3)
    labels = spark.createDataFrame([(*x, 7) for x in LABELS], "doc_id long, quality int, toxic int, row int")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in audit(docs, labels).collect()}
    assert got == by_hand(DOCS, LABELS)


@pytest.mark.parametrize("rows", [[], [(1, LONG, "en")]])
def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = audit(docs, labels).collect()
    assert len(found) == 600 * len(rows)
    assert all(r.kept == 1 and r.removed == r.redundant == r.shapley == r.good_lost == 0 for r in found)
