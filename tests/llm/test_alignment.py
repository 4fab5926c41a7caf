"""The alignment of two vocabularies against one token after the other by hand."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tidemark.llm import alignment  # noqa: E402
from tidemark.llm.tokens import VISIBLE  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def by_hand(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    value = {c: b for b, c in enumerate(VISIBLE)}
    bytes_a = lambda i: bytes(value[c] for c in first.id_to_token(i))
    bytes_b = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    found, pairs = [], Counter()
    for text in texts:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        spaced = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, a)) != spaced or b"".join(map(bytes_b, b)) != spaced:
            found.append(None)
            continue
        ends = [[sum(len(kind(i)) for i in ids[: n + 1]) for n in range(len(ids))] for ids, kind in ((a, bytes_a), (b, bytes_b))]
        groups, before = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append(tuple([i for i, e in zip(ids, own) if before < e <= cut] for ids, own in zip((a, b), ends)))
            before = cut
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        pairs.update(set(links))
        found.append((len(a), len(b), len(groups), links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    best = Counter()
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(pairs[k] == best[k[0]] for k in f[3]), sum(pairs[k] for k in f[3]), hashlib.sha256(f[4].encode()).hexdigest()) for f in found]


def texts():
    rng = random.Random(4)
    signs = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "Ж", "中", "文", "😀", "‍", " ", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'s", "12", "2024", "...", "banana", "ananas", "The", " the", "\x00", "́"]
    mixed = ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(150)]
    return [None, "", " ", "  ", "a", "▁", "x▁y", "<|endoftext|> and <s>", "中文" * 300, "anana" * 200, *mixed, *mixed[:30], "a word that stands alone", "a word that stands alone "]


def run(spark, rows, schema="doc_id long, text string"):
    return alignment.align(spark.createDataFrame(rows, schema).repartition(3), A, B).collect()


def test_rows_equal_by_hand(spark):
    own = texts()
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in run(spark, [(i, t, 1, "x") for i, t in enumerate(own)], "doc_id long, text string, row int, block string")}
    assert got == dict(enumerate(by_hand(own)))


def test_long_groups_and_many_blocks():
    """Groups whose distinct ids meet give the links that all their tokens give, and a block its documents', however they come."""
    import pyarrow as pa

    tool = alignment.Aligner(A, B)
    own = [t.encode() for t in texts() if t][:60]
    numbers, a, ends_a, b, ends_b = tool.encode(own)
    group_a, group_b = tool.groups(a, b)
    doc = np.repeat(numbers, np.diff(ends_a, prepend=0))
    mixed = (np.bincount(group_a) > 1) | (np.bincount(group_b) > 1)
    every = [alignment.irregular_links(a, b, doc, group_a, group_b, mixed, alignment.WIDE_A * tool.n_b, most) for most in (10**9, 3, 0)]
    for keys, times in every:
        assert dict(zip(keys.tolist(), times.tolist())) == dict(zip(every[0][0].tolist(), every[0][1].tolist()))
    one, several = alignment.Block(0), alignment.Block(0)
    one.add(pa.nulls(len(own), pa.int64()), own, tool)
    for t in own:
        several.add(pa.nulls(1, pa.int64()), [t], tool)
    last = [list(x.batches(tool))[-1].to_pylist() for x in (one, several)]
    assert last[0] == last[1] and pa.Table.from_batches(one.rows) == pa.Table.from_batches(several.rows).combine_chunks()


def test_edges(spark):
    rows = run(spark, [(None, "one two"), (5, "one two"), (5, "one two"), (6, None)])
    assert sorted([(r.doc_id, r.n_a, r.count_sum) for r in rows], key=repr) == [(5, 2, 6), (5, 2, 6), (6, 0, 0), (None, 2, 6)]
    assert run(spark, []) == []
