"""Every registered query of the corpus operators on the smallest tables, against brute force where there is one."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")

from tidemark.llm import bpe, queries  # noqa: E402

from test_documents import by_hand, naive_print  # noqa: E402

SF = "/root/testdata/sf0.001"


def table(name, folder=SF):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


def run(spark, name, folder=SF):
    return queries.queries()[name](spark, folder).collect()


def crc(x):
    return zlib.crc32(str(x).encode())


def test_op1(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op1_simhash_near_dedup")}
    prints = {i: naive_print(t) for i, t in documents.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    label, changed = {i: i for i in prints}, True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a], changed = label[b], True
    assert {i: r.component_id for i, r in got.items()} == label


def test_op2_and_op9(spark):
    # Held-out accuracy needs more than a few dozen documents.
    larger = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in table("documents", larger)}
    got = {r.doc_id: r for r in run(spark, "op2_language_id", larger)}
    assert set(got) == set(rows) and all(r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all((r.lang_pred == "und") == (re.search(r"[^\W\d_]", rows[i]["text"] or "") is None) for i, r in got.items())
    known = [i for i, r in got.items() if r.held_out and rows[i]["lang"] and r.lang_pred != "und"]
    right = sum(got[i].lang_pred == rows[i]["lang"] for i in known)
    scored = {r.doc_id: r for r in run(spark, "op9_toxicity", larger)}
    assert set(scored) == set(rows)
    assert all(r.held_out == (crc(i) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in scored.items())
    labels = {r["doc_id"]: r["toxic"] for r in table("labels", larger) if r["toxic"] is not None}
    held = [i for i in labels if scored[i].held_out]
    alike = sum(scored[i].predicted == labels[i] for i in held)
    print("held out:", right, "of", len(known), "languages,", alike, "of", len(held), "toxicity labels")
    assert right >= 0.95 * len(known) and alike >= 0.95 * len(held)


def test_op3(spark):
    got = {r.page_id: r for r in run(spark, "op3_html_extraction")}
    pages = {r["page_id"]: r for r in table("pages")}
    assert set(got) == set(pages)
    for i, r in got.items():
        assert r.n_chars == len(r.text) and r.url == pages[i]["url"]
        # On these pages the article element alone holds the text.
        article = re.search(r"<article>(.*)</article>", pages[i]["html"], re.S)
        words = re.sub(r"<[^>]*>", " ", article[1]).replace("&amp;", "&").split() if article else []
        assert "&" in " ".join(words) or r.text.split() == words


def test_op4(spark, documents):
    for r in run(spark, "op4_pii"):
        own = by_hand(documents[r.doc_id])
        base = ",".join(f"{k}:{a}:{z}" for k, a, z in own)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in own) for n in ("email", "ip", "card", "phone"))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_op6_and_op7(spark, documents):
    from tokenizers import Tokenizer

    word, byte = (Tokenizer.from_file(P.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    pieces, bins = {}, {}
    for r in run(spark, "op6_best_fit_packing"):
        pieces[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    expected, start = {}, 0
    files = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op7_token_files")}
    for i in sorted(documents):
        ids = np.array([*word.encode(documents[i], add_special_tokens=False).ids, 1], "<u4")
        expected |= {(i, k): (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))}
        ids = np.array([*byte.encode(documents[i], add_special_tokens=False).ids, 2], "<u4")
        assert files[i] == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert pieces == expected and set(files) == set(documents)
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(bins) <= 1.02 * -(-sum(n for _, n, _ in pieces.values()) // 4096) + 1


def test_op8(spark, documents):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op8_byte_bpe")}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = {i: enc.encode_ordinary(t) for i, t in documents.items()}
    assert got == {i: (len(ids), digest(" ".join(map(str, ids)).encode()), digest(documents[i].encode())) for i, ids in expected.items()}


def test_op5_and_op10(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert sorted(tuple(r) for r in run(spark, "op5_exact_hamming_topk")) == sorted(db.execute(queries.OP5_SQL).fetchall())
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table("embeddings")}
    got = {}
    for r in run(spark, "op10_multiprobe_ann"):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    asked = [i for i in vectors if i % 50 == 0]
    for i in asked:
        cosine = {j: float(vectors[i] @ v / np.linalg.norm(vectors[i]) / np.linalg.norm(v)) for j, v in vectors.items() if j != i}
        best = sorted(cosine, key=lambda j: (-cosine[j], j))[:5]
        own = sorted(got[i])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s - cosine[j]) < 1e-12 for _, j, s in own)
        hits += len(set(best) & {j for _, j, _ in own})
    assert hits >= 0.9 * 5 * len(asked)
