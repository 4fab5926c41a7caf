"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from decimal import Decimal

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tidemark.llm import bpe, langid, packing, pii, simhash, token_files, tokens, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "to") for b in ("bar", "dil", "fen", "gos", "hul")]


def texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    near = [base[0] + " extra", base[0].upper(), base[1][:-1] + "x", "  " + base[2].replace(" ", "\n", 3)]
    odd = ["", " \t\n", "one", "one two", None, None, "é ½ ﬁ 中文 🙂 x", "a" * 3000, "12345", " ".join(WORDS * 900), "a  <|endoftext|> b<|startoftext|>!<|endof text|>", "mail a.b@c.example.org or +1 (988) 555-2485, 4111 1111 1111 1111 at 10.0.0.255"]
    return base + near + base[:5] + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", "s", 0, 1.5, 7) for i, t in enumerate(texts())]
    rows += [rows[0], (None, "no id here at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def naive_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_meet_within_one_error_a_segment():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 22, 500)
    row, key = simhash.near_keys(words, 22)
    sets = [set(key[row == i]) for i in range(500)]
    for bit in range(22):
        assert all(k in s for k, s in zip(simhash.decode(words ^ (1 << bit)), sets, strict=True))
    assert max(map(len, sets)) <= 6
    prints = rng.integers(0, 1 << 63, 300).astype(np.int64)
    for flips in (0, 1, 2, 3):
        other = prints.copy()
        for i in range(300):
            for b in rng.choice(64, flips, replace=False):
                other.view(np.uint64)[i] ^= np.uint64(1) << np.uint64(b)
        (lr, lk), (rr, rk) = simhash.keys(prints)[0], simhash.keys(other)[1]
        left, right = {}, {}
        for r, k in zip(lr, lk, strict=True):
            left.setdefault(r, set()).add(k)
        for r, k in zip(rr, rk, strict=True):
            right.setdefault(r, set()).add(k)
        assert all(left[i] & right[i] for i in range(300))


def test_simhash_components(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [naive_print(t) for _, t in rows]
    ids = [i for i, _ in rows]
    known = [k for k, i in enumerate(ids) if i is not None]
    root = {k: k for k in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in known:
        for b in known:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for k in known:
        least[find(k)] = min(least.get(find(k), 10**9), ids[k])
    expected = sorted((ids[k], f"{prints[k]:016x}", least[find(k)]) for k in known)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == expected
    assert [(r.fingerprint, r.component_id) for r in got if r.doc_id is None] == [(f"{naive_print('no id here at all'):016x}", None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_chain_of_fingerprints_is_one_component(spark):
    chain = [0]
    for step in range(40):
        chain.append(chain[-1] ^ (0b111 << (step * 3 % 60)))
    chain = list(dict.fromkeys(chain))
    df = spark.createDataFrame([(100 - i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(chain)], "id long, fp long")
    assert {r.component for r in simhash.near_components(df).collect()} == {min(100 - i for i in range(len(chain)))}


def by_hand(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_personal_data_equals_plain_expressions(spark, docs):
    rng = random.Random(9)
    pieces = ["a@b.c", "x_d@e.f", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.1.1.1", "+1 (20) 3-4567890", "+12", "é🙂", " ", ".", "-", "@", "12", "..", "_", "6011000990139424123", "5"]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(400)] + [r.text or "" for r in docs.collect()]
    rows += ["9" * 30_000, "a" * 50_000, "a@" + "b." * 20_000 + "c", "+1" * 5_000, "1.1.1.1 " * 300]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.pii if x.kind in ("email", "ip", "card", "phone")] for r in pii.find_spans(df).collect()}
    for i, t in enumerate(rows):
        assert got[i] == by_hand(t), t[:100]


def test_checksums_and_context(spark):
    rows = ["IBAN DE89370400440532013000 here", "DE89370400440532013001", "iban GB82 WEST 1234 5698 7654 32.", "my visa card 378282246310005", "number 378282246310005", "mail: a@b.org", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.score) for x in r.pii] for r in pii.find_spans(df).collect()}
    assert [k for k, _ in got[0]] == ["iban"] and got[1] == [] and [k for k, _ in got[2]] == ["iban"]
    assert [k for k, _ in got[3]] == ["short_card"] and got[4] == []
    assert got[5] == [("email", 1.0)] and got[6] == []
    masked = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert masked[0] == "IBAN <IBAN> here" and masked[5] == "mail: <EMAIL>" and masked[4] == rows[4] and masked[6] is None


def test_language(spark):
    rng = random.Random(1)
    kinds = {"aa": ["dama", "sela", "kora", "mila"], "bb": ["strug", "plent", "brask", "dwirt"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "123 !! ½²Ⅷ", "bb"), (902, "sela " * 5000, None), (903, "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") % 4 != 2, P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in langid.predict(df, model, keep_cols=["doc_id"]).collect()}
    assert all(got[i].lang_pred == k for i, t, k in rows if i < 900 and i % 4 == 2)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901)] == [("und", 0.0)] * 2
    assert got[902].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(df.limit(0), model).count() == 0


def segmentations(word):
    """All ways to cut a word; single characters count as pieces that no vocabulary has, too."""
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        for rest in segmentations(word[n:]):
            yield (word[:n], *rest)
            if n == 1:
                yield (None, *rest)


@pytest.mark.parametrize("shared", [langid.SHARED_LENGTH, 1])
def test_forward_and_expected_uses_sum_all_segmentations(monkeypatch, shared):
    monkeypatch.setattr(langid, "SHARED_LENGTH", shared)
    vocabulary = ["▁a", "▁", "a", "b", "ab", "▁ab", "ba", "▁abbaabbaab"]
    pieces = langid.Pieces(vocabulary)
    p = np.array([[0.1 * (i + 1), 0.3 / (i + 1)] for i in range(len(vocabulary))])
    place = {w: int(np.flatnonzero(pieces.keys == np.uint64(langid.piece_key(w)))[0]) for w in vocabulary}
    model = langid.Model(["x", "y"], pieces, pieces.scaled(p), np.zeros(2))
    words = ["a", "ab", "abba", "aabbab", "azb", "abbaabbaab"]
    uses = np.zeros_like(p)
    for word, got in zip(words, np.exp(model.word_scores(words)), strict=True):
        total, own = np.zeros(2), np.zeros_like(p)
        for cut in segmentations("▁" + word):
            if all(c is None or c in place for c in cut):
                chance = np.prod([np.full(2, langid.UNKNOWN) if c is None else p[place[c]] for c in cut], axis=0)
                total += chance
                for c in cut:
                    if c is not None:
                        own[place[c]] += chance
        assert np.allclose(got, total, rtol=1e-9)
        uses += 3 * own / total
    assert np.allclose(langid.expected_uses(words, np.full((len(words), 2), 3.0), pieces, pieces.scaled(p)), uses, rtol=1e-7)


def test_long_words_are_scored_whole():
    pieces = langid.Pieces(["▁a", "a", "aaa", "b"])
    model = langid.Model(["x"], pieces, pieces.scaled(np.array([[0.1], [0.2], [0.3], [0.4]])), np.zeros(1))
    tiny, mark, one, three = Decimal(langid.UNKNOWN), Decimal("0.1"), Decimal("0.2"), Decimal("0.3")
    alpha = [Decimal(1), tiny, tiny**2 + mark + tiny * one]  # of the mark and the first letters
    while len(alpha) < 5002:
        alpha.append(alpha[-1] * (tiny + one) + (alpha[-3] * three if len(alpha) > 3 else 0))
    for n in (2, 62, 63, 64, 65, 5000):
        assert np.isclose(model.word_scores(["a" * n])[0, 0], float(alpha[n + 1].ln()), rtol=1e-9)


def test_vocabulary_is_whole():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    assert set(langid.Pieces(langid.vocabulary(P.path("piece_bpe_32k.model"))).keys.tolist()) == {langid.piece_key(p) for p in plain}


def test_language_sample_is_bounded_and_has_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 100)
    rows = [(i, "same text" if i % 3 else f"text {i}", "aa") for i in range(500)] + [(900, "rare", "bb"), (901, "x" * 101, "bb"), (902, None, "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got, sizes = langid.sample(df, F.lit(True), "doc_id", "text", "lang")
    texts = got.collect()
    assert sizes == {"aa": 500, "bb": 2} and [r.text for r in texts if r.lang == "bb"] == ["rare"]
    own = [r.text for r in texts if r.lang == "aa"]
    assert 10 <= len(own) <= 20 and sum(map(len, own)) <= 100


def test_toxicity_learns_sentences_from_document_labels(spark):
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice(WORDS) for _ in range(8)) + "."
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 1
        parts = [clean() for _ in range(rng.randint(1, 6))]
        if toxic:
            parts.insert(rng.randint(0, len(parts)), "you " + rng.choice(["grobnak", "grobnaks", "snarf"]) + " " + clean())
        rows.append((i, " ".join(parts), 0.3))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (1000, None, 0.0), (1001, "", 0.0)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (5, 0), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, lab, F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in toxicity.score(df, model, keep_cols=["doc_id"]).collect()}
    assert all((got[i].score >= 0.5) == bool(y) for i, y in labels)
    text = rows[1][1]
    (s,) = got[1].sentences
    assert re.search("grobnak|snarf", text[s.start : s.end])
    assert got[1000].score == got[1001].score < 0.5
    assert toxicity.score(df.limit(0), model).count() == 0
    assert 0 < toxicity.fit([], np.array([], int)).document("x")[0] <= 0.5


def reference_ids(name, rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in rows]


@pytest.mark.parametrize(("kind", "name", "end"), [("byte", "byte_bpe_50k.json", 2), ("word", "word_bpe_49k.json", 1)])
def test_chunks_have_the_ids_of_whole_texts(kind, name, end):
    rng = random.Random(6)
    pieces = ["a", "B", "H", "h", "é", "É", "e\u0301", "\u0331", " ", "  ", "\n", "\t", "\u3000", "\xa0", "\u2003", "\x1c", "\x85", "\0", "'", "'s", "'LL", "!", "?", "<|endoftext|>", "<|startoftext|>", "<|endof", "|>"]
    pieces += ["12", "½", "中", "🙂", "\u212a", "İ", "ß", "ﬁ", "\u200d", "_", "-", "=", "\u0338", "\r\n", "\v", "\x7f", "ª", "²", "×", "Ж"]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    ids, ends = tokens.Encoder(P.path(name), kind, end).encode([x.encode() for x in rows])
    expected = reference_ids(name, rows, end)
    assert np.cumsum([len(x) for x in expected]).tolist() == ends.tolist()
    assert (np.concatenate(expected) == ids).all()


def test_token_files_roundtrip(spark, docs):
    rows = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()))
    manifest = token_files.write_corpus(docs, P.path("byte_bpe_50k.json"), 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, list(r.ids)) for r in token_files.read_corpus(manifest).collect())
    start = 0
    for (i, _), ids, r in zip(rows, reference_ids("byte_bpe_50k.json", [t for _, t in rows], 2), got, strict=True):
        assert r == (start, i, len(ids), zlib.crc32(ids), ids.tolist())
        start += len(ids)
    empty = token_files.write_corpus(docs.limit(0), P.path("byte_bpe_50k.json"), 2)
    assert empty.count() == 0 and token_files.read_corpus(empty).count() == 0


def test_packing_of_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.pack(docs, P.path("word_bpe_49k.json"), capacity=512, with_ids=True).collect()
    expected = []
    for (i, _), ids in zip(rows, reference_ids("word_bpe_49k.json", [t for _, t in rows], 1), strict=True):
        expected += [(str(i), k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512])) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == r.length
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_plans_are_whole_and_near_the_bound():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.choice([10, 50, 4096])
        lengths = [rng.choice([rng.randint(1, capacity), rng.randint(max(1, capacity // 3), capacity), min(capacity, int(rng.expovariate(5 / capacity)) + 1)]) for _ in range(rng.choice([1, 6, 40, 900]))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.plan(dict(histogram), capacity)
        held = {}
        for p in plan:
            assert sum(w * n for w, n in p.lengths) <= capacity
            for w, n in p.lengths:
                held[w] = held.get(w, 0) + n * p.sequences
        assert held == histogram


def test_dominance_reduction_keeps_the_optimum():
    def optimum(items, capacity):
        best = [len(items)]

        def place(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= items[k]}.values():
                place(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
            place(k + 1, [*rooms, capacity - items[k]])

        place(0, [])
        return best[0]

    rng = random.Random(8)
    for _ in range(150):
        items = sorted((rng.randint(2, 20) for _ in range(9)), reverse=True)
        left = {x: items.count(x) for x in set(items)}
        fixed = packing.reduce_by_dominance(left, 20)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        assert sum(p.sequences for p in fixed) + optimum(rest, 20) == optimum(items, 20)


def test_byte_bpe(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN), path).collect()
    expected = sorted((str(r.doc_id), enc.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == expected
    both = bpe.encode(docs, path, P.PATTERN, decoded=True).collect()
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in both) == expected
    # A pattern of its own, and a column that is in the way.
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=bpe.ranks(path), special_tokens={})
    other = bpe.decode(bpe.encode(docs, path, r"\S+|\s+").withColumn("decoded", F.lit(1)), path).collect()
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in other) == sorted((str(r.doc_id), own.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert bpe.encode(docs.limit(0), path, P.PATTERN).count() == 0
    assert hashlib.sha256(bytes(got[0].decoded)).digest()
