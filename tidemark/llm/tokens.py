"""Token ids by the tokenizers library, each distinct chunk of text once for a Python worker.

Texts are cut, as one array of bytes, where both vocabularies begin a new token whatever stands
around, so a text's ids are those of its chunks in order. Chunks repeat, texts hardly do: a
worker keeps the ids of the chunks that it has met, up to ``CACHE_CHUNKS`` of them, and only
new ones reach the tokenizer. Strings of special tokens are chunks of their own, as the tokenizer
takes them out before anything else.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import worker_slot

#: Chunks that a worker remembers; past it, it keeps those of the batch at hand.
CACHE_CHUNKS = 500_000
#: A byte that UTF-8 never holds stands between texts.
BETWEEN = b"\xff"

UNSURE, SPACE, BREAK, LETTER, DIGIT, MARK, HIGH = range(7)
#: First bytes of two-byte letters of the Latin and Cyrillic scripts: blocks that hold letters only, but for two signs.
LETTER_PAIRS = (0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1)
#: Those two, and the letter that becomes two characters in lower case.
SIGN_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


def _classes() -> np.ndarray:
    """The class of each byte. White space beyond ASCII begins with one of four bytes, which stay unsure; so do control characters.

    An apostrophe may begin a contraction: it is visible, but nothing is cut beside it.
    """
    table = np.full(256, UNSURE, np.uint8)
    table[0x21:0x7F] = MARK
    table[0x80:0xF5] = HIGH
    table[[ord("'"), 0xC2, 0xE1, 0xE2, 0xE3]] = [HIGH, UNSURE, UNSURE, UNSURE, UNSURE]
    table[list(LETTER_PAIRS)] = LETTER
    for chars, kind in (("0123456789", DIGIT), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER), ("\t\n\v\f\r", BREAK), (" ", SPACE)):
        table[[ord(c) for c in chars]] = kind
    return table


CLASSES = _classes()


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 texts; both bytes of a two-byte letter are letters."""
    kinds = CLASSES[data]
    high = np.flatnonzero((kinds[:-1] == LETTER) & (data[:-1] >= 0x80))
    kinds[high + 1] = LETTER
    for first, second in SIGN_PAIRS:
        signs = high[(data[high] == first) & (data[high + 1] == second)]
        kinds[signs] = kinds[signs + 1] = HIGH
    return kinds


def valid_texts(column: pa.Array) -> list[bytes]:
    """The texts of a column of bytes; what is not UTF-8 becomes the replacement character."""
    try:
        column.cast(pa.string())
        return column.to_pylist()
    except pa.ArrowInvalid:
        return [x.decode("utf-8", "replace").encode() for x in column.to_pylist()]


def chunks(texts: list[bytes], kind: str, special: re.Pattern[bytes] | None = None) -> pa.BinaryArray:
    """The chunks of all texts in order, each text followed by the chunk ``BETWEEN``.

    Byte-level vocabularies (``byte``): the last of several white space characters before a visible one goes with it if
    it is a space, and alone if not, so both are cut there; so are words, numbers and punctuation. Vocabularies
    with word ends (``word``) drop white space and case; the chunks have neither.
    """
    raw = BETWEEN.join([*texts, b""])
    data = np.frombuffer(raw, np.uint8)
    kinds = byte_kinds(data)
    own = [m.span() for m in special.finditer(raw)] if special else []
    for a, z in own:
        kinds[a:z] = UNSURE
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = True
    worded = (kinds >= LETTER) & (kinds <= MARK)
    cut[1:-1] = worded[1:] & worded[:-1] & (kinds[1:] != kinds[:-1])
    blank = (kinds == SPACE) | (kinds == BREAK)
    if kind == "byte":
        ahead = blank[:-1] & (kinds[1:] >= LETTER)
        cut[:-2] |= ahead
        cut[1:-1] |= ahead & (kinds[:-1] == BREAK)
        cut[1:-1] |= blank[1:] & worded[:-1]
    else:
        cut[1:] |= blank
    ends = np.flatnonzero(data == BETWEEN[0])
    cut[ends] = cut[ends + 1] = True
    if own:
        cut[np.array(own).ravel()] = True
    if kind == "word":
        # A letter before anything beyond ASCII may compose with it in one case only.
        upper = (data[:-1] >= 65) & (data[:-1] <= 90) & ((data[1:] < 128) | (data[1:] == BETWEEN[0]))
        data = data + np.append(upper, False).astype(np.uint8) * np.uint8(32)
        data, cut = data[~blank], cut[:-1][~blank]
        starts = np.flatnonzero(cut)
    else:
        starts = np.flatnonzero(cut[:-1])
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` one after the other, and where each ends."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    source = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    source += np.arange(total, dtype=kind)
    return flat[source], ends


def _visible_bytes() -> str:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


VISIBLE = _visible_bytes()


def single_tokens(words: pa.BinaryArray, kind: str) -> np.ndarray:
    """Which chunks are one run of letters, of punctuation or (``byte``) of digits, after at most one space: one pre-token each."""
    size = len(words)
    starts, data = np.frombuffer(words.buffers()[1], np.int32)[: size + 1], np.frombuffer(words.buffers()[2], np.uint8)
    kinds = byte_kinds(data[: starts[-1]])
    starts, length = starts[:-1], np.diff(starts)
    led = starts[(kinds[starts] == SPACE) & (length > 1)]
    kinds[led] = kinds[led + 1]
    least, most = np.minimum.reduceat(kinds, starts), np.maximum.reduceat(kinds, starts)
    return (least == most) & ((least == LETTER) | (least == MARK) | ((least == DIGIT) & ((length == 1) | (kind == "byte"))))


class Encoder:
    """``kind`` is byte for byte-level vocabularies, word for the one with word ends.

    Special tokens have to stand for their plain strings: none that strips white space, wants whole words or is normalised.
    With ``plain`` their strings in a text are text like any other.
    """

    def __init__(self, path: str, kind: str, end_id: int, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.tokenizer.encode_special_tokens = plain
        added = {} if plain else self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("special tokens of other kinds than plain strings")
        self.fixed = {t.content.encode(): i for i, t in added.items()} | {BETWEEN: end_id}
        longest = sorted((t.content.encode() for t in added.values()), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.forget()

    def forget(self) -> None:
        self.number = {c: i for i, c in enumerate(self.fixed)}
        self.flat = np.array(list(self.fixed.values()), self.dtype)
        self.starts, self.sizes = np.arange(len(self.fixed)), np.ones(len(self.fixed), np.int64)

    def merged(self, word: bytes) -> list[int]:
        """The ids of a chunk that is one pre-token: the model's merges alone."""
        if self.kind == "word":
            word = word.lower() if word.isascii() else word.decode().lower().encode()
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(VISIBLE))]

    def learn(self, words: pa.BinaryArray, listed: list[bytes]) -> None:
        """Encodes the chunks that are not known yet."""
        new = [i for i, w in enumerate(listed) if w not in self.number]
        if not new:
            return
        self.model = self.tokenizer.model
        single = single_tokens(words, self.kind)
        alone, others = [i for i in new if single[i]], [i for i in new if not single[i]]
        ids = list(map(self.merged, map(listed.__getitem__, alone)))
        for at in range(0, len(others), 20_000):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast([listed[i].decode() for i in others[at : at + 20_000]], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.number.update(zip(map(listed.__getitem__, alone + others), range(len(self.sizes), len(self.sizes) + len(ids)), strict=True))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum())))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end_id``, and where each text ends."""
        cut = chunks(texts, self.kind, self.special).dictionary_encode()
        words = cut.dictionary.to_pylist()
        if len(self.number) + len(words) > CACHE_CHUNKS:
            self.forget()
        self.learn(cut.dictionary, words)
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        place = number[cut.indices.to_numpy()]
        ids, ends = gathered(self.flat, self.starts[place], self.sizes[place])
        return ids, ends[place == self.number[BETWEEN]]


def encoder(path: str, kind: str, end_id: int) -> Encoder:
    """One encoder for a Python worker, kept between its tasks until another operator runs there."""
    return worker_slot(("tokens", path, kind, end_id), lambda: Encoder(path, kind, end_id))
