"""Token ids of whole texts from public vocabulary files, with what frequent words give remembered.

A text is cut where no token can cross: before a single space that a character other than white space
follows (and, for byte-level vocabularies, between a letter and a following mark).  Both kinds of
vocabulary here encode the pieces independently of each other, so a piece's ids are looked up once
and reused; the tests compare with encoding whole texts.  Pieces found in the last
``2 * MEMO`` different ones are remembered, long ones never.

The files' path is a parameter; by default they're those of the ``public_tokenizers`` package.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

MEMO = 250_000
LONG = 64
SLICE = 4096  # pieces given to a library at once, whose results are far larger than their ids

_ASCII = np.zeros(256, bool)
_ASCII[33:127] = True
_VISIBLE = _ASCII.copy()  # first bytes of characters that are never white space
_VISIBLE[[*range(0xC3, 0xE0), 0xE0, *range(0xE4, 0xF5)]] = True
_BEFORE = np.ones(256, bool)  # last bytes that may stand before a cut: no white space, not the mark U+2581
_BEFORE[[*range(9, 14), 32, 0x81]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?)")] = True


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts by ``encode``, a function of a list of pieces (bytes) that gives the ids of each."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], marks: bool, memo: int = MEMO) -> None:
        self.encode, self.marks, self.memo = encode, marks, memo
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def pieces(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and how many come before each text (one entry more than texts)."""
        ends = np.cumsum([0, *map(len, texts)])
        data = b"".join(texts)
        b = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(b) + 1, bool)
        if len(b) > 2:
            cut[1:-2] = (b[1:-1] == 32) & _VISIBLE[b[2:]] & _BEFORE[b[:-2]]
            if self.marks:
                cut[1:-1] |= _MARK[b[1:]] & _LETTER[b[:-1]]
            last = ends[1:-1] - 1  # a space at a text's end stays with what precedes it
            last = last[(last >= 0) & (b[np.maximum(last, 0)] == 32)]
            cut[last] = False
        cut[ends] = True
        at = np.flatnonzero(cut).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), max(len(at) - 1, 0), [None, pa.py_buffer(at), pa.py_buffer(data)])
        return array, np.searchsorted(at, ends)

    def looked_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit numbers."""
        out: list[bytes | None] = list(map(self.young.get, pieces))
        for i, got in enumerate(out):
            if got is None and (got := self.old.get(pieces[i])) is not None:
                self.young[pieces[i]] = out[i] = got
        missed = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(missed), SLICE):
            some = missed[k : k + SLICE]
            for i, ids in zip(some, self.encode([pieces[i] for i in some])):
                out[i] = np.array(ids, "<u4").tobytes()
                if len(pieces[i]) <= LONG:
                    self.young[pieces[i]] = out[i]
            if len(self.young) > self.memo:
                self.old, self.young = self.young, {}
        return out

    def known(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces (int32), and how many come before each (one entry more than pieces)."""
        found = self.looked_up(pieces)
        return np.frombuffer(b"".join(found), "<u4").astype(np.int32), np.cumsum([0, *[len(x) >> 2 for x in found]], dtype=np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) one after the other, and how many come before each text (one entry more than texts)."""
        pieces, first = self.pieces(texts)
        which, names = different(pieces)
        flat, begin = self.known(names)
        n = np.diff(begin)[which]
        before = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(begin[which] - before[:-1], n) + np.arange(before[-1])
        return flat[at], before[first]


def different(pieces: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The number of each piece among the different ones, and these."""
    if not len(pieces):
        return np.empty(0, np.int64), []
    coded = pieces.dictionary_encode()
    bounds = np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(coded.dictionary) + 1).tolist()
    data = coded.dictionary.buffers()[2].to_pybytes()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [data[a:b] for a, b in zip(bounds, bounds[1:])]


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}


@lru_cache(maxsize=4)
def byte_level(path: str, special: bool, memo: int = MEMO) -> Encoder:
    """Ids of the ``tokenizers`` library without added tokens; special: their strings inside a text count as such.

    A piece that is a space and letters (of Latin scripts) at most is one word to the library, so its model alone is asked, which
    spares the search for added tokens and words.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
    from tokenizers import Tokenizer

    t, letters = Tokenizer.from_file(path), _byte_letters()
    t.encode_special_tokens = not special
    model = t.model

    def encode(pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = []
        for piece in pieces:
            word = piece.decode()
            body = word[1:] if word.startswith(" ") else word
            plain = len(piece) <= LONG and body.isalpha() and (body.isascii() or max(body) < "\u0250")
            if not plain:
                out.append(None)
                continue
            shown = ("\u0120" + body if body is not word else body) if word.isascii() else piece.decode("latin-1").translate(letters)
            out.append([x.id for x in model.tokenize(shown)])
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, t.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = x.ids
        return out

    return Encoder(encode, marks=True, memo=memo)


@lru_cache(maxsize=4)
def pieces_of_words(path: str, memo: int = MEMO) -> Encoder:
    """Ids of the ``sentencepiece`` library for texts that begin with the space which the library adds itself."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return Encoder(lambda xs: s.encode([x[1:].decode() for x in xs], num_threads=1), marks=False, memo=memo)


@lru_cache(maxsize=4)
def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    t, values = Tokenizer.from_file(path), {c: b for b, c in _byte_letters().items()}
    names = [t.id_to_token(i) for i in range(t.get_vocab_size())]
    return [bytes(values[c] for c in x) if all(c in values for c in x) else x.encode() for x in names]


@lru_cache(maxsize=4)
def piece_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece vocabulary, U+2581 as a space, byte pieces as their byte."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [s.id_to_piece(i) for i in range(s.get_piece_size())]
    return [bytes([int(x[3:5], 16)]) if s.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
