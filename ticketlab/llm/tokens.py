"""Token ids of whole texts by a public tokenizer file, piece by piece.

The tokenizer (``word_bpe_49k.json``) normalises, drops white space, and cuts
what is left into runs of letters, single digits, and runs of other characters,
which its BPE model encodes one by one. So the ids of a text are those of its
pieces in order, and the distinct pieces of a slice of texts are encoded once:

* words (as in ``bytetext``) made of ASCII and Latin-1 letters and ASCII
  punctuation (but ``'`` and ``<``) are cut at every change between the two kinds,
  lowered, and given to the tokenizer's own BPE model;
* all other words are given whole to its ``encode``.

Ids are kept by piece hash for the life of a Python worker, up to a fixed number
of entries; beyond, pieces are encoded again.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from . import bytetext as B

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
KEPT = 400_000
SLICE_BYTES = 2 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_chars() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def pieces(s: B.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts: bytes (lowered in plain words), starts, ends, index
    of each text's first, hashes, and whether they are of plain words."""
    d = s.data
    inside = ~B.is_space(d)
    starts, ends, first = B.runs(inside, s.offsets)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return d, none, none, first, none.astype(np.uint64), none.astype(bool)
    after, before = np.append(d[1:], np.uint8(0)), np.concatenate((np.zeros(1, np.uint8), d[:-1]))
    latin = (d == 0xC3) & (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
    trail = np.concatenate((np.zeros(1, bool), latin[:-1]))
    plain_byte = (d > 0x20) & (d < 0x7F) & ((d < 0x30) | (d > 0x39)) & (d != ord("'")) & (d != ord("<"))
    odd = inside & ~plain_byte & ~latin & ~trail
    plain_word = ~np.logical_or.reduceat(odd, starts)          # spaces up to the next word are not odd
    plain = np.zeros(len(d), bool)
    plain[starts[0]:] = np.repeat(plain_word, np.diff(np.append(starts, len(d))))
    plain &= inside
    low = np.where(plain, B.lower(d), d)
    low = np.where(plain & trail & (before == 0xC3) & (d < 0x9F), low + 0x20, low).astype(np.uint8)
    letter = ((d | 0x20) >= ord("a")) & ((d | 0x20) <= ord("z")) | latin | trail
    begin = np.zeros(len(d), bool)
    begin[starts] = True
    begin[1:] |= plain[1:] & plain[:-1] & (letter[1:] != letter[:-1])
    at = np.flatnonzero(begin)
    final = np.zeros(len(d), bool)      # last bytes of pieces: of words, and before a change of kind
    final[ends - 1] = True
    final[:-1] |= begin[1:] & inside[:-1]
    stop = np.flatnonzero(final) + 1
    hashes = B.run_hashes(low, inside, at, stop) ^ np.where(plain[at], np.uint64(0), np.uint64(0x5851F42D4C957F2D))
    return low, at, stop, np.searchsorted(at, s.offsets), hashes, plain[at]


class PieceIds:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chars = _byte_chars()
        self.kept: dict[int, bytes] = {}   # ids as 16-bit numbers; the vocabulary is smaller than that

    def _encode(self, piece: bytes, plain: bool) -> bytes:
        if plain:
            mapped = piece.decode() if piece.isascii() else "".join([self.chars[b] for b in piece])
            ids = [t.id for t in self.model.tokenize(mapped)]
        else:
            ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array("H", ids).tobytes()

    def slice(self, s: B.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and where each text's
        start (one entry more than texts)."""
        low, starts, ends, first, hashes, plain = pieces(s)
        distinct, at, place = B.distinct(hashes)
        kept, raw, a, z, p = self.kept, low.tobytes(), starts[at].tolist(), ends[at].tolist(), plain[at].tolist()
        got: list = list(map(kept.get, distinct.tolist()))
        for i in [i for i, ids in enumerate(got) if ids is None]:
            got[i] = ids = self._encode(raw[a[i]: z[i]], p[i])
            if len(kept) < KEPT:
                kept[int(distinct[i])] = ids
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 2
        flat = np.frombuffer(b"".join(got), np.uint16)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        each = sizes[place]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - begin[place], each)]
        return ids.astype(np.uint32), upto[first]


_LOADED: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    """The worker's own tokenizer of this file."""
    if path not in _LOADED:
        _LOADED[path] = PieceIds(path)
    return _LOADED[path]
