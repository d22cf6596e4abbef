"""Token ids through a word cache.

The tokenizer lower-cases, and splits at white space, around each digit and between letters and other
signs, before it merges. So a text's ids are the ids of its chunks in order. A batch of texts is cut
into chunks on its bytes, the different chunks are found by Arrow's dictionary encoding, and only
those go through the worker's bounded cache, or the tokenizer if they are new. An apostrophe is never
a border, since it may start a suffix of its own, and neither is a sign outside ASCII that is no
letter. A text with white space on which Python and the tokenizer could differ is encoded whole; one
with letters outside the Latin blocks, or with what could be a special token, is cut at white space
alone and keeps its case until the tokenizer sees it.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from . import rolling as R

#: White space outside space, tab, CR and LF, and the separators that only Python calls white space.
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
#: Letters whose lower case could depend on their neighbours or be more than one sign.
_FOREIGN = re.compile("[^\x00-įı-ɏ‐-‧‰-⁞]")
#: Chunks that a worker keeps when its cache is full.
RESTING = 100_000
_ENCODERS: dict[tuple[str, int], Encoder] = {}
#: Kinds of bytes: white space, letters, digits, other ASCII signs, and signs with no border around them.
_SPACE, _LETTER, _DIGIT, _SIGN, _HELD = range(5)


def _kinds() -> np.ndarray:
    kind = np.full(256, _SIGN, np.uint8)
    kind[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = _LETTER
    kind[[*range(0x30, 0x3A)]] = _DIGIT
    kind[[0x27, *range(0x80, 0xC3), *range(0xCA, 0x100)]] = _HELD
    return kind


_KIND = _kinds()
#: Bytes of which a text is looked at by the two patterns above.
_RARE = np.zeros(256, bool)
_RARE[[0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xC4, *range(0xC9, 0x100)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()


class Encoder(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes; cut back when it holds `limit` chunks."""

    def __init__(self, path: str, limit: int):
        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        return self.whole(chunk)

    def learn(self, chunks: list[str]) -> None:
        """Cache the ids of chunks. Words of letters alone go straight to the merges, others through the whole tokenizer."""
        tokenize, other, raw = self.tokenizer.model.tokenize, [], self.raw
        for chunk in chunks:
            if len(chunk) > 64:
                continue
            if chunk.isalpha():
                if chunk.isascii() and chunk.islower():
                    self[chunk] = b"".join([raw[t.id] for t in tokenize(chunk)])
                    continue
                low = chunk.lower()
                if not _FOREIGN.search(chunk) and unicodedata.is_normalized("NFC", low):
                    self[chunk] = b"".join([raw[t.id] for t in tokenize(low.encode().decode("latin-1").translate(_BYTE_SIGNS))])
                    continue
            other.append(chunk)
        for chunk, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self[chunk] = np.array(found.ids, "<u4").tobytes()

    def rest(self) -> None:
        """Keep the chunks learned first, which are the frequent ones, and let the others go."""
        kept = list(itertools.islice(self.items(), min(RESTING, self.limit // 2)))
        self.clear()
        self.update(kept)

    def ids(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with `end` behind each, n + 1 offsets)."""
        data, off = R.column_bytes(texts)
        letters, starts, ends, first, whole = _chunks(data, off)
        size = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=size[1:])
        held = pa.StringArray.from_buffers(len(starts), pa.py_buffer(size), pa.py_buffer(letters)).dictionary_encode()
        chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(held.dictionary)], pa.int32()), held.dictionary), " ")[0].as_py().split(" ") if len(held) else []
        new = [c for c in chunks if c not in self]
        if new:
            if len(self) + len(new) > self.limit:
                self.rest()
                new = [c for c in chunks if c not in self]
            self.learn(new)
        # one more entry behind each text: its end, or the whole text's ids if it was not cut
        parts = [self[c] for c in chunks]
        own = np.full(len(off) - 1, len(parts))
        parts.append(end)
        for d in whole:
            own[d] = len(parts)
            parts.append(self.whole(data[off[d] : off[d + 1]].tobytes().decode()) + end)
        length = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        begin = np.cumsum(length) - length
        which = np.empty(len(starts) + len(own), np.int64)
        last = first[1:] + np.arange(len(own))
        is_last = np.zeros(len(which), bool)
        is_last[last] = True
        which[last], which[~is_last] = own, held.indices.to_numpy()
        n = length[which]
        stop = np.cumsum(n)
        place = np.repeat(begin[which] - (stop - n), n)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(parts), "<u4")[place], np.concatenate([[0], stop[last]])

    def encode(self, texts: list[str | None], rows: int = 256) -> Iterator[bytes]:
        for at in range(0, len(texts), rows):
            ids, off = self.ids(pa.array(texts[at : at + rows], pa.string()))
            for a, b in itertools.pairwise(off.tolist()):
                yield ids[a:b].tobytes()


def _chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(bytes of the chunks, their starts and ends, the first chunk of each text, texts that can't be cut)."""
    low, kind, n = R.translated(data, R.LOWER), R.translated(data, _KIND), len(data)
    # a sign's further bytes are of its kind
    tail = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    kind[tail[_KIND[data[tail - 1]] == _LETTER]] = _LETTER
    odd = np.flatnonzero(R.translated(data, _RARE))
    special = np.flatnonzero(data == 0x3C)
    special = special[data[np.minimum(special + 1, n - 1)] == 0x7C]
    whole, coarse = [], set((np.searchsorted(off, special, side="right") - 1).tolist())
    for d in np.unique(np.searchsorted(off, odd, side="right") - 1).tolist():
        text = data[off[d] : off[d + 1]].tobytes().decode()
        if _ODD.search(text):
            whole.append(d)
            kind[off[d] : off[d + 1]] = _SPACE
        elif _FOREIGN.search(text):
            coarse.add(d)
    # the two signs among the letters' first bytes that are no letters
    sign = np.flatnonzero((data == 0x97) | (data == 0xB7))
    sign = sign[(data[sign - 1] == 0xC3) & (kind[sign] != _SPACE)]
    kind[sign] = kind[sign - 1] = _HELD
    border = np.zeros(n + 1, bool)
    if n:
        before, after = kind[:-1], kind[1:]
        border[1:-1] = (before == _DIGIT) | (after == _DIGIT) | ((before == _LETTER) & (after == _SIGN)) | ((before == _SIGN) & (after == _LETTER))
    for d in coarse:
        border[off[d] : off[d + 1]] = False
        low[off[d] : off[d + 1]] = data[off[d] : off[d + 1]]
    border[off] = True
    filled = kind != _SPACE
    # a chunk starts and ends where white space meets other signs or at a border between two of those
    edge = border[:-1] & filled
    if n:
        edge[1:] |= filled[1:] & ~filled[:-1]
    starts = np.flatnonzero(edge)
    edge = border[1:] & filled
    if n:
        edge[:-1] |= filled[:-1] & ~filled[1:]
    ends = np.flatnonzero(edge) + 1
    return low[filled], starts, ends, np.searchsorted(starts, off), whole


def encoder(path: str | None = None, limit: int = 500_000) -> Encoder:
    """This process's encoder for a tokenizer file."""
    key = (path or default_path(), limit)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
