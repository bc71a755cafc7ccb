"""Token ids of whole texts with a public byte-level BPE vocabulary.

``WordEncoder`` gives exactly the ids of ``Tokenizer.encode(text,
add_special_tokens=False)``, control strings taken as ordinary text.  The
vocabulary's splitter never joins characters across a single blank or line end
that stands between two non-blank characters, nor a letter and the punctuation
after it (the apostrophe is left alone here), so a text may be cut there and
every distinct piece be encoded by the library once and kept.

Texts stay in their Arrow buffers: a group of them is cut by array operations on
its bytes, Arrow numbers the equal pieces, and only the distinct ones of a group
are looked up one by one.
"""
from __future__ import annotations

import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

#: Pieces kept by one encoder in two generations, some 150 MB: when the young one is
#: full it becomes the old one, and what is met again moves over.
KEPT_WORDS = 1_000_000
#: Bytes of text whose pieces are looked up in one call.
GROUP_BYTES = 1 << 20

#: Kinds of bytes: white space, last byte of a Latin letter, ASCII punctuation without the apostrophe.
BLANK, LETTER, MARK = 1, 2, 3
_KIND = np.array([BLANK if c.isspace() else LETTER if c.isalpha() else MARK if c.isprintable() and not c.isdigit() and c != "'" else 0
                  for c in map(chr, range(128))] + [0] * 128, dtype=np.uint8)
#: UTF-8 bytes, as one number, of the white space beyond ASCII, by its length in bytes.
_WIDE = {k: np.array([int.from_bytes(c.encode()) for c in map(chr, range(128, 0x3001)) if c.isspace() and len(c.encode()) == k],
                     dtype=np.uint32) for k in (2, 3)}
#: What the splitter never cuts and the library's model takes as it is.
_PIECE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: The byte alphabet of the vocabulary: a printable byte is its own character, the others follow from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHER = sorted(set(range(256)) - _PLAIN)
_ALPHABET = [chr(b if b in _PLAIN else 256 + _OTHER.index(b)) for b in range(256)]


def vocabulary_path(path: str | None = None) -> str:
    """The given tokenizer file, or the installed public vocabulary."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_mask(data: np.ndarray) -> np.ndarray:
    """Where texts of these UTF-8 bytes may be cut: true at the first byte of a piece.
    Where texts meet, the caller cuts in any case."""
    kind = _KIND[data]
    at = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, letters but for two signs
    kind[at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)] + 1] = LETTER
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[np.isin(data[at].astype(np.uint32) << 8 | data[at + 1], _WIDE[2])]
    kind[at] = kind[at + 1] = BLANK
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    at = at[np.isin(data[at].astype(np.uint32) << 16 | data[at + 1].astype(np.uint32) << 8 | data[at + 2], _WIDE[3])]
    kind[at] = kind[at + 1] = kind[at + 2] = BLANK

    cut = np.zeros(len(data), dtype=bool)
    solid = kind != BLANK
    alone = solid[:-2] & solid[2:]
    line = alone & (data[1:-1] == 0x0A)
    cut[1:-1] = line | alone & (data[1:-1] == 0x20)
    cut[2:] |= line
    cut[1:] |= (kind[:-1] == LETTER) & (kind[1:] == MARK)
    return cut


class Generation(dict):
    """Pieces numbered in the order they are met; ids of piece k in ``flat`` from start[k]."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.size = 0
        self.start, self.count = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int32)
        self.flat, self.used = np.zeros(4096, dtype="<u4"), 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def ids(self, word: str) -> np.ndarray | None:
        n = self.get(word, self.size)
        if n >= self.size:
            return None
        a = self.start[n]
        return self.flat[a:a + self.count[n]]

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Ids of the new pieces, in their order, and how many each has."""
        end, used = self.size + len(counts), self.used + len(ids)
        if end > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * end), np.resize(self.count, 2 * end)
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        self.flat[self.used:used] = ids
        self.count[self.size:end] = counts
        self.start[self.size:end] = self.used + np.cumsum(counts) - counts
        self.size, self.used, self.new = end, used, []


class WordEncoder:
    def __init__(self, path: str | None = None, kept: int = KEPT_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.tokenizer.encode_special_tokens = True
        self.kept, self.young, self.old = kept, Generation(), Generation()
        self.model = self.tokenizer.model

    def _learn(self) -> None:
        """Ids of the pieces that the young generation has just met: from the old one,
        straight from the library's model where the splitter would leave the piece whole,
        else from the whole library."""
        old, whole, tokenize = self.old, _PIECE.fullmatch, self.model.tokenize
        rest = [w for w in self.young.new if not (w in old or whole(w))]
        encoded = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        flat, counts = array("I"), array("q")
        for word in self.young.new:
            before = len(flat)
            if (ids := old.ids(word)) is not None:
                flat.frombytes(ids.tobytes())
            elif whole(word):
                flat.extend([t.id for t in tokenize("".join(map(_ALPHABET.__getitem__, word.encode())))])
            else:
                flat.extend(next(encoded).ids)
            counts.append(len(flat) - before)
        self.young.add(np.frombuffer(flat, dtype=np.uint32), np.frombuffer(counts, dtype=np.int64))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers; null is empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(column):
            return []
        column = pc.fill_null(column.cast(pa.large_string()), "")
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        out, first = [], 0
        while first < len(column):
            stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + GROUP_BYTES, side="right")) - 1)
            out += self._encode_group(data[bounds[first]:bounds[stop]], bounds[first:stop + 1] - bounds[first])
            first = stop
        return out

    def _encode_group(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of the texts that lie in ``data`` from one bound to the next."""
        if len(self.young) > self.kept // 2:
            self.young, self.old = Generation(), self.young
        cut = cut_mask(data)
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        edges = np.append(np.flatnonzero(cut), len(data))
        buffers = [None, pa.py_buffer(edges), pa.py_buffer(data)]
        pieces = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, buffers).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False)
        words = np.fromiter(map(self.young.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        if self.young.new:
            self._learn()
        which = pieces.indices.to_numpy()
        counts = self.young.count[words].astype(np.int64)[which]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.young.flat[np.repeat(self.young.start[words][which] - ends[:-1], counts) + np.arange(ends[-1])]
        stops = ends[np.searchsorted(edges, bounds)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(stops, stops[1:])]


def worker_encoder(path: str | None = None, kept: int = KEPT_WORDS) -> WordEncoder:
    """The encoder of this Python worker, kept for its later tasks.

    Task code arrives pickled by value, without lasting globals, so the encoder
    lives in a module object of its own."""
    give_back()
    state = sys.modules.setdefault("quillmark_worker_state", types.ModuleType("quillmark_worker_state"))
    encoders = state.__dict__.setdefault("encoders", {})
    if (path, kept) not in encoders:
        encoders[path, kept] = WordEncoder(path, kept)
    return encoders[path, kept]
