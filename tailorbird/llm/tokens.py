"""Whole-text tokenization with a public vocabulary, shared by the token output and the packer.

A byte-level BPE never merges across the word boundaries of its pre-tokenizer, so a text's ids are the ids
of its words one after the other.  `Encoder` cuts a batch of texts in front of every space that follows a
character other than white space (always such a boundary), finds the distinct pieces with Arrow, looks them up among those
that it remembers, has the others' words encoded by the tokenizers library's own model, and puts the ids together
with NumPy: Python runs per new distinct piece, not per word.  A vocabulary file whose pre-tokenizer, normalizer or model is of another
kind, and a text that holds the string of a special token, go through the library's whole-text call.

Cases: a null text is an empty one; the string of a special token inside a text becomes that token, as in the
library's own call with add_special_tokens=False, or ordinary text with `special=False`.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that one Python worker remembers from batch to batch (about 50 bytes each), and the bytes of the longest.
CACHE_SIZE, CACHE_LONGEST = 600_000, 48

#: Bytes of text that go through at a time; a single larger text stays whole.
CHUNK = 4 << 20

_loaded: dict[tuple[str, bool], "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letters in which a byte-level BPE writes bytes: printable ones stay, others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _is_plain(config: dict) -> bool:
    """Whether a vocabulary file is a byte-level BPE with the pre-tokenizer that `Encoder` knows."""
    model, before = config["model"], config.get("pre_tokenizer") or {}
    known = {"type": "ByteLevel", "add_prefix_space": False}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk")
    return model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in odd) and not config.get("normalizer") and all(before.get(k) == v for k, v in known.items()) and before.get("use_regex", True)


#: Classes of bytes: 1 letters and digits, 2 other printable ASCII, 3 white space; 0 is all else, near which only a space cuts.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 2
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 3


#: Pieces that are one word in any version of Unicode: Latin letters, all of which are old.
_ONE_WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"


def _cuts(data: np.ndarray) -> np.ndarray:
    """A mark at every byte of UTF-8 text in front of which a word surely begins, whatever stands around.

    That is white space behind another character, a sign behind a letter or digit, and a letter or digit behind
    a single line end; two white spaces in a row hang together, as the pre-tokenizer looks ahead there.
    """
    kind = _CLASS[data]
    solid = (kind == 1) | (kind == 2)
    space = kind == 3
    marks = np.zeros(len(data), bool)
    marks[1:] = space[1:] & solid[:-1]
    marks[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
    marks[2:] |= (kind[2:] == 1) & (data[1:-1] == 10) & solid[:-2]
    # the last two bytes of some white space beyond ASCII also end other characters, which then aren't cut behind
    wide = np.flatnonzero(data[:-1] >= 128)
    wide = wide[data[wide + 1] == 32]
    marks[wide + 1] = ~np.isin(data[np.maximum(wide - 1, 0)], (0xC2, 0x80, 0x81, 0x9A))
    return marks


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes of each of some large strings begin, with their end as the last, and the bytes."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets - offsets[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


class _Words(dict):
    """Words to their numbers in the order in which they came."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of whole texts by one vocabulary file."""

    def __init__(self, path: str, special: bool = True, capacity: int = CACHE_SIZE):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.plain = _is_plain(config)
        self._special = [t["content"] for t in config.get("added_tokens", []) if special or not t.get("special")]
        self._model = self.tokenizer.model
        self._words_of = regex.compile(public_tokenizers.PATTERN).findall
        self._letters = _byte_letters()
        self._capacity = capacity
        # the pieces that are remembered, how often later batches had them, and their ids one after the other
        self._known, self._hits = pa.array([], pa.large_string()), np.zeros(0, np.int32)
        self._ids, self._sizes = np.zeros(0, "<u4"), np.zeros(0, np.int32)

    def _split(self, piece: str) -> list[str]:
        """A piece's words; most pieces are one."""
        return [piece] if piece.isalpha() or (piece[0] == " " and piece[1:].isalpha()) else self._words_of(piece)

    def _coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and each one's number of ids. Byte 255 never stands in UTF-8, so it can part words."""
        simple = pc.match_substring_regex(pieces, _ONE_WORD).to_numpy(zero_copy_only=False)
        ones, split, known = pieces.filter(pa.array(simple)), list(map(self._split, pieces.filter(pa.array(~simple)).to_pylist())), _Words()
        of_piece, words = np.ones(len(pieces), np.int64), np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64)
        of_piece[~simple] = np.fromiter(map(len, split), np.int64, len(split))
        offsets, data = _bytes(ones)
        parted = [np.insert(data, offsets[1:-1], 255).tobytes()] * (len(ones) > 0) + [w.encode("utf-8", "replace") for w in known]
        if not parted:
            return np.zeros(0, "<u4"), np.zeros(len(pieces), np.int32)
        letters = b"\xff".join(parted).decode("latin-1").translate(self._letters).split("\xff")
        found = [[t.id for t in tokens] for tokens in map(self._model.tokenize, letters)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        one = np.repeat(simple, of_piece)
        which = np.zeros(len(one), np.int64)
        which[one], which[~one] = np.arange(len(ones)), words + len(ones)
        ids, ends = _runs(np.fromiter(chain.from_iterable(found), np.uint32), sizes, which)
        return ids, np.diff(np.append(0, ends)[np.append(0, np.cumsum(of_piece))]).astype(np.int32)

    def _remember(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep short new pieces; once there are too many, the three quarters of them that came most often, of equals the newest."""
        short = pc.less_equal(pc.binary_length(pieces), CACHE_LONGEST)
        keep = np.flatnonzero(short.to_numpy(zero_copy_only=False))
        self._known = pa.concat_arrays([self._known, pieces.filter(short)])
        self._hits = np.append(self._hits, np.zeros(len(keep), np.int32))
        self._ids, self._sizes = np.append(self._ids, _runs(ids, sizes, keep)[0]), np.append(self._sizes, sizes[keep])
        if len(self._known) > self._capacity:
            best = np.sort(np.argsort(self._hits, kind="stable")[-(self._capacity * 3 // 4) :])
            self._known, self._hits = self._known.take(pa.array(best)), self._hits[best] // 2
            self._ids, self._sizes = _runs(self._ids, self._sizes, best)[0], self._sizes[best]

    def encode(self, texts: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the ids of `end` behind it; and where each text's begin,
        with their end as the last."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.full(len(texts), not self.plain)
        for token in self._special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._mixed(texts, odd, end)
        n, (offsets, data) = len(texts), _bytes(texts)
        marks = _cuts(data)
        marks[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        edges = np.append(np.flatnonzero(marks), len(data))
        first = np.searchsorted(edges[:-1], offsets)  # the first piece of each text
        pieces = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        number = pc.fill_null(pc.index_in(coded.dictionary, value_set=self._known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(number < 0)
        self._hits[number[number >= 0]] += 1
        fresh = coded.dictionary.take(pa.array(new))
        fresh_ids, fresh_sizes = self._coded(fresh)
        number[new] = np.arange(len(new)) + len(self._known)
        # the ids of each known piece, then those of the new ones, then those of the end, in one table
        table = np.concatenate([self._ids, fresh_ids, np.array(end, np.uint32)])
        sizes = np.concatenate([self._sizes, fresh_sizes, np.array([len(end)], np.int32)])
        which = np.insert(number[coded.indices.to_numpy()], first[1:], len(sizes) - 1)
        self._remember(fresh, fresh_ids, fresh_sizes)
        ids, ends = _runs(table, sizes, which)
        return ids, np.append(0, ends[first[1:] + np.arange(n)])

    def _mixed(self, texts: pa.Array, odd: np.ndarray, end: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The same, odd texts one by one by the library's whole-text call."""
        ids, at = self.encode(texts.filter(pa.array(~odd)), end) if not odd.all() else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        plain, found = zip(at[:-1].tolist(), at[1:].tolist()), []
        for i, whole in enumerate(odd.tolist()):
            if whole:
                own = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
                found.append(np.array([*own, *end], "<u4"))
            else:
                found.append(ids[slice(*next(plain))])
        return np.concatenate(found), np.cumsum([0, *map(len, found)])


def _runs(table: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs named by `which`, one after the other, of a table of consecutive runs; and where each ends."""
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    lengths = sizes[which]
    ends = np.cumsum(lengths, dtype=np.int64)
    source = np.repeat(begin[which] - (ends - lengths), lengths)
    source += np.arange(len(source))
    return table[source], ends


def encoder(path: str, special: bool = True) -> Encoder:
    """The worker's encoder for a vocabulary file; Python workers are reused, so it outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
    if (path, special) not in _loaded:
        _loaded[path, special] = Encoder(path, special)
    return _loaded[path, special]


def crc32(ids: bytes | np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if isinstance(ids, bytes) else np.ascontiguousarray(ids, "<u4"))
