"""Byte-level BPE ids by the tokenizers library, for whole columns of text.

A byte-level BPE cuts text into pretokens by a fixed pattern and merges each
by itself.  The library's own cutter is the slow part, so the pattern's borders
are found here for a whole block of bytes at once, from each character's class
(letter, number, white space, other) as the library's expressions tell it, and
the library's model encodes each distinct pretoken once.
Texts are first parted at the strings of the vocabulary's added tokens, each of
which is its one id.  The ids equal Tokenizer.encode(text,
add_special_tokens=False); tests compare them.
"""

from __future__ import annotations

import os
from itertools import repeat
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import runs, text_bytes

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Classes of characters in the byte-level pretoken pattern, a fixed value of this family of vocabularies:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_CLASSES = (r"\p{L}+", r"\p{N}+", r"\s+")
_OTHER, _SPACE, _UNKNOWN = 0, 3, 255
#: Pretokens a worker remembers, unless told otherwise.
CACHE_ENTRIES = 600_000
#: Pretokens the model gets at a time.
_AT_A_TIME = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> np.ndarray:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the rest as U+0100 onward."""
    out = np.arange(256, dtype="<u4")
    rest = (out < 33) | ((out > 126) & (out < 161)) | (out == 173)
    out[rest] = 256 + np.arange(rest.sum())
    return out


class _Store:
    """Distinct strings and the ids of each, kept flat."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def add(self, strings: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        base = len(self.index)
        self.index.update(zip(strings, range(base, base + len(strings)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[at]
        return self.flat[np.repeat(self.starts[at], lengths) + runs(lengths)], lengths


class Encoder:
    """Encodes text columns; one for each vocabulary file and worker."""

    _made: dict[tuple[str, int], Encoder] = {}

    @classmethod
    def of(cls, path: str, entries: int = CACHE_ENTRIES) -> Encoder:
        if (path, entries) not in cls._made:
            cls._made[path, entries] = cls(path, entries)
        return cls._made[path, entries]

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.entries = path, entries
        self.model = Tokenizer.from_file(path)
        cutter = self.model.pre_tokenizer
        if not isinstance(cutter, pre_tokenizers.ByteLevel) or cutter.add_prefix_space or self.model.normalizer is not None:
            raise ValueError("a byte-level BPE without normaliser or prefix space is needed")
        # Pretokens of ordinary text only reach the model: an added token is never to be found in them.
        self.model.encode_special_tokens = True
        added = self.model.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that match by their surroundings are not known here")
        self.added = {t.content: i for i, t in added.items()}
        self.parting = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.model.get_vocab()
        self.letters = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.letters[i] = len(piece)
        self.table = _byte_letters()
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self._classify(np.arange(128))
        self.pretokens = _Store()

    @property
    def whole(self) -> Tokenizer:
        """The library's own tokenizer, to compare ids with."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _classify(self, points: np.ndarray) -> None:
        """Learn the classes of these characters from the library's own expressions, whose Unicode version counts."""
        from tokenizers import Regex, pre_tokenizers

        text = "".join(map(chr, points.tolist()))
        self.classes[points] = _OTHER
        for k, pattern in enumerate(_CLASSES, 1):
            for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                self.classes[points[start:end]] = k

    def _byte_classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        kinds = self.classes[data]
        lead = np.flatnonzero(data >= 0xC0)
        if not len(lead):
            return kinds
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        points = data[lead].astype(np.int64) & (0x7F >> size)
        for k in (1, 2, 3):
            at = size > k
            points[at] = points[at] << 6 | (data[lead[at] + k] & 0x3F)
        new = points[self.classes[points] == _UNKNOWN]
        if len(new):
            self._classify(np.unique(new))
        found = self.classes[points]
        for k in (0, 1, 2, 3):
            at = size > k
            kinds[lead[at] + k] = found[at]
        return kinds

    def _borders(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The first byte of each pretoken."""
        edge = np.zeros(len(data) + 4, bool)
        edge[rows] = True
        kinds = self._byte_classes(data)
        first = edge.copy()
        first[1 : len(data)] |= kinds[1:] != kinds[:-1]
        # White space before other text: its last character stands alone, or leads the text if it is a space.
        space = kinds == _SPACE
        after = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1 : len(data)]) + 1
        last = after - 1
        for _ in range(3):
            last = last - ((data[last] & 0xC0) == 0x80)
        first[last] = True
        first[after[data[last] == 0x20]] = False
        # Contractions, where an apostrophe starts a pretoken.
        at = np.flatnonzero((data == 0x27) & first[: len(data)])
        next1, next2 = (np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0) for k in (1, 2))
        inside1 = ~edge[at + 1]
        inside2 = inside1 & ~edge[at + 2]
        short = at[inside1 & np.isin(next1, np.frombuffer(b"stmd", np.uint8))]
        long = at[inside2 & (((next2 == ord("e")) & ((next1 == ord("r")) | (next1 == ord("v")))) | ((next1 == ord("l")) & (next2 == ord("l"))))]
        first[short + 1] = False
        first[short + 2] = True
        first[long + 1] = first[long + 2] = False
        first[long + 3] = True
        return np.flatnonzero(first[: len(data)])

    def _learn(self, pretokens: pa.Array, strings: list[str]) -> None:
        data, rows = text_bytes(pretokens)
        letters, parts = self.table[data], []
        for i in range(0, len(strings), _AT_A_TIME):
            ends = rows[i : i + _AT_A_TIME + 1]
            text = np.insert(letters[ends[0] : ends[-1]], ends[1:-1] - ends[0], 32).astype("<u4").tobytes().decode("utf-32-le")
            parts.append(np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(parts)
        ends = np.searchsorted(np.cumsum(self.letters[ids]), rows[1:]) + 1
        self.pretokens.add(strings, ids, np.diff(ends, prepend=0))

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where each pretoken's ids are; new ones are learnt."""
        strings = distinct.to_numpy(zero_copy_only=False).tolist()
        known = self.pretokens.index
        at = np.fromiter(map(known.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(known) + np.arange(len(new))
            self._learn(distinct.take(pa.array(new)), [strings[i] for i in new.tolist()])
        return at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, end to end, and n + 1 offsets; nulls are empty."""
        if len(self.pretokens.index) > self.entries:
            self.pretokens = _Store()
        column = pc.fill_null(column, "")
        holds = np.zeros(len(column), bool)
        for token in self.added:
            holds |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        return self._parted(column, holds) if holds.any() else self._plain(column)

    def _parted(self, column: pa.Array, holds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where some rows hold added tokens: the stretches between them are encoded as rows of their own."""
        stretches: list[pa.Array] = []
        last, specials = np.ones(len(column), np.int64), []
        start = 0
        for r in [*np.flatnonzero(holds).tolist(), len(column)]:
            stretches.append(column.slice(start, r - start))
            if r < len(column):
                text = column[r].as_py()
                found = self.parting.findall(text)
                stretches.append(pa.array(self.parting.split(text), column.type))
                last[r] = len(found) + 1
                specials.append([self.added[t] for t in found])
            start = r + 1
        flat, ends = self._plain(pa.concat_arrays(stretches))
        # An added token follows each stretch of its row but the last.
        last = np.cumsum(last)
        inner = np.ones(len(ends) - 1, bool)
        inner[last - 1] = False
        ids = np.insert(flat, ends[1:][inner], np.concatenate(specials).astype(np.uint32))
        return ids, np.concatenate([[0], (ends[1:] + np.cumsum(inner))[last - 1]])

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, rows = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        starts = self._borders(data, rows)
        offsets = np.append(starts, len(data)).astype(np.int64)
        pretokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pretokens.dictionary_encode()
        flat, lengths = self.pretokens.gather(self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)])
        return flat, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, rows)]
