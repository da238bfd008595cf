"""Ids of whole texts by the ``tokenizers`` library, each distinct unit encoded once.

Both vocabularies in use first split a text by a pattern and then encode every match
on its own.  Units here are such matches, or several that stand together: runs of
letters, digits or punctuation (with the one space before them, where the vocabulary
keeps spaces), and runs of white space.  Units are found and looked up for a whole
batch at once; the library encodes those that are new.  Texts and words with anything
unusual (apostrophes, rare characters, special tokens) go to the library undivided.
"""

from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from martflow.llm.common import gather
from martflow.llm.words import mix

LETTER, DIGIT, PUNCT, SPACE, BREAK, ODD, END, UNDIVIDED = range(8)


def _classes() -> np.ndarray:
    table = np.full(0x250, ODD, dtype=np.uint8)
    for c in range(0x250):
        ch = chr(c)
        if c < 0x80:
            table[c] = LETTER if ch.isalpha() else DIGIT if ch.isdigit() else PUNCT if 0x20 < c < 0x7F else ODD
        elif c >= 0xC0 and c not in (0xD7, 0xF7, 0x130, 0x149, 0x1F0) and ch.isalpha():
            table[c] = LETTER
    table[[9, 10, 13]] = BREAK
    table[32] = SPACE
    table[[ord("'"), ord("<")]] = ODD
    table[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0]] = UNDIVIDED
    table[0] = END
    return table


_TABLE = _classes()
# White space whose neighbours decide how it is split: texts with it, or with a special
# token, are not divided.
_WIDE_SPACE = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_UNDIVIDED = re.compile("<\\||[\0\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SLOT_BITS = 21
_POOL = 12_000_000
_PART = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(7))
_LONGEST = 256


def _powers(base: int) -> np.ndarray:
    out = np.full(_LONGEST, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = (_powers(0xA0761D6478BD642F), _powers(0xE7037ED1A0B428DB))
_VALUES = mix(np.arange(1, 0x251, dtype=np.uint64))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    bytes for themselves, the others for the letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_LETTERS = {b: c for b, c in enumerate(_byte_letters())} | {0: "\n"}
_BLOCK = 2000  # units of a line for the bare model


class Encoder:
    """Encodes texts with one vocabulary file.

    ``spaces``: whether the vocabulary keeps white space.  Memory is bounded: the
    table of known units has a fixed number of slots, and it is emptied when its ids
    fill their pool."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # The same model alone, for units that its pattern would not split: one line each.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        self.width = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token.removesuffix(suffix) if suffix else token)
        self.spaces = spaces
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if self.size <= 0xFFFF else np.uint32
        self._clear()

    def _clear(self):
        n = 1 << _SLOT_BITS
        self.key = np.zeros((2, n), dtype=np.uint64)
        self.start = np.zeros(n, dtype=np.int32)
        self.length = np.zeros(n, dtype=np.int32)
        self.pool = np.zeros(1 << 16, dtype=self.dtype)
        self.used = 0

    def _keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        parts: list[list[str]] = [[]]
        owner: list[list[int]] = [[]]
        size = 0
        for i, text in enumerate(texts):
            for piece in self._pieces(text or ""):
                if size and size + len(piece) > _PART:
                    parts.append([])
                    owner.append([])
                    size = 0
                parts[-1].append(piece)
                owner[-1].append(i)
                size += len(piece) + 1
        ids, counts = [], np.zeros(len(texts), dtype=np.int64)
        for part, own in zip(parts, owner, strict=True):
            if part:
                got, n = self._part(part)
                ids.append(got)
                np.add.at(counts, own, n)
        return (np.concatenate(ids) if ids else np.empty(0, dtype=self.dtype)), counts

    def _pieces(self, text: str):
        """Cut a very long text where a single space stands between two characters
        that are not space: no match can reach over the start of such a space."""
        if len(text) <= _PART or _UNDIVIDED.search(text):
            yield text
            return
        at = 0
        while len(text) - at > _PART:
            cut = text.rfind(" ", at + 1, at + _PART)
            while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.used > _POOL:
            self._clear()
        plain: list[str | None] = list(texts)
        joined = "\0".join([*texts, ""])
        units = None if "<|" in joined else self._units(joined, len(texts))
        if units is None:
            plain = [None if _UNDIVIDED.search(t) else t for t in texts]
            joined = "\0".join([*(t or "" for t in plain), ""])
            units = self._units(joined, len(texts))
        start, stop, single = units
        edges = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in plain])))
        units = np.diff(np.searchsorted(start, edges))
        at, length = self._look_up(joined, start, stop, single)
        before = np.concatenate(([0], np.cumsum(length)))
        last = np.cumsum(units)
        counts = before[last] - before[last - units]
        ids = gather(self.pool, at.astype(np.int64), length.astype(np.int64))
        if any(p is None for p in plain):
            own = np.split(ids, np.cumsum(counts)[:-1])
            own = [x if p is not None else self.whole(t) for x, p, t in zip(own, plain, texts, strict=True)]
            return np.concatenate(own), np.array([len(x) for x in own])
        return ids, counts

    def _units(self, joined: str, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Start and end of each unit, and whether the pattern leaves it in one piece;
        None if a text must not be divided."""
        chars = self._chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = _TABLE[np.minimum(chars, 0x24F)]
        high = np.flatnonzero(chars >= 0x250)
        if len(high):
            kind[high] = ODD
            if np.isin(chars[high], _WIDE_SPACE).any():
                return None
        end = kind == END
        if (kind == UNDIVIDED).any() or int(end.sum()) != texts:
            return None
        blank = (kind == SPACE) | (kind == BREAK)
        solid = ~blank & ~end
        prev_blank = np.concatenate(([False], blank[:-1]))
        prev_end = np.concatenate(([True], end[:-1]))
        prev_space = np.concatenate(([False], kind[:-1] == SPACE))
        next_solid = np.concatenate((solid[1:], [False]))
        # A word is a run of characters that are not space; odd ones stay whole.
        word_start = solid & (prev_blank | prev_end)
        word = np.cumsum(word_start)
        odd_word = np.zeros(int(word[-1]) + 1 if len(word) else 1, dtype=bool)
        odd_word[word[kind == ODD]] = True
        change = np.concatenate(([True], kind[1:] != kind[:-1]))
        inner = solid & ~prev_blank & ~prev_end & change & ~odd_word[word]
        first = inner | (blank & (~prev_blank | next_solid)) | (prev_end & ~end)
        if self.spaces:
            first |= word_start & ~prev_space
        else:
            first |= word_start
        first |= end
        at = np.flatnonzero(first)
        stop = np.append(at[1:], len(chars))
        keep = ~end[at] if self.spaces else solid[at]
        at, stop = at[keep], stop[keep]
        single = blank[stop - 1] | ~odd_word[word[stop - 1]]
        if not self.spaces:
            single &= kind[stop - 1] != DIGIT
        return at, stop, single

    def _look_up(self, joined: str, start: np.ndarray, stop: np.ndarray, single: np.ndarray):
        n = stop - start
        if not len(n):
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        flat = gather(self._chars, start, n)
        first = np.cumsum(n) - n
        where = np.arange(len(flat)) - np.repeat(first, n)
        long = n > _LONGEST
        if long.any():
            where %= _LONGEST
        values = _VALUES[np.minimum(flat, 0x24F)]
        high = np.flatnonzero(flat >= 0x24F)
        if len(high):
            values[high] = mix(flat[high].astype(np.uint64) + np.uint64(1))
        key = [mix(np.add.reduceat(values * p[where], first) + n.astype(np.uint64)) for p in _POWERS]
        slot = (key[0] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at, length = self.start[slot], self.length[slot]
        new = (self.key[0][slot] != key[0]) | (self.key[1][slot] != key[1]) | long
        if new.any():
            todo = np.flatnonzero(new)
            _, pick, inverse = np.unique(key[0][todo] ^ long[todo] * todo.astype(np.uint64), return_index=True, return_inverse=True)
            one = todo[pick]
            units = [joined[a:b] for a, b in zip(start[one].tolist(), stop[one].tolist(), strict=True)]
            ids, size = self._new(units, single[one])
            base = self._keep(ids)
            place = (base + np.cumsum(size) - size).astype(np.int32)
            at[todo], length[todo] = place[inverse], size[inverse]
            kept = one[~long[one]]
            self.key[0][slot[kept]], self.key[1][slot[kept]] = key[0][kept], key[1][kept]
            self.start[slot[kept]], self.length[slot[kept]] = at[kept], length[kept]
        return at, length


    def _new(self, units: list[str], single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units by the library, one after another, and their numbers."""
        size = np.zeros(len(units), dtype=np.int64)
        rest, plain = np.flatnonzero(~single), np.flatnonzero(single)
        others = [
            np.array(got.ids, dtype=self.dtype)
            for got in self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False)
        ]
        size[rest] = [len(x) for x in others]
        flat = np.empty(0, dtype=self.dtype)
        if len(plain):
            joined = "\0".join([units[i] for i in plain])  # no unit holds a zero byte
            blob = (joined if self.spaces else joined.lower()).encode()
            cuts = np.append(np.flatnonzero(np.frombuffer(blob, dtype=np.uint8) == 0), len(blob))
            edges = [-1, *cuts[_BLOCK - 1 :: _BLOCK].tolist()]
            if edges[-1] < len(blob):
                edges.append(len(blob))
            lines = [blob[a + 1 : b].decode("latin-1").translate(_LETTERS) for a, b in zip(edges, edges[1:], strict=False)]
            got = self.model.encode_batch_fast(lines, add_special_tokens=False)
            flat = np.concatenate([np.array(g.ids, dtype=self.dtype) for g in got])
            # The letters of the ids fill the units exactly.
            ends = cuts - np.arange(len(cuts))
            last = np.searchsorted(np.cumsum(self.width[flat]), ends)
            size[plain] = np.diff(np.concatenate(([0], last + 1)))
            if not len(rest):
                return flat, size
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=self.dtype)
        out[gather(np.arange(len(out)), start[plain], size[plain])] = flat
        for i, own in zip(start[rest].tolist(), others, strict=True):
            out[i : i + len(own)] = own
        return out, size


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """The task's encoder for a vocabulary file, kept while the worker lives."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]
