"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

The vocabulary file gives pieces and scores.  A text gets the segmentation of the highest
total score, the one in which each unknown character costs the lowest score and a penalty
and becomes its bytes.  Spaces are written as a mark, one more stands before the text.

No piece has a mark after another character, so a text is a row of marked words (marks
and the characters up to the next mark) that can be segmented one by one.  The distinct
new words of a batch are sorted, which is a depth-first walk of their trie: the forward
scores of the prefix that a word shares with the one before are kept, and only the rest
is computed.  Known words are looked up.

The file at hand lists pieces of a merging model; its scores are used as they stand, as
those of a unigram model, which is what the search is defined for.

Cases: a null text is an empty one, and an empty text has no ids; the mark itself in a
text decodes to a space; rows that repeat count each; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import gather, slices

MARK = "▁"
PENALTY = 10.0
# Marks, then everything up to the next mark; a run of characters without one.
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LONG = 64  # longer words are not kept
_KNOWN = 150_000
_POOL = 8_000_000  # ids of known words
_NEAR = 4  # characters whose endings are remembered
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class Pieces:
    """A vocabulary, and the words it has segmented so far (a bounded number)."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = np.full(256, -1, dtype=np.int64)
        self.byte_of: dict[int, int] = {}
        self.rank: dict[str, tuple[float, int]] = {}
        for i, piece in enumerate(self.texts):
            if model.is_byte(i):
                self.bytes[int(_BYTE.match(piece)[1], 16)] = i
                self.byte_of[i] = int(_BYTE.match(piece)[1], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[piece] = (model.get_score(i), i)
        self.control = {i for i in range(len(self.texts)) if model.is_control(i)}
        self.unknown = min(s for s, _ in self.rank.values()) - PENALTY
        # Every ending of a piece; those that are no piece themselves have no id.
        self.tails: dict[str, tuple[float, int]] = {}
        for piece in self.rank:
            for at in range(1, len(piece)):
                self.tails.setdefault(piece[at:], (0.0, -1))
        self.tails |= self.rank
        self.endings: dict[str, tuple] = {}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece has a mark after another character")
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.start = self.size = self.uses = np.zeros(0, dtype=np.int64)
        self.used = 0

    def _forget(self):
        """Make room: keep the half of the known words that occurred most."""
        index = np.fromiter(self.known.values(), dtype=np.int64, count=len(self.known))
        kept = np.argsort(-self.uses[index], kind="stable")[: _KNOWN // 2]
        words = list(self.known)
        self.known = {words[i]: k for k, i in enumerate(kept.tolist())}
        index = index[kept]
        ids, self.size = gather(self.pool, self.start[index], self.size[index]), self.size[index]
        self.start, self.uses = np.cumsum(self.size) - self.size, self.uses[index] // 2
        self.pool, self.used = np.concatenate((ids, np.zeros(1 << 16, dtype=np.int32))), len(ids)

    def segment(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of sorted words; also the number of characters whose forward scores were
        computed (not taken from the word before)."""
        out, computed = [], 0
        last = ""
        deepest = max(map(len, words), default=0) + 1
        # For each prefix: its score, the start of its last piece and the piece's id.
        best, since, piece = [0.0] * deepest, [0] * deepest, [-1] * deepest
        tails, unknown, endings = self.tails, self.unknown, self.endings
        if len(endings) > _KNOWN:
            endings.clear()
        for word in words:
            same = 0
            for a, b in zip(last, word):  # noqa: B905  (they differ in length)
                if a != b:
                    break
                same += 1
            n = len(word)
            for end in range(same + 1, n + 1):
                lo = end - _NEAR if end > _NEAR else 0
                near = word[lo:end]
                try:
                    found, more = endings[near]
                except KeyError:
                    found, more = endings[near] = self._endings(near)
                top, at, which = best[end - 1] + unknown, end - 1, -1
                for length, value, i in found:
                    score = best[end - length] + value
                    if score >= top:  # of equal scores the longer last piece
                        top, at, which = score, end - length, i
                if more:  # longer pieces may end here
                    for begin in range(lo - 1, -1, -1):
                        tail = tails.get(word[begin:end])
                        if tail is None:
                            break
                        if tail[1] >= 0:
                            score = best[begin] + tail[0]
                            if score >= top:
                                top, at, which = score, begin, tail[1]
                best[end], since[end], piece[end] = top, at, which
            computed += n - same
            last = word
            ids, end = [], n
            while end:
                if piece[end] >= 0:
                    ids.append(piece[end])
                else:
                    ids += [int(self.bytes[b]) for b in reversed(word[since[end] : end].encode())]
                end = since[end]
            ids.reverse()
            out.append(ids)
        return out, computed

    def _endings(self, near: str) -> tuple[tuple[tuple[int, float, int], ...], bool]:
        """The pieces that a few characters end with, and whether longer ones may."""
        out = []
        for length in range(1, len(near) + 1):
            found = self.tails.get(near[-length:])
            if found is None:
                return tuple(out), False
            if found[1] >= 0:
                out.append((length, *found))
        return tuple(out), True

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's."""
        words, counts = [], []
        for text in texts:
            found = _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []
            words += found
            counts.append(len(found))
        if len(self.known) > _KNOWN or self.used > _POOL:
            self._forget()
        new = sorted(set(words) - self.known.keys())
        ids, _ = self.segment(new)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total, base, first = int(sizes.sum()), self.used, len(self.start)
        while base + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[base : base + total] = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=total)
        self.used += total
        self.start = np.concatenate((self.start, base + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        passing: dict[str, int] = {}
        for k, word in enumerate(new):
            (self.known if len(word) <= _LONG else passing)[word] = first + k
        place = self.known | passing if passing else self.known
        which = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), dtype=np.int64)))
        self.uses += np.bincount(which, minlength=len(self.uses))
        size = self.size[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        cuts = np.concatenate(([0], np.cumsum(np.array(counts, dtype=np.int64))))
        return gather(self.pool, self.start[which], size), np.diff(ends[cuts])

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of some ids: bytes together as UTF-8, marks as spaces, without the
        first."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if i not in self.control:
                out.append(self.texts[i])
        if held:
            out.append(held.decode(errors="replace"))
        return "".join(out).replace(MARK, " ").removeprefix(" ")


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The task's vocabulary, kept while the worker lives."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in slices(batches, "text"):
            ids, counts = pieces.encode(batch.column("text").to_pylist())
            data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array([data[e - 4 * n : e] for n, e in zip(counts, ends, strict=True)], type=pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` with ``text``, decoded from ``ids``.  The texts of
    pieces are joined as they stand; only ids of bytes are put together one by one."""
    schema = encoded.withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        special = np.zeros(len(pieces.texts), dtype=bool)
        special[[*pieces.byte_of, *pieces.control]] = True
        blobs = [t.replace(MARK, " ").encode() for t in pieces.texts]
        sizes = np.array([len(b) for b in blobs], dtype=np.int64)
        pool, start = np.frombuffer(b"".join(blobs), dtype=np.uint8), np.cumsum(sizes) - sizes
        for batch in slices(batches, "ids"):
            out = []
            for blob in batch.column("ids").to_pylist():
                ids = np.frombuffer(blob or b"", dtype="<u4").astype(np.int64)
                if special[ids].any():
                    out.append(pieces.decode(ids.tolist()))
                else:
                    out.append(gather(pool, start[ids], sizes[ids]).tobytes().decode().removeprefix(" "))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, schema)
