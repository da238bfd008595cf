"""A toxicity score of texts whose disguises are undone first.

A noisy channel: somebody meant plain words and wrote some letters as digits or signs
(``1d10t``), put spaces or dots between letters (``i d i o t``), or repeated letters
(``idiooot``).  Every token, or run of single characters, that could be disguised spans a
lattice of what may have been meant, byte by byte; a Viterbi search finds the reading of
least cost under a character language model and the channel's costs.  The model holds the
four-grams of all documents.  The restored text is scored by a sparse logistic regression
on the words it holds.

Cases: a null or empty text has no word, so its score is the model's intercept, and 0.5
without any labelled text; a null ``doc_id`` counts as held out; several labels of one
document, and of equal texts, count as their mean, null labels not at all; a single
character between spaces is read with its neighbours only if at least three stand in a
row; a run of any length is decoded whole; repeated rows get equal scores; an empty table
gives no row.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import pick, slices, staged
from martflow.llm.quality import held_out

# Classes of bytes: 0 a word's edge, 1 to 26 letters, then bytes beyond ASCII, digits, signs.
CLASSES = 30
_WIDE, _DIGIT, _SIGN = 27, 28, 29
_CONTEXTS = CLASSES**3

# Letters that signs are used for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou",
}
JOINTS = " .-_*~"
_MARKS, _SIGNS = ".,;:?)]\"'", ".,;:?)]\"'!$@|+(<*&%#=~_-"
# Negative logarithms of the channel's chances: a letter as a sign, a joint inside a word, a
# joint for the end of one, a letter written a second time, and once more.
COSTS = {"leet": 2.5, "joint": 1.0, "end": 1.5, "second": 2.5, "more": 0.5}

_HIDDEN = re.compile("[­​-‍⁠﻿]")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
_WORD = re.compile(r"[^\W\d_]+")
_DOUBTFUL = re.compile(
    r"([a-z])\1"  # a letter twice
    r"|[a-z][0-9@$!|+(<*]|[0-9@$!|+(<*][a-z]"  # a sign beside a letter
    r"|[a-z][.\-_*~]+[a-z0-9@$!|+(<]"  # a joint inside
)
# What makes a token doubtful once its first pair of equal letters is known.
_ELSE = re.compile(r"([a-z])\1|[0-9@$!|+(<*._~-]")
_CACHED = 1 << 18


def _byte_classes() -> np.ndarray:
    table = np.full(256, _SIGN, dtype=np.int32)
    table[128:] = _WIDE
    table[ord("0") : ord("9") + 1] = _DIGIT
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    table[[9, 10, 11, 12, 13, 32]] = 0
    for c in ",;:?\"'()[]{}":  # punctuation that parts words
        table[ord(c)] = 0
    return table


_CLASS = _byte_classes()
_KINDS = bytes(_CLASS.astype(np.uint8))


def gram_counts(text: bytes) -> np.ndarray:
    """How often each four classes follow each other; words stand alone, with three
    edges before each."""
    kinds = _CLASS[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    kinds = kinds[(kinds != 0) | (np.append(kinds[1:], 1) != 0)]  # one edge for each run of them
    kinds = np.repeat(kinds, np.where(kinds == 0, 3, 1))
    if len(kinds) < 4:
        return np.zeros(_CONTEXTS * CLASSES, dtype=np.int64)
    code = ((kinds[:-3] * CLASSES + kinds[1:-2]) * CLASSES + kinds[2:-1]) * CLASSES + kinds[3:]
    return np.bincount(code, minlength=_CONTEXTS * CLASSES)


def count_grams(docs: DataFrame) -> DataFrame:
    """``(gram, n)`` over all texts: each task adds up its own, Spark adds up the tasks.
    There are at most 810,000 grams, whatever the size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CONTEXTS * CLASSES, dtype=np.int64)
        for batch in slices(batches, "text"):
            total += gram_counts("\n".join(t for t in batch.column("text").to_pylist() if t).lower().encode())
        gram = np.flatnonzero(total)
        for at in range(0, len(gram), 10000):
            part = gram[at : at + 10000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], names=["gram", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(gram: np.ndarray, n: np.ndarray) -> array:
    """Negative logarithms of the chance of each class after three others, smoothed by
    Witten and Bell: orders are mixed by how many classes were seen after a context."""
    counts = np.zeros(_CONTEXTS * CLASSES)
    counts[gram] = n
    lower = np.full((1, CLASSES), 1 / CLASSES)
    for order in range(4):
        seen = counts.reshape(-1, CLASSES**order, CLASSES).sum(axis=0)
        kinds = (seen > 0).sum(axis=1, keepdims=True)
        total = seen.sum(axis=1, keepdims=True)
        back = np.tile(lower, (len(seen) // len(lower), 1))
        lower = np.where(total > 0, (seen + kinds * back) / np.maximum(total + kinds, 1), back)
    return array("d", (-np.log(lower)).ravel().tobytes())


def _readings() -> list[list[tuple[int, int, float]]]:
    """For each byte: what may have been meant, as (byte or -1 for nothing, class, cost)."""
    table = [[(b, int(_CLASS[b]), 0.0)] for b in range(256)]
    for sign, letters in LEET.items():
        cost = COSTS["leet"] + math.log(len(letters))
        table[ord(sign)] += [(ord(c), int(_CLASS[ord(c)]), cost) for c in letters]
    for joint in JOINTS:
        if joint != " ":
            table[ord(joint)].append((32, 0, COSTS["end"]))
        table[ord(joint)].append((-1, 0, COSTS["joint"]))
    return table


_READINGS = _readings()
_ONCE = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789@$!|+(<")


def viterbi(observed: bytes, model: array) -> bytes:
    """The reading of least cost; of equal ones the first found.

    A state is the last three classes meant, so the work grows with the length.  Where all
    readings have led to one state, what was meant so far is settled."""
    out = bytearray()
    states: dict[int, tuple] = {0: (0.0, None)}
    before, repeats = -1, 0
    for b in observed:
        readings = _READINGS[b]
        repeats = repeats + 1 if b == before and b in _ONCE else 0
        before = b
        if len(states) == 1:
            ((context, (_, path)),) = states.items()
            if path is not None:
                out += _spelled(path)
            if not repeats and len(readings) == 1:  # nothing to choose
                meant, kind, _ = readings[0]
                out.append(meant)
                states = {(context * CLASSES + kind) % _CONTEXTS if kind else 0: (0.0, None)}
                continue
            states = {context: (0.0, None)}
        new: dict[int, tuple] = {}
        for context, (cost, path) in states.items():
            for meant, kind, extra in readings:
                if meant < 0:
                    to, value, link = context, cost + extra, path
                elif kind:
                    value = cost + extra + model[context * CLASSES + kind]
                    to, link = (context * CLASSES + kind) % _CONTEXTS, (path, meant)
                else:  # a word ends, if there is one
                    value = cost + extra + (model[context * CLASSES] if context else 0.0)
                    to, link = 0, (path, meant)
                if to not in new or value < new[to][0]:
                    new[to] = (value, link)
            if repeats:
                value = cost + COSTS["second" if repeats == 1 else "more"]
                if context not in new or value < new[context][0]:
                    new[context] = (value, path)
        states = new
    ends = [(cost + (model[context * CLASSES] if context else 0.0), path) for context, (cost, path) in states.items()]
    return bytes(out + _spelled(min(ends, key=lambda e: e[0])[1]))


def _spelled(path: tuple | None) -> bytearray:
    out = bytearray()
    while path is not None:
        path, meant = path
        out.append(meant)
    out.reverse()
    return out


def one_double(observed: bytes, at: int, model: array) -> bytes:
    """As ``viterbi``, for a token whose only doubt is the letter at ``at`` that stands
    twice: the two readings cost the same again three classes later."""
    kinds = b"\0\0\0" + observed.translate(_KINDS) + b"\0"
    context = (kinds[at + 1] * CLASSES + kinds[at + 2]) * CLASSES + kinds[at + 3]
    other = (context * CLASSES + kinds[at + 4]) % _CONTEXTS
    more = model[context * CLASSES + kinds[at + 4]] - COSTS["second"]
    for kind in kinds[at + 5 : at + 8]:
        more += model[other * CLASSES + kind] - model[context * CLASSES + kind]
        if not kind:  # a word ends
            break
        context, other = (context * CLASSES + kind) % _CONTEXTS, (other * CLASSES + kind) % _CONTEXTS
    return observed if more <= 0 else observed[:at] + observed[at + 1 :]


class _Cache(dict):
    """Results by token, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        self[token] = got = self.make(token)
        return got


class Decoder:
    """Restores texts; remembers the tokens it has seen, a bounded number of them
    besides those of one text."""

    def __init__(self, model: array):
        self.model = model
        self.restored = _Cache(self._restore)
        self.spelled = _Cache(lambda token: tuple(_WORD.findall(self.restored[token])))

    def _restore(self, token: str) -> str:
        doubt = _DOUBTFUL.search(token)
        if doubt is None and " " not in token:
            return token
        core = token.rstrip(_SIGNS)
        if len(token) - len(core) < 2:
            core = token.rstrip(_MARKS)
        if core and core != token:  # punctuation, or a row of signs as decoration
            return self.restored[core] + token[len(core) :]
        if doubt and doubt[1] and not _ELSE.search(token, doubt.end() - 1):
            at = len(token[: doubt.start()].encode())
            return one_double(token.encode(), at, self.model).decode()
        return viterbi(token.encode(), self.model).decode()

    def _tokens(self, text: str) -> list[str]:
        """Tokens to be restored: runs of single characters, and what white space parts."""
        text = text.lower()
        if not text.isascii():
            text = _HIDDEN.sub("", text)
        out, at = [], 0
        for run in _SPACED.finditer(text):
            out += text[at : run.start()].split()
            out.append(" ".join(run[0].split()))
            at = run.end()
        out += text[at:].split()
        if len(self.restored) > _CACHED:
            self.restored.clear()
            self.spelled.clear()
        return out

    def tokens(self, text: str | None) -> list[str]:
        """The restored tokens of a text, in order, in small letters."""
        return [self.restored[t] for t in self._tokens(text)] if text else []

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text."""
        if not text:
            return set()
        return set(chain.from_iterable(map(self.spelled.__getitem__, set(self._tokens(text)))))


def learn_language(docs: DataFrame) -> array:
    """The character model of all texts of ``docs``."""
    rows = staged(count_grams(docs), "grams").toArrow()  # bounded by the classes
    return language_model(rows["gram"].to_numpy(), rows["n"].to_numpy())


def restore(docs: DataFrame, model: array | None = None, name: str = "restored") -> DataFrame:
    """All rows and columns of ``docs`` with the restored text, tokens parted by one
    space; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn_language(docs))
    schema = docs.withColumn(name, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in slices(batches, "text"):
            out = [None if t is None else " ".join(decoder.tokens(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


@dataclass
class Model:
    language: array
    weights: dict[str, float]
    intercept: float

    def score(self, words: set[str]) -> float:
        z = self.intercept + math.fsum(self.weights[w] for w in words & self.weights.keys())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, n_columns: int, l1: float, rounds: int = 400):
    """Weights and intercept of a logistic regression with an absolute penalty, by
    accelerated proximal gradient steps.  ``rows, columns``: where a word occurs."""
    w, b = np.zeros(n_columns), 0.0
    if not len(labels):
        return w, b
    rate = float(labels.mean())
    b = math.log((rate + 1e-3) / (1 - rate + 1e-3))
    # A bound of the curvature: the largest number of words, by rows and columns.
    per_row = np.bincount(rows, minlength=len(labels)) + 1
    by_column = np.bincount(columns, weights=per_row[rows], minlength=n_columns) if n_columns else np.zeros(1)
    step = 4 * len(labels) / max(float(by_column.max(initial=0)), float(per_row.sum()))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        z = np.bincount(rows, weights=v[columns], minlength=len(labels)) + c
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / len(labels)
        slope = np.bincount(columns, weights=error[rows], minlength=n_columns)
        to = v - step * slope
        to = np.sign(to) * np.maximum(np.abs(to) - step * l1, 0)
        to_b = c - step * error.sum()
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = to + (t - 1) / s * (to - w), to_b + (t - 1) / s * (to_b - b)
        if np.dot(v - to, to - w) + (c - to_b) * (to_b - b) < 0:  # overshot: start anew
            v, c, s = to.copy(), to_b, 1.0
        w, b, t = to, to_b, s
    return w, b


def fit_relaxed(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, n_columns: int, l1: float):
    """Choose words by ``fit``, then fit those again with a tenth of the penalty, which
    would else keep the weights of words that matter too small."""
    w, b = fit(rows, columns, labels, n_columns, l1)
    kept = np.flatnonzero(w)
    among = np.full(n_columns, -1)
    among[kept] = np.arange(len(kept))
    use = among[columns] >= 0
    w[kept], b = fit(rows[use], among[columns[use]], labels, len(kept), l1 / 10)
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, max_train: int = 12000, max_words: int = 20000, least: int = 3, l1: float = 1e-3) -> Model:
    """Learn the language from all texts, and toxicity from at most ``max_train`` labelled
    documents outside the held-out fold, chosen by a hash of their id.  Words of fewer than
    ``least`` training texts, and beyond the ``max_words`` that differ most between the
    classes, are no features."""
    language = learn_language(docs)
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
        .where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id", 2, 4))
        .groupBy("_id")
        .agg(F.avg(F.col("_y").cast("double")).alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_train)
    )
    # At most max_train rows of two numbers are broadcast; equal texts are one row.
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "_id")
        .groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("_same"))
        .agg(F.avg("_y").alias("label"), F.min("text").alias("text"))
        .select(F.xxhash64("_same").alias("_key"), "label", "text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(language)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in slices(batches, "text"):
            for key, label, text in zip(*(batch.column(c).to_pylist() for c in ("_key", "label", "text")), strict=True):
                found = sorted(decoder.words(text)) or [""]
                for at in range(0, len(found), 10000):
                    part = found[at : at + 10000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(part), pa.int64()), pa.array([label] * len(part), pa.float64()), pa.array(part)],
                        names=["_key", "label", "word"],
                    )

    seen = staged(rows.mapInArrow(words, "_key long, label double, word string"), "toxic-words")
    texts = seen.groupBy("_key").agg(F.first("label")).toArrow().to_pydict()  # max_train rows at most
    y = dict(sorted(zip(*texts.values(), strict=True)))
    rate = sum(y.values()) / len(y) if y else 0.5
    features = (
        seen.where("word != ''")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
        .where(F.col("n") >= least)
        .orderBy(F.abs(F.col("hits") - F.col("n") * rate) / F.sqrt("n"), "word", ascending=[False, True])
        .limit(max_words)
    )
    names = sorted(features.select("word").toArrow()["word"].to_pylist())
    numbers = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "word string, _column int")
    # max_words short rows are broadcast; what comes back are two numbers for each pair.
    pairs = seen.join(F.broadcast(numbers), "word").select("_key", "_column").toArrow()
    rows = np.searchsorted(np.array(list(y), dtype=np.int64), pairs["_key"].to_numpy())
    weights, intercept = fit_relaxed(rows, pairs["_column"].to_numpy(), np.array(list(y.values())), len(names), l1)
    return Model(language, {w: float(x) for w, x in zip(names, weights, strict=True) if x}, intercept)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the score of their restored text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        decoder = Decoder(model.language)
        for batch in slices(batches, "text"):
            values = [model.score(decoder.words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Score and decide: ``doc_id, held_out, score, predicted``."""
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), learn(docs, labels, **options))
    return scored.select(
        "doc_id", held_out("doc_id", 2, 4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents whose score is below ``threshold``, with their own columns."""
    name = pick(docs.columns, "_score")
    return score(docs, learn(docs, labels, **options), name).where(F.col(name) < threshold).drop(name)
