"""A text quality score by the votes of nearest labelled neighbours.

Texts become bags of terms (trigrams of character classes, and whether a word repeats
one shortly before it), weighted by inverse document frequency and projected to a
latent space by a truncated singular value decomposition of the labelled texts.  The
labelled vectors are broadcast: their number is bounded by ``max_train``.  For every
document the exact cosines with all of them are computed in blocks, and the labels of
the ``k`` nearest are averaged with the similarities as weights.

Cases: a null or empty text has no term, so its score is the mean label of the training
rows, and 0.5 if there are none; a doc with a null ``doc_id`` counts as held out; several
labels of one document count as their mean, null labels not at all; a repeated document
is learnt from once; neighbours as near as the k-th all vote; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import pick, slices
from martflow.llm.words import words_of

FEATURES = 2048
_BACK = (1, 2, 3, 4)  # distances at which repeated words are counted
_WIDTH = FEATURES + 2 * len(_BACK)
_STOP = 63


def _byte_classes() -> np.ndarray:
    table = np.full(256, 1, dtype=np.int32)  # letters beyond ASCII count as small ones
    for b in range(128):
        c = chr(b)
        table[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == " " else 5 if c in "\n\r" else 6
    for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        table[ord(c)] = 7 + i
    return table


_CLASS = _byte_classes()
_FOLD = np.random.Generator(np.random.PCG64(11)).integers(0, FEATURES, size=64**3)
_DECODED_PART = 1 << 20


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of each term in each text."""
    out = np.zeros((len(texts), _WIDTH))
    for i, text in enumerate(texts):  # very long texts alone, in parts
        if text and len(text) > _DECODED_PART:
            for at in range(0, len(text), _DECODED_PART):
                out[i, :FEATURES] += _trigrams([text[at : at + _DECODED_PART + 2]])[0]
    short = [i for i, t in enumerate(texts) if t and len(t) <= _DECODED_PART]
    if short:
        out[short, :FEATURES] += _trigrams([texts[i] for i in short])
    words = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), words.counts)
    for k, back in enumerate(_BACK):
        if words.hashes.shape[1] > back:
            same_text = owner[back:] == owner[:-back]
            again = words.hashes[0, back:] == words.hashes[0, :-back]
            for kind, hit in enumerate((again & same_text, ~again & same_text)):
                out[:, FEATURES + 2 * k + kind] = np.bincount(owner[back:][hit], minlength=len(texts))
    return out


def _trigrams(texts: list[str]) -> np.ndarray:
    blobs = [t.encode() + b"\0\0" for t in texts]
    kinds = _CLASS[np.frombuffer(b"".join(blobs), dtype=np.uint8)]
    sizes = np.array([len(b) for b in blobs])
    ends = np.cumsum(sizes)
    kinds[ends - 1] = kinds[ends - 2] = _STOP
    term = _FOLD[(kinds[:-2] << 12) | (kinds[1:-1] << 6) | kinds[2:]]
    owner = np.repeat(np.arange(len(texts)), sizes)[:-2]
    return np.bincount(owner * FEATURES + term, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)


@dataclass
class Model:
    weight: np.ndarray  # inverse document frequency of each term
    axes: np.ndarray  # terms x latent dimensions
    vectors: np.ndarray  # labelled texts x latent dimensions, of length one
    labels: np.ndarray
    prior: float
    k: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = _relative(counts) * self.weight @ self.axes
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)

    def score(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled texts."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        latent = self.latent(counts)
        k = min(self.k, len(self.labels))
        for at in range(0, len(counts), block):
            cosine = latent[at : at + block] @ self.vectors.T
            least = np.partition(cosine, -k, axis=1)[:, -k][:, None]
            votes = np.where(cosine >= least, np.maximum(cosine, 0), 0)
            total = votes.sum(axis=1)
            np.divide(votes @ self.labels, total, out=out[at : at + block], where=total > 0)
        return np.clip(out, 0, 1)


def _relative(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares within the trigrams and within each distance."""
    out = np.empty_like(counts)
    cuts = [0, *range(FEATURES, _WIDTH + 1, 2)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        total = counts[:, a:b].sum(axis=1, keepdims=True)
        out[:, a:b] = np.sqrt(np.divide(counts[:, a:b], total, out=np.zeros_like(out[:, a:b]), where=total > 0))
    return out


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = 48, k: int = 25) -> Model:
    """Learn the latent space and keep the labelled vectors."""
    if not len(labels):
        return Model(np.ones(_WIDTH), np.zeros((_WIDTH, 1)), np.zeros((0, 1)), labels, 0.5, k)
    weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.2
    weight = weight.astype(counts.dtype)  # the driver holds the training rows in single precision
    x = _relative(counts)
    x *= weight
    rng = np.random.Generator(np.random.PCG64(5))
    start = rng.standard_normal((_WIDTH, min(dimensions + 10, *x.shape))).astype(x.dtype)
    q = np.linalg.qr(x @ start)[0]
    for _ in range(4):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dimensions].T
    model = Model(weight, axes, np.zeros((0, 1)), labels, float(labels.mean()), k)
    model.vectors = model.latent(counts)
    return model


def held_out(doc_id, fold: int = 0, folds: int = 5):
    """Whether a row belongs to the fold that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = 4000, **options) -> Model:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold, chosen
    by a hash of their id.  Only their term counts come to the driver."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q"))
        .where(F.col("_q").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.avg(F.col("_q").cast("double")).alias("_q"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_train)
    )
    # The chosen labels are at most max_train rows of two numbers.
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id")
        .agg(F.first("_q").alias("label"), F.min("_text").alias("text"))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = term_counts(batch.column("text").to_pylist())
            where = [np.flatnonzero(row) for row in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("label"),
                    pa.array([w.astype("<u2").tobytes() for w in where], type=pa.binary()),
                    pa.array([row[w].astype("<f4").tobytes() for row, w in zip(found, where, strict=True)], type=pa.binary()),
                ],
                names=["_id", "label", "terms", "counts"],
            )

    got = rows.mapInArrow(count, "_id long, label double, terms binary, counts binary").collect()
    got.sort(key=lambda r: r["_id"])
    counts = np.zeros((len(got), _WIDTH), dtype=np.float32)
    for row, r in zip(counts, got, strict=True):
        row[np.frombuffer(r["terms"], dtype="<u2")] = np.frombuffer(r["counts"], dtype="<f4")
    return fit(counts, np.array([r["label"] for r in got]), **options)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the score of their text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = shared.value.score(term_counts(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Score and decide: ``doc_id, held_out, score, predicted``."""
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), learn(docs, labels, **options))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents whose score is ``threshold`` or more, with their own columns."""
    name = pick(docs.columns, "_score")
    return score(docs, learn(docs, labels, **options), name).where(F.col(name) >= threshold).drop(name)
