"""Packing documents into sequences of a fixed window, by non-negative least squares.

A document longer than the window fills whole sequences; what remains of it has one of
``window`` lengths, so the remainders of any number of documents are one histogram of
that size.  Combinations of two to ``DEPTH`` lengths that fill the window exactly are
enumerated: all of a small window, a fixed draw of ``COLUMNS`` from a large one, where
all would be hundreds of millions and their counts fractions of one.  Their repeat
counts are the non-negative least-squares solution against the histogram, rounded so
that no length is used more often than it occurs; further rounds do the same with what
is left.  The rest is laid end to end in order of length and cut at window borders, so
only the last sequence of all can be short.

Cases: a null text is an empty one (its only id is the end id), and so is a text with
no ids; rows that repeat a ``doc_id`` are packed each; a null ``doc_id`` stays null;
an empty table gives no piece.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martflow.llm.common import slices, staged
from martflow.llm.tokens import encoder

ENCODED = "doc_id long, part int, rest int, rank long, fulls long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


DEPTH = 4
COLUMNS = 4000
ROUNDS = 24


def combinations(histogram: np.ndarray, seed: int = 0, limit: int = COLUMNS) -> np.ndarray:
    """Combinations of lengths that occur and fill the window exactly, as rows of
    ``DEPTH`` numbers, longest first; 0 stands for none.  ``histogram[n]``: pieces of
    length n.  All of them, or if they are more than ``limit``, about as many drawn in
    proportion to the pieces."""
    window = len(histogram)
    have = np.flatnonzero(histogram[1:]) + 1
    if not len(have):
        return np.empty((0, DEPTH), dtype=np.int64)
    if len(have) ** (DEPTH - 1) <= 20 * limit:
        first = np.stack(np.meshgrid(*[np.append(have, 0)] * (DEPTH - 1), indexing="ij"), axis=-1).reshape(-1, DEPTH - 1)
    else:
        rng = np.random.Generator(np.random.PCG64(seed))
        share = histogram[have] / histogram[have].sum()
        first = rng.choice(have, p=share, size=(2 * limit, DEPTH - 1))
        for depth in range(1, DEPTH - 1):  # as many of each depth
            first[depth - 1 :: DEPTH - 1, depth:] = 0
    last = window - first.sum(axis=1)
    fits = (last > 0) & (histogram[np.clip(last, 0, window - 1)] > 0) & (last < window)
    rows = np.concatenate((first[fits], last[fits, None]), axis=1)
    return np.unique(-np.sort(-rows, axis=1), axis=0)


def repeat_counts(lengths: np.ndarray, histogram: np.ndarray, steps: int = 150) -> np.ndarray:
    """Whole, feasible repeat counts of each combination: accelerated projected
    gradients for the least-squares problem with counts of zero or more, then rounding
    down after shrinking every combination to its scarcest length."""
    if not len(lengths):
        return np.empty(0, dtype=np.int64)
    window, flat = len(histogram), lengths.ravel()
    scale = float(histogram.max())
    target = histogram / scale
    weight = (flat > 0).astype(float)

    def made(x):
        return np.bincount(flat, np.repeat(x, lengths.shape[1]) * weight, minlength=window)

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[lengths].sum(axis=1)

    v = np.ones(len(lengths))
    for _ in range(12):
        v = back(made(v))
        v /= np.linalg.norm(v)
    top = float(np.linalg.norm(back(made(v)))) * 1.02
    x = y = np.zeros(len(lengths))
    t = 1.0
    for _ in range(steps):
        x_new = np.maximum(0, y - back(made(y) - target) / top)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = x_new + (t - 1) / t_new * (x_new - x)
        x, t = x_new, t_new
    used = made(x)
    ratio = np.ones(window)
    np.divide(target, used, out=ratio, where=used > target)
    ratio[0] = 1
    return np.floor(x * ratio[lengths].min(axis=1) * scale + 1e-9).astype(np.int64)


@dataclass
class Plan:
    """Where the pieces of each length go, by their rank among the pieces of it."""

    window: int
    first: np.ndarray  # segments of length n: first[n] to first[n + 1]
    rank: np.ndarray  # first rank of each segment
    sequence: np.ndarray  # sequence of that rank; the following ranks follow
    offset: np.ndarray
    left_rank: np.ndarray  # for each length: ranks from here on are laid end to end
    left_start: np.ndarray  # place of the first of them in the row of all
    packed: int  # sequences filled by combinations
    sequences: int  # and with those laid end to end
    padding: int


def make_plan(histogram: np.ndarray, rounds: int = ROUNDS) -> Plan:
    """Solve, round and lay out a histogram of remainders.  Its work depends on the
    window only."""
    window = len(histogram)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros(window, dtype=np.int64)
    lengths_of, ranks, sequences, offsets = [], [], [], []
    packed = 0
    for turn in range(rounds):
        before = packed
        combos = combinations(left, turn)
        counts = repeat_counts(combos, left)
        some = counts > 0
        for combo, n in zip(combos[some].tolist(), counts[some].tolist(), strict=True):
            n = min([n, *(left[x] // combo.count(x) for x in set(combo) if x)])
            if n <= 0:
                continue
            at = 0
            for x in combo:
                if x:
                    lengths_of.append(x)
                    ranks.append(int(taken[x]))
                    sequences.append(packed)
                    offsets.append(at)
                    taken[x] += n
                    left[x] -= n
                    at += x
            packed += n
        if packed - before <= packed // 200:
            break
    order = np.lexsort((ranks, lengths_of)) if ranks else np.empty(0, dtype=np.int64)
    lengths_arr = np.array(lengths_of, dtype=np.int64)[order]
    sizes = left * np.arange(window)
    total = int(sizes.sum())
    more = -(-total // window)
    return Plan(
        window,
        np.searchsorted(lengths_arr, np.arange(window + 1)),
        np.array(ranks, dtype=np.int64)[order],
        np.array(sequences, dtype=np.int64)[order],
        np.array(offsets, dtype=np.int64)[order],
        taken,
        np.cumsum(sizes) - sizes,
        packed,
        packed + more,
        more * window - total,
    )


def place(plan: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """Pieces of the remainder of this length and rank: start in the remainder, length,
    sequence, offset."""
    if rank < plan.left_rank[length]:
        a, b = plan.first[length], plan.first[length + 1]
        k = a + int(np.searchsorted(plan.rank[a:b], rank, side="right")) - 1
        return [(0, length, int(plan.sequence[k] + rank - plan.rank[k]), int(plan.offset[k]))]
    at = int(plan.left_start[length] + (rank - plan.left_rank[length]) * length)
    out, done = [], 0
    while done < length:
        n = min(length - done, plan.window - at % plan.window)
        out.append((done, n, plan.packed + at // plan.window, at % plan.window))
        done, at = done + n, at + n
    return out


def encode(docs: DataFrame, vocabulary: str, end_id: int, window: int, spaces: bool = True) -> DataFrame:
    """Ids of all documents, written out.  Every row knows its task, its rank among the
    task's remainders of the same length, and the full sequences of the task before it:
    ranking all remainders of a length needs no further sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, spaces)
        kind = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        part, seen, fulls = TaskContext.get().partitionId(), np.zeros(window, dtype=np.int64), 0
        for batch in slices(batches, "text"):
            ids, counts = enc.encode(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            data = np.insert(ids.astype(kind), ends, end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            rests = counts % window
            ranks = np.empty(len(counts), dtype=np.int64)
            for i, r in enumerate(rests.tolist()):
                ranks[i] = seen[r]
                seen[r] += 1
            whole = counts // window
            before = fulls + np.cumsum(whole) - whole
            fulls += int(whole.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(counts), part, dtype=np.int32)),
                    pa.array(rests.astype(np.int32)),
                    pa.array(ranks),
                    pa.array(before),
                    pa.array(counts),
                    pa.array([data[e - n : e].tobytes() for n, e in zip(counts, ends, strict=True)], type=pa.binary()),
                ],
                names=["doc_id", "part", "rest", "rank", "fulls", "n_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(run, ENCODED), "ids")


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = 2048, spaces: bool = True) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids`` (little-endian unsigned
    32-bit), ``doc_tokens, sequence_id, offset``.  Every id lies in one piece."""
    ids = encode(docs, vocabulary, end_id, window, spaces)
    groups = staged(
        ids.groupBy("part", "rest").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n_tokens") / window)).alias("fulls")
        ),
        "lengths",
    )
    # At most one row for each length below the window.
    histogram = np.zeros(window, dtype=np.int64)
    for row in groups.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[row["rest"]] = row["n"]
    plan = make_plan(histogram)
    by_part = groups.groupBy("part").agg(F.sum("fulls").alias("fulls"))
    first_full = by_part.select(  # one row for each task
        F.col("part").alias("_part"),
        (F.sum("fulls").over(Window.orderBy("part")) - F.col("fulls")).alias("_fulls"),
    )
    before = groups.select(
        F.col("part").alias("_part"),
        F.col("rest").alias("_rest"),
        (F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")).alias("_before"),
    )
    places = staged(before.join(first_full, "_part"), "places")
    joined = ids.join(places, (F.col("part") == F.col("_part")) & (F.col("rest") == F.col("_rest"))).select(
        "doc_id", "rest", (F.col("rank") + F.col("_before")).alias("rank"), (F.col("fulls") + F.col("_fulls")).alias("fulls"), "n_tokens", "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "rest", "rank", "fulls", "n_tokens", "ids")]
            for doc, rest, rank, fulls, n, blob in zip(*columns, strict=True):
                data = np.frombuffer(blob, dtype="<u2" if len(blob) == 2 * n else "<u4").astype("<u4").tobytes()
                whole = n - rest
                pieces = [(k * window, window, plan.sequences + fulls + k, 0) for k in range(whole // window)]
                if rest:
                    pieces += [(whole + s, m, q, o) for s, m, q, o in place(plan, rest, rank)]
                for s, m, q, o in pieces:
                    for k, v in zip(out, (doc, s, m, data[4 * s : 4 * (s + m)], n, q, o), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    return joined.mapInArrow(cut, PIECES)


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
