"""Joining documents by the Jaccard similarity of their word 5-grams, with Bayesian
pruning of candidates.

1. Equal texts become one class, with the smallest ``doc_id`` and a number of rows.
2. Each text gets a MinHash signature, cut into bands; texts with an equal band are
   candidates.  The classes that candidates connect form groups.
3. A group is compared in blocks of at most ``2 * BLOCK`` texts, so a group of any size
   is many tasks.  Candidate pairs are compared by ``STEP`` MinHash values at a time and
   dropped once the posterior probability that their similarity reaches the threshold
   falls below ``tolerance`` (uniform prior).  The rest are verified exactly, on the
   words themselves.
4. A block returns link counts and a spanning forest of its links, not pairs.

A pair at the threshold itself has no equal band with probability 7e-5, and less above.

Cases: a text of one to four words has one shingle, all of them; a text without words
(null, empty, blank) links with nothing; a null ``doc_id`` counts as smaller than any
other; rows that repeat a ``doc_id`` and a text are the same document and stay or go
together; an empty table gives no row.  Other columns are ignored by ``links`` and kept
by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import slices, staged
from martflow.llm.graph import components, fewer
from martflow.llm.words import mix, runs, within, words_of
from martflow.session import plan_unions_safely

WORDS = 5
BANDS, ROWS = 24, 5
VALUES = BANDS * ROWS
STEP = 24
BLOCK = 192
_LOWEST = -(1 << 63)
_RNG = np.random.Generator(np.random.PCG64(42))
_FACTOR = _RNG.integers(1, 1 << 63, size=VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, size=VALUES, dtype=np.uint64)


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats) of all texts, and their number per text."""
    words = words_of(texts)
    counts = words.counts
    long = runs(words.hashes, WORDS)[within(counts, WORDS)]
    per_text = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(per_text.sum()), dtype=np.uint64)
    place = np.cumsum(per_text) - per_text
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    whole = np.ones(len(out), dtype=bool)
    whole[place[short]] = False
    out[whole] = long
    for i in short:
        own = words.hashes[:, words.offsets[i] : words.offsets[i + 1]]
        out[place[i]] = mix(runs(own, int(counts[i])) + np.uint64(counts[i]))[0]
    return out, per_text


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values of each text (32 bits each), and its number of shingles."""
    hashes, counts = shingle_hashes(texts)
    out = np.zeros((len(texts), VALUES), dtype=np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for k in range(VALUES):
            out[some, k] = np.minimum.reduceat(hashes * _FACTOR[k] + _SHIFT[k], starts) >> np.uint64(32)
    return out, counts


def band_hashes(values: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band of each signature, different between bands."""
    parts = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), BANDS)).copy()
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def least_matches(threshold: Fraction, tolerance: float) -> dict[int, int]:
    """For each number of MinHash values compared, the fewest equal ones with which a
    pair goes on: the posterior tail of the beta distribution, as a binomial sum."""
    t = float(threshold)
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            # P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m)
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def shingle_ids(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers that are equal only for equal words."""
    known: dict[bytes, int] = {}
    lists = [np.array([known.setdefault(w, len(known)) for w in t.encode().split()], dtype=np.int64) for t in texts]
    sizes = np.array([len(x) for x in lists])
    words = np.concatenate(lists) if lists else np.empty(0, dtype=np.int64)
    if len(words) < WORDS:
        number = np.empty(0, dtype=np.int64)
    else:
        two = np.unique((words[:-1] << 32) | words[1:], return_inverse=True)[1]
        four = np.unique((two[:-2] << 32) | two[2:], return_inverse=True)[1]
        number = np.unique((four[:-1] << 32) | words[4:], return_inverse=True)[1]
    short: dict[tuple, int] = {}
    out, at = [], 0
    for own, n in zip(lists, sizes.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(number[at : at + n - WORDS + 1]))
        elif n:
            out.append(np.array([len(words) + short.setdefault(tuple(own.tolist()), len(short))]))
        else:
            out.append(np.empty(0, dtype=np.int64))
        at += n
    return out


def verified(pairs: np.ndarray, texts: list[str], threshold: Fraction) -> np.ndarray:
    """Which of the pairs (rows of two indexes) reach the threshold exactly."""
    used, inverse = np.unique(pairs, return_inverse=True)
    inverse = inverse.reshape(pairs.shape)
    sets = shingle_ids([texts[i] for i in used])
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    start = np.cumsum(sizes) - sizes
    mark = np.zeros(int(flat.max()) + 1, dtype=bool)
    out = np.zeros(len(pairs), dtype=bool)
    order = np.argsort(inverse[:, 0], kind="stable")
    cuts = np.flatnonzero(np.diff(inverse[order, 0])) + 1
    for own in np.split(order, cuts):
        a, others = inverse[own[0], 0], inverse[own, 1]
        mark[sets[a]] = True
        for at in range(0, len(others), 64):
            part = others[at : at + 64]
            n = sizes[part]
            where = np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            common = np.add.reduceat(mark[flat[where]].astype(np.int64), np.cumsum(n) - n)
            union = sizes[a] + n - common
            out[own[at : at + 64]] = common * threshold.denominator >= union * threshold.numerator
        mark[sets[a]] = False
    return out


def block_links(values: np.ndarray, bands: np.ndarray, texts: list[str], pairs_of: np.ndarray, threshold: Fraction, least: dict[int, int]) -> np.ndarray:
    """The linked pairs among those that ``pairs_of`` (a matrix of booleans) allows."""
    candidate = np.zeros_like(pairs_of)
    for k in range(bands.shape[1]):
        candidate |= bands[:, k][:, None] == bands[:, k][None, :]
    a, b = np.nonzero(candidate & pairs_of)
    equal = np.zeros(len(a), dtype=np.int64)
    for n, fewest in least.items():
        equal += (values[a, n - STEP : n] == values[b, n - STEP : n]).sum(axis=1)
        on = equal >= fewest
        a, b, equal = a[on], b[on], equal[on]
    pairs = np.stack((a, b), axis=1)
    return pairs[verified(pairs, texts, threshold)] if len(pairs) else pairs


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of ``n`` items the smallest item it is connected with by the pairs."""
    root = np.arange(n)
    while len(pairs):
        before = root.copy()
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        root = root[root]
        if (root == before).all():
            break
    return root


_SIGNED = pa.schema([("_id", pa.int64()), ("_key", pa.binary()), ("_values", pa.binary()), ("_bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        values, counts = signatures(batch.column("_text").to_pylist())
        keys = batch.column("_key").to_pylist()
        bands = band_hashes(values).view(np.int64)
        some = counts > 0
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                pa.array([k if s else None for k, s in zip(keys, some, strict=True)], type=pa.binary()),
                pa.array([v.tobytes() if s else None for v, s in zip(values, some, strict=True)], type=pa.binary()),
                pa.array([v.tolist() if s else None for v, s in zip(bands, some, strict=True)], type=pa.list_(pa.int64())),
            ],
            schema=_SIGNED,
        )


def links(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id`` (smallest ``doc_id`` with
    the same text), ``n_links`` (other documents linked), ``component_id`` (smallest
    ``doc_id`` reachable by links), ``kept`` (whether that is its own), ``_key`` (digest
    of the text)."""
    spark = docs.sparkSession
    plan_unions_safely(spark)
    exact = Fraction(str(threshold))
    least = least_matches(exact, tolerance)
    rows = keyed(docs)
    signed = staged(rows.select("_id", "_text", "_key").mapInArrow(_sign, "_id long, _key binary, _values binary, _bands array<long>"), "signed")
    classes = staged(
        signed.where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.first("_values").alias("_values"), F.first("_bands").alias("_bands"))
        .withColumn("_node", F.monotonically_increasing_id()),
        "classes",
    )
    # Groups of candidates: each text is tied to the smallest of its bucket.
    bands = classes.select("_node", F.explode("_bands").alias("_band"))
    buckets = staged(
        bands.groupBy("_band").agg(F.min("_node").alias("_b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_band", "_b"),
        "buckets",
    )
    # At most one tie for each band of a text.
    ties = bands.join(buckets, "_band").where(F.col("_node") != F.col("_b")).select(F.col("_node").alias("_a"), "_b")
    groups = components(fewer(ties), "candidates")
    sizes = groups.groupBy("_root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    members = staged(
        groups.join(staged(sizes, "sizes"), "_root")
        .join(classes, "_node")
        .select("_node", "_root", "_blocks", "_key", "_first", "_rows", "_values", "_bands"),
        "members",
    )
    # A text goes once to each pair of blocks that its own block is in.
    sent = (
        rows.join(members, (rows["_key"] == members["_key"]) & (rows["_id"] == members["_first"]))
        .select("_node", "_root", "_blocks", "_rows", "_values", "_bands", "_text", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int").alias("_block"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_low", F.least("_block", "_other"))
        .withColumn("_high", F.greatest("_block", "_other"))
        .select("_node", "_root", "_rows", "_values", "_bands", "_text", "_block", "_low", "_high")
    )

    def compare(rows: pa.Table) -> pa.Table:
        nodes = rows.column("_node").to_numpy()
        _, first = np.unique(nodes, return_index=True)  # a repeated row counts once
        rows = rows.take(pa.array(first))
        nodes, weight, block = (rows.column(c).to_numpy() for c in ("_node", "_rows", "_block"))
        values = np.frombuffer(b"".join(rows.column("_values").to_pylist()), dtype=np.uint32).reshape(len(nodes), VALUES)
        bands = np.array(rows.column("_bands").to_pylist(), dtype=np.int64)
        low, high = rows.column("_low")[0].as_py(), rows.column("_high")[0].as_py()
        allowed = np.triu(np.ones((len(nodes), len(nodes)), dtype=bool), 1)
        if low != high:
            allowed &= block[:, None] != block[None, :]
        pairs = block_links(values, bands, rows.column("_text").to_pylist(), allowed, exact, least)
        count = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(count, pairs[:, 0], weight[pairs[:, 1]])
        np.add.at(count, pairs[:, 1], weight[pairs[:, 0]])
        root = forest(len(nodes), pairs)
        some = count > 0
        return pa.table({"_a": nodes[some], "_n": count[some], "_b": nodes[root[some]]})

    found = staged(sent.groupBy("_root", "_low", "_high").applyInArrow(compare, "_a long, _n long, _b long"), "found")
    counts = found.groupBy(F.col("_a").alias("_node")).agg(F.sum("_n").alias("_n"))
    roots = components(fewer(found.where("_a != _b")), "links")
    named = roots.join(classes.select("_node", "_first"), "_node")
    names = staged(named.groupBy("_root").agg(F.min("_first").alias("_component")), "names")
    linked = staged(
        counts.join(roots, "_node").join(names, "_root").select(F.col("_node").alias("_linked"), "_n", "_component"), "linked"
    )
    per_class = staged(
        classes.join(linked, F.col("_node") == F.col("_linked"), "left").select(
            F.col("_key").alias("_class_key"),
            "_first",
            (F.coalesce("_n", F.lit(0)) + F.col("_rows") - 1).alias("_n"),
            F.coalesce("_component", F.col("_first")).alias("_component"),
        ),
        "per_class",
    )
    null_or = lambda c: F.when(c != _LOWEST, c)
    every = signed.select("_id", "_key").join(per_class, F.col("_key") == F.col("_class_key"), "left")
    component = F.coalesce("_component", F.col("_id"))
    return every.select(
        null_or(F.col("_id")).alias("doc_id"),
        null_or(F.coalesce("_first", F.col("_id"))).alias("class_id"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        null_or(component).alias("component_id"),
        (F.col("_id") == component).alias("kept"),
        "_key",
    )


def keyed(docs: DataFrame) -> DataFrame:
    """Id, text and digest of the text, and the document's columns in a struct."""
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("_id"),
        text.alias("_text"),
        F.unhex(F.sha2(text, 256)).alias("_key"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents without those that are linked, over any number of links, with a
    document of smaller ``doc_id``."""
    gone = staged(
        links(docs, threshold)
        .where(~F.col("kept"))
        .select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("_gone"), F.col("_key").alias("_gone_key"))
        .distinct(),
        "gone",
    )
    rows = keyed(docs)
    stay = rows.join(gone, (F.col("_id") == F.col("_gone")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    return stay.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
