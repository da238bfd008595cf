"""Removing passages that occur earlier, by difference-cover anchors.

A window is ``width`` consecutive words of one document.  A word is removed if a window
that covers it has the same words as a window that starts earlier: in a document with a
smaller ``doc_id``, or earlier in the same one.  Windows are judged on the input.

Only the runs of ``width - period + 1`` words that start at positions of a difference
cover modulo ``period`` are looked up across documents: two equal windows always have
such a run at the same place inside them.  Runs found in more than one bucket of
documents mark the windows around them, and these windows alone are compared in full.

1. Documents are dealt to buckets by ``doc_id``; this exchange of texts is used by all
   steps.  Later copies of a whole text are only marked, by ``doc_id`` and the text's hash.
2. Each bucket names every anchor once, so a passage of a third of all documents is one
   row for each bucket.  Anchors of two or more buckets go back to their buckets.
3. Each bucket names every marked window once, at its first place.  All but the first
   place over all buckets go back.
4. Each bucket removes what those windows and its own repeats cover.

Cases: a null text stays null and has no words; a text of fewer words than ``width``
loses nothing; a null ``doc_id`` counts as smaller than any other; rows that repeat a
``doc_id`` are one document in order of their text, though no window spans two rows, so
of identical rows the first is kept; an empty table gives no row.  The words that stay
keep the white space after them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from martflow.llm.common import copies, pick, staged
from martflow.llm.words import bounds, runs, within, words_of
from martflow.session import plan_unions_safely

WIDTH = 20
# Every difference modulo 13 is one of two members of this set.
PERIOD, COVER = 13, (0, 1, 3, 9)
_BUCKET_BYTES = 2_000_000
_LOWEST = -(1 << 63)
_COPY, _ANCHOR, _LATER = 0, 1, 2
_SIDE = "_b int, _kind int, _id long, _at long"


def text_of(rows: pa.Table) -> list[str | None]:
    return pc.struct_field(rows.column("_row"), "text").to_pylist()


class Bucket:
    """The documents of a bucket in their order, and the words of those that are no
    copies of an earlier text."""

    def __init__(self, rows: pa.Table, side: pa.Table):
        ids = rows.column("_id").to_pylist()
        texts = text_of(rows)
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or ""))
        self.texts = [texts[i] for i in self.order]
        kind = side.column("_kind").to_numpy()
        self.side_id, self.side_at = side.column("_id").to_numpy(), side.column("_at").to_numpy()
        self.side = {k: kind == k for k in (_COPY, _ANCHOR, _LATER)}
        # A mark is for the rows of an id with this text, not for all rows of the id.
        marks = self.side[_COPY]
        later = set(zip(self.side_id[marks].tolist(), self.side_at[marks].tolist(), strict=True))
        self.ids = np.array([ids[i] for i in self.order], dtype=np.int64)
        digests = rows.column("_digest").to_pylist()
        self.copied = np.array([texts[i] is not None and (ids[i], digests[i]) in later for i in self.order], dtype=bool)
        words = words_of([None if c else t for c, t in zip(self.copied, self.texts, strict=True)])
        self.words, self.counts = words.hashes, words.counts
        self.offsets = words.offsets
        # Words before the first row of the same document.
        first_row = np.searchsorted(self.ids, self.ids)
        self.document = self.offsets[first_row] if len(self.ids) else np.zeros(0, dtype=np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors and their hashes."""
        at = within(self.counts, WIDTH - PERIOD + 1)
        row = np.repeat(np.arange(len(self.counts)), np.maximum(self.counts - (WIDTH - PERIOD), 0))
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        at = at[cover[(at - self.offsets[row]) % PERIOD]]
        # A document shorter than a window has nothing to find.
        row = np.searchsorted(self.offsets, at, side="right") - 1
        at = at[self.counts[row] >= WIDTH]
        return at, runs(self.words, WIDTH - PERIOD + 1)[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all windows and both their hashes."""
        at = within(self.counts, WIDTH)
        return at, runs(self.words, WIDTH, 0)[at], runs(self.words, WIDTH, 1)[at]


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number the distinct pairs: the first place of each, and each place's number."""
    order = np.lexsort((b, a)) if len(a) else np.empty(0, dtype=np.int64)
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    number = np.empty(len(a), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number  # the sort is stable, so the first of a group is its first place


def _cogroup(left: DataFrame, right: DataFrame, step, schema: str) -> DataFrame:
    return left.groupBy("_b").cogroup(right.groupBy("_b")).applyInArrow(step, schema)


def dedup(docs: DataFrame, removed_names: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the removed words cut out of ``text``, and two more columns: the
    words it had and the words removed (by default ``n_words`` and ``n_removed``, with
    underscores before them if ``docs`` has such columns already)."""
    spark = docs.sparkSession
    plan_unions_safely(spark)
    n_words, n_removed = removed_names or (pick(docs.columns, "n_words"), pick(docs.columns, "n_removed"))
    inner = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    text = F.col("text").cast("string")
    slim = staged(
        docs.select(
            inner.alias("_id"),
            F.when(F.length(text) > 0, F.unhex(F.sha2(text, 256))).alias("_key0"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"),
            F.xxhash64(text).alias("_digest"),
        ),
        "keys",
    )
    total = slim.agg(F.sum("_bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(-(-total // _BUCKET_BYTES), 4 * parts)
    bucket = F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int")
    same = copies(slim, F.col("_key0"), "_id", label="texts")
    later = staged(
        slim.join(same, F.col("_key0") == F.col("_key"))
        .where(F.col("_id") > F.col("_first"))
        .select(bucket.alias("_b"), F.lit(_COPY).alias("_kind"), "_id", F.col("_digest").alias("_at")),
        "later",
    )
    # The documents' own columns travel in one struct, so no name of theirs can clash.
    own = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("_row"), inner.alias("_id"), F.xxhash64(text).alias("_digest")).withColumn("_b", bucket)

    def name_anchors(rows: pa.Table, side: pa.Table) -> pa.Table:
        own = Bucket(rows, side)
        at, hashes = own.anchors()
        hashes, first = np.unique(hashes, return_index=True)
        b = rows.column("_b")[0].as_py() if rows.num_rows else 0
        return pa.table({"_hash": hashes.view(np.int64), "_place": (b << 32) + at[first]})

    def meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by hash, those whose hash another row has."""
        last_hash, last_place, last_told = None, 0, False
        for batch in batches:
            h, place = batch.column("_hash").to_numpy(), batch.column("_place").to_numpy()
            if not len(h):
                continue
            like_before = np.concatenate(([h[0] == last_hash if last_hash is not None else False], h[1:] == h[:-1]))
            like_next = np.concatenate((h[1:] == h[:-1], [False]))
            told = like_before | like_next
            out = place[told]
            if like_before[0] and not last_told:
                out = np.concatenate(([last_place], out))
            last_hash, last_place, last_told = h[-1], place[-1], bool(told[-1])
            yield _side_batch((out >> 32).astype(np.int32), _ANCHOR, np.zeros(len(out), dtype=np.int64), out & 0xFFFFFFFF)

    def name_windows(rows: pa.Table, side: pa.Table) -> pa.Table:
        own = Bucket(rows, side)
        at, hashes = own.anchors()
        marked = np.zeros(own.words.shape[1] + 1, dtype=np.int64)
        asked = hashes[np.searchsorted(at, own.side_at[own.side[_ANCHOR]])]
        np.add.at(marked, at[np.isin(hashes, asked)] + 1, 1)
        marked = np.cumsum(marked)
        at, a, b = own.windows()
        # A window is marked if an anchor inside it is.
        some = marked[at + PERIOD] > marked[at]
        at, a, b = at[some], a[some], b[some]
        first, _ = _groups(a, b)
        at, a, b = at[first], a[first], b[first]
        row = np.searchsorted(own.offsets, at, side="right") - 1
        return pa.table(
            {"_h1": a.view(np.int64), "_h2": b.view(np.int64), "_id": own.ids[row] if len(row) else np.zeros(0, np.int64), "_at": at - own.document[row] if len(row) else np.zeros(0, np.int64)}
        )

    def not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by window, id and place, all but the first of each window."""
        last = None
        for batch in batches:
            a, b = batch.column("_h1").to_numpy(), batch.column("_h2").to_numpy()
            if not len(a):
                continue
            again = np.concatenate(([last == (a[0], b[0])], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
            last = (a[-1], b[-1])
            yield pa.RecordBatch.from_arrays([batch.column("_id").filter(pa.array(again)), batch.column("_at").filter(pa.array(again))], names=["_id", "_at"])

    out_type = StructType([rows.schema["_row"], StructField("_kept", StringType()), StructField("_n", LongType()), StructField("_cut", LongType())])

    def remove(rows: pa.Table, side: pa.Table) -> pa.Table:
        own = Bucket(rows, side)
        at, a, b = own.windows()
        first, number = _groups(a, b)
        gone = np.zeros(own.words.shape[1] + 1, dtype=np.int64)
        if len(at):
            sent = own.side[_LATER]
            # Place in the bucket of the windows that have an earlier one elsewhere.
            row = np.searchsorted(own.ids, own.side_id[sent])
            place = own.document[row] + own.side_at[sent]
            elsewhere = np.zeros(len(first), dtype=bool)
            elsewhere[number[np.searchsorted(at, place)]] = True
            removed = elsewhere[number]
            here = np.ones(len(at), dtype=bool)
            here[first] = False
            removed |= here
            np.add.at(gone, at[removed], 1)
            np.add.at(gone, at[removed] + WIDTH, -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept, counts, cut = [], [], []
        for i, text in enumerate(own.texts):
            mine = gone[own.offsets[i] : own.offsets[i + 1]]
            n = len(mine)
            if own.copied[i]:  # equal to an earlier text: each of its windows is
                n = len(bounds(np.frombuffer(text.encode(), dtype=np.uint8))[0])
                mine = np.full(n, n >= WIDTH)
            counts.append(n)
            cut.append(int(mine.sum()))
            kept.append(cut_words(text, mine) if mine.any() else text)
        return pa.table(
            {"_row": rows.column("_row").take(pa.array(own.order)), "_kept": pa.array(kept, type=pa.string()), "_n": pa.array(counts, type=pa.int64()), "_cut": pa.array(cut, type=pa.int64())}
        )

    anchors = _cogroup(rows, later, name_anchors, "_hash long, _place long")
    shared = anchors.repartition("_hash").sortWithinPartitions("_hash").mapInArrow(meet_again, _SIDE)
    windows = _cogroup(rows, later.unionByName(shared), name_windows, "_h1 long, _h2 long, _id long, _at long")
    elsewhere = (
        windows.repartition("_h1")
        .sortWithinPartitions("_h1", "_h2", "_id", "_at")
        .mapInArrow(not_first, "_id long, _at long")
        .select(bucket.alias("_b"), F.lit(_LATER).alias("_kind"), "_id", "_at")
    )
    done = _cogroup(rows, later.unionByName(elsewhere), remove, out_type)
    own = [F.col("_kept").cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*own, F.col("_n").alias(n_words), F.col("_cut").alias(n_removed))


def _side_batch(b, kind: int, ids, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(b), pa.array(np.full(len(b), kind, dtype=np.int32)), pa.array(ids), pa.array(at)], names=["_b", "_kind", "_id", "_at"]
    )


def cut_words(text: str, gone: np.ndarray) -> str:
    """The text without the words marked; each goes with the white space after it."""
    blob = np.frombuffer(text.encode(), dtype=np.uint8)
    start, _ = bounds(blob)
    edges = np.concatenate((start, [len(blob)]))
    keep = np.concatenate((np.ones(int(edges[0]), dtype=bool), np.repeat(~gone, np.diff(edges))))
    return blob[keep].tobytes().decode()

