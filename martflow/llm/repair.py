"""Token ids in grammar-compressed shard files (Re-Pair).

Each shard holds whole documents in ascending order.  Its ids are compressed by
replacing frequent pairs of neighbours by new symbols, round after round: a round
counts all pairs, takes the most frequent ones and replaces their occurrences from
left to right, never across two documents, until no pair is frequent or all symbols of
16 bits are in use.  The file stores the rules, the number of
ids each symbol expands to, and where each document starts, so any range of ids can
be decoded alone.

Cases: a null text is an empty one (its only id is the end id); a null ``doc_id`` sorts
first; rows that repeat a ``doc_id`` are ordered by a hash of their text and each keeps
its own place; an empty table gives no shard.  Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martflow.llm.common import folder, fresh_name, gather, slices, staged, store, tasks
from martflow.llm.tokens import encoder

MAGIC = b"RPR1"
# A round takes pairs of at least this part of the highest count, and may use a third of
# the symbols left, or so many.
_FACTOR, _LEAST = 16, 1024
_HEAD = struct.Struct("<4sIIIQQ")

MANIFEST = "part int, seq int, file string, docs long, tokens long, before long, stored_bytes long"
DECODED = "doc_id long, start long, n_tokens long, ids binary, file string"


@dataclass
class Grammar:
    """Compressed ids of one shard."""

    base: int  # symbols below are ids
    rules: np.ndarray  # (n, 2) symbols of each rule
    lengths: np.ndarray  # ids that each rule expands to
    symbols: np.ndarray
    doc_symbols: np.ndarray  # first symbol of each document, and the end
    doc_ids: np.ndarray
    has_id: np.ndarray

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of all rules one after another, and where each symbol's are."""
        start = np.concatenate((np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths)).astype(np.int64)
        length = np.concatenate((np.ones(self.base, dtype=np.int64), self.lengths.astype(np.int64)))
        pool = np.empty(self.base + int(self.lengths.sum()), dtype=np.uint32)
        pool[: self.base] = np.arange(self.base)
        for k, (a, b) in enumerate(self.rules.tolist()):
            at = start[self.base + k]
            pool[at : at + length[a]] = pool[start[a] : start[a] + length[a]]
            at += length[a]
            pool[at : at + length[b]] = pool[start[b] : start[b] + length[b]]
        return pool, start, length

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each document's."""
        pool, start, length = self.expansions()
        n = length[self.symbols]
        ends = np.concatenate(([0], np.cumsum(n)))
        return gather(pool, start[self.symbols], n), np.diff(ends[self.doc_symbols])

    def decode_range(self, doc: int, first: int, stop: int) -> np.ndarray:
        """Ids ``first`` to ``stop`` of one document; only their symbols are expanded."""
        own = self.symbols[self.doc_symbols[doc] : self.doc_symbols[doc + 1]].astype(np.int64)
        n = np.where(own < self.base, 1, self.lengths[np.maximum(own - self.base, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(n)
        stop = min(stop, int(ends[-1]) if len(ends) else 0)
        if first >= stop:
            return np.empty(0, dtype=np.uint32)
        a = int(np.searchsorted(ends, first, side="right"))
        b = int(np.searchsorted(ends, stop - 1, side="right"))
        out, stack = [], own[a : b + 1][::-1].tolist()
        while stack:
            s = stack.pop()
            if s < self.base:
                out.append(s)
            else:
                x, y = self.rules[s - self.base].tolist()
                stack += [y, x]
        skip = first - (int(ends[a]) - int(n[a]))
        return np.array(out[skip : skip + stop - first], dtype=np.uint32)


def compress(ids: np.ndarray, counts: np.ndarray, base: int, min_count: int = 8, max_rules: int | None = None):
    """Rules, their expansion lengths, the compressed ids and each document's number of
    symbols.  A rule is made for a pair that occurs ``min_count`` times or more; rounds end
    when there is no such pair or all ``max_rules`` are made."""
    room = max((1 << 16) - base, 4096) if max_rules is None else max_rules
    seq = ids.astype(np.uint32)  # a copy
    last = np.zeros(len(seq), dtype=bool)
    ends = np.cumsum(counts)
    last[ends[counts > 0] - 1] = True
    owner_ends = ends
    rules, lengths = [], np.ones(base, dtype=np.int64)
    # Where a pair starts that may still be frequent.  The count of a pair only falls, and all
    # new neighbours hold a new symbol, so a rare pair is looked at no more.
    live = ~last
    while len(seq) >= 2 and room > 0:
        fits = base + sum(map(len, rules)) <= 1 << 16
        at = np.flatnonzero(live)
        keys = (seq[at] << np.uint32(16)) if fits else (seq[at].astype(np.uint64) << np.uint64(32))
        keys |= seq[at + 1]
        ordered = np.sort(keys)
        if len(ordered) < min_count:
            break
        # A key is frequent if the one min_count - 1 places on is equal.
        again = np.flatnonzero(ordered[min_count - 1 :] == ordered[: len(ordered) - min_count + 1])
        found = ordered[again]
        edge = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))[: len(found)]
        found, n = found[edge], np.diff(np.append(edge, len(found))) + min_count - 1
        if not len(found):
            break
        bits = max(16, len(found).bit_length() + 4)
        slots = np.zeros(1 << bits, dtype=bool)
        slots[_spread(found, bits)] = True
        some = np.flatnonzero(slots[_spread(keys, bits)])  # a few rare ones share a slot and stay
        at, keys = at[some], keys[some]
        # Pairs of far lower counts wait: this round's new symbols may form better ones.
        good = n * _FACTOR >= n.max()
        found, n = found[good], n[good]
        take = min(len(found), max(room // 3, min(room, _LEAST)))
        if take < len(found):
            top = np.sort(np.argpartition(-n, take - 1)[:take])
            found, n = found[top], n[top]
        first_new = base + sum(map(len, rules))
        spots, which = _starts(found, keys, at)
        where, chosen = _apart(spots, which)
        # A rule that its neighbours leave next to nothing in this round is not made yet.
        used = np.bincount(chosen, minlength=len(found)) >= max(2, min_count // 2)
        if not used.all():
            if not used.any():
                used[np.argmax(n)] = True
            found, ours = found[used], used[which]
            where, chosen = _apart(spots[ours], (np.cumsum(used) - 1)[which[ours]])
        wide = found.astype(np.uint64)
        half = np.uint64(16) if fits else np.uint64(32)
        pair = np.stack((wide >> half, wide & ((np.uint64(1) << half) - np.uint64(1))), axis=1).astype(np.uint32)
        rules.append(pair)
        lengths = np.concatenate((lengths, lengths[pair[:, 0]] + lengths[pair[:, 1]]))
        room -= len(found)
        seq[where] = first_new + chosen
        last[where] = last[where + 1]
        live[:] = False
        live[at] = True
        beside = np.concatenate((where, where[where > 0] - 1))
        live[beside] = ~last[beside]
        owner_ends = owner_ends - np.searchsorted(where + 1, owner_ends)
        keep = np.ones(len(seq), dtype=bool)
        keep[where + 1] = False
        kept = np.flatnonzero(keep)
        seq, last, live = seq[kept], last[kept], live[kept]
    table_of = np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.uint32)
    return table_of, lengths[base:], seq, np.diff(np.concatenate(([0], owner_ends)))


def _occurrences(found: np.ndarray, keys: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs ``found`` (sorted) are replaced, and which of them at each place, of
    the keys of all places but those that are ``last``."""
    at = np.flatnonzero(~last)
    return _apart(*_starts(found, keys[at], at))


def _starts(found: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs ``found`` (sorted) start among ``keys`` at the places ``at``, and
    which of them at each."""
    bits = max(16, len(found).bit_length() + 3)
    table = np.full(1 << bits, -1, dtype=np.int32)
    table[_spread(found, bits)] = np.arange(len(found), dtype=np.int32)
    which = table[_spread(keys, bits)]
    hit = np.flatnonzero(which >= 0)
    which, keys = which[hit], keys[hit]
    other = np.flatnonzero(found[which] != keys)
    # Another pair has the slot: look for those that share it.
    which[other] = np.minimum(np.searchsorted(found, keys[other]), len(found) - 1)
    right = found[which] == keys
    return at[hit[right]], which[right]


def _apart(where: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a run of overlapping occurrences every second one: those are replaced."""
    new_run = np.concatenate(([True], np.diff(where) > 1))[: len(where)]
    run_start = where[new_run][np.cumsum(new_run) - 1]
    second = (where - run_start) % 2 == 0
    return where[second], which[second]


def _spread(keys: np.ndarray, bits: int) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def pack_shard(ids: np.ndarray, counts: np.ndarray, doc_ids: list[int | None], base: int, **options) -> bytes:
    """The bytes of a shard file."""
    rules, lengths, symbols, per_doc = compress(ids, counts, base, **options)
    wide = base + len(rules) > 1 << 16
    kind = "<u4" if wide else "<u2"
    has = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    return b"".join(
        (
            _HEAD.pack(MAGIC, base, len(rules), 4 if wide else 2, len(symbols), len(doc_ids)),
            rules.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            np.concatenate(([0], np.cumsum(per_doc))).astype("<u8").tobytes(),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            has.tobytes(),
            symbols.astype(kind).tobytes(),
        )
    )


def unpack_shard(blob: bytes) -> Grammar:
    """Read a shard file."""
    magic, base, n_rules, width, n_symbols, n_docs = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    rules = take("<u4", 2 * n_rules).reshape(-1, 2)
    lengths, starts = take("<u4", n_rules), take("<u8", n_docs + 1).astype(np.int64)
    doc_ids, has = take("<i8", n_docs), take("u1", n_docs)
    return Grammar(base, rules, lengths, take("<u4" if width == 4 else "<u2", n_symbols), starts, doc_ids, has)


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, spaces: bool = False, shard_tokens: int = 2_000_000, **options) -> DataFrame:
    """Encode, compress and write all documents; returns the manifest, one row for each
    shard: ``file``, its ``docs`` and ``tokens``, and ``start``, the ids before it.

    Documents go to tasks by range of ``doc_id``.  A task writes a shard whenever
    ``shard_tokens`` ids have come together, so its memory does not grow with its part."""
    spark = docs.sparkSession
    target = folder(spark, "shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(target)
        fs.create_dir(path, recursive=True)
        enc = encoder(vocabulary, spaces)
        base = max(enc.size, end_id + 1)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held_ids, held_counts, held_docs, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held
            ids, counts = np.concatenate(held_ids), np.concatenate(held_counts)
            blob = pack_shard(ids, counts, held_docs, base, **options)
            name = f"{path}/{fresh_name(f'shard-{part:05d}-{seq:05d}', '.rpr')}"
            with fs.open_output_stream(name, compression=None) as out:
                out.write(blob)
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "file": name, "docs": len(counts), "tokens": len(ids), "before": before, "stored_bytes": len(blob)}],
                schema=_MANIFEST,
            )
            seq, before, held = seq + 1, before + len(ids), 0
            for x in (held_ids, held_counts, held_docs):
                x.clear()
            return row

        for batch in slices(batches, "text"):
            ids, counts = enc.encode(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            ids = np.insert(ids.astype(np.uint32), ends, end_id)
            held_ids.append(ids)
            held_counts.append(counts + 1)
            held_docs += batch.column("doc_id").to_pylist()
            held += len(ids)
            if held >= shard_tokens:
                yield flush()
        if held_docs:
            yield flush()

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    shards = staged(rows.mapInArrow(write, MANIFEST), "manifest")
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("_tokens"))
    # One row for each task that wrote, not for each document.
    places = totals.select(
        F.col("part").alias("_part"),
        (F.sum("_tokens").over(Window.orderBy("part")) - F.col("_tokens")).alias("_start"),
    )
    return shards.join(places, F.col("part") == F.col("_part")).select(
        "file", "docs", "tokens", "stored_bytes", (F.col("_start") + F.col("before")).alias("start")
    )


_MANIFEST = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("before", pa.int64()), ("stored_bytes", pa.int64())]
)
_DECODED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("file", pa.string())])


def read_shards(manifest: DataFrame, where: str) -> DataFrame:
    """All documents of the shards in ``manifest``: ``doc_id, start, n_tokens, file`` and
    ``ids``, little-endian unsigned 32-bit numbers.  ``where``: any file of the store,
    or its folder; it names the file system."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(where)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["file"]) as f:
                    shard = unpack_shard(f.read())
                ids, counts = shard.decode()
                if len(ids) != row["tokens"]:
                    raise ValueError(f"{row['file']} does not hold the ids of its manifest")
                data = ids.astype("<u4").tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts
                for a in range(0, len(counts), 500):
                    own = slice(a, a + 500)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[own], mask=shard.has_id[own] == 0),
                            pa.array(row["start"] + starts[own]),
                            pa.array(counts[own]),
                            pa.array([data[4 * s : 4 * e] for s, e in zip(starts[own], ends[own], strict=True)], type=pa.binary()),
                            pa.array([row["file"]] * len(counts[own])),
                        ],
                        schema=_DECODED,
                    )

    return manifest.select("file", "tokens", "start").repartition(tasks(manifest.sparkSession), "file").mapInArrow(read, DECODED)
