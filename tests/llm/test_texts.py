"""The operators on texts: edge rows, and plain versions of random small inputs."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from fractions import Fraction
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from martflow.llm import licenses, ngram, packing, pieces, quality, repair, substring, warc
from martflow.llm.tokens import Encoder
from martflow.llm.words import words_of
from martflow.session import shared_dir
from tests.conftest import rows_of
from tests.llm import plain

BYTES, WORDS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "  a  b ", "don't  stop\n\n x", "a\0b", "<|endoftext|> hi", "x  <|endoftext|>  y", "é É ñ İ! ß́ áb",
    "123 4567 12a3!?", "日本 語 nbsp", "\n", "ª² ½ x²", "ab\x1ccd \x85 q r", "A" * 3000, "😀😀 a😀b", "a\r\nb", "x<y <| z",
]
SCHEMA = "doc_id long, text string"


def _random_texts(n, seed, alphabet="aB1é .,'\n\t  <|> İß日½’-", size=40):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, size))) for _ in range(n)]


def _sentences(n, seed, words=("a", "b", "c", "d", "e"), size=60):
    pick = random.Random(seed)
    return [" ".join(pick.choice(words) for _ in range(pick.randint(0, size))) for _ in range(n)]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (90, None), (91, "twice"), (91, "twice"), (92, "x y " * 40_000)]
    return spark.createDataFrame(
        [(d, t, 1, "w", 2, [3]) for d, t in rows], "doc_id long, text string, n_words int, _row string, _id int, _key array<int>"
    )


# --- ids --------------------------------------------------------------------


@pytest.mark.parametrize("path, spaces", [(BYTES, True), (WORDS, False)])
def test_ids_are_those_of_the_library(path, spaces):
    encoder, library = Encoder(path, spaces), Tokenizer.from_file(path)
    texts = [None, *ODD, *_random_texts(1500, 1)]
    for _ in range(2):  # new units, then known ones
        ids, counts = encoder.encode(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_a_very_long_text_is_cut_where_nothing_changes():
    text = " ".join(_sentences(40, 3, ("alpha", "beta,", "gamma\n\n", "é'x", "  "), 8000))
    encoder, library = Encoder(BYTES, True), Tokenizer.from_file(BYTES)
    assert len(text) > 1 << 19
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_are_split_and_told_apart():
    texts = [None, "", "a b\ta", "a\x0bb\x0cc\r\nd", "x" * 9000 + " y", "x" * 8999 + "z y", "  é"]
    words = words_of(texts)
    assert words.counts.tolist() == [len(plain.WORD.findall(t or "")) for t in texts]
    flat = [w for t in texts for w in plain.WORD.findall(t or "")]
    for (i, a), (j, b) in itertools.combinations(enumerate(flat), 2):
        assert (a == b) == (words.hashes[0, i] == words.hashes[0, j]) == (words.hashes[1, i] == words.hashes[1, j])


# --- shards -----------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_ranges(seed):
    pick = np.random.default_rng(seed)
    counts = pick.integers(0, 90, size=40)
    ids = pick.choice([3, 4, 5, 5, 5, 70_000], size=int(counts.sum())).astype(np.uint32)
    shard = repair.unpack_shard(repair.pack_shard(ids, counts, [None, *range(39)], 70_001, min_count=2))
    back, sizes = shard.decode()
    assert back.tolist() == ids.tolist() and sizes.tolist() == counts.tolist()
    assert len(shard.rules) and len(shard.symbols) < len(ids)
    edges = np.concatenate(([0], np.cumsum(counts)))
    for doc in range(40):
        own = ids[edges[doc] : edges[doc + 1]]
        for a, b in ((0, len(own)), (3, 7), (len(own) - 1, len(own) + 5), (5, 5)):
            assert shard.decode_range(doc, max(a, 0), b).tolist() == own[max(a, 0) : b].tolist()


def test_equal_ids_and_no_ids():
    for ids in ([7] * 101, [], [1, 2]):
        shard = repair.unpack_shard(repair.pack_shard(np.array(ids, dtype=np.uint32), np.array([len(ids)]), [5], 10, min_count=2))
        assert shard.decode()[0].tolist() == ids


@pytest.mark.parametrize("base, copies", [(40_000, 60), (70_001, 60), (40_000, 9), (40_000, 3)])
def test_pairs_are_replaced_until_none_is_frequent(base, copies):
    pick = np.random.default_rng(copies)
    passage = pick.integers(0, base, size=3000)
    docs = [np.concatenate((pick.integers(0, base, size=50), passage)) for _ in range(copies)]
    ids, counts = np.concatenate(docs).astype(np.uint32), np.full(copies, 3050)
    shard = repair.unpack_shard(repair.pack_shard(ids, counts, list(range(copies)), base))
    assert shard.decode()[0].tolist() == ids.tolist() and shard.decode()[1].tolist() == counts.tolist()
    left = Counter()
    for a, b in itertools.pairwise(shard.doc_symbols.tolist()):
        left.update(itertools.pairwise(shard.symbols[a:b].tolist()))
    assert max(left.values()) < 8
    assert max(shard.lengths, default=1) == (3000 if copies >= 8 else 1)
    # Short sequences, and what a limit on the rules leaves.
    for n in range(1, 20):
        few = repair.unpack_shard(repair.pack_shard(np.zeros(n, dtype=np.uint32), np.array([n]), [1], base))
        assert few.decode()[0].tolist() == [0] * n
    some = repair.unpack_shard(repair.pack_shard(ids, counts, list(range(copies)), base, max_rules=100))
    assert len(some.rules) == (100 if copies >= 8 else 0) and some.decode()[0].tolist() == ids.tolist()


def test_pairs_of_one_slot_all_get_rules():
    keys = np.arange(1, 1 << 20, dtype=np.uint32)
    spread = repair._spread(keys, 16)
    found = keys[spread == spread[0]][:5]
    text = np.tile(found, 4)
    where, which = repair._occurrences(found, text, np.zeros(len(text), dtype=bool))
    assert len(found) == 5 and where.tolist() == list(range(0, 20, 2)) and found[which].tolist() == text[::2].tolist()


def test_shards_of_odd_rows(spark, odd_docs):
    shards = repair.write_shards(odd_docs.repartition(3), WORDS, 2, shard_tokens=10)
    rows = repair.read_shards(shards, shared_dir(spark)).collect()
    library = Tokenizer.from_file(WORDS)
    want = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in odd_docs.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), len(r["ids"]) // 4) for r in rows) == sorted(
        ((d is not None, d or 0), len(i)) for d, i in want
    )
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])][0] is None
    empty = repair.write_shards(spark.createDataFrame([], SCHEMA), WORDS, 2)
    assert repair.read_shards(empty, shared_dir(spark)).isEmpty()


# --- packing ----------------------------------------------------------------


def test_combinations_fill_the_window_exactly():
    h = np.array([0, 3, 0, 2, 5, 1, 0, 4, 0, 1])
    found = {tuple(c) for c in packing.combinations(h).tolist()}
    have = [n for n in range(10) if h[n]]
    some = itertools.chain.from_iterable(itertools.combinations_with_replacement(have, k) for k in range(2, packing.DEPTH + 1))
    want = {tuple(sorted(c, reverse=True)) + (0,) * (packing.DEPTH - len(c)) for c in some if sum(c) == 10}
    assert found == want
    wide = packing.combinations(np.arange(500) % 7)
    assert len(wide) > 1000 and (wide.sum(axis=1) == 500).all() and not (wide % 7 == 0).any(where=wide > 0)


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_piece_once(seed):
    pick = np.random.default_rng(seed)
    h = pick.integers(0, 200, size=64) * (pick.random(64) < 0.7)
    h[0] = 5
    plan = packing.make_plan(h)
    filled = np.zeros((plan.sequences, 64), dtype=int)
    whole = 0
    for n in range(1, 64):
        for rank in range(int(h[n])):
            parts = packing.place(plan, n, rank)
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]
            whole += len(parts) == 1
            for _, m, q, o in parts:
                filled[q, o : o + m] += 1
    assert filled.max() <= 1 and (filled == 0).sum() == plan.padding < 64
    # Most pieces are placed by combinations, whole.
    assert whole / h[1:].sum() > 0.7


def test_packing_of_odd_rows(spark, odd_docs):
    got = packing.pack(odd_docs.where("doc_id != 91"), BYTES, 1, window=64).withColumn("ids_crc32", F.crc32("ids")).collect()
    library = Tokenizer.from_file(BYTES)
    rows = odd_docs.where("doc_id != 91").select("doc_id", "text").collect()
    ids = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows}
    plain.check_pieces(got, ids, 64)
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTES, 1).isEmpty()
    twice = packing.pack(odd_docs.where("doc_id = 91 or doc_id is null"), BYTES, 1).collect()
    assert sorted((r["doc_id"] is not None, r["start"]) for r in twice) == [(False, 0), (True, 0), (True, 0)]


# --- substring dedup --------------------------------------------------------


def test_cover_has_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_like_the_plain_version(spark, seed):
    pick = random.Random(seed)
    passages = _sentences(4, seed + 100, tuple("pqrstuvw"), 70)
    docs = []
    for i, text in enumerate(_sentences(60, seed, tuple(f"w{k}" for k in range(500)), 120)):
        parts = [text, *pick.choices(passages, k=pick.randint(0, 2))]
        pick.shuffle(parts)
        docs.append((i * 7, "\n ".join(parts)))
    docs += [(1000 + i, docs[i][1]) for i in range(5)] + [(2000, "x " * 90), (2001, "\t".join(["x"] * 19)), (2002, None)]
    want = plain.without_repeats(docs)
    got = substring.dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_removed"], plain.WORD.findall(r["text"] or "")) == (*want[r["doc_id"]][:2], want[r["doc_id"]][2])


def test_repeats_of_odd_rows(spark, odd_docs):
    got = substring.dedup(odd_docs)
    assert got.columns == [*odd_docs.columns, "_n_words", "n_removed"]
    rows = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert got.count() == odd_docs.count() and rows[(90, None)]["_n_words"] == 0
    assert rows[(None, "no id here")]["n_removed"] == 0 and rows[(91, "twice")]["_key"] == [3]
    long = [r for (d, _), r in rows.items() if d == 92][0]
    # All but the first period of the repeated pair, and what is left of a window.
    assert long["_n_words"] == 80_000 and long["n_removed"] == 80_000 - 2
    same = spark.createDataFrame([(1, "a b " * 3 + " ".join(map(str, range(30))))] * 2, SCHEMA)
    assert sorted(r["n_removed"] for r in substring.dedup(same).collect()) == [0, 36]
    assert substring.dedup(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_a_copy_among_other_rows_of_its_id(spark):
    """One id with a copied text, texts of its own and a null: only the copy is one."""
    copied, own, other = (" ".join(f"{c}{k}" for k in range(30)) for c in "anz")
    docs = [(1, copied), (5, own), (5, None), (5, copied), (5, other), (5, ""), (7, own + " tail"), (8, copied), (8, "short")]
    got = [(r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in substring.dedup(spark.createDataFrame(docs, SCHEMA)).collect()]
    want = [(1, copied, 30, 0), (5, own, 30, 0), (5, None, 0, 0), (5, "", 30, 30), (5, other, 30, 0), (5, "", 0, 0)]
    want += [(7, "tail", 31, 30), (8, "", 30, 30), (8, "short", 1, 0)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_cut_words_keeps_the_space_after_what_stays():
    assert substring.cut_words(" a  b\nc d ", np.array([False, True, False, True])) == " a  c "


# --- similar texts ----------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_links_like_the_plain_version(spark, seed):
    pick = random.Random(seed)
    docs = []
    for i in range(12):
        base = [f"w{pick.randint(0, 300)}" for _ in range(pick.randint(3, 120))]
        for k in range(pick.randint(1, 6)):
            words = list(base)
            for _ in range(pick.randint(0, 2)):
                words[pick.randrange(len(words))] = f"n{pick.randint(0, 99)}"
            docs.append((i * 100 + k, " ".join(words)))
    docs += [(5000, "one two"), (5001, " one  two\n"), (5002, "two one"), (5003, ""), (5004, None), (5005, ""), (5006, "  ")]
    want = plain.near_texts(docs)
    for r in ngram.links(spark.createDataFrame(docs, SCHEMA)).collect():
        d = r["doc_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (*want[d], want[d][1] == d)


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(60)]
    rows = ngram.links(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r["n_links"] for r in rows} == {59} and {r["component_id"] for r in rows} == {0}


def test_least_matches_follow_the_posterior():
    least = ngram.least_matches(Fraction(4, 5), 1e-6)
    grid = np.linspace(0.0005, 0.9995, 1000)
    for n, m in least.items():
        for k in (m - 1, m):
            density = grid**k * (1 - grid) ** (n - k)
            tail = density[grid >= 0.8].sum() / density.sum()
            assert (tail >= 1e-6) == (k == m)


def test_one_of_each_group_stays(spark, odd_docs):
    kept = ngram.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    # "a b" is there twice, with other spaces; a repeated row is the same document.
    gone = odd_docs.select("text").exceptAll(kept.select("text"))
    assert rows_of(gone) == [("a\r\nb",)]
    base = " ".join(f"w{i}" for i in range(100))
    docs = [(5, base), (3, base + " end"), (9, base), (1, "other"), (None, "other"), (7, None), (8, None)]
    left = ngram.keep_one(spark.createDataFrame(docs, SCHEMA))
    assert rows_of(left, "doc_id") == sorted([(3,), (None,), (7,), (8,)], key=repr)
    assert ngram.links(spark.createDataFrame([], SCHEMA)).isEmpty()


# --- quality ----------------------------------------------------------------


def test_scores_of_odd_rows(spark, odd_docs):
    docs = [(i, "Good words in a row, as they should be. " * 3) for i in range(100, 160)]
    docs += [(i, "BAD!! " * 30) for i in range(160, 200)]
    labels = [(i, int(i < 160)) for i in range(100, 200)] + [(100, None), (None, 1), (10_000, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = spark.createDataFrame(docs, SCHEMA).unionByName(odd_docs.select("doc_id", "text"))
    rows = quality.rate(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[100]["score"] > 0.95 and by[199]["score"] < 0.05 and by[None]["held_out"] is True
    trained = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5]
    prior = sum(i < 160 for i in trained) / len(trained)
    assert by[0]["score"] == pytest.approx(prior) == by[90]["score"]
    none = quality.rate(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.rate(docs.where("false"), labels).isEmpty()
    stay = quality.keep_good(docs.where("doc_id >= 100"), labels)
    assert stay.count() == 60 and stay.where("doc_id >= 160").isEmpty()
    good = quality.keep_good(odd_docs.withColumn("_score", F.lit(1)), labels)
    assert good.columns == [*odd_docs.columns, "_score"]


def test_votes_like_the_plain_version():
    texts = _sentences(80, 5, ("Good", "day.", "BAD!!", "BAD!!", "x", "|"), 30)
    labels = np.array([t.count("BAD") < 6 for t in texts], dtype=float)
    counts = quality.term_counts(texts)
    model = quality.fit(counts[:60], labels[:60], dimensions=8, k=5)
    got = model.score(counts[60:], block=7)
    for x, value in zip(model.latent(counts[60:]), got, strict=True):
        cosine = model.vectors @ x
        near = cosine >= np.sort(cosine)[-5] - 1e-12
        weight = np.maximum(cosine[near], 0)
        want = (weight @ model.labels[near]) / weight.sum() if weight.sum() > 0 else model.prior
        assert value == pytest.approx(want)


# --- pieces -----------------------------------------------------------------


def test_segments_are_the_best(spark):
    vocabulary = pieces.Pieces(PIECES)
    words = sorted({"▁" + w for t in _random_texts(200, 7, "abethnd日", 7) for w in t.split()})
    got, computed = vocabulary.segment(words)
    assert computed < sum(map(len, words))  # common prefixes once

    def value(ids, word):
        known = [i for i in ids if i not in vocabulary.byte_of]
        rest = len(word) - sum(len(vocabulary.texts[i]) for i in known)
        return sum(vocabulary.rank[vocabulary.texts[i]][0] for i in known) + rest * vocabulary.unknown

    for word, ids in zip(words, got, strict=True):
        best = -float("inf")
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(edges)]
            if all(p in vocabulary.rank or len(p) == 1 for p in parts):
                best = max(best, sum(vocabulary.rank[p][0] if p in vocabulary.rank else vocabulary.unknown for p in parts))
        assert value(ids, word) == best and vocabulary.decode(ids) == word[1:]


def test_pieces_round_trip(spark, odd_docs, monkeypatch):
    back = pieces.decode(pieces.encode(odd_docs, PIECES), PIECES).collect()
    texts = [(r["doc_id"], (r["text"] or "")) for r in odd_docs.collect()]
    assert sorted(((r["doc_id"] or -1), r["text"]) for r in back) == sorted(((d or -1), t) for d, t in texts)
    assert {r["n_tokens"] for r in back if not r["text"]} == {0}
    # A full table of known words changes nothing.
    monkeypatch.setattr(pieces, "_KNOWN", 20)
    small, large = pieces.Pieces(PIECES), pieces.Pieces(PIECES)
    for i in range(5):
        some = _random_texts(50, i)
        monkeypatch.setattr(pieces, "_KNOWN", 20)
        a = small.encode(some)
        monkeypatch.setattr(pieces, "_KNOWN", 10**6)
        b = large.encode(some)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert pieces.encode(spark.createDataFrame([], SCHEMA), PIECES).isEmpty()


# --- licences ---------------------------------------------------------------


def test_licenses_of_odd_rows(spark, odd_docs):
    texts = [*ODD, None, "released under the mit license", "x\n\nAll rights reserved.\nall RIGHTS reserved\n\n", "All rights"]
    texts += [licenses.TEMPLATES["MIT"], "Copyright 2020\n" + licenses.TEMPLATES["MIT"].replace("\n", "\n\n"), "a " * 5000]
    texts += [" ".join(random.Random(i).sample(licenses.TEMPLATES["ISC"].split(), 60)) for i in range(20)]
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for text, got in zip(texts, scanner.scan(texts), strict=True):
        name, value, n = plain.license_of(text)
        assert (got and (got[0], float(got[1]), got[2])) == (name and (name, value, n)), text
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r["license"] for r in rows)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).isEmpty()


def _with_windows(text, templates):
    """Best licence, coefficient and number of passages, by trying every run of words."""
    data = licenses.normal(text)
    words = data.split()
    lines = [line.split() for line in data.split(b"\n")]
    ends = list(itertools.accumulate(len(line) for line in lines))
    spans, block = {(0, len(words))} | {(e - len(line), e) for e, line in zip(ends, lines)}, None
    for e, line in [*zip(ends, lines), (len(words), [])]:
        if line:
            block = (block[0] if block else e - len(line), e)
        elif block:
            spans.add(block)
            block = None
    sets = {name: licenses.bigrams(licenses.normal(t)) for name, t in templates.items()}
    pairs = list(zip(words, words[1:]))
    found, whole, windows = [], [], []
    for a, b in spans:
        value, name = min((-licenses.dice(set(pairs[a : b - 1]), s), name) for name, s in sets.items())
        if b - a > 1 and -value * 5 >= 4:
            whole.append((a, b))
            found.append((value, name))
    for name, s in sets.items():
        for i in (i for i, p in enumerate(pairs) if p in s):
            own = set()
            for j in range(i, len(pairs)):
                own.add(pairs[j])
                if pairs[j] in s and licenses.dice(own, s) * 5 >= 4 and not any(a <= i and j + 2 <= b for a, b in whole):
                    windows.append((j + 2, i))
                    found.append((-licenses.dice(own, s), name))
    n, free = len(whole), 0
    for stop, first in sorted(windows):
        if first >= free:
            n, free = n + 1, stop
    return (min(found)[1], -min(found)[0], n) if found else None


def test_licenses_inside_longer_texts():
    some = {k: licenses.TEMPLATES[k] for k in ("MIT", "MIT notice", "BSD-2-Clause", "GPL-3.0 header", "Rights reserved", "Apache-2.0 notice")}
    pick = random.Random(3)

    def prose(n):
        return " ".join(f"v{pick.randint(0, 60)}" for _ in range(n))

    def parted(name, gap, every):
        words = some[name].split()
        return gap.join(" ".join(words[i : i + every]) for i in range(0, len(words), every))

    texts = [f"{prose(90)}\n\n{parted(name, gap, 45)}\n\n{prose(120)}" for name in ("MIT", "BSD-2-Clause", "GPL-3.0 header") for gap in ("\n\n", "\n#\n# ", "\n *\n * ")]
    texts += [f"{prose(40)} text. Released under the MIT License. more {prose(40)}", prose(30) + " " + "all rights reserved " * 40]
    texts += [f"{prose(20)} {some['MIT']} {prose(9)} {some['Rights reserved']} {prose(5)} {some['Rights reserved']}", some["MIT"] + "\n\n" + some["MIT"]]
    small = "all rights reserved released under the mit license licensed apache version 2 0 x".split()
    texts += [" ".join(pick.choice(small) + pick.choice(["", "", "", "\n", "\n\n"]) for _ in range(60)) for _ in range(150)]
    notices = [t for k, t in some.items() if len(t) < 60]
    texts += [" ".join(w for t in pick.choices(notices, k=5) for w in [prose(2), *t.split()] if pick.random() < 0.95) for _ in range(60)]
    got = licenses.Scanner(some, 0.8).scan(texts)
    for text, one in zip(texts, got, strict=True):
        assert one == _with_windows(text, some), text
    assert [g and g[0] for g in got[:9]] == ["MIT"] * 3 + ["BSD-2-Clause"] * 3 + ["GPL-3.0 header"] * 3 and got[9] == ("MIT notice", 1, 1)
    full = licenses.Scanner(licenses.TEMPLATES, 0.8).scan([f"{prose(500)}\n\n{licenses.TEMPLATES[n]}\n\n{prose(2000)}" for n in ("Apache-2.0", "MPL-2.0")])
    assert [f[:2] for f in full] == [("Apache-2.0", 1), ("MPL-2.0", 1)]


# --- archives ---------------------------------------------------------------


def test_archives_of_odd_rows(spark):
    rows = [(1, "http://a/é", "<p>x</p>", "e"), (2, None, None, "e"), (3, "http://b\r\nc", "<p>x</p>", "e"), (4, "u", "", "e")]
    rows += [(None, "n", "<p>x</p>", "e"), (None, "m", "only", "e"), (6, "v", "six\r\n\r\nWARC/1.1", "e"), (6, "w", "six\r\n\r\nWARC/1.1", "e")]
    rows += [(7, "l", "日本" * 200_000, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    index = warc.write_archives(pages, file_bytes=400)
    assert index.select("file").distinct().count() > 2
    back = {(r["page_id"], r["url"]): r for r in warc.read_records(index, shared_dir(spark)).collect()}
    assert len(back) == len(rows)
    got = {k: (r["record_type"], r["refers_to"], r["html"]) for k, r in back.items()}
    assert got[(1, "http://a/é")] == got[(None, "n")] == ("revisit", 3, None)
    assert got[(3, "http://b%0D%0Ac")] == ("response", None, "<p>x</p>")
    assert got[(2, None)] == ("revisit", 4, None) and got[(4, "u")] == ("response", None, "")
    assert got[(None, "m")] == ("response", None, "only")
    assert got[(6, "v")] == got[(6, "w")] == ("response", None, "six\r\n\r\nWARC/1.1")
    assert back[(7, "l")]["payload_bytes"] == 1_200_000 and got[(7, "l")][2] == "日本" * 200_000
    # A selection reads its own ranges only.
    some = warc.read_records(index.where("page_id in (1, 7)"), shared_dir(spark), gap_bytes=0)
    assert rows_of(some, "page_id") == [(1,), (7,)]
    assert warc.read_records(warc.write_archives(pages.where("false")), shared_dir(spark)).isEmpty()


def test_a_damaged_payload_is_noticed():
    data = warc.record(1, "u", b"payload")
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload\r\n", b"paxload\r\n"))


# --- pipeline ---------------------------------------------------------------


def test_pipeline_like_the_plain_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf)
    assert good.columns == docs.columns and 0.5 < good.count() / docs.count() <= 1
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    one = stages["n-gram Jaccard join"](spark, good, sf)
    near = plain.near_texts(rows)
    assert rows_of(one, "doc_id") == sorted(((d,) for d, _ in rows if near[d][1] == d), key=repr)
    cut = stages["substring dedup"](spark, one, sf)
    assert cut.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = plain.without_repeats(rows)
    got = cut.collect()
    assert len(got) == len(rows)
    for r in got:
        assert plain.WORD.findall(r["text"]) == want[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
    library = Tokenizer.from_file(BYTES)
    ids = {r["doc_id"]: np.array(library.encode(r["text"], add_special_tokens=False).ids + [1]) for r in got}
    plain.check_pieces(corpus_pipeline.run(spark, sf).collect(), ids, 2048)
