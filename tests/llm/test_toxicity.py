"""Undoing disguises, against all readings; scores on the held-out fold."""

import math
import random
import zlib
from itertools import product

import numpy as np
import pytest

from martflow.llm import toxicity
from martflow.llm.queries import QUERIES
from tests.conftest import rows_of
from tests.oracle import connect

TEXT = "you are an idiot and a loser. stupid trash, worthless scum; what a pathetic clown. hello good people all! " * 30


@pytest.fixture(scope="module")
def language():
    counts = toxicity.gram_counts(TEXT.encode())
    gram = np.flatnonzero(counts)
    return toxicity.language_model(gram, counts[gram])


def _cost(meant, model):
    """Four-gram cost of bytes that were meant; an edge starts anew."""
    context, total = 0, 0.0
    for b in meant + b" ":
        kind = int(toxicity._CLASS[b])
        if kind == 0:
            total += model[context * toxicity.CLASSES] if context else 0.0
            context = 0
        else:
            total += model[context * toxicity.CLASSES + kind]
            context = (context * toxicity.CLASSES + kind) % toxicity.CLASSES**3
    return total


def _cheapest(observed, model):
    choices = []
    for i, b in enumerate(observed):
        own = list(toxicity._READINGS[b])
        if i and observed[i - 1] == b and b in toxicity._ONCE:
            second = i < 2 or observed[i - 2] != b
            own.append((-1, 0, toxicity.COSTS["second" if second else "more"]))
        choices.append(own)
    best = math.inf
    for way in product(*choices):
        meant = bytes(m for m, _, _ in way if m >= 0)
        best = min(best, sum(c for _, _, c in way) + _cost(meant, model))
    return best


def _cost_of(observed, reading, model):
    """The least cost of any way from what was meant to what was written."""
    ways = {0: 0.0}
    for i, b in enumerate(observed):
        new = {}
        for at, cost in ways.items():
            options = list(toxicity._READINGS[b])
            if i and observed[i - 1] == b and b in toxicity._ONCE:
                second = i < 2 or observed[i - 2] != b
                options.append((-1, 0, toxicity.COSTS["second" if second else "more"]))
            for meant, _, extra in options:
                to = at if meant < 0 else at + 1 if reading[at : at + 1] == bytes([meant]) else None
                if to is not None:
                    new[to] = min(new.get(to, math.inf), cost + extra)
        ways = new
    return ways[len(reading)] + _cost(reading, model)


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_finds_the_cheapest_of_all_readings(language, seed):
    pick = random.Random(seed)
    for _ in range(60):
        observed = "".join(pick.choice("idotls105@$.- oos") for _ in range(pick.randint(1, 7))).encode()
        reading = toxicity.viterbi(observed, language)
        assert _cost_of(observed, reading, language) == pytest.approx(_cheapest(observed, language))


def test_one_double_is_the_search_in_short(language):
    pick = random.Random(5)
    for _ in range(2000):
        a, b = ("".join(pick.choice("abcdefilmostuéß") for _ in range(pick.randint(0, 5))) for _ in range(2))
        word = a + 2 * pick.choice("eilos") + b
        found = toxicity._DOUBTFUL.search(word)
        if not toxicity._ELSE.search(word, found.end() - 1):
            at = len(word[: found.start()].encode())
            assert toxicity.one_double(word.encode(), at, language) == toxicity.viterbi(word.encode(), language)


@pytest.mark.parametrize(
    "written, meant",
    [
        ("1d10t", "idiot"), ("i d i o t", "idiot"), ("I.D.I.O.T", "idiot"), ("idiooooot", "idiot"), ("st*pid", "stupid"),
        ("l0$3r!!", "loser!!"), ("sc-um", "scum"), ("t r @ 5 h", "trash"), ("cl​own", "clown"), ("sccuuum,", "scum,"),
        ("hello", "hello"), ("good", "good"), ("555-1624", "555-1624"), ("", ""),
    ],
)
def test_disguises(language, written, meant):
    assert " ".join(toxicity.Decoder(language).tokens(written)) == meant


def test_long_runs_are_decoded_whole(language):
    text = " ".join("idiot" * 4000) + " " + "1d10t" * 3000 + " " + "s" * 50000 + "cum"
    got = toxicity.Decoder(language).tokens(text)
    assert len(got) == 3 and got[0].count("idiot") == 4000 and got[1].count("idiot") == 3000 and got[2] == "scum"


ODD = [
    (1, "You IDIOT"), (2, "good people all"), (3, "what a l o s e r"), (4, "hello"), (5, None), (6, ""), (None, "you are 5tup1d"),
    (1, "You IDIOT"), (7, "trash"), (8, "hello good"), (9, "​ \t"), (10, "clown " * 20000), (11, "people"), (12, "an idiot"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in ODD], "doc_id long, text string, score double, _y string")
    labels = spark.createDataFrame(
        [(i, int(i in (1, 3, 7, 10, 12)), 1) for i in range(1, 13) if i != 11] + [(2, None, 1), (None, 1, 1), (1, 1, 0), (99, 1, 0)],
        "doc_id long, toxic int, quality int",
    )
    got = toxicity.rate(docs, labels, least=1).collect()
    assert len(got) == len(ODD) and all(0 < r["score"] < 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (5, 6, 9)}
    assert len(empty) == 1
    kept = toxicity.drop_toxic(docs, labels, threshold=0.5, least=1)
    assert kept.columns == docs.columns and {1, 3}.isdisjoint(r[0] for r in kept.collect())
    model = toxicity.learn_language(docs)
    back = {r["doc_id"]: r["restored"] for r in toxicity.restore(docs, model).collect()}
    assert back[5] is None and back[6] == "" and back[10].split() == ["clown"] * 20000


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert rows_of(toxicity.rate(docs, labels), "doc_id", "score", "predicted") == [(1, 0.5, 1), (2, 0.5, 1)]
    assert toxicity.rate(docs.where("false"), labels).isEmpty()


def test_grams_grow_with_the_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    once, twice = (dict(toxicity.count_grams(d).collect()) for d in (docs, docs.union(docs)))
    assert twice == {g: 2 * n for g, n in once.items()}
    # Three edges, two letters, three edges, one letter, three edges: nine times four in a row.
    assert toxicity.gram_counts(b"aa, b").sum() == 9


def test_scores_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op11_noisy_channel_toxicity"](spark, sf).collect()}
    labels = connect(sf).execute("select doc_id, toxic from labels").fetchall()
    tested = sorted(((rows[d]["score"], y) for d, y in labels if rows[d]["held_out"]), reverse=True)
    hits = np.cumsum([y for _, y in tested])
    precision = hits / np.arange(1, len(tested) + 1)
    average = float(np.mean([p for p, (_, y) in zip(precision, tested, strict=True) if y]))
    flagged = [y for s, y in tested if s >= 0.3]
    assert average > 0.85 and np.mean(flagged) > 0.95 and sum(flagged) > 0.75 * sum(y for _, y in tested)
