"""The registered queries on whole tables: against SQL, or against a plain version."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from martflow.llm.queries import ORACLES, QUERIES
from tests.llm import plain
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, text from documents order by doc_id").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == []


def test_each_operator_is_registered_once():
    numbers = [re.match(r"op(\d+)_", q)[1] for q in QUERIES if q.startswith("op")]
    assert sorted(map(int, numbers)) == list(range(1, 14)) and "pipeline" in QUERIES
    assert QUERIES.items() <= entry.queries().items()


def _ids(texts, file, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return {
        d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4") for d, t in texts.items()
    }


def test_shards(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op10_repair_shards"](spark, SF).collect()}
    start = 0
    for doc, ids in sorted(_ids(texts, "word_bpe_49k.json", 2).items()):
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_packing(spark, texts):
    rows = QUERIES["op6_nnls_packing"](spark, SF).collect()
    plain.check_pieces(rows, _ids(texts, "byte_bpe_50k.json", 1), 2048)


def test_quality_on_the_held_out_fold(spark, con):
    rows = {r["doc_id"]: r for r in QUERIES["op4_neighbour_quality"](spark, "/root/testdata/sf0.01").collect()}
    wide = connect("/root/testdata/sf0.01")
    labels = wide.execute("select doc_id, quality from labels").fetchall()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    tested = [(rows[d]["predicted"], q) for d, q in labels if rows[d]["held_out"]]
    assert len(rows) == 1000 and sum(p == q for p, q in tested) / len(tested) > 0.9


def test_pieces(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r["doc_id"]: r for r in QUERIES["op7_shared_prefix_pieces"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for d, t in texts.items():
        assert rows[d]["decoded_sha256"] == hashlib.sha256(t.replace("▁", " ").encode()).hexdigest()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    library = sentencepiece.SentencePieceProcessor(model_proto=plain.as_unigram(path))
    for d in list(texts)[:25]:
        ids = plain.best_segments(model, texts[d])
        # The library adds scores up in single precision and can end below the best.
        assert sum(map(model.get_score, ids)) >= sum(map(model.get_score, library.encode(texts[d])))
        assert rows[d]["n_tokens"] == len(ids)
        assert rows[d]["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_licenses(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op9_dice_licenses"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for d, t in texts.items():
        want = plain.license_of(t)
        assert (rows[d]["license"], rows[d]["n_passages"]) == (want[0], want[2])
        assert rows[d]["dice"] == pytest.approx(want[1]) if want[0] else rows[d]["dice"] is None
    assert any(r["license"] for r in rows.values())
