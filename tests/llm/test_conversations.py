"""The repair of conversations against an exhaustive search, and on odd rows."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from martflow.llm import conversations
from tests.conftest import rows_of

SPACE = "\x20\t\n\x0b\x0c\r"
ROLES = ["user", "assistant", "system", "tool", "User", "", None]


def cheapest(rows):
    """Of all edits whose roles match the pattern: least cost, then least letters."""
    roles = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    starts = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def go(i, last, inserted):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            cost, letters, out = go(i, roles[last][0], inserted + 1)
            found.append((cost + 2, "I" + letters, ((roles[last], ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, letters, out = go(i + 1, last, 0)
            found.append((cost + 3, "D" + letters, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[:1] in starts[last]:
                    cost, letters, out = go(i + 1, role[:1], 0)
                    found.append((cost + more, "K" + letters, ((role, text), *out)))
                cost, letters, out = go(i + 1, roles[last][0], 0)
                found.append((cost + 2 + more, "R" + letters, ((roles[last], text), *out)))
        return min(found, default=(1 << 40, "", ()))

    return go(0, "", 0)


def plain(rows):
    """What ``summarise`` gives for one conversation of ``(turn, role, text)``."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, judged = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "sound" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        judged.append((role, text, fault))
    cost, letters, out = cheapest(tuple(judged))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    count = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *count,
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        letters,
        hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
        out,
    )


def _random(seed, n, pick=None):
    pick = random.Random(seed)
    rows = []
    for conv in range(n):
        for k in range(pick.randint(1, 9)):
            role = pick.choice(ROLES) if pick.random() < 0.3 else pick.choice(ROLES[:2])
            text = pick.choice(["Yes.", "No", " ", "", None, "a b!\n", " ", f"t{k}.", f"t{k}", "x?\t "])
            turn = None if pick.random() < 0.05 else pick.randint(0, 6) if pick.random() < 0.3 else k
            rows.append((None if conv == 3 else conv, turn, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("open_rows", [48, 1])
def test_like_the_exhaustive_search(spark, monkeypatch, open_rows):
    monkeypatch.setattr(conversations, "_OPEN", open_rows)
    rows = _random(open_rows, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = plain([r[1:] for r in rows if r[0] == conv])
    got = {r[0]: tuple(r)[1:] for r in conversations.summarise(df).collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    back = {}
    for conv, position, edit, role, text in sorted(conversations.repair(df).collect(), key=lambda r: (str(r[0]), r[1])):
        back.setdefault(conv, []).append((position, edit, role, text))
    for conv, v in want.items():
        own = back.get(conv, [])
        assert [(r, x) for _, _, r, x in own] == list(v[-1]) and [p for p, *_ in own] == list(range(len(own)))
        assert "".join(e for _, e, _, _ in own) == v[6].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, _, r, _ in own))


def test_damage(spark):
    rows = [(c, t, "assistant", f"A. b! c? {t}") for c in range(40) for t in range(6)] + [(None, 1, None, None), (1, None, "system", "x.")]
    got = rows_of(conversations.damage(spark.createDataFrame(rows, SCHEMA)))
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want.append((c, t, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)))
    assert got == sorted(want, key=repr) and {r[4] for r in got} == {0, 1, 2}


def test_dropped_rows_leave_their_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (None, 0, "user", "a.", 0), (2, 0, "user", "Hi.", 3)], SCHEMA + ", times int")
    got = {r[0]: tuple(r)[1:] for r in conversations.summarise(df, times="times").collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1] == got[None] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[2] == (0, 0, 2, 0, 2, 6 + 2, "KDDI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())
    assert conversations.summarise(df.where("false")).isEmpty() and conversations.repair(df.where("false")).isEmpty()


def test_clashing_columns(spark):
    rows = [(1, 0, "user", "Hi.", 7, "x", 1), (1, 1, "assistant", "Yes.", 8, "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", _turn int, _text string, _n long")
    assert rows_of(conversations.summarise(df), "audit", "cost") == [("KK", 0)]


def test_one_very_long_conversation(spark):
    n = 20000
    rows = spark.range(n).selectExpr(
        "7L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "if(id % 5 = 4, 'Same.', concat('t', id, '.')) as text"
    )
    plan = conversations._streamed(rows, None)._jdf.queryExecution().toString()
    assert "Window" not in plan
    row = conversations.summarise(rows).first()
    assert row["duplicate"] == n // 5 - 2 and len(row["audit"]) >= n
    now = conversations.Conversation(lambda *edit: None)
    widest = 0
    for i in range(n):
        now.row(i, ("user", "assistant", "assistant")[i % 3], "x", 1, "sound")
        widest = max(widest, now.width)
    assert widest < 1000


def test_equal_rows_are_one_row_with_a_count(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA).union(spark.range(5000).selectExpr("1L", "1L", "'assistant'", "'Yes.'"))
    judged = conversations._judged(df, None)
    assert sorted(r["_n"] for r in judged.collect()) == [1, 5000]
    row = conversations.summarise(df).first()
    assert (row["audit"], row["cost"], row["illegal"]) == ("KK" + "D" * 4999, 3 * 4999, 4999)
