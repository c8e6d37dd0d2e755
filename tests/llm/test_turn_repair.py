"""Repair against all sequences of edits, pieces against whole conversations, and the SQL."""

import itertools
import random
import re
import zlib

import duckdb
import pytest

from graphloom.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def brute(turns):
    """(cost, audit) of the cheapest edits: every choice for each turn, and every number of insertions between, up to two."""
    best = None
    for edits in itertools.product("KRD", repeat=len(turns)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, turns)):
            continue
        for ins in itertools.product(range(3), repeat=len(turns) + 1):
            audit, initials, cost = "", "", 0
            for i in range(len(turns) + 1):
                for _ in range(ins[i]):
                    audit, cost, initials = audit + "I", cost + 2, initials + ("a" if initials.endswith("u") else "u")
                if i < len(turns):
                    audit += edits[i]
                    cost += {"K": 0, "R": 2, "D": 3}[edits[i]] + (edits[i] != "D" and turns[i][1] == "truncated")
                    initials += {"K": turns[i][0], "R": "a" if initials.endswith("u") else "u", "D": ""}[edits[i]]
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_search_finds_the_cheapest_edits():
    rng = random.Random(3)
    for _ in range(150):
        turns = [(rng.choice("ssuuaat"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(5))]
        assert R.repair(turns)[:2] == brute(turns), turns


def test_pieces_fold_to_the_whole():
    rng = random.Random(4)
    for _ in range(200):
        turns = [(i, rng.choice("suuaat"), rng.choice(["", "", "", "blank", "truncated"])) for i in range(rng.randrange(1, 30))]
        fold, at = R.Fold(), 0
        while at < len(turns):
            n = rng.randrange(1, 6)
            fold.add(R._summed(turns[at : at + n], False))
            at += n
        whole = R._summed(turns, True)
        assert list(fold.result()) == list(whole["whole"])
        assert (fold.blank, fold.truncated, fold.illegal, fold.turns) == (whole["blank"], whole["truncated"], whole["illegal"], whole["turns"])


def conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randrange(1, 9)):
            text = rng.choice(["Yes. No!", "no end", "", None, "  ", "é?", f"text {t}.", "same."])
            rows.append((c, rng.choice([t, t + 5, None]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), text, "x"))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t % 40}.", "x") for t in range(700)]
    rows += [(501, None, "user", "x" * 200_000 + ".", "x")] * 3
    dropped = [i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:2]
    return spark.createDataFrame(rows + [(c, 0, "user", "a.", "x") for c in dropped], SCHEMA), dropped


@pytest.mark.parametrize("piece", [R.PIECE, 3])
def test_query_equals_sql(spark, piece):
    df, dropped = conversations(spark)
    got = R.repaired(R.damaged(df), df, piece)
    c = duckdb.connect()
    c.register("conversations", df.toArrow())
    out = c.execute(R.SQL)
    assert [d[0] for d in out.description] == got.columns
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(out.fetchall(), key=str)
    empty = {r[0]: r[1:] for r in rows if r[0] in dropped}
    assert set(empty.values()) == {(0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")} and len(empty) == 2


def test_empty_table_and_other_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.report(none).count() == 0
    text = spark.createDataFrame([("a", 1, "user", "Hm."), ("a", 2, "assistant", "Oh.")], "conv_id string, turn int, role string, text string")
    (row,) = R.report(text).collect()
    assert row.conv_id == "a" and row.cost >= 0
