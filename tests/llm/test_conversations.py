"""The repair of conversations against all edit sequences, and its edge cases."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from sigevents.llm import conversations


def every_repair(rows):
    """Least (cost, audit, text) over all edits of each row and insertions of up to two rows in each gap; rows: role, text, must_go, truncated."""
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    for inserted in product(gaps, repeat=len(rows) + 1):
        if sum(map(len, inserted)) > 3:
            continue
        for edits in product(*[["D"] if x[2] else ["D", "K", "user", "assistant"] for x in rows]):
            cost, audit, out = 3 * sum(map(len, inserted)), "", []
            for i, gap in enumerate(inserted):
                audit += "I" * len(gap)
                out += [(role, "") for role in gap]
                if i < len(rows):
                    role, text, _, cut = rows[i]
                    e = edits[i]
                    audit += e if e in "DK" else "R"
                    cost += {"D": 4, "K": 3 * cut}.get(e, 3 + 3 * cut)
                    out += {"D": [], "K": [(role, text)]}.get(e, [(e, text)])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best = min(x for x in (best, (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))) if x)
    return best


def test_cheapest_of_all_repairs():
    r = random.Random(1)
    for _ in range(250):
        rows = [(r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["a.", "b", "c!"]), r.random() < 0.2, False) for _ in range(r.randrange(4))]
        rows = [(role, text, go, not go and text == "b") for role, text, go, _ in rows]
        cost, audit, text = every_repair(rows)
        found = conversations.Repair()
        for row in rows:
            found.row(*row)
        assert found.result() == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


@pytest.mark.parametrize("block", [9, 40, 100_000])
def test_settled_letters_change_nothing(monkeypatch, block):
    """The same result however often letters are taken out, and for conversations of many blocks."""
    r = random.Random(2)
    rows = [(r.choice(["user", "assistant", "system", "x"]), str(i), r.random() < 0.1, r.random() < 0.1) for i in range(700)]
    whole = conversations.Repair()
    monkeypatch.setattr(conversations, "BLOCK", block)
    parts = conversations.Repair()
    for role, text, go, cut in rows:
        whole.row(role, text, go, cut and not go)
        parts.row(role, text, go, cut and not go)
    assert whole.result() == parts.result()
    assert block > 99 or parts.width < 200


def sql_of(con, turns):
    con.register("conversations", turns.toArrow())
    return con.sql(conversations.ORACLE_SQL).fetchall()


def key(row):
    return tuple((x is not None, x) for x in row)


def test_table_against_sql(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2, 3, 4, 5, 6]), r.choice([None, *range(9)]), r.choice(["user", "user", "assistant", "assistant", "system", None, "tool"]), r.choice([None, "", "one.", "two", "three! ", " \t", "four?\n", "É."])) for _ in range(260)]
    rows += rows[:20] + [(7, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    turns = turns.select("*", *[F.lit("x").alias(c) for c in ("_c", "_d", "gone", "fault", "_first", "later", "blank", "_n")])
    got = [tuple(x) for x in conversations.repair_table(turns).collect()]
    assert sorted(got, key=key) == sorted(sql_of(duckdb.connect(), turns.select("conv_id", "turn", "role", "text")), key=key)
    assert len(got) == 8
    assert conversations.repair_table(turns.limit(0)).count() == 0


def test_all_rows_dropped(spark):
    gone = [i for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    turns = spark.createDataFrame([(i, 0, "user", "Hm.") for i in gone], "conv_id long, turn long, role string, text string")
    assert sorted(tuple(x) for x in conversations.repair_table(turns).collect()) == [(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in gone]


def test_repaired_turns(spark):
    """The repaired rows have the roles wanted and the hash that was told; long texts and repeated ids of text kind."""
    r = random.Random(5)
    rows = [(r.choice(["a", "b", "c", None]), i, r.choice(["user", "assistant", "system"]), r.choice(["x.", "y", f"long {i} " * 9_000 + "."])) for i in range(60)]
    plain = conversations.plain(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    told = {x.conv_id: x for x in conversations.repair(plain).collect()}
    found: dict = {}
    for x in conversations.repaired_turns(plain).orderBy("conv_id", "place").collect():
        found.setdefault(x.conv_id, []).append(x)
    assert set(told) == {"a", "b", "c", None}
    for c, t in told.items():
        out = found.get(c, [])
        assert [x.place for x in out] == list(range(len(out))) and re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in out))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in out).encode()).hexdigest() == t.repaired_sha256
        assert "".join(x.edit for x in out) == t.audit.replace("D", "")
