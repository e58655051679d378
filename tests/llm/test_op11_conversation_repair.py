"""Conversation repair against exhaustive search from the back, and against its SQL."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from quoteflow.llm.conversation_repair import ORACLE, Repair, damage, digest, op11_conversation_repair, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, initials) by trying every edit, from the last row back. rows: (initial, must go, truncated)."""

    @lru_cache(maxsize=None)
    def rest(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in "0A" else []
        if inserted < 4:
            c, s = rest(i, "A" if state == "U" else "U", inserted + 1)
            ways.append((c + 2, "I" + s))
        if i < len(rows):
            initial, gone, cut = rows[i]
            c, s = rest(i + 1, state, 0)
            ways.append((c + 3, "D" + s))
            if not gone:
                to = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}.get((state, initial))
                if to:
                    c, s = rest(i + 1, to, 0)
                    ways.append((c + cut, "K" + s))
                c, s = rest(i + 1, "A" if state == "U" else "U", 0)
                ways.append((c + 2 + cut, "R" + s))
        return min(ways) if ways else (10**6, "")

    return rest(0, "0", 0)


def faulty(rows):
    """Damaged rows of one conversation in order, with their faults."""
    out, seen = [], set()
    for turn, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = ("blank" if not said else "duplicate" if (role, text) in seen else
                 "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def replay(rows, audit):
    out, i, state = [], 0, "0"
    for x in audit:
        to = "assistant" if state == "U" else "user"
        if x == "I":
            out.append(f"{to}:")
        else:
            _, role, text, _ = rows[i]
            i += 1
            if x == "D":
                continue
            to = role if x == "K" else to
            out.append(f"{to}:{text}")
        state = to[0].upper()
    return "\n".join(out)


def brute(given):
    """The query's rows by definition."""
    by, ids = {}, {r[0] for r in given}
    for conv_id, turn, role, text in given:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by.setdefault(conv_id, []).extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = []
    for c in ids:
        rows = faulty(sorted(by.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
        turns = {r[0] for r in rows} - {None}
        cost, audit = cheapest([(r[1][:1], r[3] in ("blank", "duplicate"), int(r[3] == "truncated")) for r in rows])
        initials = [r[1][:1] for r in rows]
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *[sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                    cost, audit, hashlib.sha256(replay(rows, audit).encode()).hexdigest()))
    return sorted(out, key=str)


def by_sql(con):
    return sorted(con.execute(ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, op11_conversation_repair(spark, sf).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == brute(rows) == by_sql(con)


def random_rows(r, n, roles="suat", texts=("Yes.", "No", "", " \t", "Why?", "so", "Go!")):
    named = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    return [(r.randrange(n + 2), named[r.choice(roles)], r.choice(texts) + (f" {i}." if r.random() < .3 else "")) for i in range(n)]


def walk(rows):
    """(cost, initials, most unresolved) of the survivors' edits."""
    m, out = Repair(), []
    for row in rows:
        out += m.add(row, row[1][:1], row[3] in ("blank", "duplicate"), row[3] == "truncated")
    out += m.finish()
    return sum(n.cost for n in out), "".join(n.letter for n in out), m.most


def test_survivors_find_the_least_audit():
    r = random.Random(11)
    for k in range(4000):
        rows = faulty(sorted(random_rows(r, r.randrange(0, 14), r.choice(["suat", "ua", "su", "u", "a", "s", "uat"]))))
        want = cheapest([(x[1][:1], x[3] in ("blank", "duplicate"), int(x[3] == "truncated")) for x in rows])
        assert walk(rows)[:2] == want, rows


def test_what_is_unresolved_stays_small():
    clean = [(i, "ua"[i % 2] == "u" and "user" or "assistant", f"turn {i}.", None) for i in range(20_000)]
    cost, audit, most = walk(clean)
    assert (cost, audit) == (0, "K" * 20_000) and most < 10
    noisy = [(i, random.Random(i).choice(["user", "assistant", "system", "tool"]), f"t {i}.", None) for i in range(20_000)]
    cost, audit, most = walk(noisy)
    assert len(audit) >= 20_000 and most < 200
    # a whole conversation of ties: deleting a row costs what giving it a role costs
    tied = [(i, "tool", f"turn {i}", "truncated") for i in range(3000)]
    assert walk(tied)[:2] == (9000, "D" * 3000)


def test_operator_emits_whole_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "x")]
    got = [tuple(r) for r in repair(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(1, 0, "K", 0, 0, None, "system", "system", "Be kind."), (1, 1, "K", 0, 1, None, "user", "user", "Hi."),
                   (1, 2, "D", 3, 2, "duplicate", "user", None, None), (1, 3, "R", 3, 3, "truncated", "tool", "assistant", "x")]


def test_odd_rows(spark, tmp_path):
    r = random.Random(5)
    rows = [(1, None, None, None), (1, None, "user", "Null turn."), (1, 4, None, "No role."), (1, 4, "user", None), (2, 0, "", "Empty role."),
            (2, 0, "", "Empty role."), (None, 1, "user", "Nobody."), (None, None, "assistant", "x"), (3, 7, "user", "é!" * 100_000),
            (3, 8, "assistant", "word " * 50_000 + "end."), (4, -3, "user", "Below."), (4, 9, "assistant", "Above.")]
    for c in range(10, 70):
        rows += [(c, *x) for x in random_rows(r, r.randrange(1, 9))]
    rows += [(99, i, "user" if i % 2 else "assistant", f"Long {i}.") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumn("fault", F.lit(3)).withColumn("at", F.lit("x")).withColumn("kind", F.lit(None).cast("int"))
    path = str(tmp_path)
    df.coalesce(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    got = sorted(map(tuple, op11_conversation_repair(spark, path).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    small = [x for x in rows if x[0] != 99]
    assert [x for x in got if x[0] != 99] == brute(small)
    assert got == by_sql(con)
    empty = df.where("false")
    assert damage(empty).count() == 0 and digest(repair(empty)).count() == 0
