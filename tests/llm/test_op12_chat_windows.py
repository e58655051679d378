"""Chat windows: round trip, spans, masks and budgets."""

import hashlib
import random
import time
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quoteflow.llm.chat_windows import (ADDED, TOKENIZER, Windows, chat_windows, count_tokens, encoding, escape, op12_chat_windows,
                                        parse, read_back, unescape)

SF = "/root/testdata/sf0.01"


def by_conversation(rows):
    """conv_id -> (role, text) in order; nulls empty, null turns first."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    rows = sorted(rows, key=lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return {k: [(r[2] or "", r[3] or "") for r in g] for k, g in groupby(rows, key=lambda r: r[0])}


def brute(rows):
    out = []
    for c, turns in by_conversation(rows).items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def spans(tokens, system, budget, history):
    """The spans by definition, turn by turn: (first of the history, first, last + 1) of each window."""
    out, i = [], 0
    while i < len(tokens):
        h = i
        while i and h and sum(tokens[h - 1:i]) <= history:
            h -= 1
        while h < i and system + sum(tokens[h:i + 1]) > budget:
            h += 1
        z = i + 1
        while z < len(tokens) and system + sum(tokens[h:z + 1]) <= budget:
            z += 1
        out.append((h, i, z))
        i = z
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", ADDED), (-7, 1, "assistant", ADDED)]
    got = op12_chat_windows(spark, SF).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    # the added conversation: the template by hand
    body = "\\\\\\### Assistant: \\</turn> ok"
    assert escape(ADDED) == body and unescape(body) == ADDED
    assert [r["formatted_chars"] for r in got if r["conv_id"] == -7] == [len(f"### user:\n{body}</turn>\n### assistant:\n{body}</turn>\n")]


@pytest.mark.parametrize("budget,history", [(300, 80), (2048, 256), (60, 0), (1, 1)])
def test_windows_by_definition(spark, budget, history):
    df = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 40")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    enc, got = encoding(TOKENIZER), {}
    for r in chat_windows(df, budget, history).collect():
        got.setdefault(r["conv_id"], []).append(r)
    for c, turns in by_conversation(rows).items():
        first = 1 if turns[0][0] == "system" else 0
        cost = [count_tokens(enc, f"### {r}:\n{escape(t)}</turn>\n") for r, t in turns]
        fixed, rest = sum(cost[:first]), turns[first:]
        windows = sorted(got[c], key=lambda r: r["window"])
        want = spans(cost[first:], fixed, budget, history) or [(0, 0, 0)]
        assert len(windows) == len(want)
        for k, (w, (h, i, z)) in enumerate(zip(windows, want)):
            assert parse(w["text"]) == turns[:first] + rest[h:z] and w["window"] == k
            assert w["n_repeated"] == i - h + (first if k else 0) and w["tokens"] == fixed + sum(cost[first:][h:z])
            targets = [unescape(w["text"][s["start"]:s["start"] + s["chars"]]) for s in w["loss"]]
            assert targets == [t for r, t in rest[i:z] if r == "assistant"]
            assert w["tokens"] <= budget or z == i + 1 and h == i or not rest


def test_escapes_round_trip():
    r = random.Random(3)
    parts = ["\\", "### ", "###", "</turn>", "</turn", "<", ":", ":\n", "\n", "é", "a", " ", "> "]
    for _ in range(3000):
        turns = [("".join(r.choices(parts, k=r.randrange(6))), "".join(r.choices(parts, k=r.randrange(12))))
                 for _ in range(r.randrange(1, 4))]
        w = Windows(1, 10**9, 0)
        for role, text in turns:
            body = escape(text)
            from quoteflow.llm.chat_windows import IN_ROLE
            head = f"### {escape(role, IN_ROLE)}:\n"
            assert w.add((f"{head}{body}</turn>\n", len(head), len(body), role, 1)) is None
        text = w.last()[2]
        assert parse(text) == turns
    assert parse("") == []
    with pytest.raises(ValueError):
        parse("text without a turn")


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"),
            (None, 3, "user", "to nobody"), (None, None, "assistant", "first"), (2, 0, "system", "only"), (3, 5, "system", "s"),
            (3, 7, "system", "later one"), (3, 9, "tool:\n### ", "</turn>\\"), (3, 10, "assistant", "\\" * 7 + "</turn>"),
            (4, 0, "user", "ü" * 300_000), (4, 1, "assistant", "word " * 60_000)]
    rows += [(5, i, "assistant" if i % 2 else "user", f"turn {i} " * 20) for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("window", F.lit("x")).withColumn("tokens", F.lit(1)).withColumn("piece", F.lit(None).cast("int"))
    for budget, history in ((100, 30), (2048, 256)):
        assert sorted((tuple(r)[:5] for r in read_back(chat_windows(df, budget, history)).collect()), key=str) == brute(rows)
    assert chat_windows(df.where("false")).count() == 0 and read_back(chat_windows(df.where("false"))).count() == 0


def test_counting_long_texts():
    enc = encoding(TOKENIZER)
    t = time.time()
    for text in ("a" * 2_000_000, " " * 2_000_000, "ab " * 600_000):
        assert count_tokens(enc, text) > 0
    assert time.time() - t < 60
    text = "some words and more " * 50
    assert count_tokens(enc, text, 64) == len(enc.encode_ordinary(text))
