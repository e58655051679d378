"""Token counts against a plain recurrence; merge-dropout round trips."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoteflow.llm.merge_dropout import Encoder, decode, decoded, encoded, hash8, hash16, op10_merge_dropout
from quoteflow.llm.pieces import MODEL, SPACE, units, vocabulary
from quoteflow.llm.token_counts import Counter, op7_token_counts, token_counts

SF = "/root/testdata/sf0.001"
TEXT = st.text("ab é漢▁\ue000\n<0x41>the", max_size=40)


def plain_count(c, text):
    """The whole text in one recurrence, without trie or units."""
    w = (" " + text).replace(SPACE, "\ue000").replace(" ", SPACE) if text else ""
    states = [(0.0, 0)]
    for end in range(1, len(w) + 1):
        options = []
        if w[end - 1] not in c.logp:
            n = len(w[end - 1].encode())
            options.append((states[end - 1][0] + n * c.byte, states[end - 1][1] - n))
        for a in range(max(0, end - c.longest), end):
            if w[a:end] in c.logp:
                options.append((states[a][0] + c.logp[w[a:end]], states[a][1] - 1))
        states.append(max(options))
    return -states[-1][1]


COUNTER = Counter(vocabulary())


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_counts(text):
    assert COUNTER.counts([units(text)]) == [plain_count(COUNTER, text)]


def test_counts_query_and_odd_rows(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in op7_token_counts(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k in list(docs)[:25]:
        assert got[k] == plain_count(COUNTER, (docs[k] or ""))
    df = spark.createDataFrame([(1, None), (1, ""), (None, "z" * 5000)], "doc_id long, text string").withColumn("n_tokens", F.lit(0))
    rows = {(r["doc_id"], r["n_tokens"]) for r in token_counts(df).collect()}
    assert rows == {(1, 0), (None, plain_count(COUNTER, "z" * 5000))}
    assert token_counts(df.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(0, 3), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_round_trip(text, key, rate):
    v = vocabulary()
    assert decode(v, Encoder(v, 5, rate).encode(text, key)) == text


def test_rate_zero_is_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    e = Encoder(vocabulary(), rate=0.0)
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect():
        assert e.encode(r["text"] or "").tolist() == sp.encode(r["text"] or "")


def test_dropout_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_merge_dropout(spark, SF).collect()
    assert len(rows) == len(docs) and all(r["lossless"] for r in rows)
    assert all(r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() for r in rows)
    df = spark.createDataFrame([(i, "varied segmentations of merges " * 3) for i in range(20)] + [(90, None), (90, ""), (None, "q" * 3000)],
                               "doc_id long, text string").withColumn("ids", F.lit("x"))
    out = encoded(df)
    assert len({tuple(r["ids"]) for r in out.collect() if (r["doc_id"] or 99) < 20}) > 3
    assert sorted(r["text"] for r in decoded(out).collect()) == sorted(r["text"] or "" for r in df.collect())
    again = encoded(df.repartition(3)).collect()
    assert sorted(r["ids_crc32"] for r in again) == sorted(r["ids_crc32"] for r in out.collect())
    assert encoded(df.where("false")).count() == 0


@pytest.mark.parametrize("rate,least", [(0.0, 1), (1.0, 10)])
def test_rates(rate, least):
    v = vocabulary()
    assert len(Encoder(v, 1, rate).encode("international")) >= least


def test_segmentations_are_not_capped():
    """One word in many documents, and many times in one: far more than four cuts, each place by its own draws."""
    v = vocabulary()
    e = Encoder(v, 5, 0.1)
    assert len({tuple(e.encode("international", k)) for k in range(400)}) > 8
    once = [e.unit(" international", d) for d in range(400)]
    assert len(set(once)) > 8 and once == [e._merged(" international", d)[0] for d in range(400)]
    for w in ("▁the", "ing", "tion", " of", " international"):        # kept decisions give what a fresh run gives
        assert [e.unit(w, d) for d in range(200)] == [e._merged(w, d)[0] for d in range(200)]
    ids = e.encode(" ".join(["international"] * 400), 1).tolist()
    whole = Encoder(v, 5, 0.0).encode("international").tolist()
    assert len(ids) > 400 * len(whole)


def test_counts_after_forgetting(monkeypatch):
    """Counts don't depend on what a worker has stored, nor on the batches they come in."""
    monkeypatch.setattr("quoteflow.llm.token_counts.UNITS_HELD", 40)
    small = Counter(vocabulary())
    words = [f" w{i % 7}ord é{i}" + "漢" * (i % 5) for i in range(200)] + [" " + "long" * 60]
    right = [plain_count(COUNTER, w) for w in words]
    assert [n for w in words * 2 for n in small.counts([units(w)])] == right * 2
    assert len(small.known) <= 43 and small.before
    assert Counter(vocabulary()).counts([units(w) for w in words]) == right


def test_hashes_of_many_are_xxhash():
    r = np.random.default_rng(1)
    for n in range(4, 17):
        xs = [r.bytes(n) for _ in range(50)]
        seeds = r.integers(0, 1 << 64, 50, dtype=np.uint64)
        number = lambda x: int.from_bytes(x, "little")
        if n <= 8:
            got = hash8(np.array([number(x[-4:]) + (number(x[:4]) << 32) for x in xs], np.uint64), np.uint64(n), seeds)
        else:
            got = hash16(*(np.array([number(x[c]) for x in xs], np.uint64) for c in (slice(8), slice(-8, None))), np.uint64(n), seeds)
        assert got.tolist() == [xxhash.xxh3_64_intdigest(x, s) for x, s in zip(xs, seeds.tolist())]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_texts_are_merged_together(monkeypatch, rate):
    """Units of all texts are merged at once, not one by one, and as each would be by itself, forgetting or not."""
    monkeypatch.setattr("quoteflow.llm.merge_dropout.HELD", 300)
    monkeypatch.setattr("quoteflow.llm.merge_dropout.RUN", 100)
    r = random.Random(3)
    words = ["the", "international", "thermodynamics", "é漢", "▁the", "x", "a\nb", "", "Straße", "😀", "привет", "k" * 200, "ab" * 60]
    texts = [" ".join(r.choices(words, k=30)) for _ in range(40)] + [""]
    v = vocabulary()
    e, alone = Encoder(v, 5, rate), []
    for k, t in enumerate(texts):
        first = xxhash.xxh3_64_intdigest(f"5:{k}".encode())
        alone.append([i for n, u in enumerate(units(t)) for i in
                      e._merged(u, xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), first))[0]])
    one_by_one, calls = e._merged, []
    monkeypatch.setattr(e, "_merged", lambda u, draw: calls.append(u) or one_by_one(u, draw))
    assert [x.tolist() for x in e.encode_all(texts, list(range(len(texts))))] == alone
    assert all(len(u) > 128 for u in calls)
