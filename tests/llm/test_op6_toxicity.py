"""Toxicity: automaton against edit distance, context, held-out accuracy."""

import zlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoteflow.llm.toxicity import Model, Trie, clean, fit, op6_toxicity, score, scorer

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text("abc", min_size=5, max_size=7), st.text("abc", min_size=4, max_size=8))
def test_automaton_is_edit_distance_one(entry, word):
    got = Trie({entry + "$": 1.0}).match(word)
    d = distance(entry, word)
    assert got == ((entry + "$", d) if d <= 1 else ())


@given(st.text("abc", min_size=5, max_size=7), st.text("abc", min_size=4, max_size=9))
def test_swaps_and_prefixes(entry, word):
    def swapped(a, b):
        return any(a[:i] + a[i + 1] + a[i] + a[i + 2:] == b for i in range(len(a) - 1))

    def near(a, b):
        return distance(a, b) <= 1 or swapped(a, b)

    assert bool(Trie({entry + "$": 1.0}, swaps=True).match(word)) == near(entry, word)
    got = Trie({entry: 1.0}, swaps=True).match(word)
    assert bool(got) == any(near(entry, word[:k]) for k in range(len(word) + 1))
    assert not got or got[1] == (not word.startswith(entry))


def test_stems_and_context():
    m = Model({"moron$": 0.98, "lowei": 0.95}, {"moron$": 0.9}, 0.1, (-3.5, 1.2))
    t = Trie(m.entries)
    assert score("you MORON, go", m, t) > 0.9 and score("you mor0n", m, t) > 0.8 and score("die loweikeit", m, t) > 0.8
    assert score('he said "you moron" and left', m, t) < 0.3
    assert score("", m, t) == score(None, m, t) < 0.1


def test_held_out_accuracy(spark):
    got = op6_toxicity(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    y = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    tp, fp, fn = (y.where(c).count() for c in ("predicted = 1 and toxic = 1", "predicted = 1 and toxic = 0",
                                               "predicted = 0 and toxic = 1"))
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.85      # measured: 0.99 and 0.88


def test_odd_rows(spark):
    rows = [(i, f"word{i} you idiot{' very bad' * (i % 7)} x{i}", 1) for i in range(60)]
    rows += [(i, f"word{i} nice prose y{i}", 0) for i in range(60, 400)] + [(900, None, 0), (901, "", 0), (None, "idiot", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit("s"))
    labels = df.select("doc_id", "toxic")
    m = fit(df, labels)
    assert "idiot$" in m.entries
    left = clean(df, labels)
    assert left.columns == df.columns and left.count() == 342
    assert fit(df, labels.where("false")).entries == {} and clean(df.where("false"), labels).count() == 0
    assert clean(df, labels.where("toxic = 0")).count() == df.count()
    assert scorer(m) is not None


def test_misspelled_prefix_entries(spark):
    """Inflected toxic terms are learned as a prefix; their misspelled forms in held-out rows score as toxic."""
    ends = ["ta", "ten", "tos", "ke", "kung", "mal"]
    rows = [(i, f"word{i} you zorbachl{ends[i % 6]} x{i}", 1) for i in range(80)]
    rows += [(i, f"word{i} you nice prose y{i}", 0) for i in range(80, 400)]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    forms = ["zorbahclta", "zorbxchlten", "zrbachlkung", "zorbaachlmal", "ozrbachlke"]     # swapped, changed, left out, too many
    planted = {i: forms[n % 5] for n, i in enumerate(held[:20])}
    rows += [(i, f"word{i} you {w} z{i}", 1) for i, w in planted.items()]
    rows += [(i, f"word{i} you calm prose z{i}", 0) for i in held[20:40]]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = fit(df, df.select("doc_id", "toxic"))
    assert "zorbachl" in m.entries
    left = {r["doc_id"] for r in clean(df, df.select("doc_id", "toxic")).collect()}
    assert not left & planted.keys() and set(held[20:40]) <= left
