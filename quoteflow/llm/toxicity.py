"""Operator 6: toxicity by Levenshtein automata over a lexicon trie.

Fitting: distinct word stems (prefixes, and whole words ending in "$") of at most
SAMPLE labelled training documents, the ones with the smallest id hashes, are
counted by label; near copies count once (one minimum hash of their words). Stems
whose log-likelihood ratio against the base rate exceeds MIN_EVIDENCE and that
toxic documents hold mostly are the lexicon, by falling ratio, one of those
that begin each other. All text statistics come from that sample; every document is scored.

Scoring: the lexicon's trie is intersected with the Levenshtein automaton
(distance 1, a swap of neighbouring letters being one edit) of each word; entries of
FUZZY_FROM letters or more also match misspelled, whole entries the whole word and
prefixes any beginning of it. A hit weighs the log-odds of toxic among the training documents that hold
its entry over those of all, for a misspelling times the share of toxic documents
among those with its misspellings alone, times its context: in a window of CONTEXT characters to each
side, quotation marks around the hit and words of reporting lower it. A logistic
curve, fitted to the sample's strengths in BINS bins, turns a document's sum into its score.

Defined results: null text is empty; null doc_ids are not held out; without
labelled toxic documents all scores are the base rate; repeated labels of a
document: toxic if one is; other columns are kept or ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import read, stage, texts_of

SAMPLE = 16_000
MIN_EVIDENCE, MIN_SHARE, MAX_STEMS = 14.0, 0.5, 20_000
BINS, STRONGEST = 100, 20.0
STEM_FROM, STEM_TO, WORD_TO = 3, 12, 24
FUZZY_FROM, CONTEXT, THRESHOLD = 5, 60, 0.3
WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»]")
REPORTING = frozenset("said says wrote writes quoted quote called cited reported dijo escribió sagte schrieb dit écrit".split())
WORDS_HELD = 400_000


def stems(word: str) -> list[str]:
    out = [word[:k] for k in range(STEM_FROM, min(len(word), STEM_TO) + 1)]
    return out + [word + "$"] if len(word) <= WORD_TO else out


class Trie:
    """Lexicon entries; a node is a dict, its "" holds the entry."""

    def __init__(self, entries: dict[str, float], swaps: bool = False):
        self.swaps = swaps                     # a swap of neighbouring letters is one edit
        self.root: dict = {}
        for e in entries:
            node = self.root
            for c in e:
                node = node.setdefault(c, {})
            node[""] = e
        self.held: dict[str, tuple] = {}

    def match(self, word: str) -> tuple:
        """(entry, distance) of the exact hit, else of a misspelled one, else ()."""
        if word not in self.held:
            if len(self.held) >= WORDS_HELD:
                self.held.clear()
            self.held[word] = self._match(word + "$")
        return self.held[word]

    def _match(self, w: str) -> tuple:
        node, found = self.root, None
        for c in w:
            node = node.get(c)
            if node is None:
                break
            found = node.get("", found)
        if found:
            return found, 0
        if len(w) - 1 >= FUZZY_FROM - 1:
            return self._fuzzy(w)
        return ()

    def _fuzzy(self, w: str) -> tuple:
        """States of the automaton are (letters of w read, edits, letter due): a
        letter is due after the first of two swapped ones. A whole entry accepts at
        the end of w, a prefix after any of its letters. Whole entries go first."""
        todo, hits = [(self.root, frozenset([(0, 0, ""), (1, 1, "")]))], []
        while todo:
            node, states = todo.pop()
            entry = node.get("")
            if entry and len(entry.rstrip("$")) >= FUZZY_FROM and any(
                    not due and (i == len(w) or entry[-1] != "$") for i, _, due in states):
                hits.append(entry)
            for c, child in node.items():
                if c:
                    to = set()
                    for i, e, due in states:
                        if due:
                            if c == due:
                                to.add((i + 2, 1, ""))
                        elif i < len(w) and w[i] == c:
                            to.add((i + 1, e, ""))
                            if not e and i + 2 < len(w):
                                to.add((i + 2, 1, ""))      # the next letter of w is one too many
                        elif not e and c != "$":
                            to.add((i, 1, ""))              # a letter left out
                            if i + 1 < len(w):
                                to.add((i + 1, 1, ""))      # a letter changed
                                if self.swaps and w[i + 1] == c:
                                    to.add((i, 1, w[i]))    # swapped with the next
                    if to:
                        todo.append((child, frozenset(to)))
        return (min(hits, key=lambda x: (x[-1] != "$", x)), 1) if hits else ()


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=dict)    # share of toxic documents among those with it
    fuzzy: dict[str, float] = field(default_factory=dict)      # the same for misspelled hits, where seen
    base: float = 0.1                                          # share of toxic documents
    curve: tuple[float, float] = (-4.0, 1.0)                   # of the logistic curve


def context_factor(text: str, a: int, z: int) -> float:
    """Below 1 where the words around text[a:z] look like a quotation."""
    before, after = text[max(0, a - CONTEXT):a], text[z:z + CONTEXT]
    quoted = len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after) is not None
    reported = not REPORTING.isdisjoint(WORD.findall(before) + WORD.findall(after))
    return (0.4 if quoted else 1.0) * (0.6 if quoted and reported else 1.0)


def odds(share: float) -> float:
    return math.log(share / (1.0 - share))


def strength(text: str, model: Model, trie: Trie) -> float:
    """The sum of a document's hits, STRONGEST at most."""
    low, total = (text or "").lower(), 0.0
    for w in sorted(set(WORD.findall(low))):
        if m := trie.match(w):
            share = model.entries[m[0]]
            weight = max(0.0, odds(share) - odds(model.base)) * (model.fuzzy.get(m[0], 0.5) if m[1] else 1.0)
            for at in re.finditer(rf"(?<![^\W_]){w}(?![^\W_])", low):
                total += weight * context_factor(low, *at.span())
                if total >= STRONGEST:
                    return STRONGEST
    return total


def logistic(x: float, curve: tuple[float, float]) -> float:
    return 1.0 / (1.0 + math.exp(-(curve[0] + curve[1] * x)))


def score(text: str, model: Model, trie: Trie) -> float:
    return logistic(strength(text, model, trie), model.curve)


def fit_curve(bins: list[tuple[float, int, int]], steps: int = 60) -> tuple[float, float]:
    """Newton steps on (strength, documents, toxic ones), with a weak prior."""
    a, b = -2.0, 1.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = -0.01 * a, -0.01 * (b - 1.0), 0.01, 0.0, 0.01
        for x, n, t in bins:
            p = logistic(x, (a, b))
            ga, gb = ga + t - n * p, gb + (t - n * p) * x
            h = n * p * (1.0 - p)
            haa, hab, hbb = haa + h, hab + h * x, hbb + h * x * x
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a + da / size, b + db / size
    return a, b


def select(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """The lexicon: stems by falling evidence, unless a chosen one begins them
    or begins with them."""
    out: dict[str, float] = {}
    barred: set[str] = set()                   # what begins a chosen stem
    for s, (pos, neg) in counts.items():
        begins = {s[:k] for k in range(1, len(s) + 1)}
        if s not in barred and not any(x in out for x in begins):
            out[s] = (pos + 0.5) / (pos + neg + 1.0)
            barred |= begins
    return out


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the sample, near copies once. The ids of the sample
    are SAMPLE rows at most, which is what the broadcast holds."""
    seen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
            .where("toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    return texts_of(docs).join(F.broadcast(seen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for t in b.column(0).to_pylist():
                words = set(WORD.findall(t.lower()))
                keys.append(str(min((xxhash.xxh3_64_intdigest(w.encode()) for w in words), default=-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys)], names=["text", "toxic", "key"])

    sample = (training(docs, labels).mapInArrow(keyed, "text string, toxic int, key string")
              .groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    sample = stage(sample, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, neg = Counter(), Counter()
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = set()
                for w in set(WORD.findall(t.lower())):
                    found.update(stems(w))
                (pos if toxic else neg).update(found)
            every = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_pydict({"stem": every, "pos": [pos[s] for s in every], "neg": [neg[s] for s in every]},
                                             pa.schema([("stem", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not total["toxic"] or total["toxic"] == total["n"]:
        return Model(curve=(odds((total["toxic"] + 0.01) / (total["n"] + 0.03)), 0.0))
    base = total["toxic"] / total["n"]
    share = (F.col("pos") + 0.01) / (F.col("pos") + F.col("neg") + 0.02)
    evidence = F.col("pos") * F.log(share / base) + F.col("neg") * F.log((1 - share) / (1 - base))
    found = (sample.mapInArrow(count, "stem string, pos long, neg long").groupBy("stem")
             .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("evidence", evidence)
             .where((F.col("evidence") > MIN_EVIDENCE) & (share >= MIN_SHARE))
             .orderBy(F.desc("evidence"), F.desc(F.length("stem")), "stem").limit(MAX_STEMS).collect())    # a bounded lexicon
    entries = select({r["stem"]: (r["pos"], r["neg"]) for r in found})

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(entries, swaps=True)
        for b in batches:
            pairs = []
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits = {trie.match(w) for w in set(WORD.findall(t.lower()))} - {()}
                if all(d for _, d in hits):
                    pairs += [(e, toxic) for e, _ in hits]
            yield pa.RecordBatch.from_pydict({"entry": [x for x, _ in pairs], "toxic": [x for _, x in pairs]},
                                             pa.schema([("entry", pa.string()), ("toxic", pa.int32())]))

    fuzzy = {r["entry"]: (r["t"] + 0.5) / (r["n"] + 1.0)
             for r in sample.mapInArrow(outcome, "entry string, toxic int").groupBy("entry")
             .agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    model = Model(entries, fuzzy, base)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(entries, swaps=True)
        for b in batches:
            xs = [round(strength(t, model, trie) * BINS / STRONGEST) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int32()), b.column(1)], names=["bin", "toxic"])

    bins = (sample.mapInArrow(strengths, "bin int, toxic int").groupBy("bin")
            .agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).orderBy("bin").collect())
    model.curve = fit_curve([(r["bin"] * STRONGEST / BINS, r["n"], r["t"]) for r in bins])
    return model


def scorer(model: Model):
    """A column function: text -> score."""
    held: list = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Trie(model.entries, swaps=True))
        return pd.Series([score(t, model, held[0]) for t in texts], dtype="float64")

    return scored


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    return docs.where(scorer(fit(docs, labels))(F.coalesce(F.col("text"), F.lit(""))) < THRESHOLD)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    return (texts_of(docs).select("doc_id", held_out.alias("held_out"), scorer(model)("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
