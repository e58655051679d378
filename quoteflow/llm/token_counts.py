"""Operator 7: token counts by dynamic programming shared in a trie.

Texts are cut into pre-tokens (a run of spaces and what follows it). The distinct
pre-tokens of a batch whose counts aren't known yet go into a trie, which is made and
walked depth first by taking them in sorted order: only the path to the newest pre-token
is held. A trie node has the best unigram forward score of its prefix and that
segmentation's token count, computed from its parent once for all pre-tokens that
share the prefix; for that it carries the vocabulary pieces that have begun and can still
end, as places in a trie of the vocabulary. The last node's count is the pre-token's and
is stored. Piece probabilities fall with rank r as 1 / (r + 1) over the vocabulary; of
equal scores the one with fewer tokens counts. A character outside the vocabulary costs
one token per UTF-8 byte.

A worker keeps stored counts from task to task; when there are UNITS_HELD, those not met
since the time before are forgotten. Pre-tokens over LONG characters are scored the same
way, holding the last node only, and not stored. Nothing is shuffled.

Defined results: null and empty texts have no tokens; doc_ids pass through, null or
repeated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quoteflow.llm.common import read, slices, texts_of
from quoteflow.llm.pieces import MODEL, SPACE, Vocabulary, units, vocabulary

#: Counts that a worker stores, twice at most; the longest of their pre-tokens; characters worked on at a time.
UNITS_HELD, LONG, CHARS = 750_000, 128, 1 << 23


class Counter:
    """A trie node is (score, -tokens, living): living holds what an extension can still complete, the
    vocabulary node, score and -tokens of each piece's beginning, one after the other."""

    def __init__(self, v: Vocabulary):
        ranked = sorted(v.scores, key=lambda p: (-v.scores[p], v.ids[p]))
        norm = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        self.logp = {p: -math.log(r + 1) - norm for r, p in enumerate(ranked)}
        self.byte = -math.log(len(ranked) + 1) - norm
        self.longest = v.longest
        self.pieces: dict = {}                     # of every vocabulary node: character -> [its children, log probability]
        for p, logp in self.logp.items():
            children = self.pieces
            for c in p:
                node = children.setdefault(c, [{}, None])
                children = node[0]
            node[1] = logp
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def forward(self, node: tuple, c: str) -> tuple:
        """``node`` extended by ``c``."""
        s, k, living = node
        on = []
        begun = self.pieces.get(c)
        if begun is None or begun[1] is None:
            n = len(c.encode())
            best, tokens = s + n * self.byte, k - n
        else:
            best, tokens = s + begun[1], k - 1
        if begun is not None and begun[0]:
            on += (begun[0], s, k)
        if living:
            it = iter(living)
            for children, s, k in zip(it, it, it):
                piece = children.get(c)
                if piece is not None:
                    children, logp = piece
                    if logp is not None and (s + logp, k - 1) > (best, tokens):
                        best, tokens = s + logp, k - 1
                    if children:
                        on += (children, s, k)
        return best, tokens, on

    def learn(self, new: list[str]) -> None:
        """Store the counts of pre-tokens."""
        path, last, forward = [(0.0, 0, ())], "", self.forward
        for unit in sorted(new):
            w = unit.replace(SPACE, "\ue000").replace(" ", SPACE)
            shared, most = 0, min(len(w), len(last))
            while shared < most and w[shared] == last[shared]:
                shared += 1
            del path[shared + 1:]
            node = path[shared]
            for c in w[shared:]:
                node = forward(node, c)
                path.append(node)
            self.known[unit] = -node[1]
            last = w

    def counts(self, texts: list[list[str]]) -> list[int]:
        """Tokens of texts, which are given as lists of pre-tokens."""
        if len(self.known) > UNITS_HELD:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = list(set(chain.from_iterable(texts)).difference(known))
        known.update((u, before[u]) for u in new if u in before)
        long = [u for u in new if len(u) > LONG]
        known.update((u, self._long(u)) for u in long)
        self.learn([u for u in new if u not in known])
        out = [sum(map(known.__getitem__, units)) for units in texts]
        for u in long:
            del known[u]
        return out

    def _long(self, unit: str) -> int:
        node = (0.0, 0, ())
        for c in unit.replace(SPACE, "\ue000").replace(" ", SPACE):
            node = self.forward(node, c)
        return -node[1]


@lru_cache(maxsize=2)
def counter(file: str) -> Counter:
    """Kept by a worker from task to task."""
    return Counter(vocabulary(file))


@contextmanager
def collector_off():
    """Python's cyclic collector would walk the vocabulary and the path again and again; neither is cyclic."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def token_counts(docs: DataFrame, file: str = MODEL) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(file).counts
        for b in batches:
            texts, pre, tokens = b.column(1).to_pylist(), [], []
            for i, j in slices([len(t) for t in texts], CHARS):
                with collector_off():
                    cut = [units(t) for t in texts[i:j]]
                    pre += map(len, cut)
                    tokens += counts(cut)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["doc_id", "n_pretokens", "n_tokens"])

    return texts_of(docs).mapInArrow(part, "doc_id long, n_pretokens long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
