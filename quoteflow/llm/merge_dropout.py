"""Operator 10: SentencePiece encoding with seeded merge-dropout, and decoding.

A unit (a run of spaces and what follows it) starts as characters. An agenda holds
candidate merges of neighbours by piece score, then place. A candidate taken from the
agenda is skipped when the hash of (seed, document id, the unit's number, its place,
its piece) falls below the dropout rate; it is then gone for good. So every occurrence
of a word is cut by its own draws, and results do not depend on the partitioning. Which
candidate comes next follows from the unit and the decisions before it; that tree, which
no draw is part of, is kept as far as it was walked, up to HELD nodes. Rate 0 is the
model's own encoding.

Characters outside the vocabulary become byte tokens; so does a U+2581 of the text
itself, which else would come back as a space. Decoding is then exact for any text.

Defined results: null and empty texts have no tokens and decode to the empty text;
doc_ids pass through, null or repeated; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import crc32_u32, read, slices, texts_of
from quoteflow.llm.pieces import MODEL, SPACE, Vocabulary, units, vocabulary

SEED, RATE, HELD = 17, 0.1, 3_000_000
#: Units walked together, and the longest that is kept.
RUN, LONGEST = 1 << 17, 128
NEVER = 1 << 40
OWN = "\ue000"                  # a U+2581 of the text, and U+E000 itself: never merged


#: What the 64-bit XXH3 hash adds to its seed, for 4 to 8 and for 9 to 16 bytes, and its multipliers.
FLIP8, FLIP16 = 0x1CAD21F72C81017C ^ 0xDB979083E96DD4DE, (0x1F67B3B7A4A44072 ^ 0x78E5C0CC4EE679CB, 0x2172FFCC7DD05A82 ^ 0x8E2443F7744608B8)
MUL8, MUL16 = 0x9FB21C651E98DF25, 0x165667919E3779F9
U, LOW = np.uint64, np.uint64((1 << 32) - 1)


def turned(h: np.ndarray, n: int) -> np.ndarray:
    return (h << U(n)) | (h >> U(64 - n))


def hash8(x: np.ndarray, size, seed: np.ndarray) -> np.ndarray:
    """xxh3_64 of many inputs of 4 to 8 bytes (their last four, then their first four, as a number), each by its seed."""
    h = x ^ (U(FLIP8) - (seed ^ ((seed & LOW).astype(np.uint32).byteswap().astype(U) << U(32))))
    h ^= turned(h, 49) ^ turned(h, 24)
    h *= U(MUL8)
    h ^= (h >> U(35)) + size
    h *= U(MUL8)
    return h ^ (h >> U(28))


def hash16(x: np.ndarray, y: np.ndarray, size, seed: np.ndarray) -> np.ndarray:
    """xxh3_64 of many inputs of 9 to 16 bytes (their first eight, their last eight), each by its seed."""
    x, y = x ^ (U(FLIP16[0]) + seed), y ^ (U(FLIP16[1]) - seed)
    a, b, c, d = x & LOW, x >> U(32), y & LOW, y >> U(32)
    low, one, two = a * c, b * c, a * d
    cross = (low >> U(32)) + (one & LOW) + two
    high = (one >> U(32)) + (cross >> U(32)) + b * d
    h = size + x.byteswap() + y + ((x * y) ^ high)
    h ^= h >> U(37)
    h *= U(MUL16)
    return h ^ (h >> U(32))


class Merges:
    """What merging needs of a vocabulary, as tables: symbols are numbers of pieces and characters."""

    def __init__(self, v: Vocabulary):
        self.v = v
        names = list(dict.fromkeys([*v.scores, *"".join(v.scores)]))
        number = {p: i for i, p in enumerate(names)}
        rank = {x: i for i, x in enumerate(sorted({-x for x in v.scores.values()}))}
        self.order = np.array([rank[-v.scores[p]] << 8 if p in v.scores else NEVER for p in names], np.int64)
        self.names = [p.encode() for p in names]
        self.out = [np.array([v.ids[p]] if p in v.ids else [v.bytes[x] for x in p.encode()], "<u4").tobytes() for p in names]
        self.symbol = np.full(0x110000, -1, np.int32)        # of a code point
        for p, i in number.items():
            if len(p) == 1 and p not in (SPACE, OWN):
                self.symbol[ord(p)] = i
        if SPACE in number:
            self.symbol[ord(" ")] = number[SPACE]
        pairs = {(number[p[:i]] << 32) + number[p[i:]]: number[p] for p in v.scores for i in range(1, len(p))
                 if p[:i] in number and p[i:] in number and OWN not in (p[:i], p[i:])}
        self.bits = max(len(pairs) * 8, 2).bit_length()
        self.key, self.merged = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        key, to = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at = self._slot(key)
        while len(key):                                      # a taken slot sends a pair on to the next
            free = np.flatnonzero(self.key[at] < 0)
            self.key[at[free]], self.merged[at[free]] = key[free], to[free]
            left = (self.key[at] != key) | (self.merged[at] != to)
            key, to, at = key[left], to[left], (at[left] + 1) & ((1 << self.bits) - 1)
        # Candidates: place and piece. Of each, what is hashed; 1, 2: up to 8, 16 bytes, 3: longer.
        self.known = np.full((LONGEST, len(v.scores)), -1, np.int32)
        self.hashed: list[bytes] = []
        self.kind, self.size = np.zeros(0, np.uint8), np.zeros(0, U)
        self.x, self.y = np.zeros(0, U), np.zeros(0, U)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(U) * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def symbols(self, text: str) -> np.ndarray:
        """A character's symbol; one that is in no piece gets its own, and never merges."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        for c in np.unique(code[self.symbol[code] < 0]).tolist():
            c = chr(c)
            self.symbol[ord(c)] = len(self.out)
            self.out.append(np.array([self.v.bytes[x] for x in c.encode()], "<u4").tobytes())
        return self.symbol[code].astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that two neighbours merge to, or -1."""
        key = (a << 32) + b
        at = self._slot(key)
        there = self.key[at]
        to = np.where(there == key, self.merged[at], -1)
        on = np.flatnonzero((there != key) & (there >= 0))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            there = self.key[at[on]]
            to[on] = np.where(there == key[on], self.merged[at[on]], -1)
            on = on[(there != key[on]) & (there >= 0)]
        return to

    def candidates(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        c = self.known[place, symbol]
        if (c < 0).any():
            new = np.unique((place * self.known.shape[1] + symbol)[c < 0])
            self.known.reshape(-1)[new] = np.arange(len(self.hashed), len(self.hashed) + len(new))
            xs = [f"{k // self.known.shape[1]}:".encode() + self.names[k % self.known.shape[1]] for k in new.tolist()]
            self.hashed += xs
            n = np.array([len(x) for x in xs])
            number = lambda x: int.from_bytes(x, "little")
            self.kind = np.append(self.kind, np.where(n > 16, 3, np.where(n > 8, 2, np.where(n >= 4, 1, 3))).astype(np.uint8))
            self.size = np.append(self.size, n.astype(U))
            self.x = np.append(self.x, np.array([number(x[:8]) if len(x) > 8 else number(x[-4:]) + (number(x[:4]) << 32) for x in xs], U))
            self.y = np.append(self.y, np.array([number(x[-8:]) for x in xs], U))
            c = self.known[place, symbol]
        return c

    def skipped(self, c: np.ndarray, draws: np.ndarray, limit: int) -> np.ndarray:
        """Whether each occurrence skips its candidate."""
        kind, h = self.kind[c], np.empty(len(c), U)
        one, two = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        n = c[one]
        h[one] = hash8(self.x[n], self.size[n], draws[one])
        n = c[two]
        h[two] = hash16(self.x[n], self.y[n], self.size[n], draws[two])
        for i in np.flatnonzero(kind == 3).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.hashed[c[i]], int(draws[i]))
        return (h >> U(32)) < U(limit)

    def run(self, us: list[str], draws: np.ndarray, limit: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units of up to LONGEST characters, all merged at once, a decision of each at a time. Also their
        decisions, in order within a unit: the unit's number, the candidate, whether skipped."""
        n = np.array([len(u) for u in us], np.int64)
        width = int(n.max())
        inside = np.arange(width) < n[:, None]
        text = np.full((len(us), width), -1, np.int64)
        text[inside] = self.symbols("".join(us))
        merged = np.full(text.shape, -1, np.int64)
        there = inside[:, 1:]
        merged[:, :-1][there] = self.pairs(text[:, :-1][there], text[:, 1:][there])
        places = np.arange(width)
        order = np.where(merged >= 0, self.order[merged] + places, NEVER)
        before = np.broadcast_to(places - 1, text.shape).copy()
        after = np.broadcast_to(places + 1, text.shape).copy()
        text, merged, before, after, flat = (x.reshape(-1) for x in (text, merged, before, after, order))
        rows, row, cand, skip = np.arange(len(us)), [], [], []

        def propose(r: np.ndarray, a: np.ndarray, z: np.ndarray) -> None:
            at = r * width + a
            to = self.pairs(text[at], text[r * width + z])
            merged[at] = to
            flat[at] = np.where(to >= 0, self.order[to] + a, NEVER)

        while len(rows):
            a = order[rows].argmin(axis=1)
            open_ = flat[rows * width + a] < NEVER
            rows, a = rows[open_], a[open_]
            at = rows * width + a
            c = self.candidates(a, merged[at])
            no = self.skipped(c, draws[rows], limit)
            row.append(rows)
            cand.append(c)
            skip.append(no)
            flat[at[no]] = NEVER
            r, a, at = rows[~no], a[~no], at[~no]
            z = after[at]
            text[at], text[r * width + z], flat[r * width + z] = merged[at], -1, NEVER
            to = after[r * width + z]
            after[at], flat[at] = to, NEVER
            more = to < n[r]
            before[(r * width + to)[more]] = a[more]
            propose(r[more], a[more], to[more])
            b = before[at]
            more = b >= 0
            propose(r[more], b[more], a[more])
        text = text.reshape(-1, width)
        ends = np.cumsum((text >= 0).sum(axis=1)).tolist()
        ids = list(map(self.out.__getitem__, text[text >= 0].tolist()))
        row = np.concatenate(row)
        by = np.argsort(row, kind="stable")
        return ([b"".join(ids[x:y]) for x, y in zip([0, *ends], ends)], row[by], np.concatenate(cand)[by],
                np.concatenate(skip)[by].astype(np.int64))


@lru_cache(maxsize=2)
def merges(v: Vocabulary) -> Merges:
    return Merges(v)


class Encoder:
    """The tree as tables. A node is a candidate and the nodes if taken and if skipped; an end holds ids. All
    units of a run go down together, a level at a time; where the tree ends, they are merged together."""

    def __init__(self, v: Vocabulary, seed: int = SEED, rate: float = RATE):
        self.v, self.m, self.seed, self.limit = v, merges(v), seed, int(rate * (1 << 32))
        self.forget()

    def forget(self) -> None:
        self.held: dict[str, int] = {}                  # a unit's first node
        self.nodes = 1
        self.cand = np.full(1 << 16, -1, np.int32)      # -1: an end
        self.to = np.zeros((1 << 16, 2), np.int32)      # 0: not walked yet
        self.ids: list[bytes | None] = [None]

    def skipped(self, x: bytes, draw: int) -> bool:
        return self.limit and xxhash.xxh3_64_intdigest(x, draw) >> 32 < self.limit

    def unit(self, u: str, draw: int) -> tuple[int, ...]:
        """Ids of a unit; ``draw`` seeds the hashes of its candidates."""
        return tuple(np.frombuffer(self.walked([u], np.array([draw], U))[0], "<u4").tolist())

    def _keep(self, us: list[str], ids: list[bytes], edge: np.ndarray, depth: np.ndarray,
              row: np.ndarray, cand: np.ndarray, skip: np.ndarray) -> None:
        """Adds what lies behind ``edge`` (2 * node + side, or -1: a new unit) for units that share none."""
        n = np.bincount(row, minlength=len(us))
        start = n.cumsum() - n
        behind = np.arange(len(row)) - start[row] >= depth[row]
        size = n - depth + 1                            # with the end
        first = self.nodes + size.cumsum() - size
        last = first + size - 1
        total = self.nodes + int(size.sum())
        while len(self.cand) < total:
            self.cand = np.concatenate([self.cand, np.full_like(self.cand, -1)])
            self.to = np.concatenate([self.to, np.zeros_like(self.to)])
        row, cand, skip, step = row[behind], cand[behind], skip[behind], (np.arange(len(row)) - start[row])[behind]
        at = first[row] + step - depth[row]
        self.cand[at], self.to[at, skip] = cand, at + 1
        self.ids += [None] * (total - self.nodes)
        for i, x in zip(last.tolist(), ids):
            self.ids[i] = x
        old = edge >= 0
        self.to.reshape(-1)[edge[old]] = first[old]
        for i in np.flatnonzero(~old).tolist():
            self.held[us[i]] = int(first[i])
        self.nodes = total

    def walked(self, us: list[str], draws: np.ndarray) -> list[bytes]:
        """Ids, as bytes, of each unit by its own draws."""
        if self.nodes >= HELD:
            self.forget()
        get = self.held.get
        node = np.array([get(u, 0) for u in us], np.int64)
        edge, depth = np.full(len(us), -1, np.int64), np.zeros(len(us), np.int64)
        on, level = np.flatnonzero(self.cand[node] >= 0), 0
        while len(on):
            at, level = node[on], level + 1
            e = 2 * at + self.m.skipped(self.cand[at], draws[on], self.limit)
            to = self.to.reshape(-1)[e]
            node[on] = to
            out = to == 0
            edge[on[out]], depth[on[out]] = e[out], level
            on = on[self.cand[to] >= 0]
        ids = list(map(self.ids.__getitem__, node.tolist()))
        left = [i for i in np.flatnonzero(node == 0).tolist()]
        left.sort(key=lambda i: len(us[i]))
        short = [i for i in left if len(us[i]) <= LONGEST]
        for a, b in slices([len(us[i]) * len(us[i]) for i in short], RUN * 8):
            now = np.array(short[a:b])
            mine = [us[i] for i in short[a:b]]
            found, row, cand, skip = self.m.run(mine, draws[now], self.limit)
            for i, x in zip(short[a:b], found):
                ids[i] = x
            # One unit of those that left the tree at the same place, or are new and the same.
            new: dict = {}
            for k, (e, u) in enumerate(zip(edge[now].tolist(), mine)):
                if e >= 0:
                    if not self.to.reshape(-1)[e]:
                        new.setdefault(e, k)
                elif u not in self.held:
                    new.setdefault(u, k)
            one = np.array(sorted(new.values()), np.int64)
            if len(one):
                number = np.full(len(mine), -1, np.int64)
                number[one] = np.arange(len(one))
                mark = number[row] >= 0
                self._keep([mine[k] for k in one.tolist()], [found[k] for k in one.tolist()], edge[now[one]], depth[now[one]],
                           number[row[mark]], cand[mark], skip[mark])
        for i in left[len(short):]:
            ids[i] = np.array(self._merged(us[i], int(draws[i]))[0], "<u4").tobytes()
        return ids

    def _merged(self, u: str, draw: int) -> tuple[tuple[int, ...], list[tuple[bytes, bool]]]:
        """Of a unit by itself: ids, and the candidates in turn: the bytes that are hashed, whether skipped."""
        scores = self.v.scores
        text = [SPACE if c == " " else OWN if c == SPACE else c for c in u]
        n = len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, str, int]] = []
        path: list[tuple[bytes, bool]] = []

        def propose(a: int) -> None:
            z = after[a]
            if z < n and text[a] != OWN and text[z] != OWN:
                p = text[a] + text[z]
                if p in scores:
                    heapq.heappush(agenda, (-scores[p], a, p, z))

        for a in range(n - 1):
            propose(a)
        while agenda:
            _, a, p, z = heapq.heappop(agenda)
            if after[a] != z or text[a] is None or text[z] is None or text[a] + text[z] != p:
                continue
            x = f"{a}:{p}".encode()
            path.append((x, bool(self.skipped(x, draw))))
            if path[-1][1]:
                continue
            text[a], text[z] = p, None
            after[a] = after[z]
            if after[z] < n:
                before[after[z]] = a
            if before[a] >= 0:
                propose(before[a])
            propose(a)
        out = []
        for i, p in enumerate(text):
            if p is not None:
                if p in self.v.ids and p != OWN and not (p == SPACE and u[i] != " "):
                    out.append(self.v.ids[p])
                else:
                    out += [self.v.bytes[b] for b in u[i].encode()]
        return tuple(out), path

    def encode(self, text: str, key: int | None = None) -> np.ndarray:
        """Ids of a text; ``key`` (a document id) varies the segmentation."""
        return next(self.encode_all([text], [key]))

    def encode_all(self, texts: list[str], keys: list[int | None]) -> Iterator[np.ndarray]:
        """Ids of each text, by bounded runs of units."""
        for a, b in slices([len(t) for t in texts]):
            cut = [units(t) for t in texts[a:b]]
            n = np.array([len(us) for us in cut], np.int64)
            first = np.array([xxhash.xxh3_64_intdigest(f"{self.seed}:{k}".encode()) for k in keys[a:b]], U)
            number = (np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)).astype(U)
            draws = hash8((number >> U(32)) + (number << U(32)), U(8), np.repeat(first, n))
            us = list(chain.from_iterable(cut))
            ids = [x for i in range(0, len(us), RUN) for x in self.walked(us[i:i + RUN], draws[i:i + RUN])]
            at = 0
            for m in n.tolist():
                yield np.frombuffer(b"".join(ids[at:at + m]), "<u4")
                at += m


@lru_cache(maxsize=2)
def encoder(file: str, seed: int, rate: float) -> Encoder:
    """Kept by a worker from task to task."""
    return Encoder(vocabulary(file), seed, rate)


def decode(v: Vocabulary, ids) -> str:
    """The text of ids: exact for what Encoder.encode gives."""
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    return b"".join(map(v.text_of.__getitem__, ids)).decode()[1:]


def encoded(docs: DataFrame, file: str = MODEL, seed: int = SEED, rate: float = RATE, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, lossless and, with keep_ids, ids."""
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"] + ["ids"] * keep_ids

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(file, seed, rate)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                s = b.slice(a, 256)
                texts = s.column(1).to_pylist()
                ids = list(e.encode_all(texts, s.column(0).to_pylist()))
                back = [decode(e.v, x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([crc32_u32(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                     pa.array([t == x for t, x in zip(back, texts)], pa.bool_())]
                    + [pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32()))] * keep_ids, names=names)

    return texts_of(docs).mapInArrow(part, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"
                                     + ", ids array<int>" * keep_ids)


def decoded(rows: DataFrame, file: str = MODEL) -> DataFrame:
    """doc_id and text from rows of doc_id and ids."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(v, x or ()) for x in b.column(1).to_pylist()], pa.string())],
                                             names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(part, "doc_id long, text string")


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), keep_ids=False)
