"""Operator 12: chat formatting in budgeted windows.

1. Every turn is put into the template and its tokens are counted where the table is
   read, so the heavy work doesn't depend on how large a conversation is.
2. Turns are dealt by conversation and sorted within the partitions (Spark's external
   sort). One pass over the sorted rows holds the system turn, the turns of the
   window being filled and the history before it: at most the budget and one turn.
3. Prefix sums of the turns' tokens choose turn-aligned spans: a window takes turns
   while the system turn, the history and the span fit BUDGET. Every window
   begins with the conversation's system turn (its first turn, where that has the role
   ``system``) and the latest earlier turns that fit HISTORY tokens. Repeated turns are
   counted in ``n_repeated`` and have no target: each assistant text is one in one window.

A turn is ``### role:\\n text </turn>\\n`` without the spaces. Within texts, and roles, every
backslash and every control string gets a backslash in front (``escape``), which
``unescape`` takes away, so any text can be read back.

A conversation is formatted in the order of its turns by one task, as windows follow from those
before; the task streams it, whatever its length, and never holds it whole.

Defined results: a null role or text is an empty one; null turns come first, equal turns
by role, then template text; repeated rows are turns of their own; a turn that is larger than the
budget has a window to itself, with the system turn and no history (``tokens`` tells); texts of
any length are whole; rows with a null conv_id are one conversation; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import read

BUDGET, HISTORY = 2048, 256
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Characters counted at a time: a longer turn is counted in parts, cut before white space where there is some.
COUNTED = 1 << 16
ROWS_OUT, CHARS_OUT = 1024, 4 << 20

OPEN, NAMED, CLOSE = "### ", ":\n", "</turn>"
IN_TEXT = re.compile(r"\\|### |</turn>")
IN_ROLE = re.compile(r"[\\:]|### |</turn>")
ESCAPED = re.compile(r"\\(.)", re.S)

TURNS = "conv_id long, turn long, piece string, body_at int, body_chars int, role string, tokens long"
WINDOWS = ("conv_id long, window long, text string, tokens long, n_repeated int, "
           "loss array<struct<start:int,chars:int>>")


def escape(s: str, controls: re.Pattern = IN_TEXT) -> str:
    return controls.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return ESCAPED.sub(r"\1", s)


def _find(text: str, what: str, at: int) -> int:
    """The first ``what`` from ``at`` on that is not escaped."""
    while True:
        i = text.index(what, at)
        k = i
        while k > at and text[k - 1] == "\\":
            k -= 1
        if (i - k) % 2 == 0:
            return i
        at = i + 1


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of a window's turns."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        a = _find(text, NAMED, at + len(OPEN))
        z = _find(text, CLOSE, a + len(NAMED))
        out.append((unescape(text[at + len(OPEN):a]), unescape(text[a + len(NAMED):z])))
        at = z + len(CLOSE) + 1
    return out


@lru_cache(maxsize=2)
def encoding(file: str):
    import base64

    import public_tokenizers
    import tiktoken

    path = file if os.path.isabs(file) else public_tokenizers.path(file)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(enc, text: str, limit: int = COUNTED) -> int:
    n, a = 0, 0
    while a < len(text):
        z = a + limit
        if z < len(text):
            cut = max(text.rfind(" ", a + 1, z), text.rfind("\n", a + 1, z))
            z = cut if cut > a else z
        n += len(enc.encode_ordinary(text[a:z]))
        a = z
    return n


def formatted_turns(conversations: DataFrame, tokenizer_file: str = TOKENIZER) -> DataFrame:
    """Every turn in the template, where its text is, and its tokens."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer_file)
        for b in batches:
            pieces, at, chars, tokens = [], [], [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                head, body = f"{OPEN}{escape(role, IN_ROLE)}{NAMED}", escape(text)
                pieces.append(f"{head}{body}{CLOSE}\n")
                at.append(len(head))
                chars.append(len(body))
                tokens.append(count_tokens(enc, pieces[-1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(pieces, pa.string()), pa.array(at, pa.int32()),
                 pa.array(chars, pa.int32()), b.column(2), pa.array(tokens, pa.int64())],
                names=["conv_id", "turn", "piece", "body_at", "body_chars", "role", "tokens"])

    words = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *words).mapInArrow(put, TURNS)


class Windows:
    """The windows of one conversation, from its turns in order."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system = None
        self.held: list[tuple] = []        # history, then the span
        self.upto = [0]                    # prefix sums: tokens before each held turn and after the last
        self.n_history = self.window = 0
        self.first = True

    def _room(self) -> int:
        return self.budget - (self.system[4] if self.system else 0)

    def add(self, turn: tuple):
        """Take (piece, body_at, body_chars, role, tokens); gives the window that this turn ends, if any."""
        if self.first and turn[3] == "system":
            self.system, self.first = turn, False
            return None
        done = None
        if len(self.held) > self.n_history and self.upto[-1] - self.upto[0] + turn[4] > self._room():
            done = self._window()
            # the latest turns of at most ``history`` tokens
            self._keep_from(bisect_left(self.upto, self.upto[-1] - self.history))
        if len(self.held) == self.n_history:                   # a span begins: its first turn goes before history
            self._keep_from(min(bisect_left(self.upto, self.upto[-1] + turn[4] - self._room()), len(self.held)))
        self.first = False
        self.held.append(turn)
        self.upto.append(self.upto[-1] + turn[4])
        return done

    def _keep_from(self, k: int) -> None:
        self.held, self.upto = self.held[k:], self.upto[k:]
        self.n_history = len(self.held)

    def _window(self):
        fixed = [self.system] if self.system else []
        turns = fixed + self.held
        # the system turn is new in the first window
        repeated = self.n_history + (len(fixed) if self.window else 0)
        at, loss = 0, []
        for i, (piece, body_at, chars, role, _) in enumerate(turns):
            if i >= repeated and role == "assistant":
                loss.append({"start": at + body_at, "chars": chars})
            at += len(piece)
        out = (self.conv_id, self.window, "".join(t[0] for t in turns), sum(t[4] for t in turns), repeated, loss)
        self.window += 1
        return out

    def last(self):
        return self._window() if len(self.held) > self.n_history or (self.system and not self.window) else None


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                 tokenizer_file: str = TOKENIZER) -> DataFrame:
    """conv_id, window, text, tokens, n_repeated (turns at the window's beginning that
    earlier windows hold) and loss (spans of code points of ``text``), the windows of a conversation
    in order within one partition."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("tokens", pa.int64()),
                            ("n_repeated", pa.int32()),
                            ("loss", pa.list_(pa.struct([("start", pa.int32()), ("chars", pa.int32())])))])
        now, out, held = None, [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            c = [b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)]
            for conv_id, *turn in zip(*c):
                done = []
                if now is None or now.conv_id != conv_id:
                    done.append(now and now.last())
                    now = Windows(conv_id, budget, history)
                done.append(now.add(tuple(turn)))
                for w in filter(None, done):
                    out.append(w)
                    held += len(w[2])
                if len(out) >= ROWS_OUT or held >= CHARS_OUT:
                    yield rows()
                    out, held = [], 0
        w = now and now.last()
        if w:
            out.append(w)
        if out:
            yield rows()

    return (formatted_turns(conversations, tokenizer_file).repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "piece").mapInArrow(fill, WINDOWS))


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, from their texts and masks alone. ``windows``
    are those of ``chat_windows``, in its order."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        at, out = None, []

        def done():
            if at:
                conv_id, _, n, turns, chars, loss, size = at
                out.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            c = [b.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
            for conv_id, window, text, repeated, loss in zip(*c):
                if window == 0:
                    done()
                    at = [conv_id, 0, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if at is None or at[:2] != [conv_id, window]:
                    raise ValueError("windows out of order")
                at[1] += 1
                for role, said in parse(text)[repeated:]:
                    at[2] += 1
                    at[3].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    said = unescape(text[s["start"]:s["start"] + s["chars"]])
                    at[4] += len(said)
                    at[5].update(said.encode())
                at[6] += len(text)
            if len(out) >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return windows.mapInArrow(take, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                    "loss_sha256 string, formatted_chars long")


#: The text of the conversation that the query adds, in both of its turns.
ADDED = "\\### Assistant: </turn> ok"


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-7, 0, "user", ADDED), (-7, 1, "assistant", ADDED)],
                                  "conv_id long, turn long, role string, text string")
    given = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"),
                                                        F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(chat_windows(given.unionByName(added)))
