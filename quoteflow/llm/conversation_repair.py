"""Operator 11: conversation structure repair by survivor-coalescence Viterbi.

A conversation's role initials must read ``(s?(ua)+)?``. Its automaton has four states: START
(nothing yet), S (after a system turn), U and A (after a user or an assistant turn); START and A
may end. Rows are kept (0), given the role user or assistant (2) or deleted (3, required for blank
and duplicate rows); empty turns are inserted (2); undeleted truncated rows add 1.

The pass over a conversation's sorted rows keeps one survivor a state: the cheapest edits that
lead there, of equally cheap ones those with the least string of initials (D, I, K, R). Survivors
are nodes of a backpointer tree. Two tied paths are compared from their common ancestor on,
the whole of what is unresolved, so the choice is exact: of two equally dear paths to one
state neither is the beginning of the other, as what is more would be insertions, which cost. Nodes count
their references; a node that nothing refers to goes, and when the root has one child left and
is no survivor itself, all survivors share that child: its edit is emitted and it is the new root.
Survivors that can't win any more are dropped (START where A is cheaper by over 3, the most that a
system row can save; S where A is better, as S has no way on that A lacks), so what
is unresolved is a few rows unless a conversation keeps equally dear ways open.

Spark finds duplicates (a row number by role, text digest) and sorts; both spill. A conversation is
repaired in order by one task, which streams it: the choice of least initials and the digest of
the repaired text go from front to back. One shuffle serves both, as it is by conversation.

Defined results: null values count as one space; rows go by turn, nulls first, equal turns by role,
then text; rows equal in role and text after the first are duplicates, blank ones blank; roles other
than system, user and assistant are given one or deleted, by their first letter; texts of any length
are whole; rows with a null conv_id are one conversation; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import read

START, S, U, A = range(4)
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What each role initial leads to, by state.
NEXT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
ROLE = {U: "user", A: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
ROWS_OUT, CHARS_OUT = 2048, 4 << 20

EDITS = "conv_id long, at long, edit string, cost int, turn long, fault string, was string, role string, text string"


class Node:
    """An edit at the end of a path. kids and survivors are its references."""

    __slots__ = ("up", "letter", "cost", "row", "role", "kids", "survivors", "depth")

    def __init__(self, up, letter, cost, row, role):
        self.up, self.letter, self.cost, self.row, self.role = up, letter, cost, row, role
        self.kids: list[Node] = []
        self.survivors = 0
        self.depth = up.depth + 1 if up else 0


def unresolved(a: tuple, b: tuple) -> tuple[str, str]:
    """The initials of two paths, each a node and one letter more, after their common ancestor."""
    (m, x), (n, y) = a, b
    p, q = [x], [y]
    while m is not n:
        if m.depth >= n.depth:
            p.append(m.letter)
            m = m.up
        else:
            q.append(n.letter)
            n = n.up
    return "".join(reversed(p)), "".join(reversed(q))


class Repair:
    """The edits of one conversation, from its rows in order."""

    def __init__(self):
        self.root = Node(None, "", 0, None, None)
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.root.survivors = 1
        self.most = 0                      # unresolved rows at once, for tests
        self._insertions()

    def _better(self, found, cost, up, letter):
        """Whether the path through ``up`` with ``letter`` beats what was found for a state."""
        if found is None or cost != found[0]:
            return found is None or cost < found[0]
        new, old = unresolved((up, letter), (found[1], found[2]))
        return new < old

    def _settle(self, found: dict[int, tuple]) -> None:
        """Make the chosen paths (cost, up, letter, added, row, role) the survivors."""
        last, self.best = self.best, {}
        for state, (cost, up, letter, added, row, role) in found.items():
            if letter:
                node = Node(up, letter, added, row, role)
                up.kids.append(node)
            else:
                node = up
            node.survivors += 1
            self.best[state] = (cost, node)
        for _, node in last.values():
            node.survivors -= 1
            self._release(node)

    def _release(self, node: Node) -> None:
        while not node.survivors and not node.kids and node is not self.root:
            up, node.up = node.up, None
            up.kids.remove(node)
            node = up

    def _insertions(self) -> None:
        """Insert a turn where that is the cheapest way into a state; then drop who can't win."""
        found = {s: (c, n, "", 0, None, None) for s, (c, n) in self.best.items()}
        self._settle(found)
        for to, sources in ((U, (START, S, A)), (A, (U,))):
            found = {s: (c, n, "", 0, None, None) for s, (c, n) in self.best.items()}
            for s in sources:
                if s in self.best:
                    cost, up = self.best[s][0] + INSERT, self.best[s][1]
                    if self._better(self._path(found.get(to)), cost, up, "I"):
                        found[to] = (cost, up, "I", INSERT, None, ROLE[to])
            self._settle(found)
        c_a = self.best[A][0] if A in self.best else None
        gone = []
        if c_a is not None and START in self.best and self.best[START][0] > c_a + DELETE:
            gone.append(START)
        if c_a is not None and S in self.best:
            c, n = self.best[S]
            if c > c_a or c == c_a and self._older(self.best[A][1], n):
                gone.append(S)
        for s in gone:
            _, n = self.best.pop(s)
            n.survivors -= 1
            self._release(n)

    def _older(self, m: Node, n: Node) -> bool:
        a, b = unresolved((m, ""), (n, ""))
        return a < b

    @staticmethod
    def _path(x):
        return None if x is None else (x[0], x[1], x[2])

    def add(self, row: tuple, initial: str, must_go: bool, truncated: bool) -> list[Node]:
        """Take a row; gives the edits that are now settled."""
        found: dict[int, tuple] = {}

        def offer(state, cost, up, letter, added, role):
            if self._better(self._path(found.get(state)), cost, up, letter):
                found[state] = (cost, up, letter, added, row, role)

        more = TRUNCATED if truncated else 0
        for state, (cost, up) in self.best.items():
            offer(state, cost + DELETE, up, "D", DELETE, None)
            if must_go:
                continue
            to = NEXT.get(initial, {}).get(state)
            if to is not None:
                offer(to, cost + more, up, "K", more, None)
            to = A if state == U else U
            offer(to, cost + RELABEL + more, up, "R", RELABEL + more, ROLE[to])
        self._settle(found)
        self._insertions()
        return self._emit()

    def _emit(self) -> list[Node]:
        out = []
        while not self.root.survivors and len(self.root.kids) == 1:
            root, self.root = self.root, self.root.kids[0]
            root.kids, self.root.up = [], None
            out.append(self.root)
        if self.best:
            self.most = max(self.most, max(n.depth for _, n in self.best.values()) - self.root.depth)
        return out

    def finish(self) -> list[Node]:
        """The rest of the cheapest edits that end in START or A."""
        ends = [self.best[s] for s in (START, A) if s in self.best]
        end = ends[0]
        for e in ends[1:]:
            if e[0] < end[0] or e[0] == end[0] and self._older(e[1], end[1]):
                end = e
        out, n = [], end[1]
        while n is not self.root:
            out.append(n)
            n = n.up
        return out[::-1]


def repair(conversations: DataFrame) -> DataFrame:
    """Every edit of every conversation, in order (``at``) within one partition: its initial, its cost, the
    row's turn, fault (blank, duplicate, truncated or none) and role as it was, and the repaired role and
    text (null: deleted)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    end = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    same = Window.partitionBy("conv_id", "said").orderBy("turn")
    fault = (F.when(end == "", "blank").when(F.row_number().over(same) > 1, "duplicate")
             .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated"))
    rows = (rows.repartition("conv_id").withColumn("fault", fault).drop("said")
            .sortWithinPartitions("conv_id", "turn", "role", "text"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4]
        names = [x.split()[0] for x in EDITS.split(", ")]
        now, conv_id, at, out, held = None, None, 0, [], 0

        def take(nodes):
            nonlocal at, held
            for n in nodes:
                turn, role, text, fault = n.row or (None, None, "", None)
                gone = n.letter == "D"
                out.append((conv_id, at, n.letter, n.cost, turn, fault, role,
                            None if gone else n.role or role, None if gone else text))
                at += 1
                held += 0 if gone else len(text)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for b in batches:
            for c, turn, role, text, fault in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now is None or c != conv_id:
                    if now is not None:
                        take(now.finish())
                    now, conv_id, at = Repair(), c, 0
                take(now.add((turn, role, text, fault), role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
                if len(out) >= ROWS_OUT or held >= CHARS_OUT:
                    yield batch()
                    out.clear()
                    held = 0
        if now is not None:
            take(now.finish())
        if out:
            yield batch()

    return rows.mapInArrow(mend, EDITS)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the planted faults of the query's contract."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("kind"),
        one("role").alias("role"), one("text").alias("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies)
        .drop("col"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
DIGEST = "conv_id long, " + "".join(f"{c} long, " for c in COUNTS) + "audit string, repaired_sha256 string"


def digest(edits: DataFrame) -> DataFrame:
    """One row a conversation from ``repair``'s edits, in its order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64()] * (1 + len(COUNTS)) + [pa.string()] * 2
        out, now = [], None

        def done():
            if now is None:
                return
            gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
            out.append((now["conv_id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"],
                        "".join(now["audit"]), now["sha"].hexdigest()))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for b in batches:
            for conv_id, at, edit, cost, turn, fault, was, role, text in zip(*(b.column(i).to_pylist() for i in range(9))):
                if at == 0:
                    done()
                    now = {"conv_id": conv_id, "at": 0, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0,
                           "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "was": None, "said": False}
                if now is None or (now["conv_id"], now["at"]) != (conv_id, at):
                    raise ValueError("edits out of order")
                now["at"] += 1
                now["cost"] += cost
                now["audit"].append(edit)
                if edit != "I":
                    if turn is not None and turn != now["high"]:
                        now["low"], now["high"] = turn if now["turns"] == 0 else now["low"], turn
                        now["turns"] += 1
                    if fault:
                        now[fault] += 1
                    if now["was"] is not None and now["was"] + was[:1] not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["was"] = was[:1]
                if role is not None:
                    now["sha"].update((("\n" if now["said"] else "") + f"{role}:{text}").encode())
                    now["said"] = True
            if len(out) >= ROWS_OUT:
                yield batch()
                out.clear()
        done()
        if out:
            yield batch()

    return edits.mapInArrow(rows, DIGEST)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    repaired = digest(repair(damage(given))).withColumnRenamed("conv_id", "id")
    ids = given.select("conv_id").distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return (ids.join(repaired, F.col("conv_id").eqNullSafe(F.col("id")), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS],
                    *[F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()]))


#: The same in SQL: crc32 bit by bit, then the cheapest (cost, initials, repaired text) of each state, row by row.
ORACLE = """
WITH RECURSIVE
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda acc, b: list_reduce(
          [xor(acc, b), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT],
          lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),
      4294967295::UBIGINT) % 20 AS kind
  FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER c AS n, lag(substr(role, 1, 1)) OVER c AS before, substr(role, 1, 1) AS x,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM damaged WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
                 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
rows_of AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra,
         max(n) OVER (PARTITION BY conv_id) AS total FROM faults),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, {'c': 0, 's': '', 'o': ''} AS z, {'c': 1000000000, 's': '', 'o': ''} AS s,
         {'c': 2, 's': 'I', 'o': chr(10) || 'user:'} AS u,
         {'c': 4, 's': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
  FROM rows_of
  UNION ALL
  SELECT conv_id, n, z, s, u, list_min([a, {'c': u.c + 2, 's': u.s || 'I', 'o': u.o || chr(10) || 'assistant:'}]) AS a
  FROM (
    SELECT conv_id, n, z, s, a, list_min([u] || list_transform([z, s, a],
             lambda p: {'c': p.c + 2, 's': p.s || 'I', 'o': p.o || chr(10) || 'user:'})) AS u
    FROM (
      SELECT r.conv_id, r.n, {'c': w.z.c + 3, 's': w.z.s || 'D', 'o': w.z.o} AS z,
        list_min([{'c': w.s.c + 3, 's': w.s.s || 'D', 'o': w.s.o}] || CASE WHEN r.gone OR r.x <> 's' THEN [] ELSE
          [{'c': w.z.c + r.extra, 's': w.z.s || 'K', 'o': w.z.o || chr(10) || r.role || ':' || r.text}] END) AS s,
        list_min([{'c': w.u.c + 3, 's': w.u.s || 'D', 'o': w.u.o}]
          || CASE WHEN r.gone OR r.x <> 'u' THEN [] ELSE list_transform([w.z, w.s, w.a],
             lambda p: {'c': p.c + r.extra, 's': p.s || 'K', 'o': p.o || chr(10) || r.role || ':' || r.text}) END
          || CASE WHEN r.gone THEN [] ELSE list_transform([w.z, w.s, w.a],
             lambda p: {'c': p.c + 2 + r.extra, 's': p.s || 'R', 'o': p.o || chr(10) || 'user:' || r.text}) END) AS u,
        list_min([{'c': w.a.c + 3, 's': w.a.s || 'D', 'o': w.a.o}]
          || CASE WHEN r.gone OR r.x <> 'a' THEN [] ELSE
             [{'c': w.u.c + r.extra, 's': w.u.s || 'K', 'o': w.u.o || chr(10) || r.role || ':' || r.text}] END
          || CASE WHEN r.gone THEN [] ELSE
             [{'c': w.u.c + 2 + r.extra, 's': w.u.s || 'R', 'o': w.u.o || chr(10) || 'assistant:' || r.text}] END) AS a
      FROM walk w JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1))),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(n) AS total,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_of GROUP BY conv_id),
ended AS (
  SELECT c.*, list_min([w.z, w.a]) AS e FROM walk w
  JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.total = w.n)
SELECT g.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate,
       coalesce(e.truncated, 0) AS truncated, coalesce(e.illegal, 0) AS illegal, CAST(coalesce(e.e.c, 0) AS BIGINT) AS cost,
       coalesce(e.e.s, '') AS audit, sha256(coalesce(substr(e.e.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""
