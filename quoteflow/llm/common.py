"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.session import ship_package

#: Characters handed to a tokenizer (or hashed) at a time; bounds a worker's memory.
SLICE_CHARS = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only a
    local session without the setting gets a folder of its own (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="quoteflow-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage,
    fixes what a retried task could decide otherwise, and computes it once. The
    shuffle files of the write go with it, as nothing reads them again."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables whose successors are written: nothing reads them again."""
    for t in tables:
        path = getattr(t, "__dict__", {}).get("staged")
        if path:
            sc = t.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (null: empty) and the named columns, no others."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(lengths: list[int], limit: int = SLICE_CHARS):
    """(from, to) of consecutive runs of at most ``limit`` in all, one item at least."""
    a, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(lengths):
        yield a, len(lengths)


@lru_cache(maxsize=4)
def tokenizer(file: str):
    """A public tokenizer by file name or full path. Strings of special tokens
    in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.isabs(file):
        import public_tokenizers

        file = public_tokenizers.path(file)
    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True
    return t


_WHITE, _MARK = r" \t\n\r", r"!-&(-/:-@\[-`{-~"
_PLAIN = "0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u04ff"
#: A run of white space and what follows it, up to where plain letters and digits meet ASCII punctuation. An
#: apostrophe stays with what follows it (contractions), and so does all that isn't plain (U+0130 in lower case ends
#: with a mark). Neither public tokenizer's pre-tokenizer looks across the start of a unit, so a text's ids are
#: those of its units.
UNIT = re.compile(f"[{_WHITE}]*(?:[{_PLAIN}]+(?![^{_WHITE}{_MARK}'])|[{_MARK}']*[{_MARK}](?=[{_PLAIN}])|[^{_WHITE}]+)|[{_WHITE}]+")
#: White space that is rare, or that Python and the tokenizers may see differently: such texts are encoded whole.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Units that a worker remembers (about 330 MB; it forgets all when there are more), and the longest of them.
UNITS_HELD, LONGEST_UNIT = 1_500_000, 64
#: What ends a unit among others; no other character has its ids, and it is a token of its own after a space.
MARK, JOINED = " \0", 32


class Encoder:
    """Ids of texts by a public tokenizer, every distinct unit encoded once as long as it is remembered."""

    def __init__(self, tok):
        self.tok, self.known = tok, {}
        self.mark = tok.encode(MARK, add_special_tokens=False).ids

    def _encoded(self, units: list[str]):
        """Each unit and its ids, as bytes. Units that begin with white space go to the tokenizer JOINED at a time, with
        MARK after each: a call for every unit costs more than its ids do."""
        alike = [u for u in units if u[0] in " \t\n\r" and len(u) <= LONGEST_UNIT and MARK[-1] not in u
                 and not u[-1].isspace() and not RARE_SPACE.search(u)]
        groups = [alike[a:a + JOINED] for a in range(0, len(alike), JOINED)]
        alone = list(set(units).difference(alike))
        texts = ["".join(u + MARK for u in g) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark[-1]) + 1
            if len(ends) != len(g):
                alone += g
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            for u, a, b in zip(g, [0, *ends], ends):
                yield u, raw[a:b - 4 * len(self.mark)]
        for u, e in zip(alone, self.tok.encode_batch_fast(alone, add_special_tokens=False)):
            yield u, array("I", e.ids).tobytes()

    def encode(self, texts: list[str]):
        """Token ids of each text, as uint32 arrays, in bounded batches."""
        for a, b in slices([len(t) for t in texts]):
            known = self.known
            cut = [[t] if RARE_SPACE.search(t) else UNIT.findall(t) for t in texts[a:b]]
            found = [list(map(known.get, units)) for units in cut]
            new = list({u for units, ids in zip(cut, found) if None in ids for u, x in zip(units, ids) if x is None})
            known.update(self._encoded(new))
            for units, ids in zip(cut, found):
                yield np.frombuffer(b"".join(map(known.__getitem__, units) if None in ids else ids), dtype="<u4")
            if len(known) > UNITS_HELD:
                known.clear()
            for u in new:
                if len(u) > LONGEST_UNIT:
                    known.pop(u, None)


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    """Kept by a worker from task to task."""
    return Encoder(tokenizer(file))


def crc32_u32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (id, component_id),
    the smallest id reachable, for every id with an edge.

    Union-find in joins: large-star (each vertex links its larger neighbours
    to its smallest neighbour) and small-star in turn, which halves tree
    depths; each round is written to the shared folder. Stops when the edges are
    stars, each vertex with one edge to a smaller one that has none; never gives
    a partial answer."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .where("u <> v").distinct(), f"{name}-edges")
    for _ in range(rounds):
        ends = (e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root"))
                .union(e.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")))
        if ends.where("up > 1 or up = 1 and root = 1").isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.u", "x.v").where("u <> v").distinct())
        last, e = e, stage(small, f"{name}-round")
        discard(last)
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("component_id"))
    out = (roots.select(F.col("u").alias("id"), "component_id")
           .union(roots.select(F.col("component_id").alias("id"), "component_id").distinct()))
    out.staged = e.staged
    return out
