"""Stored tables as an append-only change log with compaction.

Rows are changes (key, version, further columns); the state is each key's largest (version, columns). A
batch is appended into its own folder and takes effect with its commit marker, written last, so a batch
that is repeated after a lost executor, or sent twice, adds nothing. ``compact`` merges the committed batches into
a snapshot bucketed and sorted by the key; it too takes effect with its marker. The state is the snapshot joined with
the reduced newer batches: only these move, the snapshot's buckets are read in place (Spark does so where there are at least as many
buckets as shuffle partitions). One writer at a time.
"""

from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.session import delete_path, path_exists


class ChangeLog:
    """``schema``: the rows' columns, with ``key`` and ``version`` among them. States have one column more,
    ``first_version``, the key's least version."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: str = "version", buckets: int = 16):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path.rstrip("/"), key, version, buckets
        self.schema = T.StructType.fromDDL(schema)
        self.rest = [version, *[c for c in self.schema.fieldNames() if c not in (key, version)]]

    # ------------------------------------------------------------- appending
    def _log(self, batch: int) -> str:
        return f"{self.path}/log/batch={int(batch)}"

    def _committed(self) -> DataFrame:
        """batch of every commit; -1 - generation and its batches of every compaction."""
        kind = "batch long, merged array<long>"
        p = f"{self.path}/commits"
        return (self.spark.read.schema(kind).option("recursiveFileLookup", True).parquet(p) if path_exists(self.spark, p)
                else self.spark.createDataFrame([], kind))

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch of changes; false, and nothing is written, where it has been committed before."""
        commits = {r["batch"] for r in self._committed().collect()}           # a row a batch since the last compactions
        if batch in commits or batch in self._merged()[1]:
            return False
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._log(batch))
        self._commit(batch, None)
        return True

    def _commit(self, batch: int, merged: list[int] | None) -> None:
        self.spark.createDataFrame([(batch, merged)], "batch long, merged array<long>").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/commits/{'batch' if merged is None else 'gen'}={abs(batch)}")

    def _merged(self) -> tuple[int, list[int]]:
        """The newest compaction (0: none) and all batches in its snapshot."""
        last = self._committed().where("batch < 0").orderBy("batch").first()
        return (0, []) if last is None else (-last["batch"], last["merged"])

    # ---------------------------------------------------------------- states
    def _reduced(self, rows: DataFrame) -> DataFrame:
        g = rows.groupBy(self.key).agg(F.max(F.struct(*self.rest)).alias("s"), F.min(self.version).alias("first_version"))
        return g.select(self.key, "s.*", "first_version")

    def _name(self, gen: int) -> str:
        return f"change_log_{zlib.crc32(self.path.encode())}_{os.path.basename(self.path).replace('-', '_')}_{gen}"

    def _table(self, gen: int) -> str:
        """The snapshot's catalog name; registered anew in a session that doesn't know it."""
        name = self._name(gen)
        if not self.spark.catalog.tableExists(name):
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._state_schema())
            self.spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self._snapshot(gen)}'")
        return name

    def _snapshot(self, gen: int) -> str:
        return f"{self.path}/snapshot-{gen}"

    def _state_schema(self) -> list[T.StructField]:
        by = {f.name: f for f in self.schema}
        return [by[self.key], *[by[c] for c in self.rest], T.StructField("first_version", by[self.version].dataType)]

    def _newer(self, merged: list[int]) -> tuple[DataFrame | None, list[int]]:
        """The rows of committed batches that are not in the snapshot."""
        new = sorted({r["batch"] for r in self._committed().where("batch >= 0").collect()} - set(merged))
        if not new:
            return None, []
        return self.spark.read.schema(self.schema).parquet(*[self._log(b) for b in new]), new

    def state(self) -> DataFrame:
        """G1: every key's latest row."""
        gen, merged = self._merged()
        rows, _ = self._newer(merged)
        empty = self.spark.createDataFrame([], T.StructType(self._state_schema()))
        log = self._reduced(rows) if rows is not None else empty
        if not gen:
            return log
        old, cols = self.spark.table(self._table(gen)), [*self.rest, "first_version"]
        if rows is None:
            return old
        pair = old.select(self.key, F.struct(*self.rest).alias("o"), F.col("first_version").alias("of")).join(
            log.select(self.key, F.struct(*self.rest).alias("n"), F.col("first_version").alias("nf")).hint("merge"),
            self.key, "full_outer")
        return pair.select(self.key, F.greatest("o", "n").alias("s"), F.least("of", "nf").alias("first_version")) \
            .select(self.key, "s.*", "first_version").select(self.key, *cols)

    def compact(self) -> None:
        """Merge the newer batches into a new snapshot. What the snapshot before had replaced goes."""
        gen, merged = self._merged()
        rows, new = self._newer(merged)
        if rows is None:
            return
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(gen + 1)}")       # of an attempt that was not committed
        self.state().write.mode("overwrite").bucketBy(self.buckets, self.key).sortBy(self.key) \
            .option("path", self._snapshot(gen + 1)).saveAsTable(self._name(gen + 1))
        self._commit(-(gen + 1), sorted({*merged, *new}))
        for b in merged:                                     # in both snapshots: their folders are not read any more
            delete_path(self.spark, self._log(b))
            delete_path(self.spark, f"{self.path}/commits/batch={b}")
        if gen > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(gen - 1)}")
            delete_path(self.spark, self._snapshot(gen - 1))
