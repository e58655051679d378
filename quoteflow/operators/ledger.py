"""Transaction ledger (G2, G3, X13, F6): transactions as an append-only
event log with SCD-2 validity ranges instead of in-place document updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.operators.running import previous_in_key

# Transaction statuses.
SUBMITTED = "Submitted"
FULFILLED = "Fulfilled"
PARTIALLY_FULFILLED = "PartiallyFulfilled"
CANCELLED = "Cancelled"


def transaction_events(orders: DataFrame) -> DataFrame:
    """Events per transaction from its orders: version 1 ``Submitted`` at the
    first order, version 2 with the outcome at the last one (G2). The order
    list is newest first, as repeated prepends build it (X13); a transaction
    holds a bounded number of orders."""
    g = orders.groupBy("transaction_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sort_array(F.collect_list(F.struct("attempt", "order_id")), asc=False).alias("items"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("status") == "FullyFilled", 1).otherwise(0)).alias("n_full"),
        F.sum(F.when(F.col("status") == "NotFilled", 1).otherwise(0)).alias("n_none"))
    ids = F.concat_ws(",", F.transform("items", lambda i: i["order_id"]))
    outcome = (F.when(F.col("n_full") == F.col("n"), F.lit(FULFILLED))
               .when(F.col("n_none") == F.col("n"), F.lit(CANCELLED))
               .otherwise(F.lit(PARTIALLY_FULFILLED)))
    ev = F.array(
        F.struct(F.lit(1).alias("version"), F.lit(SUBMITTED).alias("status"), F.col("first_ts").alias("ts")),
        F.struct(F.lit(2).alias("version"), outcome.alias("status"), F.col("last_ts").alias("ts")))
    e = g.select("transaction_id", ids.alias("order_ids"), F.explode(ev).alias("e"))
    return e.select("transaction_id", "e.version", "e.status", "order_ids", "e.ts")


def transaction_history(events: DataFrame) -> DataFrame:
    """History rows with validity ranges (valid_to = next version's time),
    a window per transaction (bounded: two versions each)."""
    w = Window.partitionBy("transaction_id").orderBy("version")
    return events.select("transaction_id", "version", "status", "order_ids",
                         F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


def latest_transactions(events: DataFrame) -> DataFrame:
    """F6 bulk form: the current state of every transaction."""
    s = events.groupBy("transaction_id").agg(F.max(F.struct("version", "status", "order_ids", "ts")).alias("s"))
    return s.select("transaction_id", "s.*")


# Fixed value: the reference's reply to an unknown order id.
MSG_ORDER_NOT_FOUND = "Order not found"


def lookup(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """point or bulk lookup = left-semi join to a key table."""
    return state.join(keys.select(key).distinct(), key, "left_semi")


def find(state: DataFrame, keys: DataFrame, key: str, message: str = MSG_ORDER_NOT_FOUND) -> DataFrame:
    """F6 with its outcome: one row per requested key (null keys are not found), the first matching state row in
    column order (L3; the reference's choice of equal ones is the store's), or ``message`` in ``error``."""
    rest = [c for c in state.columns if c != key]
    first = state.groupBy(key).agg(F.min(F.struct(*rest)).alias("s"))
    out = keys.select(key).distinct().join(first, key, "left")
    return out.select(key, "s.*", F.when(F.col("s").isNull(), F.lit(message)).alias("error"))


def append_log(rows: DataFrame, path: str) -> None:
    """Insert order or transaction rows = append to a change-log table."""
    rows.write.mode("append").parquet(path)


def first_match(state: DataFrame, key_col: str, key, order_cols: list[str]) -> DataFrame:
    """L3 / F6 point lookup: the first matching row, made deterministic by an
    explicit order (the reference's FirstOrDefault has none)."""
    return state.where(F.col(key_col) == F.lit(key)).orderBy(*order_cols).limit(1)


def snapshot(state: DataFrame, path: str) -> None:
    """Store the current state with a history timestamp (append)."""
    state.withColumn("history_ts", F.current_timestamp()).write.mode("append").parquet(path)


# Results of a transaction status update.
MSG_TX_UPDATED = "Transaction status updated successfully."
MSG_TX_NOT_FOUND = "No transaction found with the given TransactionId."


def update_transaction_status(state: DataFrame, updates: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """G2 in bulk: apply (transaction_id, new_status) to the current state, the updates of one
    transaction one after the other by the columns ``order``; each is compared with the status that those before left.

    As in the reference, success means a row was *modified*: an unknown id,
    or a status equal to the one there is, reports the not-found message.
    Returns (transaction_id, the order columns, new_status, status, result) where ``status`` is
    the state after the update. The status before is that of the previous update, so one lag over
    state and updates gives it (``previous_in_key``: a transaction with any number of updates is spread over tasks)."""
    none = [F.lit(None).cast(updates.schema[c].dataType).alias(c) for c in order]
    ev = (state.select("transaction_id", *none, F.lit(0).alias("is_update"), F.col("status").alias("new_status"))
          .unionByName(updates.select("transaction_id", *order, F.lit(1).alias("is_update"), "new_status")))
    # a state row goes before its updates; without one nothing is modified
    ev = previous_in_key(ev.withColumn("left", F.col("new_status")), "transaction_id", ["is_update", *order, "new_status"], "left", "before")
    known = state.select("transaction_id").distinct().withColumn("stored", F.lit(True))
    ev = ev.where("is_update = 1").join(known, "transaction_id", "left")
    old = F.when(F.col("stored"), F.col("before"))
    changed = F.col("stored") & ~old.eqNullSafe(F.col("new_status"))
    return ev.select("transaction_id", *order, "new_status",
                     F.when(changed, F.col("new_status")).otherwise(old).alias("status"),
                     F.when(changed, F.lit(MSG_TX_UPDATED)).otherwise(F.lit(MSG_TX_NOT_FOUND)).alias("result"))


# Results of storing transaction history.
MSG_HISTORY_STORED = "Transaction history stored successfully."
MSG_HISTORY_NOT_FOUND = "Transaction not found."


def store_history(state: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """G3 for a set of ids: append each found transaction's current state with
    a history timestamp; return one result row per requested id."""
    req = ids.select("transaction_id").distinct()
    found = state.join(req, "transaction_id", "left_semi")
    snapshot(found, path)
    hit = found.select("transaction_id", F.lit(True).alias("found"))
    return req.join(hit, "transaction_id", "left").select(
        "transaction_id",
        F.when(F.col("found"), F.lit(MSG_HISTORY_STORED)).otherwise(F.lit(MSG_HISTORY_NOT_FOUND)).alias("result"))
