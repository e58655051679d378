"""Trading strategies (F9, S8, G4): validation, the current strategy, and the
bulk update of the maximal trading value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.operators.opportunities import TradingParams

# Validation messages in the reference's check order.
MSG_CURRENCIES = "NumberOfCurrencies must be greater than zero"
MSG_SPREAD = "MinimalPriceSpread must be greater than zero"
MSG_TX_VALUE = "MaximalTransactionValue must be greater than zero"
MSG_TRADING_VALUE = "MaximalTradingValue must be greater than zero"
MSG_INVESTMENT = "InitialInvestmentAmount must be greater than zero"
MSG_TX_BELOW_SPREAD = "MaximalTransactionValue must be greater than or equal to MinimalPriceSpread"


def validate(strategies: DataFrame) -> DataFrame:
    """first failing rule wins, in the reference's order; the minimal
    transaction profit is not checked. A null parameter fails its rule."""
    def fails(rule):
        return ~F.coalesce(rule, F.lit(False))

    err = (F.when(fails(F.col("number_of_currencies") > 0), F.lit(MSG_CURRENCIES))
           .when(fails(F.col("minimal_price_spread") > 0), F.lit(MSG_SPREAD))
           .when(fails(F.col("maximal_transaction_value") > 0), F.lit(MSG_TX_VALUE))
           .when(fails(F.col("maximal_trading_value") > 0), F.lit(MSG_TRADING_VALUE))
           .when(fails(F.col("init_investment") > 0), F.lit(MSG_INVESTMENT))
           .when(F.col("maximal_transaction_value") < F.col("minimal_price_spread"), F.lit(MSG_TX_BELOW_SPREAD)))
    return strategies.withColumn("error", err).withColumn("valid", err.isNull())


def current_strategy(validated: DataFrame, version_col: str = "strategy_id") -> DataFrame:
    """The latest valid strategy wins (one row; a partial/final max)."""
    cols = [c for c in validated.columns if c not in ("error", "valid")]
    latest = validated.where("valid").agg(F.max(F.struct(version_col, *[c for c in cols if c != version_col])).alias("s"))
    return latest.where(F.col("s").isNotNull()).select("s.*")


def set_maximal_trading_value(strategies: DataFrame, value: float) -> DataFrame:
    """Set MaximalTradingValue on every stored strategy (a column rewrite)."""
    return strategies.withColumn("maximal_trading_value", F.lit(float(value)))


def save(strategies: DataFrame, path: str) -> None:
    """Append strategy submissions (with their validation) to the store."""
    validate(strategies).write.mode("append").parquet(path)


def load_current(spark, path: str, version_col: str = "strategy_id") -> DataFrame:
    """The current strategy from the store (latest valid row wins)."""
    return current_strategy(spark.read.parquet(path), version_col)


def trading_params(current: DataFrame) -> tuple[TradingParams, int] | None:
    """The live thresholds and the number of pairs to track of the current strategy; None without
    one (trading doesn't start). The strategy is one row."""
    r = current.first()
    if r is None:
        return None
    return TradingParams(r["minimal_price_spread"], r["min_transaction_profit"], r["maximal_transaction_value"],
                         r["maximal_trading_value"]), int(r["number_of_currencies"])
