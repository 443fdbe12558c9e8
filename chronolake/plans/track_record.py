"""Filers' records at following distance: excess over the benchmark from disclosure, held for a horizon."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.functions import stats
from chronolake.operators.asof import holding
from chronolake.plans.lens import NO_TICKER, OPTION_TYPES

BENCHMARK, HORIZONS, DEFAULT_HORIZON, LEAST_TRADES, MOST_LAG_DAYS = "SPY", (30, 90, 180), 90, 10, 400


def excess(rows: DataFrame, closes: DataFrame, entry: str, horizon: int, out: str, benchmark: str = BENCHMARK) -> DataFrame:
    """rows with `out`: per cent over the benchmark from the first close on or after `entry` to the last by entry + horizon; null if either leg fails."""
    timed = rows.withColumns({"_entry": F.col(entry), "_exit": F.date_add(F.col(entry), horizon), "_bench": F.lit(benchmark)})
    own = holding(timed, closes, ["symbol"], "_entry", "_exit").withColumnsRenamed({f"{a}_{b}": f"_own_{a}_{b}" for a in ("entry", "exit") for b in ("day", "close")})
    bench = closes.where(F.col("symbol") == benchmark).select(F.col("symbol").alias("_bench"), "day", "close")
    both = holding(own, bench, ["_bench"], "_entry", "_exit")
    gain = lambda a, b: (F.col(b) / F.nullif(a, F.lit(0.0)) - 1) * 100
    return both.withColumn(out, gain("_own_entry_close", "_own_exit_close") - gain("entry_close", "exit_close")).select(*rows.columns, out)


def purchases(trades: DataFrame) -> DataFrame:
    kept = (F.col("transaction_type") == "purchase") & (F.col("symbol") != NO_TICKER) & ~F.coalesce(F.col("asset_type").isin(*OPTION_TYPES), F.lit(False))
    return trades.where(kept)


def measured(trades: DataFrame, closes: DataFrame, today: dt.date, horizon: int = DEFAULT_HORIZON) -> DataFrame:
    """Purchases with status (measured, unpriced, unfinished), excess_pct and own_excess_pct; lags that cannot be right are dropped."""
    horizon = horizon if horizon in HORIZONS else DEFAULT_HORIZON
    priced = closes.select("symbol").distinct().withColumn("_priced", F.lit(True))
    rows = purchases(trades).join(priced, "symbol", "left").where(F.col("_priced").isNull() | (F.datediff("public_on", "traded_on") <= MOST_LAG_DAYS))
    rows = rows.withColumn("_open", F.date_add("public_on", horizon) > F.lit(today))
    rows = excess(rows, closes, "public_on", horizon, "excess_pct")
    rows = excess(rows, closes, "traded_on", horizon, "own_excess_pct")
    status = F.when(F.col("_priced").isNull(), "unpriced").when(F.col("_open"), "unfinished").when(F.col("excess_pct").isNull(), "unpriced").otherwise("measured")
    return rows.withColumn("status", status).drop("_priced", "_open")


def records(rows: DataFrame, least: int = LEAST_TRADES) -> dict[str, DataFrame]:
    """people (ranked first), everyone, counts and luck of measured purchases."""
    done = rows.where("status = 'measured'")
    about = done.groupBy("actor_id").agg(F.min_by("actor", "public_on").alias("actor"), F.min_by("role", "public_on").alias("role"), F.round(F.avg("own_excess_pct"), 2).alias("own_mean_excess_pct"), F.min("public_on").alias("first"), F.max("public_on").alias("last"))
    people = stats.interval(done, ["actor_id"], "excess_pct").join(about, "actor_id").withColumn("ranked", F.col("trades") >= least)
    counts = rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("measured", "unpriced", "unfinished")])
    ranked = people.where("ranked")
    standouts = ranked.agg(F.count(F.lit(1)).alias("ranked"), F.count_if("distinguishable").alias("standouts"), F.round(F.count(F.lit(1)) * 0.05, 1).alias("expected_by_luck"))
    return {"people": people.orderBy(F.col("ranked").desc(), F.col("mean_excess_pct").desc(), "actor_id"), "everyone": stats.interval(done, [], "excess_pct"), "counts": counts, "standouts": standouts, "luck": stats.luck(done, "actor_id", "excess_pct", least)}


def track_record(lens, horizon: int = DEFAULT_HORIZON, least: int = LEAST_TRADES) -> dict[str, DataFrame]:
    bought = purchases(lens.trades).select("symbol").distinct()
    wanted = bought.unionByName(lens.spark.createDataFrame([(BENCHMARK,)], "symbol string")).distinct()
    return records(measured(lens.trades, lens.closes(wanted, dt.date(1990, 1, 1)), lens.today, horizon), least)
