"""What was traded, how prices moved before disclosure, and what contracts add up to."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake import calendars as C
from chronolake.functions import stats
from chronolake.functions import text as X
from chronolake.operators.asof import asof

TOP_TICKERS, TOP_PEOPLE, TOP_COMPANIES, TOP_AGENCIES, EXAMPLES = 14, 9, 12, 8, 8
#: A longer gap between a trade and its disclosure is a wrong date.
MOST_LAG_DAYS = 400
GROUPS = (("insider", "Company insiders"), ("house", "Members of the House"), ("senate", "Senators"), ("fund", "Tracked funds"))


def decisions(lens, days: int, kind: str | None = None) -> DataFrame:
    """Trades by choice that became public in the last `days` days; funds unabridged."""
    since = lens.today - dt.timedelta(days=days)
    people = lens.events.where(F.col("kind").isin("insider", "congress"))
    rows = people.unionByName(lens.fund_changes()).where((F.col("disclosed_on") > F.lit(since)) & ~F.col("noise") & (F.col("direction") != "none"))
    return rows if kind is None else rows.where(F.col("kind") == kind)


def ranked_tickers(rows: DataFrame) -> DataFrame:
    """ticker, name, buyers, sellers (distinct people a side), most first."""
    side = lambda d: F.count_distinct(F.when(F.col("direction") == d, F.col("actor_id")))
    name = F.when((F.col("kind") == "insider") & F.col("asset").isNotNull(), F.when(X.shouted(F.col("asset")), X.titled(F.col("asset"))).otherwise(F.col("asset")))
    named = rows.where("ticker IS NOT NULL").withColumn("_name", name)
    out = named.groupBy("ticker").agg(F.max_by("_name", F.when(F.col("_name").isNotNull(), F.struct("disclosed_at", "id"))).alias("name"), side("buy").alias("buyers"), side("sell").alias("sellers"))
    return out.orderBy((F.col("buyers") + F.col("sellers")).desc(), F.col("buyers").desc(), F.col("ticker").desc())


def ranked_people(rows: DataFrame) -> DataFrame:
    """actor_id, actor, role, kind, buys, sells, tickers of people, most active first."""
    sided = rows.where("kind <> 'fund'")
    first = lambda c: F.max_by(c, F.struct("disclosed_at", "id")).alias(c)
    out = sided.groupBy("actor_id").agg(first("actor"), first("role"), first("kind"), F.count_if(F.col("direction") == "buy").alias("buys"), F.count_if(F.col("direction") != "buy").alias("sells"), F.count_distinct("ticker").alias("tickers"))
    return out.orderBy((F.col("buys") + F.col("sells")).desc(), F.col("actor").desc())


def traded(lens, days: int = 30, kind: str | None = None) -> dict[str, DataFrame]:
    rows = decisions(lens, days, kind)
    tickers = ranked_tickers(rows)
    return {"trades": rows, "all_tickers": tickers, "tickers": tickers.limit(TOP_TICKERS), "people": ranked_people(rows).limit(TOP_PEOPLE)}


def moves(rows: DataFrame, closes: DataFrame) -> DataFrame:
    """rows with group and move (per cent) between the last closes on or before trade and disclosure; unmeasured rows go."""
    priced = closes.select(F.col("symbol").alias("ticker"), F.col("day").alias("_day"), F.col("close").alias("_close"))
    timed = rows.where(F.col("ticker").isNotNull() & (F.col("lag_days") <= MOST_LAG_DAYS))
    before = asof(timed, priced, ["ticker"], "traded_on", "_day", ["_close"], "backward", "_before")
    after = asof(before, priced, ["ticker"], "disclosed_on", "_day", ["_close"], "backward", "_after")
    measured = after.where("_close_before <> 0 AND _close_after IS NOT NULL")
    group = F.when(F.col("kind") == "congress", F.when(F.col("role") == "Senate", "senate").otherwise("house")).otherwise(F.col("kind"))
    return measured.withColumns({"group": group, "move": (F.col("_close_after") - F.col("_close_before")) / F.col("_close_before") * 100}).select(*rows.columns, "group", "move")


def price_moves(lens, days: int = 90) -> dict[str, DataFrame]:
    rows = decisions(lens, days).where("ticker IS NOT NULL")
    start = lens.today - dt.timedelta(days=days + MOST_LAG_DAYS + 10)
    measured = moves(rows, lens.closes(rows.select("ticker").distinct(), start))
    sides = lens.spark.createDataFrame([(k, label, d) for k, label in GROUPS for d in ("buy", "sell")], "group string, label string, direction string")
    spreads = sides.join(measured.groupBy("group", "direction").agg(*stats.spread("move")), ["group", "direction"], "left").fillna({"n": 0})
    missed = F.when(F.col("direction") == "buy", F.col("move")).otherwise(-F.col("move"))
    examples = measured.where("kind <> 'fund'").orderBy(missed.desc(), "id").limit(EXAMPLES).withColumn("price_move_pct", F.round("move", 1))
    return {"trades": rows, "measured": measured, "groups": spreads, "examples": examples}


def contract_totals(frame: DataFrame, column: str) -> DataFrame:
    """net_usd, defense_usd, actions of each value of `column`, largest net first."""
    defense = F.coalesce(F.sum(F.when(F.col("defense"), F.col("obligation_usd"))), F.lit(0.0))
    out = frame.groupBy(F.col(column).alias("name")).agg(F.sum("obligation_usd").alias("net_usd"), defense.alias("defense_usd"), F.count(F.lit(1)).alias("actions"))
    return out.orderBy(F.col("net_usd").desc(), "name")


def contract_months(frame: DataFrame) -> DataFrame:
    amount = F.col("obligation_usd")
    signed = lambda c: F.coalesce(F.sum(F.when(c, amount)), F.lit(0.0))
    return frame.groupBy(F.trunc("public_on", "MM").alias("month")).agg(signed(amount > 0).alias("committed_usd"), signed(amount < 0).alias("taken_back_usd")).orderBy("month")


def contracts(lens, live=None) -> dict[str, DataFrame]:
    year_ago = lens.today - dt.timedelta(days=365)
    frame = lens.frame("government_contracts").withColumn("public_on", C.eastern_date(F.col("known_at"))).where(F.col("public_on") > F.lit(year_ago))
    defense = F.when(F.col("defense"), F.col("obligation_usd"))
    out = {
        "totals": frame.agg(F.count(F.lit(1)).alias("actions"), F.coalesce(F.sum("obligation_usd"), F.lit(0.0)).alias("net_usd"), F.coalesce(F.sum(defense), F.lit(0.0)).alias("defense_usd")),
        "companies": contract_totals(frame, "symbol").limit(TOP_COMPANIES),
        "agencies": contract_totals(frame, "awarding_agency").limit(TOP_AGENCIES),
        "months": contract_months(frame),
    }
    if live is not None:
        unseen = live.frame("government_contracts").where((F.col("as_of") <= F.lit(lens.as_of)) & (F.col("known_at") > F.lit(lens.as_of)))
        out["hidden"] = unseen.agg(F.count(F.lit(1)).alias("actions"), F.coalesce(F.sum("obligation_usd"), F.lit(0.0)).alias("net_usd"), F.count_if("defense").alias("defense_actions"))
    return out
