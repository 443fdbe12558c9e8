"""Macro series, positioning, factor returns and the catalogue of published anomalies."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake import calendars as C
from chronolake.sources.base import demand, instant, number, stamped, text

OBSERVATIONS = "observations array<struct<date: string, value: string, realtime_start: string, realtime_end: string>>"
PROCESSING_DAYS, FACTOR_LAG_DAYS, PRE_WEEKLY_LAG_DAYS = 3, 60, 90
WEEKLY_SINCE = "1992-09-30"
# Columns of the three positioning reports by category and measure.
REPORTS = {
    "legacy": {
        "noncommercial": {"long": "noncomm_positions_long_all", "short": "noncomm_positions_short_all", "spreading": "noncomm_positions_spread"},
        "commercial": {"long": "comm_positions_long_all", "short": "comm_positions_short_all"},
        "nonreportable": {"long": "nonrept_positions_long_all", "short": "nonrept_positions_short_all"},
        "total": {"open_interest": "open_interest_all"},
    },
    "disaggregated": {
        "producer_merchant": {"long": "prod_merc_positions_long", "short": "prod_merc_positions_short"},
        "swap_dealer": {"long": "swap_positions_long_all", "short": "swap__positions_short_all", "spreading": "swap__positions_spread_all"},
        "managed_money": {"long": "m_money_positions_long_all", "short": "m_money_positions_short_all", "spreading": "m_money_positions_spread"},
        "other_reportable": {"long": "other_rept_positions_long", "short": "other_rept_positions_short", "spreading": "other_rept_positions_spread"},
        "total": {"open_interest": "open_interest_all"},
    },
    "tff": {
        "dealer": {"long": "dealer_positions_long_all", "short": "dealer_positions_short_all", "spreading": "dealer_positions_spread_all"},
        "asset_manager": {"long": "asset_mgr_positions_long", "short": "asset_mgr_positions_short", "spreading": "asset_mgr_positions_spread"},
        "leveraged_funds": {"long": "lev_money_positions_long", "short": "lev_money_positions_short", "spreading": "lev_money_positions_spread"},
        "other_reportable": {"long": "other_rept_positions_long", "short": "other_rept_positions_short", "spreading": "other_rept_positions_spread"},
        "total": {"open_interest": "open_interest_all"},
    },
}


def _observations(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("_o", F.explode(F.from_json("payload", OBSERVATIONS)["observations"]))


def settled_observations(payloads: DataFrame, policy: DataFrame, lag_hours: int = 24) -> DataFrame:
    """Series that are never revised (symbol, payload); policy: (symbol, units, revised). A series that is revised or unclassified fails."""
    judged = payloads.join(policy, "symbol", "left")
    sound = demand(F.coalesce(~F.col("revised"), F.lit(False)), F.col("symbol"), F.concat(F.lit("not known to be free of revisions: "), "symbol"), "string")
    rows = _observations(judged.withColumn("symbol", sound))
    at = instant(F.to_date("_o.date"))
    made = rows.select("symbol", "units", at.alias("as_of"), (at + F.make_dt_interval(hours=F.lit(lag_hours))).alias("known_at"), number(F.col("_o.value")).alias("value"), F.lit(False).alias("vintage"))
    return stamped(made.where("value IS NOT NULL"), "fred", "series_observations")


def vintage_observations(payloads: DataFrame) -> DataFrame:
    """Every vintage of a series: known from the day it was published, never before the day it describes."""
    rows = _observations(payloads)
    at = instant(F.to_date("_o.date"))
    made = rows.select("symbol", "units", at.alias("as_of"), F.greatest(instant(F.to_date("_o.realtime_start")), at).alias("known_at"), number(F.col("_o.value")).alias("value"), F.lit(True).alias("vintage"))
    return stamped(made.where("value IS NOT NULL"), "alfred", "series_observations")


def weekly_stocks(payloads: DataFrame, calendar: DataFrame, start=None, end=None) -> DataFrame:
    """Weekly stocks (symbol, units, release_weekday with Monday 0, payload), known at 10:30 in New York on the release day.

    The release is the next such weekday after the period's end, moved on from holidays; start and end bound the release.
    """
    rows = payloads.withColumn("_d", F.explode(F.from_json("payload", "response struct<data: array<struct<period: string, value: string>>>")["response"]["data"]))
    rows = rows.select("symbol", "units", "release_weekday", F.to_date("_d.period").alias("day"), number(F.col("_d.value")).alias("value")).where("value IS NOT NULL")
    ahead = F.pmod(F.col("release_weekday") - F.weekday("day"), F.lit(7))
    rows = C.add_due(rows.withColumn("_planned", F.date_add("day", F.when(ahead == 0, 7).otherwise(ahead).cast("int"))), "_planned", 0, "_released", calendar)
    made = rows.withColumns({"as_of": instant(F.col("day")), "known_at": C.eastern_instant(F.col("_released"), 10, 30), "vintage": F.lit(False)})
    if start is not None:
        made = made.where(F.col("known_at") >= F.lit(start))
    if end is not None:
        made = made.where(F.col("known_at") <= F.lit(end))
    return stamped(made, "eia", "series_observations")


def positioning(wide: DataFrame, report: str, calendar: DataFrame, pre_weekly: bool = False) -> DataFrame:
    """A positioning report (one row a contract and week) in long form, known on release: Tuesday + 3 days at 15:30, moved on from holidays.

    Weeks before the report was weekly fail, or with pre_weekly are known 90 days later.
    """
    layout = REPORTS[report]
    names = {f"{category}|{measure}": column for category, measures in layout.items() for measure, column in measures.items() if column in wide.columns}
    cells = wide.select(F.upper(F.trim("cftc_contract_market_code")).alias("symbol"), F.to_date(F.substring("report_date_as_yyyy_mm_dd", 1, 10)).alias("day"), F.col("market_and_exchange_names").alias("name"), F.col("contract_units"), *[number(F.col(c).cast("string")).alias(n) for n, c in names.items()])
    early = F.col("day") < F.lit(WEEKLY_SINCE).cast("date")
    if not pre_weekly:
        cells = cells.withColumn("day", demand(~early, F.col("day"), F.concat(F.lit("before weekly reports: "), F.col("day").cast("string")), "date"))
    long = cells.unpivot(["symbol", "day", "name", "contract_units"], list(names), "_m", "value").where("value IS NOT NULL")
    long = C.add_due(long, "day", PROCESSING_DAYS, "_released", calendar)
    known = F.when(F.col("day") < F.lit(WEEKLY_SINCE).cast("date"), instant(F.date_add("day", PRE_WEEKLY_LAG_DAYS))).otherwise(C.eastern_instant(F.col("_released"), 15, 30))
    made = long.withColumns({"as_of": instant(F.col("day")), "known_at": known, "report": F.lit(report), "category": F.split("_m", r"\|")[0], "measure": F.split("_m", r"\|")[1], "exchange": F.trim(F.element_at(F.split("name", " - "), -1))})
    return stamped(made, "cftc_cot", "positioning")


def factor_returns(files: DataFrame, symbols: dict, now=None) -> DataFrame:
    """Daily returns of prose CSVs (payload): the first table after a header that starts with a comma; -99 is missing; per cent to shares.

    Known 60 days later, or now if that is sooner.
    """
    lines = F.split("payload", r"\r?\n")
    header = F.filter(lines, lambda x: F.trim(x).startswith(","))[0]
    sound = demand(header.isNotNull(), header, F.lit("no header row in a factor file"), "string")
    dated = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("line"), F.trim(x).rlike(r"^\d{8}\s*,").alias("dated")))
    rows = files.select(sound.alias("_header"), dated.alias("_lines"))
    first = F.filter("_lines", lambda s: s["dated"])[0]["i"]
    rows = rows.withColumn("_first", first)
    stop = F.filter("_lines", lambda s: (s["i"] > F.col("_first")) & ~s["dated"])[0]["i"]
    rows = rows.withColumn("_stop", F.coalesce(stop, F.lit(1 << 30))).select("_header", "_stop", F.explode("_lines").alias("s")).where("s.dated AND s.i < _stop")
    cells = rows.select(F.split("s.line", ",")[0].alias("_day"), F.posexplode(F.arrays_zip(F.split("_header", ",").alias("name"), F.split("s.line", ",").alias("value"))).alias("_i", "c")).where("_i > 0")
    table = F.create_map(*[F.lit(x) for pair in symbols.items() for x in pair])
    made = cells.select(table[F.trim("c.name")].alias("symbol"), F.to_date(F.trim("_day"), "yyyyMMdd").alias("day"), number(F.col("c.value")).alias("_v")).where("symbol IS NOT NULL AND _v > -99")
    moment = F.current_timestamp() if now is None else F.lit(now)
    made = made.withColumns({"as_of": instant(F.col("day")), "known_at": F.least(instant(F.date_add("day", FACTOR_LAG_DAYS)), moment), "value": F.col("_v") / 100, "units": F.lit("daily return"), "vintage": F.lit(False)})
    return stamped(made, "ken_french", "series_observations")


def anomalies(table: DataFrame) -> DataFrame:
    """Published predictors (the documentation table, all columns as text): known at the end of the year of publication."""
    told = lambda c: F.when(F.upper(F.trim(c)) != "NA", text(F.col(c)))
    year = lambda c: F.expr(f"CASE WHEN try_cast(trim(`{c}`) AS double) BETWEEN 1900 AND 2100 THEN CAST(try_cast(trim(`{c}`) AS double) AS int) END")
    named = reduce(lambda df, c: df.withColumnRenamed(c, c.replace(".", "_")), [c for c in table.columns if "." in c], table)
    published, covered = year("Year"), F.coalesce(year("SampleEndYear"), year("Year"))
    end = lambda y: instant(F.make_date(y, F.lit(12), F.lit(31)))
    made = named.where(F.trim("Acronym") != "").where(published.isNotNull()).select(
        F.trim("Acronym").alias("symbol"), F.least(end(covered), end(published)).alias("as_of"), end(published).alias("known_at"), F.substring(F.coalesce(text(F.col("LongDescription")), "Acronym"), 1, 400).alias("name"), told("Authors").alias("authors"), told("Journal").alias("journal"),
        F.coalesce(told("Cat_Signal"), F.lit("unknown")).alias("category"), told("Signal Rep Quality").alias("replication"), told("Predictability in OP").alias("evidence"), number(F.col("Return")).alias("published_return"), number(F.col("T-Stat")).alias("published_t_stat"), number(F.col("Sign")).alias("sign"),
    )
    return stamped(made, "open_asset_pricing", "anomaly_catalogue")
