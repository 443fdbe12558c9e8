"""Prices, bars, funding, instruments, index histories and option chains."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake import calendars as C
from chronolake.functions import text as X
from chronolake.operators.shapes import gaps
from chronolake.sources.base import demand, number, stamped

CHART = """chart struct<result: array<struct<
    meta: struct<symbol: string, currency: string, exchangeName: string, exchangeTimezoneName: string>, timestamp: array<bigint>,
    indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>,
    events: struct<dividends: map<string, struct<amount: double, date: bigint>>, splits: map<string, struct<date: bigint, numerator: double, denominator: double>>>>>>"""


def _charts(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("_r", F.explode(F.from_json("payload", CHART)["chart"]["result"]))


def chart_bars(payloads: DataFrame, sessions: DataFrame, now=None) -> DataFrame:
    """Daily bars of chart JSON (symbol, venue, payload): parallel arrays zipped, joined to sessions (venue, day, close_at).

    Null closes, days without a session and sessions that have not closed yet go.
    """
    q = F.col("_r.indicators.quote")[0]
    adjusted = F.coalesce(F.col("_r.indicators.adjclose")[0]["adjclose"], F.transform(F.col("_r.timestamp"), lambda _: F.lit(None).cast("double")))
    zipped = F.arrays_zip(F.col("_r.timestamp").alias("at"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume"), adjusted.alias("adj_close"))
    rows = _charts(payloads).select("symbol", "venue", F.col("_r.meta.currency").alias("currency"), F.col("_r.meta.exchangeTimezoneName").alias("_zone"), F.explode(zipped).alias("_b"))
    rows = rows.select("symbol", "venue", "currency", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("_b.at"), F.coalesce("_zone", F.lit(C.EASTERN)))).alias("day"), "_b.open", "_b.high", "_b.low", "_b.close", "_b.volume", "_b.adj_close").where("close IS NOT NULL")
    closed = C.session_closes(rows, sessions).where(F.col("close_at") <= (F.current_timestamp() if now is None else F.lit(now)))
    return stamped(closed.withColumns({"as_of": F.col("close_at"), "known_at": F.col("close_at")}), "yahoo", "ohlcv_daily")


def coverage(bars: DataFrame, sessions: DataFrame, least: float = 0.95) -> DataFrame:
    """symbol, expected, received, share, enough: sessions between a symbol's first and last bar that have a bar."""
    days = bars.select("symbol", "venue", F.to_date("as_of").alias("day")).distinct()
    spans = days.groupBy("symbol", "venue").agg(F.min("day").alias("_a"), F.max("day").alias("_z"), F.count(F.lit(1)).alias("received"))
    expected = spans.join(sessions.select("venue", "day"), "venue").where("day BETWEEN _a AND _z").groupBy("symbol", "venue").agg(F.count(F.lit(1)).alias("expected"))
    out = spans.join(expected, ["symbol", "venue"]).withColumn("share", F.col("received") / F.col("expected"))
    return out.select("symbol", "expected", "received", "share", (F.col("share") >= least).alias("enough"))


def chart_actions(payloads: DataFrame, sessions: DataFrame) -> DataFrame:
    """Dividends and splits of chart JSON, known at the close of their session."""
    charts = _charts(payloads).select("symbol", "venue", F.coalesce("_r.meta.exchangeTimezoneName", F.lit(C.EASTERN)).alias("_zone"), "_r.events.*")
    nothing = F.lit(None).cast("double")
    paid = charts.select("symbol", "venue", "_zone", F.explode(F.map_values("dividends")).alias("e")).select("symbol", "venue", "_zone", F.col("e.date").alias("at"), F.lit("dividend").alias("action"), F.col("e.amount").alias("amount"), nothing.alias("split_numerator"), nothing.alias("split_denominator"))
    split = charts.select("symbol", "venue", "_zone", F.explode(F.map_values("splits")).alias("e")).select("symbol", "venue", "_zone", F.col("e.date").alias("at"), F.lit("split").alias("action"), nothing.alias("amount"), F.col("e.numerator").alias("split_numerator"), F.col("e.denominator").alias("split_denominator"))
    rows = paid.unionByName(split).withColumn("day", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("at"), F.col("_zone"))))
    closed = C.session_closes(rows, sessions)
    return stamped(closed.withColumns({"as_of": F.col("close_at"), "known_at": F.col("close_at")}), "yahoo", "corporate_actions")


def csv_bars(payloads: DataFrame, sessions: DataFrame) -> DataFrame:
    """Daily bars of CSV pages (symbol, venue, payload); a page that is no CSV (an anti-bot page) fails."""
    lines = F.split(F.trim("payload"), r"\r?\n")
    sound = demand(F.col("payload").startswith("Date,"), lines, F.concat(F.lit("not a price file: "), F.substring("payload", 1, 60)), "array<string>")
    rows = payloads.select("symbol", "venue", F.explode(F.slice(sound, 2, 1 << 30)).alias("line")).where("trim(line) <> ''")
    cell = F.split("line", ",")
    rows = rows.select("symbol", "venue", F.to_date(cell[0]).alias("day"), *[number(F.get(cell, i)).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)]).where("close IS NOT NULL")
    closed = C.session_closes(rows, sessions)
    return stamped(closed.withColumns({"as_of": F.col("close_at"), "known_at": F.col("close_at")}), "stooq", "ohlcv_daily")


def klines(payloads: DataFrame, now=None) -> DataFrame:
    """Bars of kline pages (symbol, interval, payload): arrays by position; bars that are still open go."""
    rows = payloads.select("symbol", "interval", F.explode(F.from_json("payload", "array<array<string>>")).alias("k"))
    at = lambda i: F.timestamp_millis(F.col("k")[i].cast("long"))
    value = lambda i: F.col("k")[i].cast("double")
    made = rows.select("symbol", "interval", at(0).alias("as_of"), at(6).alias("known_at"), *[value(i).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)], value(7).alias("quote_volume"), F.col("k")[8].cast("long").alias("trades"))
    return stamped(made.where(F.col("known_at") <= (F.current_timestamp() if now is None else F.lit(now))), "binance", "ohlcv_bars")


def funding(payloads: DataFrame) -> DataFrame:
    """Funding rates with the hours since the one before."""
    rows = payloads.select(F.explode(F.from_json("payload", "array<struct<symbol: string, fundingTime: bigint, fundingRate: string, markPrice: string>>")).alias("f"))
    rows = rows.select("f.symbol", F.timestamp_millis("f.fundingTime").alias("as_of"), F.timestamp_millis("f.fundingTime").alias("known_at"), F.col("f.fundingRate").cast("double").alias("funding_rate"), number(F.col("f.markPrice")).alias("mark_price"))
    return stamped(gaps(rows.dropDuplicates(["symbol", "as_of"]), ["symbol"], "as_of", "interval_hours"), "binance", "funding_rate")


def exchange_symbols(payloads: DataFrame, now=None) -> DataFrame:
    """The instruments listed now."""
    rows = payloads.select(F.explode(F.from_json("payload", "symbols array<struct<symbol: string, status: string, baseAsset: string, quoteAsset: string>>")["symbols"]).alias("s"))
    moment = F.current_timestamp() if now is None else F.lit(now)
    made = rows.select("s.symbol", F.lit("BINANCE").alias("venue"), F.lower("s.status").alias("status"), F.col("s.symbol").alias("name"), F.col("s.quoteAsset").alias("currency"), F.col("s.baseAsset").alias("base_asset"), F.col("s.quoteAsset").alias("quote_asset"), moment.alias("as_of"), moment.alias("known_at"))
    return stamped(made, "binance", "instruments")


def index_history(payloads: DataFrame, reliable_from=None) -> DataFrame:
    """Closes of index CSVs (symbol, payload) with M/D/Y days, known at 16:15 in New York; reliable_from: (symbol, reliable_from)."""
    lines = F.split(F.trim("payload"), r"\r?\n")
    header = F.split(F.upper(lines[0]), ",")
    at = F.coalesce(F.nullif(F.array_position(header, "CLOSE"), F.lit(0)), F.lit(2)).cast("int")
    rows = payloads.select("symbol", at.alias("_at"), F.explode(F.slice(lines, 2, 1 << 30)).alias("line")).where("trim(line) <> ''")
    cell = F.split("line", ",")
    rows = rows.select("symbol", F.to_date(F.trim(cell[0]), "M/d/yyyy").alias("day"), number(F.element_at(cell, F.col("_at"))).alias("value")).where("value IS NOT NULL")
    if reliable_from is not None:
        rows = rows.join(reliable_from, "symbol", "left").where("reliable_from IS NULL OR day >= reliable_from")
    moment = C.eastern_instant(F.col("day"), 16, 15)
    return stamped(rows.withColumns({"as_of": moment, "known_at": moment, "units": F.lit("index"), "vintage": F.lit(False)}), "cboe", "series_observations")


def option_chain(payloads: DataFrame) -> DataFrame:
    """Quotes of a chain with open interest (symbol, collected_at, payload), known when they were collected."""
    shape = "data struct<current_price: double, last_trade_time: string, options: array<struct<option: string, bid: double, ask: double, last_trade_price: double, volume: double, open_interest: double, iv: double, delta: double, gamma: double, vega: double, theta: double>>>"
    rows = payloads.withColumn("_d", F.from_json("payload", shape)["data"]).select("symbol", "collected_at", F.col("_d.current_price").alias("underlying_price"), F.col("_d.last_trade_time").alias("_quoted"), F.explode("_d.options").alias("o"))
    quoted = F.least(F.coalesce(F.to_utc_timestamp(F.col("_quoted").try_cast("timestamp"), C.EASTERN), F.col("collected_at")), F.col("collected_at"))
    parts = X.occ_parts(F.col("o.option"))
    made = rows.where("o.open_interest > 0").select(
        "symbol", quoted.alias("as_of"), F.col("collected_at").alias("known_at"), parts["expiry"].alias("expiry"), parts["strike"].alias("strike"), parts["right"].alias("right"), "o.bid", "o.ask", F.col("o.last_trade_price").alias("last"),
        "o.volume", "o.open_interest", F.col("o.iv").alias("implied_vol"), "o.delta", "o.gamma", "o.vega", "o.theta", "underlying_price",
    )
    return stamped(made.where("expiry IS NOT NULL"), "options_snapshot", "chain_snapshot")


