"""Registered queries that go through the lake: the driver's tables are written as datasets, and read by the engine's own functions.

The lake is written once a session and input, in the shared folder, and goes when the session's process ends.  Lines are
daily bars (a part is a symbol, its ship day the day, known some days later) and funds' holdings; orders are
members' reports and contract actions.
"""

import atexit
import datetime as dt
import zlib

from pyspark.sql import functions as F

from chronolake import calendars as C
from chronolake import schemas
from chronolake.lake import Lake
from chronolake.plans import analytics
from chronolake.plans import events as E
from chronolake.plans.catalogue import query, table
from chronolake.plans.lens import Lens
from chronolake.session import shared_dir

_MADE = {}
MOMENT = "1998-06-30"


def _remove(spark, path):
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone; the shared folder's owner clears it
        return


def lake(spark, sf_dir, name="lake", fill=True) -> Lake:
    """The lake over the tables of sf_dir."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        made = Lake(spark, f"{shared_dir(spark)}/catalogue-{key[0]}-{zlib.crc32(sf_dir.encode()):08x}-{name}")
        atexit.register(_remove, spark, made.path)
        if fill:
            for frame, kind in ((bars(spark, sf_dir), "equity"), (reports(spark, sf_dir), "disclosure"), (holdings(spark, sf_dir), "disclosure"), (contracts(spark, sf_dir), "disclosure")):
                made.write(frame, kind)
        _MADE[key] = made
    return _MADE[key]


def _stamped(rows, source, name):
    spec = schemas.dataset(name)
    rows = rows.withColumns({"source": F.lit(source), "dataset": F.lit(name), "ingested_at": F.col("known_at")})
    return schemas.with_missing(rows, name).select(*[f.name for f in spec.schema])


def bars(spark, sf_dir):
    li, price = table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")
    known = F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_linenumber") % 3, hours=F.lit(21))
    rows = li.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("l_shipdate").alias("as_of"), known.alias("known_at"), *[price.alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").alias("volume"))
    return _stamped(rows, "ship", "ohlcv_daily")


#: bars as SQL: rows that are equal in all columns are held once.
BARS = "SELECT DISTINCT 'P' || l_partkey AS symbol, l_shipdate AS as_of, l_shipdate + to_days(CAST(l_linenumber % 3 AS INTEGER)) + INTERVAL 21 HOUR AS known_at, l_extendedprice AS close, l_quantity AS volume FROM lineitem"
_LATEST = "row_number() OVER (PARTITION BY symbol, as_of ORDER BY known_at DESC, close DESC, volume DESC)"
_KNOWN = f"SELECT *, {_LATEST} AS r, min(known_at) OVER (PARTITION BY symbol, as_of) AS first_known_at FROM ({BARS}) WHERE known_at <= TIMESTAMP '1998-06-30 23:59:59.999999'"


def reports(spark, sf_dir):
    """Orders as lines of members' reports: four orders a report."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "sale").when(F.col("o_orderstatus") == "O", "purchase").otherwise("exchange")
    rows = o.select(
        F.when(key % 9 == 0, "NO_TICKER").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("symbol"), F.col("o_orderdate").alias("as_of"), (F.col("o_orderdate") + F.make_dt_interval(days=(key % 60).cast("int"), hours=F.lit(3))).alias("known_at"),
        F.lit("house").alias("chamber"), F.concat(F.lit("D"), F.floor(key / 4).cast("string")).alias("doc_id"), (key % 4 + 1).alias("line"), F.concat(F.lit("Hon. Ann Lee"), (key % 7).cast("string")).alias("member"), F.lit("TX21").alias("state_district"), F.col("o_orderpriority").alias("asset"),
        kind.alias("transaction_type"), F.floor("o_totalprice").cast("double").alias("amount_min"), F.concat(F.lit("$1,001 - $"), (key % 5).cast("string")).alias("amount_text"), F.when(key % 6 == 0, "amended").otherwise("new").alias("filing_status"),
    )
    return _stamped(rows, "house_clerk", "congress_trades")


def holdings(spark, sf_dir):
    """Lines as funds' holdings: what a supplier shipped of a part in a quarter, reported forty days after it."""
    li = table(spark, sf_dir, "lineitem").withColumn("as_of", F.date_trunc("quarter", "l_shipdate"))
    sums = li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), "as_of", F.concat(F.lit("Q"), (F.col("l_partkey") % 40).cast("string")).alias("cusip")).agg(F.sum("l_quantity").alias("shares"), F.round(F.sum("l_extendedprice"), 2).alias("value_usd"), F.count(F.lit(1)).alias("lines"))
    rows = sums.withColumns({"known_at": F.col("as_of") + F.expr("INTERVAL 130 DAYS"), "manager_name": F.concat(F.lit("Fund "), F.col("symbol")), "put_call": F.lit("NONE"), "shares_type": F.lit("SH"), "accession": F.concat_ws("-", "symbol", F.date_format("as_of", "yyyyMMdd")), "issuer_name": F.col("cusip"), "form": F.lit("13F-HR")})
    return _stamped(rows, "sec_13f", "institutional_holdings")


def contracts(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    amount = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    rows = o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), F.col("o_orderdate").alias("as_of"), (F.col("o_orderdate") + F.expr("INTERVAL 92 DAYS")).alias("known_at"), key.cast("string").alias("transaction_key"), key.cast("string").alias("award_id"), (key % 3).cast("string").alias("modification_number"),
        F.lit("ACME").alias("recipient_name"), F.lit("U1").alias("parent_uei"), F.col("o_orderpriority").alias("awarding_agency"), (key % 2 == 0).alias("defense"), F.when(key % 5 == 0, "EXERCISE AN OPTION").alias("action_type"), amount.alias("obligation_usd"),
    )
    return _stamped(rows, "usaspending", "government_contracts")


# Scans and snapshots ------------------------------------------------------------------------------
@query(f"SELECT symbol, as_of, close, volume FROM ({_KNOWN}) WHERE r = 1 AND as_of >= TIMESTAMP '1996-01-01' AND as_of <= TIMESTAMP '1998-06-30 23:59:59.999999'")
def lake_as_of(spark, sf_dir):
    """A snapshot: what was knowable at its instant, the latest version of each key."""
    return lake(spark, sf_dir).as_of(MOMENT).ohlcv_daily(start="1996-01-01").select("symbol", "as_of", "close", "volume")


@query(f"SELECT symbol, as_of, known_at, close, first_known_at FROM ({_KNOWN}) WHERE r = 1")
def lake_first_known(spark, sf_dir):
    rows = lake(spark, sf_dir).scan("ohlcv_daily", source="ship", asset_class="equity", known_before=MOMENT, first_known=True)
    return rows.select("symbol", "as_of", "known_at", "close", "first_known_at")


@query(f"""
    SELECT symbol, as_of, known_at, close FROM ({BARS}) WHERE as_of >= TIMESTAMP '1997-01-01' AND as_of <= TIMESTAMP '1999-12-31 23:59:59.999999'
    AND symbol IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 40)""")
def lake_versions_of_symbols(spark, sf_dir):
    """All versions in a span of days, of symbols that come as a relation."""
    wanted = table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"))
    rows = lake(spark, sf_dir).scan("ohlcv_daily", symbols=wanted, start="1997-01-01", end="1999-12-31", dedup=False)
    return rows.select("symbol", "as_of", "known_at", "close")


@query(f"""
    SELECT 'ship' AS source, 'ohlcv_daily' AS dataset, 'equity' AS asset_class, count(*) AS rows, count(DISTINCT symbol) AS symbols, min(as_of) AS first_as_of, max(as_of) AS last_as_of, max(known_at) AS last_known_at FROM ({BARS})
    UNION ALL SELECT 'usaspending', 'government_contracts', 'disclosure', count(*), count(DISTINCT o_custkey), min(o_orderdate), max(o_orderdate), max(o_orderdate) + INTERVAL 92 DAY FROM orders""")
def lake_stats(spark, sf_dir):
    rows = lake(spark, sf_dir).stats().where("dataset IN ('ohlcv_daily', 'government_contracts') AND files > 0 AND bytes > 0 AND age_days > 0")
    return rows.select("source", "dataset", "asset_class", "rows", "symbols", "first_as_of", "last_as_of", "last_known_at")


@query("SELECT DISTINCT s AS symbol FROM (SELECT 'P' || l_partkey AS s FROM lineitem UNION ALL SELECT 'C' || o_custkey FROM orders WHERE o_orderkey % 9 <> 0)")
def lake_symbols(spark, sf_dir):
    """Symbols of two datasets without the placeholder."""
    return lake(spark, sf_dir).symbols_in(["ohlcv_daily", "congress_trades"])


@query(f"SELECT symbol, max(as_of) - INTERVAL 7 DAY AS resume_at FROM ({BARS}) GROUP BY 1")
def lake_resume_points(spark, sf_dir):
    return lake(spark, sf_dir).resume_points("ohlcv_daily", "ship")


@query(f"""
    SELECT h.symbol, h.held_from, f.fetched_from FROM (SELECT symbol, min(as_of) AS held_from FROM ({BARS}) GROUP BY 1) h
    JOIN (SELECT symbol, min(as_of) AS fetched_from FROM ({BARS}) WHERE close > 50000 GROUP BY 1) f ON f.symbol = h.symbol WHERE fetched_from > held_from + INTERVAL 10 DAY""")
def lake_coverage_regressions(spark, sf_dir):
    return lake(spark, sf_dir).coverage_regressions(bars(spark, sf_dir).where("close > 50000"), "ohlcv_daily").select("symbol", "held_from", "fetched_from")


@query(f"SELECT (SELECT count(*) FROM ({BARS}) WHERE close > 50000) AS first, (SELECT count(*) FROM ({BARS}) WHERE NOT close > 50000) AS second, 0 AS third")
def lake_appends_once(spark, sf_dir):
    """Rows that three writes add: dear bars, then all, then all again."""
    own = lake(spark, sf_dir, "appends", fill=False)
    _remove(spark, own.path)
    rows = bars(spark, sf_dir)
    added = [own.write(r, "equity") for r in (rows.where("close > 50000"), rows, rows)]
    return spark.createDataFrame([added], "first long, second long, third int")


@query("""
    SELECT count(*) FILTER (WHERE l_quantity < 3) AS null_close, count(*) FILTER (WHERE l_quantity > 48) AS before_as_of, 0 AS null_symbol, 0 AS in_future FROM lineitem""")
def lake_violations(spark, sf_dir):
    """What validation counts in bars with values taken away and instants put before their day."""
    spoiled = bars(spark, sf_dir).withColumns({"close": F.when(F.col("volume") >= 3, F.col("close")), "known_at": F.when(F.col("volume") > 48, F.col("as_of") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("known_at"))})
    found = schemas.violations(spoiled, "ohlcv_daily")
    return found.select("null_close", "before_as_of", F.col("null_symbol").cast("int").alias("null_symbol"), F.col("in_future").cast("int").alias("in_future"))


def _asked(text):
    """Register one query that a snapshot's SQL and DuckDB both run as it stands, over ohlcv_daily."""
    view = f"WITH ohlcv_daily AS (SELECT symbol, as_of, known_at, close, volume FROM ({_KNOWN}) WHERE r = 1)"

    def put(f):
        sql = f"{view}, {text[5:]}" if text.startswith("WITH ") else f"{view} {text}"

        def run(spark, sf_dir):
            return lake(spark, sf_dir).as_of(MOMENT).sql(text, ["ohlcv_daily"])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(sql)(run)

    return put


@_asked("SELECT a.symbol, count(*) AS n, round(sum(a.close - b.close), 2) AS apart FROM ohlcv_daily a JOIN ohlcv_daily b USING (symbol) WHERE a.as_of > b.as_of GROUP BY 1")
def sql_join_using():
    """JOIN USING, ordinals and aliases through a snapshot's SQL."""


@_asked("SELECT symbol, mode(volume) AS common FROM (SELECT symbol, volume, count(*) OVER (PARTITION BY symbol, volume) AS n FROM ohlcv_daily) WHERE n > 1 GROUP BY 1 HAVING count(DISTINCT volume) = 1")
def sql_mode():
    """mode() where it is not tied."""


@_asked("SELECT symbol, floor(close)::bigint AS whole, (volume > 25) AS many FROM ohlcv_daily WHERE (close > 20000) AND NOT (volume < 5) ORDER BY close DESC, symbol, as_of LIMIT 50")
def sql_casts_and_limit():
    """Casts, boolean predicates and a report of the first fifty."""


@_asked("WITH t AS (SELECT symbol, max(close) AS top FROM ohlcv_daily GROUP BY 1) SELECT symbol, top FROM t WHERE top > (SELECT avg(close) FROM ohlcv_daily) AND symbol NOT IN (SELECT symbol FROM ohlcv_daily WHERE volume < 2)")
def sql_cte_and_subqueries():
    """Common table expressions, scalar subqueries and NOT IN."""


@_asked("SELECT symbol FROM ohlcv_daily WHERE close > 90000 UNION SELECT symbol FROM ohlcv_daily WHERE volume > 49 EXCEPT SELECT symbol FROM ohlcv_daily WHERE volume < 2")
def sql_set_operations():
    """Set operations through a snapshot's SQL."""


# Events -------------------------------------------------------------------------------------------
_DAYS = ("traded_on", "disclosed_on")
_NY = "CAST(timezone('America/New_York', timezone('UTC', {})) AS DATE)"


@query(f"""
    SELECT 'congress:D' || (o_orderkey // 4) || ':' || (o_orderkey % 4 + 1) AS id, CASE WHEN o_orderkey % 9 <> 0 THEN 'C' || o_custkey END AS ticker, CASE o_orderstatus WHEN 'F' THEN 'sell' WHEN 'O' THEN 'buy' ELSE 'none' END AS direction,
           CASE o_orderstatus WHEN 'F' THEN 'Sold' WHEN 'O' THEN 'Bought' ELSE 'Exchanged' END AS verb, '$1,001 to $' || (o_orderkey % 5) AS size, CAST(o_orderdate AS DATE) AS traded_on, d AS disclosed_on, CAST(date_diff('day', CAST(o_orderdate AS DATE), d) AS INTEGER) AS lag_days
    FROM (SELECT *, {_NY.format("o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) + INTERVAL 3 HOUR")} AS d FROM orders)""", _DAYS)  # fmt: skip
def member_events(spark, sf_dir):
    frame = lake(spark, sf_dir).scan("congress_trades")
    return E.member_events(frame, C.workdays(spark)).select("id", "ticker", "direction", "verb", "size", "traded_on", "disclosed_on", "lag_days")


@query("""
    SELECT 'contract:' || o_orderkey AS id, 'C' || o_custkey AS ticker, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 0 THEN 'sell' ELSE 'buy' END AS direction,
           CASE WHEN o_orderstatus = 'F' AND o_totalprice > 0 THEN 'Took back' WHEN o_orderkey % 3 = 0 THEN 'Awarded' WHEN o_orderkey % 5 = 0 THEN 'Exercised an option for' ELSE 'Added' END AS verb,
           CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS value_usd, CAST(o_orderdate AS DATE) AS traded_on
    FROM orders WHERE abs(o_totalprice) >= 150000""", ("traded_on",))
def contract_events(spark, sf_dir):
    frame = lake(spark, sf_dir).scan("government_contracts")
    return E.contract_events(frame, 150_000).select("id", "ticker", "direction", "verb", "value_usd", "traded_on")


_BOOK = "SELECT CAST(l_suppkey AS VARCHAR) AS manager, date_trunc('quarter', l_shipdate) AS as_of, 'Q' || (l_partkey % 40) AS cusip, sum(l_quantity) AS held, round(sum(l_extendedprice), 2) AS value_usd FROM lineitem GROUP BY 1, 2, 3"


@query(f"""
    WITH b AS ({_BOOK}), q AS (SELECT manager, as_of, row_number() OVER (PARTITION BY manager ORDER BY as_of) AS ix FROM (SELECT DISTINCT manager, as_of FROM b)),
         n AS (SELECT b.*, ix FROM b JOIN q USING (manager, as_of)),
         j AS (SELECT coalesce(n.manager, p.manager) AS manager, coalesce(n.ix, p.ix + 1) AS ix, coalesce(n.cusip, p.cusip) AS cusip, coalesce(n.held, 0) AS held, coalesce(p.held, 0) AS was, n.value_usd FROM n FULL JOIN n p ON n.manager = p.manager AND n.cusip = p.cusip AND n.ix = p.ix + 1),
         m AS (SELECT j.*, q.as_of FROM j JOIN q ON q.manager = j.manager AND q.ix = j.ix WHERE j.ix > 1 AND held <> was AND (was = 0 OR held = 0 OR abs(held - was) / was >= 0.1))
    SELECT 'fund:' || manager AS actor_id, cusip AS asset, CAST(as_of AS DATE) AS traded_on, CASE WHEN held > was THEN 'buy' ELSE 'sell' END AS direction,
           CASE WHEN was = 0 THEN 'Opened' WHEN held = 0 THEN 'Sold out of' WHEN held > was THEN 'Added' ELSE 'Cut' END AS verb, round(CASE WHEN held <> 0 AND value_usd <> 0 THEN value_usd END, 2) AS value_usd FROM m""", ("traded_on",))
def fund_events(spark, sf_dir):
    """What changed between funds' consecutive reports."""
    book = lake(spark, sf_dir).scan("institutional_holdings", first_known=True)
    nobody = spark.createDataFrame([], "cusip string, ticker string")
    return E.fund_events(book, nobody, C.workdays(spark), None).select("actor_id", "asset", "traded_on", "direction", "verb", F.round("value_usd", 2).alias("value_usd"))


@query("""
    WITH t AS (SELECT DISTINCT l_orderkey FROM lineitem), s AS (SELECT min(l_shipdate) AS first FROM lineitem)
    SELECT 'unread:' || o_orderkey AS id, o_orderdate AS disclosed_at FROM orders, s WHERE o_orderkey NOT IN (SELECT l_orderkey FROM t) AND o_orderdate >= s.first""")
def unread_events(spark, sf_dir):
    """Orders without lines, as reports of which no line was read."""
    filings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("P").alias("filing_type"), F.col("o_orderdate").alias("known_at"), *[F.lit(v).alias(c) for c, v in (("first_name", "ANN"), ("last_name", "LEE"), ("chamber", "house"), ("symbol", "TX21"), ("url", ""))], F.lit(None).cast("string").alias("suffix"))
    trades = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_shipdate").alias("known_at"))
    return E.unread_events(filings, trades).select("id", "disclosed_at")


@query("""
    SELECT 'insider:' || l_suppkey AS actor_id, 'P' || l_partkey AS ticker, CASE l_returnflag WHEN 'A' THEN 'Bought' WHEN 'R' THEN 'Sold' ELSE 'Exercised options for' END AS verb, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS direction,
           round(sum(l_quantity * l_extendedprice), 2) AS value_usd, CAST(min(l_shipdate) AS DATE) AS traded_on, l_returnflag = 'N' OR bool_or(l_discount > 0.08) AS noise
    FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_returnflag""", ("traded_on",))
def insider_events(spark, sf_dir):
    """Lines as insiders' transactions: one event for each filing, owner and kind."""
    li, key = table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    code = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("M")
    rows = li.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("l_shipdate").alias("as_of"), F.col("l_shipdate").alias("known_at"), F.lit(None).cast("long").alias("issuer_cik"), F.lit("ACME").alias("issuer_name"), key.alias("owner_cik"), F.concat(F.lit("OWNER "), key.cast("string")).alias("owner_name"),
        F.lit(True).alias("is_director"), F.lit(False).alias("is_officer"), F.lit(False).alias("is_ten_percent_owner"), F.lit(None).cast("string").alias("officer_title"), F.lit("4").alias("form"), F.col("l_orderkey").cast("string").alias("accession"), F.col("l_linenumber").cast("long").alias("line"),
        F.lit("Common Stock").alias("security_title"), F.lit(False).alias("is_derivative"), code.alias("transaction_code"), F.when(code == "S", "D").otherwise("A").alias("acquired_disposed"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") > 0.08).alias("planned_10b5_1"),
    )
    made = E.insider_events(rows, C.workdays(spark))
    return made.select("actor_id", "ticker", "verb", "direction", F.round("value_usd", 2).alias("value_usd"), "traded_on", "noise")


# Prices -------------------------------------------------------------------------------------------
@query(f"""
    SELECT symbol, {_NY.format("as_of")} AS day, arg_max(close, as_of) AS close FROM ({_KNOWN}) WHERE r = 1 AND as_of >= TIMESTAMP '1997-01-01' AND as_of <= TIMESTAMP '1998-06-30 23:59:59.999999' AND symbol IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 40) GROUP BY 1, 2""", ("day",))
def lens_closes(spark, sf_dir):
    """Closes by Washington day, of one source a symbol."""
    wanted = table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"))
    return Lens(lake(spark, sf_dir), MOMENT).closes(wanted, dt.date(1997, 1, 1))


_CLOSES = "SELECT symbol, CAST(as_of AS DATE) AS day, max(close) AS close FROM (SELECT 'P' || l_partkey AS symbol, l_shipdate AS as_of, l_extendedprice AS close FROM lineitem) GROUP BY 1, 2"


@query(f"""
    WITH c AS ({_CLOSES}), e AS (SELECT o_orderkey, 'P' || (o_orderkey % (SELECT count(*) FROM part)) AS ticker, CAST(o_orderdate AS DATE) AS traded_on, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 500 AS INTEGER) AS disclosed_on, o_orderstatus FROM orders),
         b AS (SELECT e.*, c.close AS c0 FROM e ASOF JOIN c ON e.ticker = c.symbol AND e.traded_on >= c.day WHERE o_orderkey % 500 <= 400),
         a AS (SELECT b.*, c.close AS c1 FROM b ASOF JOIN c ON b.ticker = c.symbol AND b.disclosed_on >= c.day)
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN 'senate' WHEN o_orderstatus = 'O' THEN 'house' ELSE 'insider' END AS "group", round((c1 - c0) / c0 * 100, 6) AS move FROM a WHERE c0 <> 0""")
def price_moves(spark, sf_dir):
    """How prices moved between trade and disclosure."""
    closes = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("close"))
    parts = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("_n"))  # one row
    o, key, day = table(spark, sf_dir, "orders").crossJoin(F.broadcast(parts)), F.col("o_orderkey"), F.to_date("o_orderdate")
    lag = (key % 500).cast("int")
    rows = o.select(key.cast("string").alias("id"), F.concat(F.lit("P"), (key % F.col("_n")).cast("string")).alias("ticker"), day.alias("traded_on"), F.date_add(day, lag).alias("disclosed_on"), lag.alias("lag_days"), F.when(F.col("o_orderstatus").isin("F", "O"), "congress").otherwise("insider").alias("kind"), F.when(F.col("o_orderstatus") == "F", "Senate").otherwise("TX21").alias("role"))
    return analytics.moves(rows, closes).select("id", "group", F.round("move", 6).alias("move"))


@query("""
    WITH c AS (SELECT 'Q' || (l_partkey % 40) AS cusip, 'S' || (l_suppkey % 11) AS ticker, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT cusip, ticker FROM (SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY n DESC, ticker) AS r FROM c) WHERE r = 1""")
def cusip_bridge(spark, sf_dir):
    """The pairing met most often."""
    li = table(spark, sf_dir, "lineitem")
    return E.bridge(li.select(F.concat(F.lit("Q"), (F.col("l_partkey") % 40).cast("string")).alias("cusip"), F.concat(F.lit("S"), (F.col("l_suppkey") % 11).cast("string")).alias("symbol")))
