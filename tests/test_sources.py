import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronolake import calendars as C
from chronolake import sources
from chronolake.sources import disclosures, filings, macro, market
from chronolake.streaming import ingest
from tests.rows import at, bar, frame


@pytest.fixture(scope="module")
def sessions(spark):
    days = [dt.date(2024, 1, d) for d in (2, 3, 4, 5)]
    return spark.createDataFrame([("XNAS", d, dt.datetime.combine(d, dt.time(21), dt.UTC)) for d in days], "venue string, day date, close_at timestamp")


def epoch(day):
    return int(dt.datetime.combine(day, dt.time(14, 30), dt.UTC).timestamp())


def test_chart(spark, sessions):
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, 6)]
    quote = {k: [1.0, None, 3.0] if k == "close" else [1.0, 2.0, 3.0] for k in ("open", "high", "low", "close", "volume")}
    events = {"dividends": {"1": {"amount": 0.5, "date": epoch(days[0])}}, "splits": {"2": {"date": epoch(days[1]), "numerator": 4.0, "denominator": 1.0}}}
    payload = json.dumps({"chart": {"result": [{"meta": {"currency": "USD", "exchangeTimezoneName": "America/New_York"}, "timestamp": [epoch(d) for d in days], "indicators": {"quote": [quote], "adjclose": [{"adjclose": [0.9, 1.9, 2.9]}]}, "events": events}]}})
    df = spark.createDataFrame([("A", "XNAS", payload)], "symbol string, venue string, payload string")
    bars = market.chart_bars(df, sessions).collect()
    assert [(r.close, r.adj_close, r.as_of.day) for r in bars] == [(1.0, 0.9, 2)]  # a null close and a day without a session go
    assert market.chart_bars(df, sessions, at("2024-01-02T20:00")).count() == 0
    assert {(r.action, r.amount, r.split_numerator) for r in market.chart_actions(df, sessions).collect()} == {("dividend", 0.5, None), ("split", None, 4.0)}
    share = market.coverage(market.chart_bars(df, sessions), sessions).first()
    assert (share.expected, share.received, share.enough) == (1, 1, True)


def test_csv_bars(spark, sessions):
    df = spark.createDataFrame([("A", "XNAS", "Date,Open,High,Low,Close,Volume\n2024-01-03,1,2,0.5,1.5,100\n")], "symbol string, venue string, payload string")
    assert market.csv_bars(df, sessions).first().close == 1.5
    with pytest.raises(Exception, match="not a price file"):
        market.csv_bars(df.withColumn("payload", F.lit("<html>wait</html>")), sessions).collect()


def test_crypto(spark):
    k = [[1704067200000, "1", "2", "0.5", "1.5", "10", 1704153599999, "15", 7, "0", "0", "0"]]
    df = spark.createDataFrame([("BTCUSDT", "1d", json.dumps(k))], "symbol string, interval string, payload string")
    row = market.klines(df).first()
    assert (row.close, row.trades, row.quote_volume) == (1.5, 7, 15.0) and market.klines(df, at("2024-01-01T05:00")).count() == 0
    rates = [{"symbol": "B", "fundingTime": 1704067200000 + h * 3600000, "fundingRate": "0.01", "markPrice": ""} for h in (0, 8, 12)]
    assert [r.interval_hours for r in market.funding(spark.createDataFrame([(json.dumps(rates),)], "payload string")).orderBy("as_of").collect()] == [8.0, 8.0, 4.0]
    listed = json.dumps({"symbols": [{"symbol": "BTCUSDT", "status": "TRADING", "baseAsset": "BTC", "quoteAsset": "USDT"}]})
    assert market.exchange_symbols(spark.createDataFrame([(listed,)], "payload string")).first().status == "trading"


def test_index_and_options(spark):
    df = spark.createDataFrame([("VIX", "DATE,OPEN,HIGH,LOW,CLOSE\n1/2/2024,1,2,0.5,13.2\n"), ("VVIX", "DATE,VVIX\n01/03/2024,80.5\n")], "symbol string, payload string")
    got = {r.symbol: (r.value, r.as_of.hour) for r in market.index_history(df).collect()}
    assert got == {"VIX": (13.2, 21), "VVIX": (80.5, 21)}
    options = [{"option": "SPXW261218C05000000", "bid": 1.0, "ask": 2.0, "open_interest": 5.0, "iv": 0.2}, {"option": "SPXW261218P05000000", "open_interest": 0.0}]
    chain = spark.createDataFrame([("SPX", at("2026-10-01T20:00"), json.dumps({"data": {"current_price": 4900.0, "last_trade_time": "2026-10-01T15:59:00", "options": options}}))], "symbol string, collected_at timestamp, payload string")
    row = market.option_chain(chain).collect()
    assert len(row) == 1 and row[0].right == "call" and row[0].strike == 5000.0 and row[0].as_of <= row[0].known_at


def test_macro(spark):
    cal = C.workdays(spark)
    payload = json.dumps({"observations": [{"date": "2020-01-01", "value": "1.5", "realtime_start": "2020-04-29"}, {"date": "2020-01-02", "value": "."}]})
    df = spark.createDataFrame([("DGS10", payload)], "symbol string, payload string")
    policy = spark.createDataFrame([("DGS10", "percent", False), ("GDP", "usd", True)], "symbol string, units string, revised boolean")
    assert [r.value for r in macro.settled_observations(df, policy).collect()] == [1.5]
    with pytest.raises(Exception, match="not known to be free"):
        macro.settled_observations(df.withColumn("symbol", F.lit("GDP")), policy).collect()
    row = macro.vintage_observations(df.withColumn("units", F.lit("usd"))).first()
    assert row.vintage and str(row.known_at.date()) == "2020-04-29"
    stocks = spark.createDataFrame([("CRUDE", "kb", 2, json.dumps({"response": {"data": [{"period": "2024-06-28", "value": "448"}]}}))], "symbol string, units string, release_weekday int, payload string")
    assert str(macro.weekly_stocks(stocks, cal).select(F.col("known_at").cast("string").alias("t")).first().t) == "2024-07-03 14:30:00"
    wide = spark.createDataFrame([("067651", "2024-06-25T00:00", "CRUDE OIL - NYMEX", "bbl", "1,200", "300", None, "9")], "cftc_contract_market_code string, report_date_as_yyyy_mm_dd string, market_and_exchange_names string, contract_units string, noncomm_positions_long_all string, noncomm_positions_short_all string, comm_positions_long_all string, open_interest_all string")
    got = {(r.category, r.measure): r.value for r in macro.positioning(wide, "legacy", cal).collect()}
    assert got == {("noncommercial", "long"): 1200.0, ("noncommercial", "short"): 300.0, ("total", "open_interest"): 9.0}
    old = wide.withColumn("report_date_as_yyyy_mm_dd", F.lit("1990-01-16"))
    with pytest.raises(Exception, match="before weekly"):
        macro.positioning(old, "legacy", cal).collect()
    assert macro.positioning(old, "legacy", cal, pre_weekly=True).count() == 3
    prose = "This file was made.\n\n,Mkt-RF,SMB\n20240102, 0.50,-99.99\n20240103,-0.25,0.10\n\n Annual\n,Mkt-RF\n20230101,5\n"
    made = macro.factor_returns(spark.createDataFrame([(prose,)], "payload string"), {"Mkt-RF": "KF_MKT", "SMB": "KF_SMB"}).collect()
    assert sorted((r.symbol, r.as_of.day, round(r.value, 6)) for r in made) == [("KF_MKT", 2, 0.005), ("KF_MKT", 3, -0.0025), ("KF_SMB", 3, 0.001)]
    table = spark.createDataFrame([("Mom", "Momentum", "J&T", "JF", "Predictor", "good", "clear", "1.2", "3.4", "1", "1993", "1989"), ("Bad", "x", "y", "z", "NA", "NA", "NA", "NA", "NA", "NA", "soon", "NA")], ["Acronym", "LongDescription", "Authors", "Journal", "Cat.Signal", "Signal Rep Quality", "Predictability in OP", "Return", "T-Stat", "Sign", "Year", "SampleEndYear"])
    row = macro.anomalies(table).collect()
    assert len(row) == 1 and (row[0].category, row[0].published_t_stat, row[0].known_at.year, row[0].as_of.year) == ("Predictor", 3.4, 1993, 1989)


FORM4 = """<?xml version="1.0"?><ownershipDocument><issuer><issuerCik>0000320193</issuerCik><issuerName>Apple Inc.</issuerName></issuer>
<reportingOwner><reportingOwnerId><rptOwnerCik>0001</rptOwnerCik><rptOwnerName>COOK TIMOTHY D</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>1</isOfficer><officerTitle>CEO</officerTitle></reportingOwnerRelationship></reportingOwner>
<reportingOwner><reportingOwnerId><rptOwnerCik>0002</rptOwnerCik><rptOwnerName>TRUST</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>true</isDirector></reportingOwnerRelationship></reportingOwner>
<aff10b5One>1</aff10b5One><nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-01-03</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>1438</value></transactionShares><transactionPricePerShare><value>330.19</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeHolding><securityTitle><value>Other</value></securityTitle></nonDerivativeHolding></nonDerivativeTable>
<derivativeTable><derivativeTransaction><securityTitle><value>Option</value></securityTitle><transactionDate><value>2024-01-03</value></transactionDate><transactionCoding><transactionCode>M</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>5</value></transactionShares></transactionAmounts></derivativeTransaction></derivativeTable></ownershipDocument>"""


def test_filings(spark):
    df = spark.createDataFrame([("AAPL", "0001-24-1", "4", at("2024-01-05T22:00"), FORM4)], "symbol string, accession string, form string, accepted_at timestamp, payload string")
    rows = {r.line: r for r in filings.ownership_documents(df).collect()}
    assert (rows[1].shares, rows[1].price, rows[1].planned_10b5_1, rows[1].is_director, rows[1].officer_title, rows[1].owner_name) == (1438.0, 330.19, True, True, "CEO", "COOK TIMOTHY D; TRUST")
    assert rows[2].is_derivative and rows[2].price is None and len(rows) == 2
    assert filings.ownership_documents(df.withColumn("issuer_cik", F.lit(5).cast("long"))).count() == 0
    table = '<informationTable xmlns="http://x">' + "".join(f"<infoTable><nameOfIssuer>ALLY</nameOfIssuer><titleOfClass>COM</titleOfClass><cusip>02005N100</cusip><value>{v}</value><shrsOrPrnAmt><sshPrnamt>{v * 2}</sshPrnamt><sshPrnamtType>SH</sshPrnamtType></shrsOrPrnAmt></infoTable>" for v in (10, 20)) + "</informationTable>"
    report = spark.createDataFrame([("0001067983", "Berk", dt.date(2022, 9, 30), at("2022-11-14T21:00"), "13F-HR", None, "A1", table, 2, 30.0)], "symbol string, manager_name string, period date, accepted_at timestamp, form string, amendment_type string, accession string, payload string, declared_lines int, declared_value double")
    row = filings.holdings_tables(report).first()
    assert (row.symbol, row.shares, row.value_usd, row.lines, row.put_call) == ("1067983", 60.0, 30000.0, 2, "NONE")
    with pytest.raises(Exception, match="do not add up"):
        filings.holdings_tables(report.withColumn("declared_lines", F.lit(3))).collect()
    text = f"{filings.FAILS_HEADER}\n20240102|00032Q104|AAC|100|ALL CORP|.\n20240102|A00032Q10||50|X|1.5\nTrailer record count 2\nTrailer total quantity of shares 150\n"
    fails = spark.createDataFrame([(at("2024-02-01T00:00"), text)], "posted_at timestamp, payload string")
    assert {(r.symbol, r.price) for r in filings.fails(fails).collect()} == {("AAC", None), ("A00032Q10", 1.5)}
    with pytest.raises(Exception, match="does not fit"):
        filings.fails(fails.withColumn("payload", F.regexp_replace("payload", "shares 150", "shares 151"))).collect()
    fact = lambda v, start=None: {"end": "2023-09-30", "val": v, "form": "10-K", "filed": "2023-11-03"} | ({"start": start} if start else {})
    facts = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact(2.0, "2022-10-01")]}}, "SalesRevenueNet": {"units": {"USD": [fact(9.0, "2022-10-01")]}}, "Assets": {"units": {"USD": [fact(5.0)]}}}}}
    got = {(r.metric, r.fiscal_period, r.value) for r in filings.company_facts(spark.createDataFrame([("AAPL", json.dumps(facts))], "symbol string, payload string")).collect()}
    assert got == {("revenue", "FY", 2.0), ("total_assets", "instant", 5.0)}
    recent = {"filings": {"recent": {"accessionNumber": ["1", "2"], "form": ["4", "8-K"], "filingDate": ["2024-01-03", "2024-01-03"], "acceptanceDateTime": ["2024-01-03T18:30:00.000Z", ""], "primaryDocument": ["a", "b"], "reportDate": ["", ""]}}}
    assert filings.submissions(spark.createDataFrame([("AAPL", json.dumps(recent))], "symbol string, payload string"), ("4",)).count() == 1


PTR = """Name: Hon. Ann Lee
ID Owner Asset Transaction
Type Date Notification
Date Amount Cap.
Gains >
$200?
SP Apple Inc. - Common Stock
(AAPL) [ST] P 01/03/2024 01/10/2024 $1,001 - $15,000
F      S     : New
D          : bought by the advisor
Treasury Note [GS] S (partial) 01/04/2024 01/10/2024 Over $50,000,000
F      S     : Amended
* For the complete list of asset type abbreviations, see
"""


def test_disclosures(spark):
    df = spark.createDataFrame([("D1", "Hon. Ann Lee", "TX21", dt.date(2024, 1, 15), "u", PTR)], "doc_id string, member string, state_district string, filed_on date, url string, payload string")
    rows = {r.line: r for r in disclosures.house_reports(df).collect()}
    one, two = rows[1], rows[2]
    assert (one.symbol, one.owner, one.asset_type, one.transaction_type, one.amount_min, one.amount_max, one.filing_status) == ("AAPL", "SP", "ST", "purchase", 1001.0, 15000.0, "new")
    assert (two.symbol, two.owner, two.asset, two.transaction_type, two.amount_min, two.amount_max, two.filing_status) == ("NO_TICKER", None, "Treasury Note", "sale_partial", 50000000.0, None, "amended")
    with pytest.raises(Exception, match="not recognised"):
        disclosures.house_reports(df.withColumn("payload", F.replace("payload", F.lit("S (partial)"), F.lit("?")))).collect()
    # A full line of a labelled field goes on in the next; a short one does not, and there the next asset begins.
    full, page = "D : " + "long words " * 9, "ID Owner Asset Transaction\nType Date Notification\nDate Amount Cap.\nGains >\n$200?"
    wrapped = PTR.replace("D          : bought by the advisor", f"{full}\ngoes on here\nFiling ID #20001234\n{page}")
    again = {r.line: r for r in disclosures.house_reports(df.withColumn("payload", F.lit(wrapped))).collect()}
    assert len(full) >= 95 and (again[2].asset, again[1].filing_status) == ("Treasury Note", "new")
    short = PTR.replace("D          : bought by the advisor", "D : short\nFirst part of")
    assert {r.line: r.asset for r in disclosures.house_reports(df.withColumn("payload", F.lit(short))).collect()}[2] == "First part of Treasury Note"
    cell = lambda *c: "<tr>" + "".join(f"<td> {x}</td>" for x in c) + "</tr>"
    html = "<p>Filed 01/05/2024 @ 3:07 PM</p><table><tbody>" + cell(1, "01/02/2024", "Spouse", "<a>MSFT</a>", "Microsoft", "Stock", "Sale (Full)", "$1,001 - $15,000", "--") + cell(2, "01/02/2024", "Self", "--", "Fund &amp; Co (FND)", "Fund", "Purchase", "$50,001 - $100,000", "--") + "</tbody></table>"
    pages = spark.createDataFrame([("S1", "Sen X", "u", False, dt.date(2024, 1, 5), html)], "doc_id string, member string, url string, amended boolean, filed_on date, payload string")
    got = {r.line: (r.symbol, r.owner, r.transaction_type, r.amount_max, str(r.asset)) for r in disclosures.senate_reports(pages).collect()}
    assert got == {1: ("MSFT", "SP", "sale", 15000.0, "Microsoft"), 2: ("FND", None, "purchase", 100000.0, "Fund & Co (FND)")}
    with pytest.raises(Exception, match="unknown type"):
        disclosures.senate_reports(pages.withColumn("payload", F.replace("payload", F.lit("Purchase"), F.lit("Gift")))).collect()
    index = "<FinancialDisclosure>" + "".join(f"<Member><Prefix>Hon.</Prefix><Last>Lee</Last><First>Ann</First><Suffix/><FilingType>P</FilingType><StateDst>TX21</StateDst><Year>2026</Year><FilingDate>{d}</FilingDate><DocID>{i}</DocID></Member>" for i, d in ((1, "4/29/2026"), (2, ""))) + "</FinancialDisclosure>"
    row = disclosures.house_index(spark.createDataFrame([(index,)], "payload string")).collect()
    assert len(row) == 1 and row[0].filing_type_name == "periodic transaction report"
    listing = json.dumps({"data": [["RICHARD", "BLUMENTHAL", "Senate", '<a href="/search/view/paper/AB12/">report</a>', "01/05/2024"]]})
    assert disclosures.senate_index(spark.createDataFrame([(listing,)], "payload string")).first().doc_id == "AB12"


def test_contracts(spark):
    columns = ["contract_transaction_unique_key", "award_id_piid", "recipient_name", "recipient_parent_uei", "awarding_agency_name", "federal_action_obligation", "action_date", "initial_report_date"]
    rows = [("K1", "W", "LMT", "ABCDEFGHIJKL", "Department of Energy", "2000000", "2026-06-10", "2026-06-10 16:47:00+00"), ("K1", "W", "LMT", "ABCDEFGHIJKL", "Department of Energy", "2000000", "2026-06-10", "2026-06-10 16:47:00+00"), ("K2", "W", "LMT", "ABCDEFGHIJKL", "Department of Defense", "-3000000", "2026-06-11", "2026-06-09 11:00:00+00"), ("K3", "W", "LMT", "ABCDEFGHIJKL", "Department of Energy", "5", "2026-06-10", ""), ("K4", "W", "O", "ZZZZZZZZZZZZ", "x", "9000000", "2026-06-10", "")]
    parents = spark.createDataFrame([("abcdefghijkl", "LMT")], "uei string, symbol string")
    got = {r.transaction_key: r for r in disclosures.contract_actions(spark.createDataFrame(rows, columns), parents).withColumn("k", F.col("known_at").cast("string")).collect()}
    assert {k: r.k for k, r in got.items()} == {"K1": "2026-06-12 16:47:00", "K2": "2026-09-11 00:00:00"}
    with pytest.raises(Exception, match="12-character"):
        disclosures.contract_actions(spark.createDataFrame(rows, columns), spark.createDataFrame([("abc", "LMT")], "uei string, symbol string")).collect()


def test_mirror_and_registry(spark):
    held = spark.createDataFrame([("a", 1)], "url string, first_seen int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "url string, first_seen int")
    assert sorted(tuple(r) for r in disclosures.merge_mirror(held, new).collect()) == [("a", 1), ("b", 3)]
    assert len(sources.PARSERS) == 25


def test_stream_appends_once(spark, tmp_path):
    frame(spark, "ohlcv_daily", bar("A", "2024-01-03", 1.0), bar("A", "2024-01-03", 2.0, known="2024-02-01T00:00")).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # a second pass over the same files adds nothing
        ingest.ingest(ingest.incoming(spark, str(tmp_path / "in"), "ohlcv_daily"), str(tmp_path / "lake"), "equity", str(tmp_path / checkpoint)).awaitTermination()
    from chronolake.lake import Lake

    made = Lake(spark, str(tmp_path / "lake"))
    assert made.scan("ohlcv_daily", dedup=False).count() == 2 and made.scan("ohlcv_daily").first().close == 2.0


def test_refusals(spark):
    state = spark.createDataFrame([("y", "A", 2, at("2024-01-01T00:00")), ("y", "B", 5, at("2024-01-01T00:00"))], "source string, symbol string, attempts long, last_at timestamp")
    tries = spark.createDataFrame([("y", "A", at("2024-02-01T00:00"), True), ("y", "B", at("2024-02-01T00:00"), False), ("y", "C", at("2024-02-01T00:00"), True)], "source string, symbol string, at timestamp, refused boolean")
    got = {r.symbol: (r.attempts, (r.retry_after - r.last_at).days) for r in ingest.refusals(state, tries).collect()}
    assert got == {"A": (3, 12), "C": (1, 3)}


def test_refusals_and_runs_are_kept(spark, tmp_path):
    path = str(tmp_path / "refused")
    assert ingest.read_refusals(spark, path).isEmpty()
    tries = [("y", "A", at("2024-02-01T00:00"), True), ("y", "B", at("2024-02-01T00:00"), True)]
    shape = "source string, symbol string, at timestamp, refused boolean"
    for day in (tries, tries[:1], [("y", "B", at("2024-03-01T00:00"), False)]):
        ingest.write_refusals(ingest.refusals(ingest.read_refusals(spark, path), spark.createDataFrame(day, shape)), path)
    (left,) = ingest.read_refusals(spark, path).collect()
    assert (left.symbol, left.attempts) == ("A", 2)
    (tmp_path / "refused" / "generation=9").mkdir()  # a writer that died
    state = ingest.read_refusals(spark, path)
    assert state.count() == 1 and ingest.due(state, at("2024-02-07T00:00")).count() == 1 and ingest.due(state, at("2024-02-06T00:00")).isEmpty()
    log = str(tmp_path / "runs")
    runs = spark.createDataFrame([("r1", "bars", "ok", 5, at("2024-01-01T00:00"), None), ("r1", "news", "failed", 0, at("2024-01-01T01:00"), "no answer")], ingest.RUN)
    ingest.record_runs(runs, log)
    ingest.record_runs(runs.withColumn("run_id", F.lit("r2")), log)
    (tmp_path / "runs" / "part-broken.json").write_text('{"run_id": "r3", "job"')
    assert [r.job for r in ingest.recent_runs(spark, log, 2).collect()] == ["news", "news"]
    assert sorted(tuple(r)[:4] for r in ingest.plan_totals(ingest.recent_runs(spark, log)).collect()) == [("r1", 5, 1, 0), ("r2", 5, 1, 0)]
