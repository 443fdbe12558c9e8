"""Connectors as relational transforms: recorded payloads in, dataset rows out.

A parser takes a frame of payload texts (one row a document or page) and returns rows of
its dataset.  Fetching is left to whoever has a network; PARSERS names every parser.
"""

from chronolake.sources import disclosures, filings, macro, market

PARSERS = {
    "yahoo.ohlcv_daily": market.chart_bars,
    "yahoo.corporate_actions": market.chart_actions,
    "stooq.ohlcv_daily": market.csv_bars,
    "binance.ohlcv_bars": market.klines,
    "binance.funding_rate": market.funding,
    "binance.instruments": market.exchange_symbols,
    "cboe.series_observations": market.index_history,
    "options_snapshot.chain_snapshot": market.option_chain,
    "fred.series_observations": macro.settled_observations,
    "alfred.series_observations": macro.vintage_observations,
    "eia.series_observations": macro.weekly_stocks,
    "cftc_cot.positioning": macro.positioning,
    "ken_french.series_observations": macro.factor_returns,
    "open_asset_pricing.anomaly_catalogue": macro.anomalies,
    "sec_edgar.fundamentals": filings.company_facts,
    "sec_edgar.submissions": filings.submissions,
    "sec_insider.insider_transactions": filings.ownership_documents,
    "sec_13f.institutional_holdings": filings.holdings_tables,
    "sec_ftd.fails_to_deliver": filings.fails,
    "usaspending.government_contracts": disclosures.contract_actions,
    "house_clerk.congress_filings": disclosures.house_index,
    "house_clerk.congress_trades": disclosures.house_reports,
    "senate_efd.congress_filings": disclosures.senate_index,
    "senate_efd.congress_trades": disclosures.senate_reports,
    "senate_efd.mirror": disclosures.merge_mirror,
}
