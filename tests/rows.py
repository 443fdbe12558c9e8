"""Rows of the datasets with defaults, for tests."""

import datetime as dt

from chronolake.schemas import dataset


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC)


DEFAULTS = {
    "ohlcv_daily": {"source": "yahoo", "volume": 1e6, "currency": "USD", "venue": "XNAS"},
    "insider_transactions": {
        "source": "sec_insider", "symbol": "OSPR", "issuer_cik": 1, "issuer_name": "OSPREY CORP", "owner_cik": 900, "owner_name": "OYELARAN MARCUS", "is_director": True, "is_officer": False, "is_ten_percent_owner": False, "form": "4",
        "accession": "0001-26-000001", "line": 1, "security_title": "Common Stock", "is_derivative": False, "transaction_code": "P", "acquired_disposed": "A", "shares": 12000.0, "price": 41.30,
        "as_of": at("2026-09-15T00:00"), "known_at": at("2026-09-17T22:32"),
    },
    "congress_trades": {
        "source": "house_clerk", "symbol": "OSPR", "chamber": "house", "doc_id": "D1", "line": 1, "member": "Hon. Ann Lee", "state_district": "TX21", "asset": "Osprey Corp (OSPR)", "asset_type": "ST", "transaction_type": "purchase",
        "amount_min": 100001.0, "amount_max": 250000.0, "amount_text": "$100,001 - $250,000", "filing_status": "new", "as_of": at("2026-07-02T00:00"), "known_at": at("2026-09-17T03:59"),
    },
    "institutional_holdings": {"source": "sec_13f", "symbol": "5001", "manager_name": "Harrow Peak Capital", "cusip": "OSPR00001", "put_call": "NONE", "shares_type": "SH", "form": "13F-HR", "accession": "A1", "lines": 1, "issuer_name": "OSPREY CORP"},
    "government_contracts": {
        "source": "usaspending", "symbol": "OSPR", "transaction_key": "K1", "award_id": "W1", "modification_number": "0", "recipient_name": "OSPREY CORPORATION", "parent_name": "OSPREY CORP", "parent_uei": "ABCDEFGHIJKL", "awarding_agency": "Department of Defense",
        "awarding_sub_agency": "DEPT OF THE NAVY", "defense": True, "obligation_usd": 514412527.67, "description": "SHIP  REPAIR", "as_of": at("2026-06-11T00:00"), "known_at": at("2026-09-11T00:00"),
    },
    "congress_filings": {"source": "senate_efd", "symbol": "SENATE", "chamber": "senate", "doc_id": "P9", "filing_type": "P", "first_name": "RICHARD", "last_name": "BLUMENTHAL", "as_of": at("2026-09-20T00:00"), "known_at": at("2026-09-21T03:59")},
    "fails_to_deliver": {"source": "sec_ftd", "symbol": "OSPR", "cusip": "OSPR00001", "quantity": 48210.0, "price": 39.0, "as_of": at("2026-08-31T00:00"), "known_at": at("2026-09-15T13:00")},
}


def frame(spark, name, *rows):
    spec = dataset(name)
    made = []
    for row in rows:
        full = {"dataset": name, **DEFAULTS.get(name, {}), **row}
        full.setdefault("ingested_at", full.get("known_at"))
        made.append(tuple(full.get(f.name) for f in spec.schema))
    return spark.createDataFrame(made, spec.schema)


def bar(symbol, day, close, known=None, **more):
    moment = at(f"{day}T21:00")
    return {"symbol": symbol, "as_of": moment, "known_at": at(known) if known else moment, "open": close, "high": close, "low": close, "close": close, **more}
