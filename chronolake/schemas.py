"""The datasets of the lake: columns, natural keys, required columns, and validation as a plan."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A frame does not have its dataset's shape."""


COMMON = "source string, dataset string, symbol string, as_of timestamp, known_at timestamp, ingested_at timestamp"
TIMES = ("as_of", "known_at", "ingested_at")
#: Seconds that a source's clock may be ahead of ours.
CLOCK_SLACK = 60


@dataclass(frozen=True)
class Dataset:
    name: str
    extra: str
    key: tuple[str, ...] = ("symbol",)
    required: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(f"{COMMON}, {self.extra}")

    @property
    def version_key(self) -> tuple[str, ...]:
        return (*self.key, "as_of")

    @property
    def not_null(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*(f.name for f in T.StructType.fromDDL(COMMON)), *self.required]))


_BARS = "open double, high double, low double, close double, volume double"
# The datasets' columns and keys.
_ALL = (
    Dataset("ohlcv_daily", f"{_BARS}, adj_close double, currency string, venue string", ("symbol",), ("close",)),
    Dataset("ohlcv_bars", f"{_BARS}, interval string, quote_volume double, trades long", ("symbol", "interval"), ("close", "interval")),
    Dataset("series_observations", "value double, units string, vintage boolean", ("symbol",), ("vintage",)),
    Dataset("funding_rate", "funding_rate double, mark_price double, interval_hours double", ("symbol",), ("funding_rate",)),
    Dataset("corporate_actions", "action string, amount double, split_numerator double, split_denominator double", ("symbol", "action"), ("action",)),
    Dataset("fundamentals", "metric string, value double, unit string, fiscal_period string, form string", ("symbol", "metric", "fiscal_period"), ("metric",)),
    Dataset("positioning", "report string, name string, category string, measure string, value double, contract_units string, exchange string", ("symbol", "report", "category", "measure"), ("report", "category", "measure")),
    Dataset("anomaly_catalogue", "name string, authors string, journal string, category string, replication string, evidence string, published_return double, published_t_stat double, sign double", ("symbol",), ("name", "category")),
    Dataset("chain_snapshot", "expiry date, strike double, right string, bid double, ask double, last double, volume double, open_interest double, implied_vol double, delta double, gamma double, vega double, theta double, underlying_price double", ("symbol", "expiry", "strike", "right"), ("expiry", "strike", "right")),
    Dataset(
        "insider_transactions",
        "issuer_cik long, issuer_name string, owner_cik long, owner_name string, is_director boolean, is_officer boolean, is_ten_percent_owner boolean, officer_title string, form string, accession string, line long, security_title string, "
        "is_derivative boolean, transaction_code string, acquired_disposed string, shares double, price double, shares_owned_after double, ownership string, planned_10b5_1 boolean",
        ("symbol", "accession", "line"),
        ("accession", "line", "owner_name", "transaction_code", "is_derivative"),
    ),
    Dataset(
        "institutional_holdings",
        "manager_name string, cusip string, issuer_name string, title_of_class string, put_call string, shares_type string, shares double, value_usd double, lines long, form string, amendment_type string, accession string",
        ("symbol", "cusip", "put_call", "shares_type"),
        ("cusip", "put_call", "shares_type", "accession"),
    ),
    Dataset("congress_filings", "chamber string, doc_id string, filing_type string, filing_type_name string, prefix string, first_name string, last_name string, suffix string, year long, url string", ("symbol", "doc_id"), ("chamber", "doc_id", "filing_type", "last_name")),
    Dataset(
        "congress_trades",
        "chamber string, doc_id string, line long, member string, state_district string, owner string, asset string, asset_type string, transaction_type string, notification_date date, amount_min double, amount_max double, amount_text string, filing_status string, url string",
        ("symbol", "doc_id", "line"),
        ("chamber", "doc_id", "line", "member", "transaction_type", "amount_min"),
    ),
    Dataset(
        "government_contracts",
        "transaction_key string, award_id string, modification_number string, parent_award_id string, recipient_name string, recipient_uei string, parent_name string, parent_uei string, awarding_agency string, awarding_sub_agency string, "
        "defense boolean, action_type string, obligation_usd double, total_obligated_usd double, potential_value_usd double, description string, naics_code string, naics_description string, reported_at timestamp, url string",
        ("symbol", "transaction_key"),
        ("transaction_key", "award_id", "recipient_name", "parent_uei", "obligation_usd"),
    ),
    Dataset("fails_to_deliver", "cusip string, quantity double, description string, price double", ("symbol", "cusip"), ("cusip", "quantity")),
    Dataset("instruments", "venue string, status string, name string, currency string, base_asset string, quote_asset string", ("symbol", "venue"), ("venue", "status")),
)
DATASETS = {d.name: d for d in _ALL}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
    return DATASETS[name]


def with_missing(df: DataFrame, name: str) -> DataFrame:
    """df with the dataset's nullable columns that it lacks as typed nulls."""
    spec = dataset(name)
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in spec.schema if f.name not in df.columns and f.name not in spec.not_null}
    return df.withColumns(lacking) if lacking else df


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the dataset's columns, order and types; casts fail at run time under ANSI mode."""
    spec = dataset(name)
    wanted = {f.name: f.dataType for f in spec.schema}
    if missing := [c for c in wanted if c not in df.columns]:
        raise SchemaError(f"{name}: missing columns {missing}")
    if unexpected := [c for c in df.columns if c not in wanted]:
        raise SchemaError(f"{name}: unexpected columns {unexpected}")
    for c in TIMES:
        if df.schema[c].dataType != T.TimestampType():
            raise SchemaError(f"{name}.{c}: expected an instant, got {df.schema[c].dataType.simpleString()}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in wanted.items()])


def rules(name: str) -> dict:
    """What a row of the dataset must not be: null where a value is required, of the future, known before it exists."""
    broken = {f"null_{c}": F.col(c).isNull() for c in dataset(name).not_null}
    ahead = F.col("known_at") > F.current_timestamp() + F.make_interval(secs=F.lit(CLOCK_SLACK))
    return broken | {"in_future": ahead, "before_as_of": F.col("as_of") > F.col("known_at")}


def violations(df: DataFrame, name: str) -> DataFrame:
    """One row: the number of rows that break each of the rules."""
    return df.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules(name).items()])


def offenders(df: DataFrame, name: str, rule: str, limit: int = 3) -> DataFrame:
    """Some rows that break a rule, by the columns that name them (a report of at most `limit`)."""
    return df.where(rules(name)[rule]).select(*dict.fromkeys([*dataset(name).version_key, "known_at"])).limit(limit)


def validate(df: DataFrame, name: str) -> DataFrame:
    """conform, and one aggregate pass over all rules; raises SchemaError with the counts and some of the rows."""
    out = conform(df, name)
    try:
        found = violations(out, name).first().asDict()
    except Exception as error:
        if "CAST" in str(error):
            raise SchemaError(f"{name}: {str(error).splitlines()[0]}") from error
        raise
    if bad := {k: v for k, v in found.items() if v}:
        shown = {rule: [r.asDict() for r in offenders(out, name, rule).collect()] for rule in bad}
        raise SchemaError(f"{name}: {bad}; for example {shown}")
    return out
