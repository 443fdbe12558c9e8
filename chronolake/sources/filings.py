"""Company facts, submissions, ownership documents, holdings tables and fails to deliver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake import calendars as C
from chronolake.functions import text as X
from chronolake.sources.base import demand, instant, number, stamped, text

# Accounting concepts of each metric in order of precedence, periodic forms, day spans of periods.
CONCEPTS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "SalesRevenueGoodsNet"),
    "cost_of_goods_sold": ("CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"),
    "total_assets": ("Assets",),
    "sg_and_a": ("SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"),
    "interest_expense": ("InterestExpense", "InterestIncomeExpenseNet"),
    "book_equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "accruals": ("IncreaseDecreaseInAccountsReceivable",),
    "net_income": ("NetIncomeLoss",),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
}
PERIODIC_FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A", "20-F", "40-F")
SPANS = ((80, 100, "Q"), (170, 190, "H"), (260, 285, "9M"), (350, 380, "FY"))
OWNERSHIP_FORMS = ("4", "4/A", "5", "5/A")
FAILS_HEADER = "SETTLEMENT DATE|CUSIP|SYMBOL|QUANTITY (FAILS)|DESCRIPTION|PRICE"
VALUES_IN_DOLLARS_SINCE = "2023-01-03"


def filed_at(day):
    """A filing of a day was public by 17:30 in New York."""
    return C.eastern_instant(day, 17, 30)


def period(start, end):
    """instant, Q, H, 9M or FY by the days between; null for other spans."""
    days, out = F.datediff(end, start), F.lit(None).cast("string")
    for low, high, label in SPANS:
        out = F.when(days.between(low, high), label).otherwise(out)
    return F.when(start.isNull(), "instant").otherwise(out)


def company_facts(payloads: DataFrame) -> DataFrame:
    """Facts (symbol, payload) of each metric's first concept that the filer reports."""
    fact = "struct<`start`: string, `end`: string, val: double, form: string, filed: string>"
    shape = f"facts struct<`us-gaap`: map<string, struct<units: map<string, array<{fact}>>>>>"
    ranks = payloads.sparkSession.createDataFrame([(m, c, i) for m, cs in CONCEPTS.items() for i, c in enumerate(cs)], "metric string, concept string, rank int")
    facts = payloads.select("symbol", F.explode(F.from_json("payload", shape)["facts"]["us-gaap"]).alias("concept", "c")).join(F.broadcast(ranks), "concept")
    rows = facts.select("symbol", "metric", "rank", F.explode("c.units").alias("unit", "_f")).select("symbol", "metric", "rank", "unit", F.explode("_f").alias("f")).where(F.col("f.form").isin(*PERIODIC_FORMS))
    best = rows.groupBy("symbol", "metric").agg(F.min("rank").alias("rank"))
    rows = rows.join(best, ["symbol", "metric", "rank"])
    start, end = F.to_date("f.start"), F.to_date("f.end")
    made = rows.select("symbol", "metric", "unit", F.col("f.form").alias("form"), F.col("f.val").alias("value"), period(start, end).alias("fiscal_period"), instant(end).alias("as_of"), filed_at(F.to_date("f.filed")).alias("known_at"))
    return stamped(made.where("fiscal_period IS NOT NULL AND as_of <= known_at"), "sec_edgar", "fundamentals")


def submissions(payloads: DataFrame, forms: tuple, start=None, end=None) -> DataFrame:
    """A filer's filings (symbol, payload): parallel arrays zipped; accepted_at is the acceptance, else 17:30 of the day filed."""
    arrays = ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "primaryDocument", "reportDate")
    shape = f"filings struct<recent: struct<{', '.join(f'{a}: array<string>' for a in arrays)}>>"
    recent = payloads.select("symbol", F.from_json("payload", shape)["filings"]["recent"].alias("r"))
    rows = recent.select("symbol", F.explode(F.arrays_zip(*[F.col(f"r.{a}").alias(a) for a in arrays])).alias("f")).select("symbol", "f.*").where(F.col("form").isin(*forms))
    rows = rows.withColumn("accepted_at", F.coalesce(F.col("acceptanceDateTime").try_cast("timestamp"), filed_at(F.to_date("filingDate"))))
    if start is not None:
        rows = rows.where(F.col("accepted_at") >= F.lit(start))
    return rows if end is None else rows.where(F.col("accepted_at") <= F.lit(end))


_VALUE = "struct<value: string>"
_TRADE = f"struct<securityTitle: {_VALUE}, transactionDate: {_VALUE}, transactionCoding: struct<transactionFormType: string, transactionCode: string>, transactionAmounts: struct<transactionShares: {_VALUE}, transactionPricePerShare: {_VALUE}, transactionAcquiredDisposedCode: {_VALUE}>, postTransactionAmounts: struct<sharesOwnedFollowingTransaction: {_VALUE}>, ownershipNature: struct<directOrIndirectOwnership: {_VALUE}>>"
OWNERSHIP = f"""issuer struct<issuerCik: string, issuerName: string, issuerTradingSymbol: string>,
    reportingOwner array<struct<reportingOwnerId: struct<rptOwnerCik: string, rptOwnerName: string>, reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, isTenPercentOwner: string, officerTitle: string>>>,
    aff10b5One string, nonDerivativeTable struct<nonDerivativeTransaction: array<{_TRADE}>>, derivativeTable struct<derivativeTransaction: array<{_TRADE}>>"""


def ownership_documents(documents: DataFrame) -> DataFrame:
    """Transactions of ownership XML (symbol, accession, form, accepted_at, payload); lines are numbered through both tables.

    Flags hold if they hold for any owner; only the issuer's own trades stay if `issuer_cik` is a column; trades after acceptance go.
    """
    d = documents.withColumn("_d", F.from_xml("payload", OWNERSHIP, {"mode": "FAILFAST"}))
    yes = lambda v: F.coalesce(F.lower(F.trim(v)).isin("1", "true"), F.lit(False))
    owners = F.col("_d.reportingOwner")
    flag = lambda f: F.exists(owners, lambda o: yes(o["reportingOwnerRelationship"][f]))
    none = F.array().cast(f"array<{_TRADE}>")
    tagged = lambda c, derived: F.transform(F.coalesce(F.col(c), none), lambda t: F.struct(F.lit(derived).alias("is_derivative"), t.alias("t")))
    trades = F.concat(tagged("_d.nonDerivativeTable.nonDerivativeTransaction", False), tagged("_d.derivativeTable.derivativeTransaction", True))
    about = d.withColumns({
        "issuer": F.col("_d.issuer.issuerCik").try_cast("long"), "issuer_name": text(F.col("_d.issuer.issuerName")), "owner_cik": owners[0]["reportingOwnerId"]["rptOwnerCik"].try_cast("long"),
        "owner_name": F.array_join(F.filter(F.transform(owners, lambda o: F.trim(o["reportingOwnerId"]["rptOwnerName"])), lambda n: n != ""), "; "),
        "is_director": flag("isDirector"), "is_officer": flag("isOfficer"), "is_ten_percent_owner": flag("isTenPercentOwner"),
        "officer_title": F.filter(F.transform(owners, lambda o: text(o["reportingOwnerRelationship"]["officerTitle"])), lambda t: t.isNotNull())[0],
        "planned_10b5_1": F.when(F.col("_d.aff10b5One").isNotNull(), yes(F.col("_d.aff10b5One"))),
    })
    if "issuer_cik" in documents.columns:
        about = about.where("issuer IS NULL OR issuer_cik IS NULL OR issuer = issuer_cik")
    rows = about.select("symbol", "accession", "form", F.col("accepted_at").alias("known_at"), F.col("issuer").alias("issuer_cik"), "issuer_name", "owner_cik", "owner_name", "is_director", "is_officer", "is_ten_percent_owner", "officer_title", "planned_10b5_1", F.posexplode(trades).alias("_i", "x"))
    t = "x.t."
    made = rows.withColumns({
        "line": F.col("_i").cast("long") + 1, "is_derivative": F.col("x.is_derivative"), "as_of": instant(F.to_date(F.substring(t + "transactionDate.value", 1, 10))), "security_title": text(F.col(t + "securityTitle.value")),
        "transaction_code": F.col(t + "transactionCoding.transactionCode"), "acquired_disposed": F.col(t + "transactionAmounts.transactionAcquiredDisposedCode.value"), "shares": number(F.col(t + "transactionAmounts.transactionShares.value")),
        "price": number(F.col(t + "transactionAmounts.transactionPricePerShare.value")), "shares_owned_after": number(F.col(t + "postTransactionAmounts.sharesOwnedFollowingTransaction.value")), "ownership": F.col(t + "ownershipNature.directOrIndirectOwnership.value"),
    })
    return stamped(made.where("as_of <= known_at"), "sec_insider", "insider_transactions")


HOLDING = "infoTable array<struct<nameOfIssuer: string, titleOfClass: string, cusip: string, value: string, shrsOrPrnAmt: struct<sshPrnamt: string, sshPrnamtType: string>, putCall: string>>"


def holdings_tables(reports: DataFrame) -> DataFrame:
    """Holdings of information tables (symbol, manager_name, period, accepted_at, form, amendment_type, accession, payload, declared_lines, declared_value).

    Lines of one security are summed; values before 2023 are thousands of dollars; a table that does not add up to its cover page fails.
    """
    plain = F.regexp_replace("payload", r"(</?)\w+:", "$1")
    rows = reports.withColumn("_d", F.from_xml(F.regexp_replace(plain, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), HOLDING)).withColumn("_n", F.size("_d.infoTable"))
    thousands = F.when(F.col("accepted_at") < F.lit(VALUES_IN_DOLLARS_SINCE).cast("timestamp"), 1000).otherwise(1)
    total = F.aggregate("_d.infoTable", F.lit(0.0), lambda s, h: s + F.coalesce(number(h["value"]), F.lit(0.0)))
    if "declared_lines" in reports.columns:
        sound = ((F.col("declared_lines").isNull()) | (F.col("declared_lines") == F.col("_n"))) & (F.col("declared_value").isNull() | (F.abs(F.col("declared_value") - total) < 0.5))
        rows = rows.withColumn("accession", demand(sound, F.col("accession"), F.concat(F.lit("holdings do not add up to the cover page: "), "accession"), "string"))
    lines = rows.select(X.registry_number(F.col("symbol")).alias("symbol"), "manager_name", "period", "accepted_at", "form", "amendment_type", "accession", thousands.alias("_scale"), F.explode("_d.infoTable").alias("h"))
    put = F.upper(F.coalesce(text(F.col("h.putCall")), F.lit("NONE")))
    keyed = lines.withColumns({"cusip": F.upper(F.trim("h.cusip")), "put_call": put, "shares_type": F.upper(F.trim("h.shrsOrPrnAmt.sshPrnamtType"))})
    key = ["symbol", "manager_name", "period", "accepted_at", "form", "amendment_type", "accession", "cusip", "put_call", "shares_type"]
    summed = keyed.groupBy(*key).agg(F.sum(number(F.col("h.shrsOrPrnAmt.sshPrnamt"))).alias("shares"), F.sum(number(F.col("h.value")) * F.col("_scale")).alias("value_usd"), F.count(F.lit(1)).alias("lines"), F.min(F.trim("h.nameOfIssuer")).alias("issuer_name"), F.min(F.trim("h.titleOfClass")).alias("title_of_class"))
    return stamped(summed.withColumns({"as_of": instant(F.col("period")), "known_at": F.col("accepted_at")}), "sec_13f", "institutional_holdings")


def fails(files: DataFrame) -> DataFrame:
    """Fails of pipe files (posted_at, payload), each held against the count and sum of its own trailer."""
    lines = F.filter(F.split("payload", r"\r?\n"), lambda x: F.trim(x) != "")
    trailer = lambda said: F.regexp_extract(F.filter(F.col("_lines"), lambda x: x.startswith("Trailer") & x.contains(said))[0], r"(\d+)\s*$", 1).try_cast("double")
    body = F.filter(F.slice("_lines", 2, 1 << 30), lambda x: ~x.startswith("Trailer"))
    cells = F.transform(body, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))
    rows = files.withColumn("_lines", lines).withColumn("_cells", cells)
    total = F.aggregate("_cells", F.lit(0.0), lambda s, c: s + c[3].cast("double"))
    header = F.regexp_replace(F.upper(F.col("_lines")[0]), r"\s*\|\s*", "|")
    sound = (F.trim(header) == FAILS_HEADER) & (trailer("record count") == F.size("_cells")) & (trailer("total quantity") == total)
    rows = rows.withColumn("_cells", demand(F.coalesce(sound, F.lit(False)), F.col("_cells"), F.lit("a fails file whose header or trailer does not fit"), "array<array<string>>"))
    c = F.col("c")
    made = rows.select("posted_at", F.explode("_cells").alias("c")).select(
        F.upper(F.coalesce(F.nullif(c[2], F.lit("")), c[1])).alias("symbol"), F.upper(c[1]).alias("cusip"), c[3].cast("double").alias("quantity"), F.nullif(c[4], F.lit("")).alias("description"), number(c[5]).alias("price"),
        instant(F.to_date(c[0], "yyyyMMdd")).alias("as_of"), F.col("posted_at").alias("known_at"),
    )
    return stamped(made, "sec_ftd", "fails_to_deliver")


