import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronolake.functions import stats
from chronolake.functions import text as X
from chronolake.operators import shapes, versions
from chronolake.operators.asof import asof, holding

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_against_bisection(spark, direction):
    rng = random.Random(5)
    bars = {(rng.choice("abc"), DAY + dt.timedelta(days=rng.randrange(900))): float(i) for i in range(60)}
    asks = [(i, rng.choice("abcd"), DAY + dt.timedelta(days=rng.randrange(-20, 950))) for i in range(300)]
    right = spark.createDataFrame([(s, d, v) for (s, d), v in bars.items()], "symbol string, day date, close double")
    left = spark.createDataFrame([*asks, (999, None, DAY), (998, "a", None)], "i long, symbol string, at date")
    got = {r.i: r.close for r in asof(left, right, ["symbol"], "at", "day", ["close"], direction).collect()}
    for i, s, at in asks:
        days = sorted(d for t, d in bars if t == s)
        k = bisect.bisect_right(days, at) - 1 if direction == "backward" else bisect.bisect_left(days, at)
        assert got[i] == (bars[s, days[k]] if 0 <= k < len(days) else None)
    assert got[999] is None and got[998] is None and len(got) == 302


def test_holding_rejects_backward_legs(spark):
    prices = spark.createDataFrame([("x", dt.date(2024, 3, 5), 50.0), ("x", dt.date(2024, 6, 1), 70.0)], "symbol string, day date, close double")
    left = spark.createDataFrame([(1, "x", dt.date(2024, 3, 10), dt.date(2024, 4, 10)), (2, "x", dt.date(2024, 3, 1), dt.date(2024, 6, 9))], "i int, symbol string, a date, z date")
    got = {r.i: (r.entry_close, r.exit_close) for r in holding(left, prices, ["symbol"], "a", "z").collect()}
    assert got == {1: (None, None), 2: (50.0, 70.0)}


def test_versions(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "q")], "k string, t int, v string")
    assert {(r.k, r.v) for r in versions.latest(df, ["k"], ["t"], ["v"]).collect()} == {("a", "z"), ("b", "q")}
    assert {(r.k, r.v) for r in versions.earliest(df, ["k"], ["t"]).collect()} == {("a", "x"), ("b", "q")}
    assert {(r.k, r.m) for r in versions.modal(df, ["k"], "t", "m").collect()} == {("a", 2), ("b", 1)}
    assert versions.fresh(df.unionByName(df), df.where("k = 'a'"), ()).count() == 1


def test_amended_lines(spark):
    rows = [("m", None, "D1", "new", 1), ("m", None, "D2", "amended", 2), ("m", "o", "D1", "new", 1), ("m", "o", "D3", "new", 3)]
    df = spark.createDataFrame(rows, "member string, owner string, doc string, status string, known int")
    got = {(r.owner, r.doc) for r in versions.superseded_lines(df, ["member", "owner"], "doc", "status", "known").collect()}
    assert got == {(None, "D2"), ("o", "D1"), ("o", "D3")}


def test_runs_and_changes(spark):
    df = spark.createDataFrame([(1, i, "a" if i < 5 else "b") for i in range(7)], "u int, t int, k string")
    folded = shapes.fold_runs(df, ["u"], ["t"], ["k"], 4, 3).orderBy("t").collect()
    assert [r.hidden for r in folded] == [False, False, False, True, True, False, False]
    held = spark.createDataFrame([("f", 1, "a", 2.0), ("f", 1, "b", 5.0), ("f", 2, "a", 3.0), ("f", 3, "a", 3.1), ("f", 3, "c", 1.0)], "h string, p int, i string, n double")
    got = {(r.p, r.i, r.amount, r.before) for r in shapes.quarter_changes(held, ["h"], "p", "i", "n").collect()}
    assert got == {(2, "a", 3.0, 2.0), (2, "b", 0.0, 5.0), (3, "c", 1.0, 0.0)}


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (-4, -2, 0, 2, 4, 6)], "v double")
    row = df.agg(*stats.spread("v")).first()
    assert (row.median, row.p10, row.p25, row.p75, row.p90) == (1.0, -3.0, -1.5, 3.5, 5.0)
    assert df.limit(4).agg(*stats.spread("v")).first().median is None
    sample = spark.createDataFrame([(float(x),) for x in (8, -2, 12, 3, -1, 9, 4, 1, 7, 2)], "v double")
    row = stats.interval(sample, [], "v").first()
    assert (row.mean_excess_pct, row.low_pct, row.high_pct, row.distinguishable) == (4.3, 1.03, 7.57, True)
    flat = spark.createDataFrame([(f"a{i % 2}", 0.0) for i in range(24)], "actor string, v double")
    assert stats.luck(flat, "actor", "v").first().as_good_by_chance == 1.0
    skilled = flat.unionByName(spark.createDataFrame([("s", 50.0 + i) for i in range(12)], "actor string, v double"))
    assert stats.luck(skilled, "actor", "v").first().as_good_by_chance < 0.05
    assert stats.luck(flat.limit(3), "actor", "v").count() == 0


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column.alias("y")).first().y


def test_names(spark):
    x = F.col("x")
    cases = {"COOK TIMOTHY D": "Timothy D Cook", "O'BRIEN DEIRDRE": "Deirdre O'Brien", "Vanguard Group Inc": "Vanguard Group Inc", "COOK TIM; OTHER": "Tim Cook"}
    assert {k: one(spark, k, X.display_name(x, F.lit(True))) for k in cases} == cases
    assert one(spark, "COOK TIMOTHY D", X.display_name(x, F.lit(False))) == "COOK TIMOTHY D"
    members = {"Hon. John J Mr McGuire III": "John J McGuire III", "Hon. Scott Scott Franklin": "Scott Franklin", "RICHARD BLUMENTHAL": "Richard Blumenthal"}
    assert {k: one(spark, k, X.member_name(x)) for k in members} == members
    assert one(spark, "DEPT OF THE AIR FORCE", X.agency_name(x)) == "Dept of the Air Force"
    assert one(spark, "RAYTHEON LLC 2ND UNIT", X.agency_name(x)) == "Raytheon LLC 2ND Unit"
    assert one(spark, "SHIP  REPAIR " + "WORD " * 60, X.sentence(x)).endswith("...") and one(spark, "", X.sentence(x)) is None
    assert one(spark, "Lockheed Martin Corp.", X.same_company(x, F.lit("LOCKHEED MARTIN CORPORATION"))) is True


def test_amounts(spark):
    x = F.col("x").cast("double")
    money = {"999999999": "$1.00B", "1500000": "$1.50M", "-12345": "-$12K", "12": "$12", "510412527.67": "$510.41M", "0": "$0"}
    assert {k: one(spark, k, X.money(x)) for k in money} == money
    assert one(spark, "2900000", X.count(x)) == "2.9M" and one(spark, "400", X.count(x)) == "400"
    low, high = X.amount_bounds(F.col("x"))
    assert one(spark, "$1,001 - $15,000", F.array(low, high)) == [1001.0, 15000.0]
    assert one(spark, "Over $50,000,000", F.array(low, high)) == [50000000.0, None]
    assert one(spark, "Apple Inc (AAPL)", X.trailing_ticker(F.col("x"))) == "AAPL" and one(spark, "None", X.trailing_ticker(F.col("x"))) is None
    parts = one(spark, "SPXW261218C05000000", X.occ_parts(F.col("x")))
    assert (parts.root, str(parts.expiry), parts.right, parts.strike) == ("SPXW", "2026-12-18", "call", 5000.0)
    assert one(spark, "brk.b", X.vendor_symbol(F.col("x"))) == "BRK-B" and one(spark, "0000320193", X.registry_number(F.col("x"))) == "320193"


def test_luck_deals_alike_in_memory_and_by_shuffles(spark):
    rows = [(f"a{i % 7}", float(i * 37 % 101) / 10) for i in range(140)] + [("few", 99.0), ("few", None)]
    df = spark.createDataFrame(rows, "actor string, v double")
    memory, shuffled = (stats.luck(df, "actor", "v", shuffles=300, pool=n) for n in (1000, 0))
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    a, b = memory.first(), shuffled.first()
    assert memory.schema == shuffled.schema and (a.best_mean, a.shuffles) == (b.best_mean, b.shuffles) and abs(a.beaten - b.beaten) < 60
    assert stats.luck(df.orderBy("v"), "actor", "v", shuffles=300).first() == a
    one = spark.createDataFrame([("x", (i * 7919 % 1000) / 7.0) for i in range(999)], "actor string, v double")
    assert [stats.luck(one, "actor", "v", shuffles=50, pool=n).first().beaten for n in (2000, 0)] == [50, 50]  # every deal is the same mean
