"""Point-in-time views of the lake, with guards against looking ahead, and SQL over them."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.lake import Lake, as_instant
from chronolake.schemas import dataset


class LookAheadError(ValueError):
    """Something after the snapshot's instant was asked for or came out."""


class SandboxError(ValueError):
    """A query does more than read the tables it was given."""


class Snapshot:
    """The lake as it was knowable at one instant; never changed after it is made."""

    __slots__ = ("_lake", "_moment")

    def __init__(self, lake: Lake, moment: dt.datetime):
        if moment.tzinfo is None:
            raise ValueError("a snapshot's instant needs a time zone")
        self._lake, self._moment = lake, moment.astimezone(dt.UTC)

    @property
    def as_of(self) -> dt.datetime:
        return self._moment

    @property
    def lake(self) -> Lake:
        return self._lake

    def frame(self, name: str, symbols=None, start=None, end=None, source=None, first_known: bool = False) -> DataFrame:
        """The dataset's latest versions known by the instant; bounds beyond it are refused, not cut."""
        dataset(name)
        stop = self._moment if end is None else as_instant(end, "end")
        if stop > self._moment:
            raise LookAheadError(f"data up to {stop} asked of a snapshot at {self._moment}")
        if start is not None and as_instant(start) > self._moment:
            raise LookAheadError(f"data from {start} asked of a snapshot at {self._moment}")
        rows = self._lake.scan(name, source=source, symbols=symbols, start=start, end=stop, known_before=self._moment, first_known=first_known)
        return self.guarded(rows)

    def guarded(self, rows: DataFrame) -> DataFrame:
        """rows, but the running query fails at one whose known_at or as_of lies after the instant.

        The guard is a filter, so the columns stay plain and filters on them still reach the scan.
        """
        late = (F.col("known_at") > F.lit(self._moment)) | (F.col("as_of") > F.lit(self._moment))
        return rows.where(F.when(late, F.raise_error(F.lit("a row after the snapshot's instant")).cast("boolean")).otherwise(F.lit(True)))

    def ohlcv_daily(self, **how):
        return self.frame("ohlcv_daily", **how)

    def bars(self, **how):
        return self.frame("ohlcv_bars", **how)

    def series(self, **how):
        return self.frame("series_observations", **how)

    def funding(self, **how):
        return self.frame("funding_rate", **how)

    def corporate_actions(self, **how):
        return self.frame("corporate_actions", **how)

    def instruments(self, **how):
        return self.frame("instruments", **how)

    def insider_transactions(self, **how):
        return self.frame("insider_transactions", **how)

    def institutional_holdings(self, **how):
        return self.frame("institutional_holdings", first_known=True, **how)

    def congress_trades(self, **how):
        return self.frame("congress_trades", **how)

    def with_as_of(self, moment) -> "Snapshot":
        return self._lake.as_of(moment)

    def sql(self, query: str, datasets: list[str], symbols=None, start=None) -> DataFrame:
        """Run one SELECT over the named datasets as of the instant, in a session of its own.

        The plan may only read the named tables and the query's own common table expressions.
        """
        if not datasets:
            raise ValueError("name the datasets that the query reads")
        inner = Snapshot(Lake(self._lake.spark.newSession(), self._lake.path), self._moment)
        spark = inner.lake.spark
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        for name in datasets:
            inner.frame(name, symbols=symbols, start=start).createOrReplaceTempView(name)
        check_query(spark, query, set(datasets))
        return spark.sql(query)


#: Functions that reach outside the tables or end the query.
FORBIDDEN = ("java_method", "reflect", "try_reflect", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length", "raise_error", "assert_true", "current_user", "session_user", "user", "version")
#: Nodes of a parsed query that read nothing by themselves; every other one is refused.
PLAIN = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Join", "LateralJoin", "AsOfJoin", "SubqueryAlias", "Union", "Intersect", "Except", "UnresolvedHaving",
    "WithWindowDefinition", "OneRowRelation", "LocalRelation", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "Pivot", "UnresolvedPivot", "Unpivot", "Generate", "UnresolvedHint", "Sample", "UnresolvedWith", "UnresolvedRelation", "Subquery", "Expand", "Window",
}


def check_query(spark, query: str, allowed: set) -> None:
    """Raise SandboxError unless the parsed plan is made of PLAIN nodes over `allowed` names and its own common table expressions."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    names = {n.lower() for n in allowed}
    _walk(plan, names)


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def _walk(plan, names: set) -> None:
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in PLAIN:
        raise SandboxError(f"{kind} is not allowed in a query over a snapshot")
    if kind == "UnresolvedWith":
        names = set(names)
        for pair in _seq(plan.cteRelations()):
            _walk(pair._2(), names)
            names.add(pair._1().lower())
    if kind == "UnresolvedRelation":
        parts = _seq(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in names:
            raise SandboxError(f"{'.'.join(parts)} is not one of the tables of this query")
    for expression in _seq(plan.expressions()):
        _expression(expression, names)
    for child in _seq(plan.children()):
        _walk(child, names)


def _expression(e, names: set) -> None:
    kind = e.getClass().getSimpleName()
    if "UnresolvedIdentifier" in kind:
        raise SandboxError("IDENTIFIER() is not allowed")
    if kind == "UnresolvedFunction":
        parts = _seq(e.nameParts())
        if len(parts) > 1 or parts[0].lower() in FORBIDDEN:
            raise SandboxError(f"{'.'.join(parts)} is not allowed")
    if "plan" in dir(e) and kind != "InSubquery":
        _walk(e.plan(), names)
    for child in _seq(e.children()):
        _expression(child, names)
