"""Window-shaped operators: gaps, runs, ranks, shares and rests."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, by: list, at: str, out: str, unit_seconds: float = 3600.0, digits: int = 4) -> DataFrame:
    """df with the time since the previous row of its key; the first row takes the next gap."""
    w = Window.partitionBy(*by).orderBy(at)
    seconds = lambda a, b: (F.col(a).cast("double") - F.col(b).cast("double")) / unit_seconds
    timed = df.withColumns({"_before": F.lag(at).over(w), "_after": F.lead(at).over(w)})
    return timed.withColumn(out, F.round(F.coalesce(seconds(at, "_before"), seconds("_after", at)), digits)).drop("_before", "_after")


def fold_runs(df: DataFrame, by: list, order: list, same: list, longest: int = 4, shown: int = 3) -> DataFrame:
    """df with run, run_length, run_place and hidden: runs of rows alike in `same` longer than `longest` show `shown` rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    differs = None
    for c in same:
        one = ~F.col(c).eqNullSafe(F.lag(c).over(w))
        differs = one if differs is None else differs | one
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_new", F.when(first | differs, 1).otherwise(0))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    inside = Window.partitionBy(*by, "run")
    marked = marked.withColumn("run_length", F.count(F.lit(1)).over(inside)).withColumn("run_place", F.row_number().over(inside.orderBy(*order)))
    return marked.withColumn("hidden", (F.col("run_length") > longest) & (F.col("run_place") > shown))


def top(df: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def share(df: DataFrame, by: list, value: str, out: str, scale: float = 100.0, digits: int = 6) -> DataFrame:
    """df with each value's share of its key's total."""
    total = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return df.join(total, by).withColumn(out, F.round(F.col(value) / F.nullif("_total", F.lit(0)) * scale, digits)).drop("_total")


def rest(df: DataFrame, by: list, label: str, value: str, k: int, name: str = "rest") -> DataFrame:
    """The k largest labels of each key and one row for all others."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(label))
    marked = df.withColumn(label, F.when(F.row_number().over(w) <= k, F.col(label)).otherwise(F.lit(name)))
    return marked.groupBy(*by, label).agg(F.sum(value).alias(value))


def every_nth(df: DataFrame, by: list, order: list, most: int) -> DataFrame:
    """An even sample of at most about `most` rows of each key (sampling is the feature here)."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumns({"_rank": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    step = F.greatest(F.ceil(F.col("_n") / most), F.lit(1))
    return marked.where(F.col("_rank") % step == 0).drop("_rank", "_n")


def quarter_changes(df: DataFrame, holder: list, period: str, item: str, amount: str, least: float = 0.10) -> DataFrame:
    """What changed between each holder's consecutive periods: (holder, period, item, amount, before, change).

    A holder's first period opens nothing; equal amounts and changes under `least` are left out; a gone item has amount 0.
    """
    held = df.groupBy(*holder, period, item).agg(F.sum(amount).alias("amount"))
    order = Window.partitionBy(*holder).orderBy(period)
    periods = df.select(*holder, period).distinct().withColumn("_ix", F.row_number().over(order))
    now = held.join(periods, [*holder, period]).select(*holder, item, "_ix", "amount")
    before = now.select(*holder, item, (F.col("_ix") + 1).alias("_ix"), F.col("amount").alias("before"))
    both = now.join(before, [*holder, item, "_ix"], "full").withColumns({"amount": F.coalesce("amount", F.lit(0.0)), "before": F.coalesce("before", F.lit(0.0))})
    both = both.where("_ix > 1").join(periods, [*holder, "_ix"])  # a period after the last has no row here
    moved = (F.col("amount") != F.col("before")) & ((F.col("before") == 0) | (F.col("amount") == 0) | (F.abs(F.col("amount") - F.col("before")) / F.col("before") >= least))
    change = F.when((F.col("before") != 0) & (F.col("amount") != 0), (F.col("amount") - F.col("before")) / F.col("before"))
    return both.where(moved).select(*holder, period, item, "amount", "before", change.alias("change"))
