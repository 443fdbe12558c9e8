"""As-of joins: the last price on or before a day, the first on or after it, and pairs of both.

A lookup is a union of both sides and one ordered pass (last or first non-null value).  The pass is
partitioned by key and time bucket, so a key that holds a third of all rows is spread over its
buckets.  What a bucket inherits from those before it is one more pass over one row a bucket of the key: only
buckets that have rows, and no more of them than BUCKETS a key.  `left` stands once in the plan, so joins can be nested.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a bucket, and the first and last bucket (1900 to 2100; times beyond lie in the edge buckets).
BUCKET = 64
FIRST, LAST = -400, 742


def _bucket(column):
    return F.greatest(F.least(F.floor(F.unix_date(F.col(column).cast("date")) / BUCKET), F.lit(LAST)), F.lit(FIRST))


def asof(left: DataFrame, right: DataFrame, by: list, left_on: str, right_on: str, values: list, direction: str = "backward", suffix: str = "") -> DataFrame:
    """left with right's `values` (and its time as `<right_on><suffix>`) at the last time <= left_on, or the first >= it.

    Each (by, right_on) is taken once, the greatest `values` on ties.  Rows without a match keep nulls; null keys
    are equal to each other.
    """
    forward = direction == "forward"
    names = [right_on, *values]
    found = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
    one = F.max(values[0]) if len(values) == 1 else F.max(F.struct(*values))
    prices = right.where(F.col(right_on).isNotNull()).groupBy(*by, right_on).agg(one.alias("_v"))
    prices = prices.select(*by, right_on, *([F.col("_v").alias(values[0])] if len(values) == 1 else ["_v.*"])).select(*by, F.col(right_on).alias("_t"), found.alias("_found"))
    asked = left.select(*[F.col(c).alias(f"_l_{c}") for c in left.columns])
    asked = asked.select(*[F.col(f"_l_{c}").alias(c) for c in by], F.col(f"_l_{left_on}").alias("_t"), F.struct(*asked.columns).alias("_left"))
    empty = F.lit(None)
    rows = asked.withColumn("_found", empty.cast(prices.schema["_found"].dataType)).withColumn("_side", F.lit(0 if forward else 1))
    rows = rows.unionByName(prices.withColumn("_left", empty.cast(asked.schema["_left"].dataType)).withColumn("_side", F.lit(1 if forward else 0)))
    rows = rows.withColumn("_bucket", _bucket("_t"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.col("_t").desc() if forward else F.col("_t"), F.col("_side").desc() if forward else F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.last("_found", ignorenulls=True).over(inside)).where("_left IS NOT NULL")
    edge = F.min_by if forward else F.max_by
    # The last found value of each bucket, and with it what the buckets after it inherit (going forward, the first and those before).
    ends = prices.select(*by, _bucket("_t").alias("_bucket"), "_t", "_found").groupBy(*by, "_bucket").agg(edge("_found", "_t").alias("_end"))
    ends = ends.unionByName(asked.select(*by, _bucket("_t").alias("_bucket")).distinct().withColumn("_end", empty.cast(ends.schema["_end"].dataType)))
    across = Window.partitionBy(*by).orderBy(F.col("_bucket").desc() if forward else F.col("_bucket")).rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(across)).where("_end IS NULL AND _carried IS NOT NULL")
    carried = carried.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_bucket").alias("_b"), "_carried")
    on = own["_bucket"] == carried["_b"]
    for c in by:
        on &= own[c].eqNullSafe(carried[f"_b_{c}"])
    joined = own.join(carried, on, "left").withColumn("_hit", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carried")))
    return joined.select(*[F.col(f"_left._l_{c}").alias(c) for c in left.columns], *[F.col(f"_hit.v{i}").alias(f"{c}{suffix}") for i, c in enumerate(names)])


def holding(left: DataFrame, prices: DataFrame, by: list, entry: str, exit: str, day: str = "day", close: str = "close") -> DataFrame:
    """left with the bar bought at (first on or after `entry`) and sold at (last on or before `exit`).

    entry_day, entry_close, exit_day, exit_close; all null where the exit would come before the entry.
    """
    bought = asof(left, prices, by, entry, day, [close], "forward", "__in")
    both = asof(bought, prices, by, exit, day, [close], "backward", "__out")
    sound = F.col(f"{day}__out") >= F.col(f"{day}__in")
    kept = {f"entry_{day}": f"{day}__in", f"entry_{close}": f"{close}__in", f"exit_{day}": f"{day}__out", f"exit_{close}": f"{close}__out"}
    return both.select(*left.columns, *[F.when(sound, F.col(c)).alias(n) for n, c in kept.items()])
