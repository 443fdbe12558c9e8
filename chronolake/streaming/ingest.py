"""Incremental ingestion: files that arrive are validated and appended once, in the order they became known.

The event time is known_at: a fact may describe a day long past, so as_of is never used for a watermark.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.lake import Lake
from chronolake.schemas import dataset


def incoming(spark: SparkSession, path: str, name: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream over Parquet files of one dataset."""
    return spark.readStream.schema(dataset(name).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ingest(stream: DataFrame, lake_path: str, asset_class: str, checkpoint: str):
    """Append each micro-batch to the lake; a batch that is run again adds nothing. Ends when all files there are are read."""

    def put(batch: DataFrame, _: int) -> None:
        lake = Lake(batch.sparkSession, lake_path)
        for source, name in [tuple(r) for r in batch.select("source", "dataset").distinct().collect()]:
            lake.write(batch.where((F.col("source") == source) & (F.col("dataset") == name)), asset_class)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: list, overlap: str = "14 days") -> DataFrame:
    """The stream without repeats of a key that arrive within the overlap."""
    return stream.withWatermark("known_at", overlap).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, at: str, length: str, late: str, slide: str | None = None, by: tuple = ()) -> DataFrame:
    """Counts of rows in tumbling or sliding windows, closed once the watermark has passed."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"))


def backoff_days(attempts):
    """Days to wait after a number of refusals in a row: 3, 6, 12 ... at most 90."""
    return F.least(F.lit(90.0), F.lit(3.0) * F.pow(F.lit(2.0), attempts - 1))


def refusals(state: DataFrame, attempts: DataFrame) -> DataFrame:
    """The new state (source, symbol, attempts, last_at, retry_after): refused symbols wait longer each time, successes are forgotten.

    attempts: (source, symbol, at, refused), one row for each try since the state was written.
    """
    last_good = attempts.where("NOT refused").groupBy("source", "symbol").agg(F.max("at").alias("good_at"))
    failed = attempts.where("refused").join(last_good, ["source", "symbol"], "left").where("good_at IS NULL OR at > good_at")
    counted = failed.groupBy("source", "symbol").agg(F.count(F.lit(1)).alias("more"), F.max("at").alias("at"), F.first("good_at").alias("good_at"))
    both = state.join(counted, ["source", "symbol"], "full").join(last_good.select("source", "symbol", F.lit(True).alias("_ok")), ["source", "symbol"], "left")
    before = F.when(F.coalesce("_ok", F.lit(False)), 0).otherwise(F.coalesce("attempts", F.lit(0)))
    total = before + F.coalesce("more", F.lit(0))
    out = both.select("source", "symbol", total.cast("long").alias("attempts"), F.coalesce("at", "last_at").alias("last_at")).where("attempts > 0")
    return out.withColumn("retry_after", F.col("last_at") + F.make_dt_interval(days=backoff_days(F.col("attempts")).cast("int")))


#: A written state of refusals.
STATE = "source string, symbol string, attempts long, last_at timestamp, retry_after timestamp"


def due(state: DataFrame, now) -> DataFrame:
    """The refused symbols that may be tried again."""
    return state.where(F.col("retry_after") <= now)


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the states that were written to the end, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith("generation=")]
    whole = [f for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName().partition("=")[2]) for f in whole)


def read_refusals(spark: SparkSession, path: str) -> DataFrame:
    """The last state that was written whole; no rows where there is none."""
    held = _generations(spark, path)
    return spark.read.schema(STATE).parquet(f"{path}/generation={held[-1]}") if held else spark.createDataFrame([], STATE)


def write_refusals(state: DataFrame, path: str) -> None:
    """Write a new state beside the one it may be made from; a writer that dies leaves the old one in force.

    The state before the new one stays, for those who still read it; older ones go.  One writer at a time.
    """
    spark = state.sparkSession
    held = _generations(spark, path)
    columns = [part.split(" ")[0] for part in STATE.split(", ")]
    state.select(*columns).write.mode("overwrite").parquet(f"{path}/generation={held[-1] + 1 if held else 0}")
    for old in held[:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={old}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A line of the run log.
RUN = "run_id string, job string, status string, rows long, finished_at timestamp, message string"


def record_runs(runs: DataFrame, path: str) -> None:
    """Append the jobs of a run to the JSON-lines log that `recent_runs` reads; nulls are left out of a line."""
    names = [part.split(" ")[0] for part in RUN.split(", ")]
    runs.select(*names).write.mode("append").json(path)


def plan_totals(runs: DataFrame) -> DataFrame:
    """rows, failures and skips of ingest runs; a run log is JSON lines read with DROPMALFORMED."""
    return runs.groupBy("run_id").agg(F.sum("rows").alias("rows"), F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.max("finished_at").alias("finished_at"))


def recent_runs(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The last runs of a JSON-lines log, broken lines left out (a report of the last `limit`)."""
    return spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path).where("run_id IS NOT NULL").orderBy(F.col("finished_at").desc()).limit(limit)
