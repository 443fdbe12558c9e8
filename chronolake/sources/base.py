"""What parsers share: provenance, checks at run time, and tolerant numbers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.schemas import conform, dataset, with_missing


def stamped(rows: DataFrame, source: str, name: str) -> DataFrame:
    """rows in the dataset's shape: provenance added, absent nullable columns as typed nulls."""
    made = rows.withColumns({"source": F.lit(source), "dataset": F.lit(name), "ingested_at": F.current_timestamp()})
    made = with_missing(made, name)
    return conform(made.select(*[f.name for f in dataset(name).schema]), name)


def number(text: Column) -> Column:
    """A double, or null for '.', blanks and text."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def text(value: Column) -> Column:
    """Trimmed, or null if blank."""
    return F.nullif(F.trim(value), F.lit(""))


def demand(condition: Column, value: Column, said: Column, kind: str) -> Column:
    """value where the condition holds; the running query fails with `said` otherwise."""
    return F.when(condition, value).otherwise(F.raise_error(said).cast(kind))


def instant(day: Column) -> Column:
    """Midnight UTC of a day."""
    return day.cast("timestamp")
