"""Version resolution: which of several rows with one key counts.

All are partial aggregates (the greatest struct of order and row), so a key with very many versions is counted down on
the map side, and one row of it a map task is shuffled, where a row number over a window would sort all of them in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cols(names) -> list:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _orderable(kind) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def _ranked(df: DataFrame, by: list, ties: list | None) -> Column:
    """Order and row in one struct: `by`, then `ties`, then the row itself (as text, where its columns have no order)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    last = [] if all(_orderable(f.dataType) for f in df.schema) else [F.to_json(row).alias("_text")]
    return F.struct(*[c.alias(f"_o{i}") for i, c in enumerate([*_cols(by), *_cols(ties or [])])], *last, row.alias("_row"))


def latest(df: DataFrame, key: list, by: list, ties: list | None = None) -> DataFrame:
    """The greatest row of each key by `by`; full ties are broken by `ties`, then by the row itself."""
    ranked = _ranked(df, by, ties)
    if all(_orderable(f.dataType) for f in df.schema):
        return df.groupBy(*key).agg(F.max(ranked).alias("_best")).select("_best._row.*")
    return df.groupBy(*key).agg(F.max_by(ranked["_row"], ranked.dropFields("_row")).alias("_row")).select("_row.*")


def earliest(df: DataFrame, key: list, by: list, ties: list | None = None) -> DataFrame:
    """The least row of each key by `by`."""
    ranked = _ranked(df, by, ties)
    if all(_orderable(f.dataType) for f in df.schema):
        return df.groupBy(*key).agg(F.min(ranked).alias("_best")).select("_best._row.*")
    return df.groupBy(*key).agg(F.min_by(ranked["_row"], ranked.dropFields("_row")).alias("_row")).select("_row.*")


def known_by(df: DataFrame, moment, key: list, known: str = "known_at", ties: list | None = None) -> DataFrame:
    """What was known at `moment`: rows known by then first, and only then the latest version of each key."""
    return latest(df.where(F.col(known) <= moment), key, [known], ties)


def with_first_known(df: DataFrame, moment, key: list, known: str = "known_at", ties: list | None = None) -> DataFrame:
    """known_by with first_known_at, the least `known` among all versions, in the same pass."""
    rows = df.where(F.col(known) <= moment)
    ranked = _ranked(rows, [known], ties)
    if all(_orderable(f.dataType) for f in rows.schema):
        return rows.groupBy(*key).agg(F.max(ranked).alias("_best"), F.min(known).alias("first_known_at")).select("_best._row.*", "first_known_at")
    best = rows.groupBy(*key).agg(F.max_by(ranked["_row"], ranked.dropFields("_row")).alias("_row"), F.min(known).alias("first_known_at"))
    return best.select("_row.*", "first_known_at")


def modal(df: DataFrame, key: list, value: str, out: str) -> DataFrame:
    """The most frequent non-null `value` of each key; ties go to the least."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*key).agg(F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(out))


def one_source(df: DataFrame, key: list, source: str = "source") -> DataFrame:
    """Only the rows of each key's most frequent source."""
    own = modal(df, key, source, "_own")
    return df.join(own, key).where(F.col(source) == F.col("_own")).drop("_own")


def fresh(df: DataFrame, existing: DataFrame, ignore: tuple = ("ingested_at",)) -> DataFrame:
    """Rows of df that `existing` does not hold yet, by a hash of all columns but `ignore`."""
    cols = [c for c in df.columns if c not in ignore]
    print_ = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    held = existing.select(print_.alias("_print"))
    return df.withColumn("_print", print_).dropDuplicates(["_print"]).join(held, "_print", "left_anti").drop("_print")


def superseded_lines(df: DataFrame, line: list, document: str, status: str, known: str, amended: str = "amended") -> DataFrame:
    """Drop lines that an amendment repeats: of equal lines in several documents, one of them amended, the latest document's stay.

    Nulls in `line` are equal to each other.
    """
    found = df.groupBy(*line).agg(
        F.countDistinct(document).alias("_docs"),
        F.coalesce(F.bool_or(F.col(status) == amended), F.lit(False)).alias("_amended"),
        F.max_by(F.col(document), F.struct(known, document)).alias("_latest"),
    )
    found = found.where("_docs > 1 AND _amended").select(*[F.col(c).alias(f"_k_{c}") for c in line], "_latest")
    same = None
    for c in line:
        one = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        same = one if same is None else same & one
    joined = df.join(found, same, "left").where(F.col("_latest").isNull() | (F.col(document) == F.col("_latest")))
    return joined.select(*df.columns)
