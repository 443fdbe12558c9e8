"""What the operators need from the session: the shared folder, lineage cuts and the workers' import path."""

import atexit
import os
import re
import tempfile
import uuid

_WRITTEN = []


#: Rows of a batch that goes to a Python worker: texts are long, and a worker holds a batch and its copy.
BATCH_ROWS = 1000


def ready(spark):
    """Let Python workers import this package when driver and workers share a machine (a cluster ships it with
    --py-files), and bound the batches that they get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH")) if x)
    return spark


def shared_dir(spark):
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run
    in one process (tests); on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
        named = _fallback()
    return f"{named.rstrip('/')}/chronolake"


def _fallback():
    if not hasattr(_fallback, "path"):
        _fallback.path = "file://" + tempfile.mkdtemp(prefix="chronolake-")
    return _fallback.path


def cut(df, name="step"):
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark, path):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free(*tables):
    """Delete tables that `cut` wrote, once nothing is left to be computed from them."""
    for path in {os.path.dirname(f) for t in tables for f in t.inputFiles()}:
        for k, (spark, own) in enumerate(_WRITTEN):
            if path.endswith(own.rpartition("/")[2]):
                _delete(spark, own)
                del _WRITTEN[k]
                break


def mark():
    """A point in time for `free_since`."""
    return len(_WRITTEN)


def free_since(point, but):
    """Delete what `cut` has written since `point`, but for the table `but`."""
    kept = {os.path.dirname(f).rpartition("/")[2] for f in but.inputFiles()}
    for spark, path in _WRITTEN[point:]:
        if path.rpartition("/")[2] not in kept:
            _delete(spark, path)
    _WRITTEN[point:] = [x for x in _WRITTEN[point:] if x[1].rpartition("/")[2] in kept]


def _clean():
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder's owner clears it
            return


def text_frame(df, id_col="doc_id", text_col="text"):
    """Only the two columns an operator reads, under fixed names, so that extra columns never clash."""
    from pyspark.sql import functions as F

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def numbered(df, id_col="doc_id", key="_key", repeated=False):
    """(df with a long column `key`, condition on `key`): the id, or where that is null (repeated: or another row has it too) a
    number of the row's own that is no row's id, and for which keys that is so.

    The numbers lie beyond the largest id (below the least where there is more room); only rows that get one are written.
    """
    from pyspark.sql import functions as F

    own = F.col(id_col).cast("long")
    top, least, nulls = df.agg(F.max(own), F.min(own), F.count_if(own.isNull())).first()
    named, odd = df.where(own.isNotNull()), df.where(own.isNull())
    if repeated:
        twice = cut(named.groupBy(own.alias("_twice")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_twice"), "repeated")
        if not twice.isEmpty():
            same = own == F.col("_twice")
            named, more = named.join(twice, same, "left_anti"), named.join(twice, same, "left_semi")
            odd, nulls = odd.unionByName(more), True
    if not nulls:
        return df.withColumn(key, own), F.lit(False)
    number = F.monotonically_increasing_id()
    if top is None:
        made, nameless = number, F.lit(True)
    elif (1 << 63) - 1 - top >= min(least + (1 << 63), 1 << 62):
        made, nameless = number + F.lit(top + 1).cast("long"), F.col(key) > F.lit(top)
    else:
        made, nameless = F.lit(least - 1).cast("long") - number, F.col(key) < F.lit(least)
    return named.withColumn(key, own).unionByName(cut(odd.withColumn(key, made), "nameless")), nameless
