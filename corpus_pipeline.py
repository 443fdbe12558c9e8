"""Corpus pipeline: quality classifier, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of
`documents`; the last returns the packed pieces.  `run` writes each stage's result to the
shared folder and reads it back, as a cluster job would.
"""

from pyspark.sql import functions as F

from chronolake.llm import decontam, exact_dedup, near_dedup, packing, quality, runtime
from chronolake.llm.queries import table, tokenizer_path

#: A document goes if its quality score is below this.
LEAST_QUALITY = 0.3


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality.keep_good(docs, quality.fit(docs, labels), LEAST_QUALITY)


def drop_exact_copies(spark, docs, sf_dir):
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of each near-duplicate group, the row with the least doc_id."""
    return near_dedup.drop_near(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold no window of the benchmark."""
    found = decontam.occurrences(docs, table(spark, sf_dir, "benchmark"))[0]
    hit = found.select(F.struct("doc_id", "own").alias("_hit")).distinct()
    return docs.join(hit, F.struct(F.col("doc_id"), decontam.own().alias("own")) == F.col("_hit"), "left_anti")


def pack(spark, docs, sf_dir):
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A learnt classifier and a tokenizer stand between documents and the result, so SQL cannot give it; tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        point = runtime.mark()
        docs = runtime.cut(stage(spark, docs, sf_dir), name)
        runtime.free_since(point, docs)  # what the stage wrote on its way is no longer read
    return docs
