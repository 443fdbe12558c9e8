"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z.  A document whose length and
64-bit fingerprint no other document has is a class of its own.  The texts of all
others are cut into blocks of BLOCK characters; equal blocks get one integer name
(the smallest block number among them), then adjacent pairs of names are named the same
way, level by level, until each document has a single name: equal names and equal
numbers of blocks hold for equal texts and no others, whatever the fingerprints do.

Names are made by partial aggregates and joined back, so a group that holds a large
share of all rows meets no single task before it has been counted down on the map side.
Each level is written to the shared folder.  Null texts count as empty.  Repeated rows
with the same doc_id form a group like others and all carry that id as keep_id.
"""

from pyspark.sql import functions as F

from chronolake.llm import runtime

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a block at the lowest level.
BLOCK = 2048
#: A block's number is its row's number times this, plus its place.
PLACES = 1 << 32
INTEGER = "decimal(38,0)"


def fold(text):
    """Lower-case A-Z alone, null as empty; plain lower() serves pure ASCII and is much faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _number(place):
    return (F.col("row").cast("decimal(20,0)") * F.lit(PLACES) + F.col(place)).cast(INTEGER)


def _named(rows, keys):
    """rows with `name`: the least `number` among rows with equal keys."""
    # Written, so that a join with a key of very many rows has two shuffled sides and can be split by key.
    least = runtime.cut(rows.groupBy(*keys).agg(F.min("number").alias("name")), "least")
    right = least.select(*[F.col(k).alias(f"_{k}") for k in keys], "name")
    on = None
    for k in keys:
        same = F.col(k) == F.col(f"_{k}")
        on = same if on is None else on & same
    return rows.join(right, on, "inner").drop(*[f"_{k}" for k in keys])


def block_names(docs, block=BLOCK):
    """(row, n_blocks, identity) for docs (row, body): equal identities and n_blocks if and only if equal bodies."""
    places = F.greatest(F.ceil(F.length("body") / block).cast("long"), F.lit(1))
    cut = docs.select("row", places.alias("n_blocks"), F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), places - 1), lambda i: F.col("body").substr((i * block + 1).cast("int"), F.lit(block)))).alias("place", "block"))
    level = _named(cut.withColumn("number", _number("place")), ["block"]).select("row", "n_blocks", "place", "name")
    level = runtime.cut(level, "names")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    done = [level.where("n_blocks = 1").select("row", "n_blocks", F.col("name").alias("identity"))]
    width = 1
    while width < most:
        left = level.where(f"n_blocks > {width}")
        pairs = left.groupBy("row", "n_blocks", F.floor(F.col("place") / 2).alias("half")).agg(F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1).cast(INTEGER)).alias("b"))
        pairs = pairs.withColumn("number", _number("half"))
        level = runtime.cut(_named(pairs, ["a", "b"]).select("row", "n_blocks", F.col("half").alias("place"), "name"), "names")
        width *= 2
        done.append(level.where(f"n_blocks <= {width}").select("row", "n_blocks", F.col("name").alias("identity")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(df, id_col="doc_id", text_col="text", block=BLOCK):
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = runtime.text_frame(df, id_col, text_col).select("doc_id", fold(F.col("text")).alias("body"))
    docs = docs.select("doc_id", "body", F.sha2("body", 256).alias("text_sha256"), F.xxhash64("body").alias("print"), F.length("body").alias("n"))
    shared = docs.groupBy("print", "n").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("print", "n")
    shared = runtime.cut(shared, "shared")
    alone = docs.join(shared, ["print", "n"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    likely = docs.join(shared, ["print", "n"], "left_semi").select(F.monotonically_increasing_id().alias("row"), "doc_id", "body", "text_sha256")
    likely = runtime.cut(likely, "likely")
    named = likely.select("row", "doc_id", "text_sha256").join(block_names(likely.select("row", "body"), block), "row")
    named = runtime.cut(named.select("doc_id", "text_sha256", "n_blocks", "identity"), "named")
    groups = named.groupBy("identity", "n_blocks").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = named.join(groups, ["identity", "n_blocks"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(df, id_col="doc_id", text_col="text", block=BLOCK):
    """One row of df for each group of exact_groups, with all columns: the one with the largest id.

    Of rows equal in id and text one stays, any of them.  Rows with a null id stay only where no equal text has an id.
    """
    groups = runtime.cut(exact_groups(df, id_col, text_col, block), "groups")
    kept = groups.where("kept OR (doc_id IS NULL AND keep_id IS NULL)").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    twice = kept.groupBy("_keep", "_sha").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_keep", "_sha")
    sha = F.sha2(fold(F.col(text_col).cast("string")), 256)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_keep")) & (sha == F.col("_sha"))
    if twice.isEmpty():
        return df.join(kept, same, "left_semi")
    once = df.join(kept.join(twice, ["_keep", "_sha"], "left_anti"), same, "left_semi")
    again = df.join(twice, same, "left_semi").withColumn("_sha", sha).dropDuplicates([id_col, "_sha"]).drop("_sha")
    return once.unionByName(again)
