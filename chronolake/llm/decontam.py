"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A benchmark
window is WINDOW consecutive words of an item, or all words of a shorter one.  Texts
are taken as sets of positioned shingles of two words (one word for an item of one
word), by a 64-bit hash.

1. Order: the benchmark's shingles are counted over all documents, which gives nothing but one count for each.
2. Prefix: a containment of all shingles needs a prefix of one, so a window is looked for by its rarest
   shingle alone; a window with a shingle that no document has occurs nowhere.
3. Bounds: the shingle's place gives the only place where the window can start (positional bound), and
   the document must have as many words from there (length bound).
4. Verification: the words from that place are held against the window's, word by word.

The benchmark is broadcast only while it has at most BROADCAST_SHINGLES shingles; then a document's words are
verified where its shingle is met, and no text is shuffled.  A larger benchmark is joined by shuffle, and so are the
candidates with the texts.  Documents are split into words once; the table of words goes to the shared folder.

Null texts and texts without words give no words, no hits and no items; repeated items count once for each
distinct item_id; a null item_id still marks words but is not listed; an empty benchmark hits nothing and
an empty table gives no rows.  Other columns are not read.

A window must stand in one text: rows are told apart by doc_id and a hash of the text, so
repeated rows count once and no window runs over two texts of one doc_id.  Rows of one
doc_id then share their hits; rows with a null doc_id are documents of their own.
"""

from pyspark.sql import functions as F

from chronolake.llm import runtime
from chronolake.llm.exact_dedup import fold

WINDOW = 10
#: Distinct shingles (about 60 bytes each) up to which the benchmark's side is broadcast.
BROADCAST_SHINGLES = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """Array of the words of a text; null and wordless texts give an empty array."""
    clean = F.regexp_replace(fold(text), SEPARATORS, " ")
    return F.filter(F.split(clean, " ", -1), lambda w: w != "")


def shingles(column, size):
    """Array of the hashes of all runs of `size` words (one or two)."""
    if size == 1:
        return F.transform(column, lambda w: F.xxhash64(w))
    many = F.greatest(F.size(column) - 1, F.lit(0))
    return F.zip_with(F.slice(column, F.lit(1), many), F.slice(column, F.lit(2), many), lambda a, b: F.xxhash64(a, b))


def own(id_col="doc_id", text_col="text"):
    """What a null id's row is told apart by: a hash of its text; null for rows that have an id."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string")))


def _small(df, small):
    return F.broadcast(df) if small else df


def _windows(bench, item_col, text_col, window):
    """Distinct windows of the benchmark (window, words, length) and their items."""
    items = bench.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct()
    return cut.select("item_id", "words", F.concat_ws(" ", "words").alias("window"))


#: What tells a text apart, as plain columns without nulls.
KEY = ["id", "nameless", "body"]


def _key():
    return [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("nameless"), "body"]


def occurrences(docs, bench, window=WINDOW, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", broadcast_shingles=BROADCAST_SHINGLES):
    """(occurrences (doc_id, own, start, length, window), items (window, item_id), documents (doc_id, own, n_words)); own: see `own`."""
    made = runtime.cut(_windows(bench, item_col, item_text_col, window), "windows")
    windows = made.select("window", "words").distinct().withColumn("size", F.when(F.size("words") > 1, 2).otherwise(1))
    parts = windows.select("window", "size", F.size("words").alias("length"), F.posexplode(F.when(F.col("size") == 2, shingles(F.col("words"), 2)).otherwise(shingles(F.col("words"), 1))).alias("place", "shingle"))
    parts = runtime.cut(parts, "parts")
    distinct = parts.select("shingle", "size").distinct()
    sizes = {r["size"]: r["n"] for r in distinct.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sum(sizes.values()) <= broadcast_shingles
    texts = runtime.text_frame(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("body"), words(F.col("text")).alias("w"), own().alias("own"))
    texts = runtime.cut(texts.select("doc_id", "body", "own", F.size("w").alias("n"), "w"), "words")
    rarity = None
    for size in sorted(sizes) or [2]:
        tokens = texts.select(F.explode(shingles(F.col("w"), size)).alias("shingle"))
        wanted = _small(distinct.where(F.col("size") == size).select("shingle"), small)
        # A broadcast side sieves the shingles before they are counted; a large one meets their counts.
        counted = tokens.join(wanted, "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("df")) if small else tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).join(wanted, "shingle", "left_semi")
        counted = counted.withColumn("size", F.lit(size))
        rarity = counted if rarity is None else rarity.unionByName(counted)
    rarity = runtime.cut(rarity, "rarity")
    ranked = parts.join(rarity, ["shingle", "size"], "left").groupBy("window", "length", "size").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "place")).alias("rarest"))
    prefix = runtime.cut(ranked.where("rarest.df > 0").select("window", "length", "size", F.col("rarest.shingle").alias("shingle"), F.col("rarest.place").alias("place")), "prefix")
    same = lambda c: F.array_join(F.slice("w", c["start"] + 1, c["length"]), " ") == c["window"]
    found = None
    for size in sorted(sizes) or [2]:
        place = ["doc_id", "own", "body", "n", *["w"] * small]
        # Of a column, posexplode_outer runs as generated code and copies no row; of an expression of lambdas it would copy w for each word,
        # and without outer the shingles would be made twice, to see that there are any.
        tokens = texts.withColumn("s", shingles(F.col("w"), size)).select(*place, F.posexplode_outer("s").alias("pos", "shingle"))
        met = tokens.join(_small(prefix.where(F.col("size") == size).drop("size"), small), "shingle").withColumn("start", F.col("pos") - F.col("place"))
        met = met.where("start >= 0 AND start + length <= n")
        if small:
            # The words stand beside the shingle: only where it is met are they sliced.
            met = met.where(same({c: F.col(c) for c in ("start", "length", "window")}))
        met = met.select("doc_id", "own", "body", "start", "length", "window")
        found = met if found is None else found.unionByName(met)
    # Distinct, since a repeated row gives each of its places twice.
    if small:
        proved = found.drop("body").distinct()
    else:
        likely = runtime.cut(found.drop("own").distinct(), "candidates")
        lists = likely.groupBy(*_key()).agg(F.collect_list(F.struct("start", "length", "window")).alias("likely"))
        proved = texts.select("*", *_key()[:2]).join(lists, KEY).select("doc_id", "own", F.explode(F.filter("likely", same)).alias("c")).select("doc_id", "own", "c.*").distinct()
    return runtime.cut(proved, "occurrences"), made.select("window", "item_id"), texts.select("doc_id", "own", F.col("n").cast("long").alias("n_words"))


def decontaminate(docs, bench, window=WINDOW, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", broadcast_shingles=BROADCAST_SHINGLES):
    """doc_id, n_words, n_hit, n_items, items (sorted), spans (struct start, stop of each occurrence), contaminated: one row for each row of docs.

    Rows that share a doc_id share their hits.
    """
    found, items, counts = occurrences(docs, bench, window, id_col, text_col, item_col, item_text_col, broadcast_shingles)
    # A struct is equal to another with nulls at the same fields, so null ids meet in plain joins.
    key = F.struct("doc_id", "own").alias("key")
    covered = found.select(key, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hit = covered.groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select(key, "window").distinct().join(items, "window").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = found.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("stop")))).alias("spans"))
    per = hit.join(named, "key").join(spans, "key")
    return counts.select(key, "doc_id", "n_words").join(per, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
