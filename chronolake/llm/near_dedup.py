"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document's set is its distinct
shingles of SHINGLE words (a shorter document's only shingle is all of it).  Two families of
hashes name shingles, each modulo a prime in a random base of its own: signatures come from one, links are
confirmed on sets named by the other, and sets count as equal only where both agree.  Equal sets share
one representative, so copies never meet in pairs.

A SuperMinHash signature gives every element a random permutation of the slots; at level j an
element offers j + a random share to the j-th slot of its permutation, and a level is
only gone to while some slot of the document is still empty (the early stop).  BANDS bands
of ROWS slots make buckets: at the threshold 0.75 a pair shares none with probability
(1 - 0.75**6)**60 < 1e-5, and far less above it.

A bucket of k documents is not expanded into pairs.  It is first taken as a star about its least member; the
pairs are confirmed on full sets, and confirmed links are merged (union-find by alternating
large and small stars, in DataFrames).  Then, in every bucket that still holds several components, the members
outside its largest component are held against all members of the other components, in blocks of at most BLOCK
members a side, each inside a task, and only links come out.  So no link that
changes a component is lost, and pairs inside a component are not listed.

Null or wordless texts have an empty set and are linked with nothing.  Rows that share a
doc_id count as linked; rows with a null one are in no group (`drop_near` gives them numbers).  An empty table
gives no rows.  Other columns are not read, and `drop_near` passes them through.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolake.llm import bytesops as B
from chronolake.llm import runtime

SHINGLE = 5
#: Per cent of the union that the intersection must reach.
THRESHOLD = 75
ROWS, BANDS = 6, 60
#: Members of a block, the unit of comparison.
BLOCK = 256
#: The families of shingle names: for signatures, and for what is confirmed.
SKETCHED, CONFIRMED = 51, 52
_GOLD = 0x9E3779B97F4A7C15


def shingle_sets(data, bounds, size=SHINGLE, family=SKETCHED):
    """(document, hash) of the distinct shingles of a chunk, sorted by both."""
    start, end, doc = B.word_spans(data, bounds, B.BLANKS)
    n_docs = len(bounds) - 1
    if not len(start):
        return doc, np.zeros(0, np.uint64)
    roll = B.roller(family, fold_case=True)
    word = roll.ranges(roll.prefix(data), start, end)
    words = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(words) - words
    many = np.maximum(words - size + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(n_docs), many)
    at = first[owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    last = (first + words)[owner]
    made = np.full(len(at), np.uint64(_GOLD))
    for k in range(size):
        inside = at + k < last
        here = word[np.minimum(at + k, len(word) - 1)]
        made = np.where(inside, B.mix(made * np.uint64(0x2545F4914F6CDD1D) + here), made)
    order = np.lexsort((made, owner))
    owner, made = owner[order], made[order]
    new = ~B.same_as_previous(owner, made)
    return owner[new], made[new]


def superminhash(doc, element, n_docs, slots):
    """Signatures (n_docs, slots); documents without elements keep infinity."""
    sig = np.full(n_docs * slots, np.inf)
    seed = B.mix(element ^ np.uint64(0xA0761D6478BD642F))
    steps = []
    for j in range(slots):
        draw = B.mix(seed + np.uint64((j + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
        share = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = (j + ((draw & np.uint64(0x7FF)) * np.uint64(slots - j) >> np.uint64(11))).astype(np.int16)
        # The permutation's j-th entry: undo the swaps (t, steps[t]) made before.
        slot = pick.copy()
        for t in range(j - 1, -1, -1):
            slot[slot == steps[t]] = t
        np.minimum.at(sig, doc * slots + slot, share + j)
        open_docs = np.isinf(sig.reshape(n_docs, slots)).any(1)
        left = open_docs[doc]
        if not left.any():
            break
        steps.append(pick)
        if not left.all():
            doc, seed = doc[left], seed[left]
            steps = [s[left] for s in steps]
    return sig.reshape(n_docs, slots)


def band_keys(sig, rows=ROWS):
    """One 64-bit key for each band of a signature."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), -1, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]) * np.uint64(_GOLD)
    for r in range(rows):
        key = B.mix(key * np.uint64(0x2545F4914F6CDD1D) + bits[:, :, r])
    return key


def _lists(values, counts, kind):
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _signatures(rows, bands, size):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, bounds in B.chunks(batch, max_bytes=1 << 19):
                n = j - i
                doc, element = shingle_sets(data, bounds, size)
                sizes = np.bincount(doc, minlength=n)
                sums = []
                for owner, name in ((doc, element), shingle_sets(data, bounds, size, CONFIRMED)):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, owner, B.mix(name ^ np.uint64(_GOLD)))
                    sums.append(pa.array(total.view(np.int64)))
                keys = band_keys(superminhash(doc, element, n, rows * bands), rows)
                keys = _lists(keys.ravel().view(np.int64), np.full(n, bands), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(sizes, pa.int64()), *sums, keys], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _sets(size):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, bounds in B.chunks(batch):
                doc, element = shingle_sets(data, bounds, size, CONFIRMED)
                counts = np.bincount(doc, minlength=j - i)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), _lists(element.view(np.int64), counts, pa.int64())], ["doc_id", "shingles"])

    return run


def confirm(pairs, sets, threshold=THRESHOLD):
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where((small * 100 >= large * threshold) & (common * 100 >= (F.size("sa") + F.size("sb") - common) * threshold)).select("a", "b")


def components(links):
    """(node, component) of every node of links (a, b): the least node reachable."""
    edges = runtime.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least neighbours are written, so that the joins have two shuffled sides and a hub's edges can be split.
        least = runtime.cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = runtime.cut(large, "large")
        least = runtime.cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = runtime.cut(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _compare_blocks(threshold):
    """Links between the minor members of a unit and the others of its block in other components; units arrive sorted."""

    def compare(ids, parts, is_minor, offsets, values):
        sizes = np.diff(offsets)
        minor, other = np.flatnonzero(is_minor), np.flatnonzero(~is_minor)
        if not len(minor) or not len(other):
            return []
        all_values = np.concatenate([values[offsets[k] : offsets[k + 1]] for k in other])
        starts = np.concatenate([[0], np.cumsum(sizes[other])])[:-1]
        words, at = np.unique(all_values, return_inverse=True)
        found = []
        for k in minor:
            mine = values[offsets[k] : offsets[k + 1]]
            where = np.searchsorted(words, mine)
            where[where == len(words)] = 0
            mark = np.zeros(len(words), np.int64)
            mark[where[words[where] == mine]] = 1
            common = np.add.reduceat(mark[at], starts)
            hit = (common * 100 >= (sizes[k] + sizes[other] - common) * threshold) & (parts[other] != parts[k])
            found += [(min(a, b), max(a, b)) for a, b in zip(ids[other[hit]].tolist(), [int(ids[k])] * int(hit.sum()), strict=True)]
        return found

    def units(table):
        """Unit by unit; a unit has at most 2 * BLOCK rows but for the chance of hashing."""
        columns = [table.column(c).to_numpy() for c in ("key", "x", "y")]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.flatnonzero(new)

    def some(table, first, stop):
        ids, parts = table.column("doc").to_numpy(), table.column("component").to_numpy()
        is_minor = table.column("minor").to_numpy(zero_copy_only=False)
        lists = table.column("shingles").combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        found = []
        for a, b in zip(first, [*first[1:], stop], strict=True):
            found += compare(ids[a:b], parts[a:b], is_minor[a:b], offsets[a : b + 1], values)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=LINK)

    def run(batches):
        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more]).combine_chunks()
            first = units(held).tolist()
            if len(first) > 1:  # the last unit may go on
                yield some(held, first[:-1], first[-1])
                held = held.slice(first[-1]).combine_chunks()
        if held is not None and held.num_rows:
            yield some(held, units(held).tolist(), held.num_rows)

    return run


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _in_blocks(rows, sets, threshold):
    """Links across components inside buckets; rows: (key, doc, component)."""
    counts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    about = counts.groupBy("key").agg(F.sum("n").alias("k"), F.max("n").alias("top"), F.max_by("component", F.struct("n", "component")).alias("most"))
    about = about.select("key", "most", F.ceil(F.col("k") / BLOCK).alias("blocks"), F.ceil((F.col("k") - F.col("top")) / BLOCK).alias("minor_blocks"))
    placed = rows.join(runtime.cut(about, "about"), "key").withColumn("at", F.xxhash64("doc"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    whole = placed.select("key", "doc", "component", F.lit(False).alias("minor"), F.pmod("at", "blocks").alias("x"), every("minor_blocks").alias("y"))
    minor = placed.where("component <> most").select("key", "doc", "component", F.lit(True).alias("minor"), every("blocks").alias("x"), F.pmod("at", "minor_blocks").alias("y"))
    units = whole.unionByName(minor).join(sets, F.col("doc") == F.col("doc_id")).select("key", "x", "y", "doc", "component", "minor", "shingles")
    return units.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_compare_blocks(threshold), "a long, b long").distinct()


def _linked(multi, sets, threshold):
    """Links between representatives that hold all components; multi: (key, doc) of buckets with two members or more."""
    centre = multi.groupBy("key").agg(F.min("doc").alias("c"))
    pairs = multi.join(centre, "key").where("doc > c").select(F.col("c").alias("a"), F.col("doc").alias("b")).distinct()
    links = runtime.cut(confirm(pairs, sets, threshold), "links")
    group = components(links)
    rows = multi.join(group, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    apart = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rows = runtime.cut(rows.join(apart, "key", "left_semi"), "apart")
    links = runtime.cut(links.unionByName(_in_blocks(rows, sets, threshold)), "links")
    return links, components(links)


def near_groups(df, id_col="doc_id", text_col="text", size=SHINGLE, threshold=THRESHOLD, rows=ROWS, bands=BANDS):
    """doc_id, n_shingles, component_id, kept of every row of df."""
    runtime.ready(df.sparkSession)
    docs = runtime.text_frame(df, id_col, text_col)
    signs = runtime.cut(docs.mapInArrow(_signatures(rows, bands, size), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures")
    full = signs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    keys = reps.select(F.col("rep").alias("doc"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x <> y").select("key")
    multi = runtime.cut(keys.join(shared, "key", "left_semi").distinct(), "buckets")
    needed = multi.select("doc").distinct()
    sets = runtime.cut(docs.join(needed, F.col("doc_id") == F.col("doc"), "left_semi").mapInArrow(_sets(size), "doc_id long, shingles array<long>"), "sets")
    links, group = _linked(multi, sets, threshold)
    copies = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("y")).where("rep <> y").drop("y")
    # Written, so that the join has two shuffled sides and a large group of copies can be split.
    member = full.select("doc_id", "set_a", "set_b").join(runtime.cut(copies, "copies"), ["set_a", "set_b"]).select("doc_id", "rep").distinct()
    # Rows that share a doc_id but not a set lie in several sets: those sets' representatives are linked.
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("doc_id")
    if not twice.isEmpty():
        chain = member.join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        group = components(links.unionByName(chain))
    member = member.join(group, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("found"))
    lone = group.select(F.col("node").alias("doc_id"), F.col("component").alias("found"))
    found = member.unionByName(lone).groupBy("doc_id").agg(F.min("found").alias("found"))
    out = signs.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.least("doc_id", F.coalesce("found", "doc_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near(df, id_col="doc_id", text_col="text"):
    """df with one row set (that of the least doc_id) of each group.

    Rows with a null id are documents of their own that come after all ids (before them where the largest id leaves no
    room for their numbers, see runtime.numbered): one goes only if another row of its group stays.
    """
    rows, _ = runtime.numbered(df, id_col)
    kept = near_groups(rows, "_key", text_col).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    return rows.join(kept, F.col("_key") == F.col("_keep"), "left_semi").select(*df.columns)
