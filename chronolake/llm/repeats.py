"""Repeated windows of fixed length, found through anchors: what the two substring dedups share.

A window's anchor is a place inside it that its content alone determines, so equal windows
have their anchors at equal places.  Consecutive windows of a document with the same
anchor are one run; a run has a first bucket (the name of the content at its anchor).

1. First buckets are counted; a run that is alone in its bucket has no repeated window.
2. Runs of shared buckets are named by all their content.  Runs of equal names are equal in all windows.
3. In buckets that hold several names, one run of each name (and each run that the rule may still change)
   is refined in rounds.  In each round a run's windows fall into cells by the place of the anchor, of half
   the width or less of the cells before.  A cell gets two new buckets, named by content at other offsets from the
   anchor: its core (what all windows of such a cell hold) and its whole (what its own windows cover).
   A cell alone in its core has no repeated window and goes; cells of one whole are equal in all
   windows and are decided together, one standing for all; only the others' cells, under the
   buckets that they have by then, are split in the next round.  Cells of one window are the last: core and whole
   are the window itself.

All rounds are counts by bucket, partly made before the shuffle, and joins with the counts.  So a bucket of any size
takes the same way, and no task gathers a bucket.  Names and buckets are 122 or 128 bits of hashes in random or seeded bases.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolake.llm import bytesops as B
from chronolake.llm import runtime

RUN = "bucket long, name long, more long, key long, doc_id long, pos long, len long, lead long"
NAME = ["bucket", "name", "more", "len", "lead"]
#: Bytes of a document that are taken at once: longer ones are cut into parts that overlap by a window less one unit.
PART = 1 << 18


def _found(batch, find, parts, named):
    """(row, find's arrays with places in the document) of a batch, chunk by chunk, long documents part by part."""
    for i, j, data, bounds in B.chunks(batch, max_bytes=PART):
        if j - i > 1 or len(data) <= 2 * PART:
            doc, pos, *rest = find(data, bounds, named)
            yield i + doc, pos, *rest
        else:
            for before, part in parts(data):
                doc, pos, *rest = find(part, np.array([0, len(part)]), named)
                yield i + doc, pos + before, *rest


def _runs(find, parts):
    def run(batches):
        for batch in batches:
            ids = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "doc_id")]
            for row, pos, count, lead, bucket, name, more in _found(batch, find, parts, True):
                if len(row):
                    at = pa.array(row)
                    hashes = [pa.array(x.view(np.int64)) for x in (bucket, name, more)]
                    yield pa.RecordBatch.from_arrays([*hashes, *(c.take(at) for c in ids), *(pa.array(x, pa.int64()) for x in (pos, count, lead))], [x.split()[0] for x in RUN.split(", ")])

    return run


def _buckets(find, parts):
    def run(batches):
        for batch in batches:
            for _, _, _, _, bucket in _found(batch, find, parts, False):
                if len(bucket):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64))], ["bucket"])

    return run


def _cut_out(body_of, kind):
    """The content of the runs listed with each document; body_of(data of a document) answers (pos, len) with it."""

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("runs"))
            for i, j, data, bounds in B.chunks(batch):
                part = lists.slice(i, j - i)
                rows, edges = part.flatten(), (part.offsets.to_numpy() - part.offsets[0].as_py()).tolist()
                get = {f.name: rows.field(f.name) for f in rows.type}
                pos, count = get["pos"].to_numpy().tolist(), get["len"].to_numpy().tolist()
                made = []
                for k in range(j - i):
                    own = body_of(data[bounds[k] : bounds[k + 1]])
                    made += [own(pos[r], count[r]) for r in range(edges[k], edges[k + 1])]
                key = batch.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), np.diff(edges))))
                yield pa.RecordBatch.from_arrays([key, *(get[c] for c in ("doc_id", "pos", "len", "lead", "n")), pa.array(made, kind)], ["key", "doc_id", "pos", "len", "lead", "n", "body"])

    return run


def _cells(live, piece, span, width):
    """The cells of rows (eid, low, high, n, key, doc_id, pos, lead, body): windows whose anchor place lies in low..high, by `width`."""
    first, last = (F.floor(F.col(c) / width).cast("long") for c in ("low", "high"))
    rows = live.withColumn("c", F.explode(F.sequence(first, last)))
    rows = rows.withColumns({"low": F.greatest("low", F.col("c") * width), "high": F.least("high", F.col("c") * width + (width - 1))})
    core = piece(F.col("body"), F.col("lead") - F.col("c") * width, F.lit(span - width + 1).cast("long"))
    whole = piece(F.col("body"), F.col("lead") - F.col("high"), F.col("high") - F.col("low") + span)
    names = [F.xxhash64(F.lit(1), "c", core).alias("cx"), F.xxhash64(F.lit(2), "c", core).alias("cy"), F.xxhash64(F.lit(3), "low", "high", whole).alias("fx"), F.xxhash64(F.lit(4), "low", "high", whole).alias("fy")]
    return rows.select("eid", "key", "doc_id", "n", (F.col("pos") + F.col("lead")).alias("at"), "low", "high", *names)


def refined(reps, piece, span, widths, by_document):
    """Tables of intervals (key, start, stop) that the rule removes among reps (eid, key, doc_id, pos, len, lead, n, body)."""
    core, whole = ["cx", "cy"], ["fx", "fy"]
    live = reps.withColumns({"low": F.col("lead") - F.col("len") + 1, "high": F.col("lead")})
    interval = ["key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + span).alias("stop")]
    # A core can change something if it holds what the rule may remove and something to remove it for.
    worth = [F.sum("n").alias("x"), F.min("n").alias("y")] if not by_document else [F.min("doc_id").alias("x"), F.max("doc_id").alias("y")]
    may = "x > 1 AND y = 1" if not by_document else "x < y"
    out = []
    for width in widths:
        cells = runtime.cut(_cells(live, piece, span, width), "cells")
        shared = runtime.cut(cells.groupBy(*core).agg(*worth).where(may).select(*core), "cores")
        open_cells = runtime.cut(cells.join(shared, core, "left_semi"), "open")
        if by_document:
            known = runtime.cut(open_cells.groupBy(*whole).agg(F.min("doc_id").alias("least")), "wholes")
            judged = open_cells.join(known, whole)
            out.append(runtime.cut(judged.where("doc_id > least").select(*interval), "gone"))
            left = judged.where("doc_id = least").select("eid", "n", "low", "high", *core)
        else:
            known = runtime.cut(open_cells.groupBy(*whole, *core, "low", "high").agg(F.sum("n").alias("n"), F.min("eid").alias("eid")), "wholes")
            out.append(runtime.cut(open_cells.where("n = 1").join(known.where("n > 1").select(*whole), whole, "left_semi").select(*interval), "gone"))
            left = known.select("eid", "n", "low", "high", *core)
        if width > 1:
            left = runtime.cut(left, "left")
            count = [F.count(F.lit(1)).alias("k")]
            still = runtime.cut(left.groupBy(*core).agg(*count, F.min("n").alias("y")).where("k > 1 AND y = 1").select(*core), "still") if not by_document else None
            rest = left.join(still, core, "left_semi") if still else left
            live = reps.drop("n").join(rest.select("eid", "n", "low", "high"), "eid")
        runtime.free(cells, shared, open_cells)
    return out


def repeated(docs, find, parts, body_of, kind, piece, span, widths, by_document):
    """Intervals (key, start, stop) of the windows that the rule removes, in units of the runs.

    by_document False: a window goes if it starts anywhere else; True: if it starts in a document with a
    smaller doc_id (rows with a null one are no documents then).  `docs` has key (of one row each), doc_id and text.
    """
    if by_document:
        docs = docs.where("doc_id IS NOT NULL")
    shared = docs.select("text").mapInArrow(_buckets(find, parts), "bucket long").groupBy("bucket")
    shared = runtime.cut(shared.agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket"), "buckets")
    runs = runtime.cut(docs.mapInArrow(_runs(find, parts), RUN).join(shared, "bucket", "left_semi"), "runs")
    names = runtime.cut(runs.groupBy(*NAME).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min("key").alias("key"), F.min_by("pos", "key").alias("pos")), "names")
    gone = F.col("doc_id") > F.col("least") if by_document else F.col("n") > 1
    whole = runs.join(names.where("n > 1").select(*NAME, "n", "least"), NAME).where(gone).select("key", F.col("pos").alias("start"), (F.col("pos") + F.col("len") - 1 + span).alias("stop"))
    if by_document:
        mixed = names.groupBy("bucket").agg(F.min("least").alias("x"), F.max("least").alias("y")).where("x < y").select("bucket")
        # A run's first document keeps each of its copies until the windows are compared.
        own = names.join(runtime.cut(mixed, "mixed"), "bucket", "left_semi").select(*NAME, "least")
        rest = runs.join(own, NAME).where("doc_id = least").withColumn("n", F.lit(1).cast("long"))
    else:
        mixed = names.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("x")).where("k > 1 AND x = 1").select("bucket")
        rest = names.join(runtime.cut(mixed, "mixed"), "bucket", "left_semi").withColumn("doc_id", F.lit(None).cast("long"))
    lists = rest.groupBy("key").agg(F.collect_list(F.struct("doc_id", "pos", "len", "lead", "n")).alias("runs"))
    reps = docs.select("key", "text").join(lists.hint("shuffle_hash"), "key").mapInArrow(_cut_out(body_of, kind), f"key long, doc_id long, pos long, len long, lead long, n long, body {'binary' if pa.types.is_binary(kind) else 'string'}")
    reps = runtime.cut(reps.withColumn("eid", F.monotonically_increasing_id()), "reps")
    for more in refined(reps, piece, span, widths, by_document):
        whole = whole.unionByName(more)
    return whole


def union_of(starts, stops):
    """Disjoint maximal intervals, sorted."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], stops[order]
    reach = np.maximum.accumulate(stops)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def finish(docs, found, shape, schema):
    """mapInArrow of shape(batches) over (doc_id, text, spans)."""
    spans = found.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return docs.join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans").mapInArrow(shape, schema)
