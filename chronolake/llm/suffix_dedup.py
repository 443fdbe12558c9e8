"""Substring dedup over bytes by bucket-pointer refinement of sampled suffixes.

Every byte covered by a SPAN-byte string that also starts anywhere else goes, judged on the
input.  Only suffixes that can matter are sorted into buckets.  A window of SPAN bytes is represented by the
suffix at its anchor, the q-gram (Q bytes) of least hash in it; the q-gram is that suffix's
initial bucket.  Buckets with one suffix end there.  The others are refined over the cluster by the buckets of
the content at other offsets, each round reusing the buckets of the one before, until single windows
are told apart (see repeats; WIDTHS has the anchor places that a cell of each round holds).

Null and empty texts, and texts shorter than SPAN, lose nothing.  Copies of a text of SPAN
bytes or more lose all of it, as do repeated rows.  Rows that share a doc_id, and rows with a null one,
are documents of their own.  An empty table gives no rows.  Other columns of the input are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa

from chronolake.llm import bytesops as B
from chronolake.llm import repeats, runtime

SPAN = 200
Q = 40
#: Anchor places in a cell of each round of refinement.
WIDTHS = (32, 4, 1)
#: Bits of a place in a chunk (texts up to 1 GB); the bits above hold the hash that picks anchors.
PLACE = 30
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def find_runs(data, bounds, span=SPAN, q=Q, named=True):
    """(document, first window, windows, place of the anchor in the first window, bucket, and if named two names) of the runs of a chunk."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none, *(none.view(np.uint64),) * (3 if named else 1)
    roll = B.roller(1)
    at = np.arange(n - q + 1)
    gram = roll.ranges(roll.prefix(data), at, at + q)
    key = (gram >> np.uint64(PLACE) << np.uint64(PLACE)) | at.astype(np.uint64)
    anchor = (B.sliding_min(key, span - q + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    at = at[: len(anchor)]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    fits = bounds[doc + 1] >= at + span
    edge = np.ones(len(anchor), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    new = fits & (edge | ~np.append(False, fits[:-1]))
    last = fits & (np.append(edge[1:], True) | ~np.append(fits[1:], False))
    s, e = np.flatnonzero(new), np.flatnonzero(last)
    names = [r.ranges(r.prefix(data), s, e + span) for r in (B.roller(2), B.roller(3)) if named]
    return doc[s], s - bounds[doc[s]], e - s + 1, anchor[s] - s, gram[anchor[s]], *names


def _parts(span):
    """A long document's overlapping parts: (bytes before, bytes)."""

    def cut(data):
        for a in range(0, max(len(data) - span + 1, 1), repeats.PART):
            yield a, data[a : a + repeats.PART + span - 1]

    return cut


def _bodies(span):
    def of(data):
        raw = data.tobytes()
        return lambda pos, count: raw[pos : pos + count - 1 + span]

    return of


def _piece(body, start, many):
    """`many` bytes of body from place `start`."""
    return body.substr((start + 1).cast("int"), many.cast("int"))


def _shape(with_text):
    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            out = []
            for i, j, data, bounds in B.chunks(batch):
                raw = data.tobytes()
                for k in range(j - i):
                    own = raw[bounds[k] : bounds[k + 1]]
                    listed = spans[i + k].values
                    a, b = (np.zeros(0, np.int64),) * 2
                    if listed is not None and len(listed):
                        a, b = repeats.union_of(*(listed.field(f).to_numpy() for f in ("start", "stop")))
                    kept = b"".join(own[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(own)], strict=True)) if len(a) else own
                    row = (batch.column(0)[i + k].as_py(), len(own), len(own) - len(kept), len(a), hashlib.sha256(kept).hexdigest())
                    out.append((*row, kept, [{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]) if with_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            kinds = [pa.int64()] * 4 + [pa.string()]
            if with_text:
                names += ["kept", "spans"]
                kinds += [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def dedup(df, id_col="doc_id", text_col="text", span=SPAN, with_text=False, widths=WIDTHS):
    """SCHEMA for every row; with_text also kept (bytes that stay) and spans (start, stop of what goes)."""
    runtime.ready(df.sparkSession)
    docs, _ = runtime.numbered(runtime.text_frame(df, id_col, text_col), "doc_id", "key", repeated=True)
    q = min(Q, span // 2)
    find = lambda data, bounds, named: find_runs(data, bounds, span, q, named)
    found = repeats.repeated(docs, find, _parts(span), _bodies(span), pa.binary(), _piece, span, [min(w, span) for w in widths], False)
    return repeats.finish(docs, found, _shape(with_text), SCHEMA + (", kept binary, spans array<struct<start: long, stop: long>>" if with_text else ""))
