"""Edit-aware token counts.

A document is kept as a segment tree: leaves hold up to LEAF pre-tokens (their byte
lengths and token counts and their bytes), inner nodes hold the sums below them.  An
edit finds its leaves by descending over byte sums, re-encodes only the pre-tokens it
touches plus CONTEXT bytes on either side, and updates the sums on the paths above.

`count_with_edits` builds every document's tree, applies its edits in order and
returns the counts before and after and, if asked, the trees as rows that a table can hold; `edit` applies
later edits to such rows without encoding the documents again.  Offsets are bytes of the document as it stands
when the edit is applied, clipped to it and moved down to the start of a character.
Null texts are empty; documents without edits keep their counts; edits of unknown
documents do nothing; repeated rows and rows that share a doc_id are each edited; a null doc_id
has no edits in the table of edits; empty tables give empty results.  Of an edit, a null start is
the document's start, a null stop the place of the start (nothing is cut), a null text puts nothing,
and edits without a seq come first; edits of equal seq are applied in the order of start, stop and text.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from chronolake.llm import bytesops as B
from chronolake.llm import pretokens, runtime

#: Pre-tokens in a new leaf.
LEAF = 64
#: Bytes on either side of an edit that can decide pre-token boundaries: a quote, its ending and the characters around them.
CONTEXT = 32
SCHEMA = "doc_id long, n_bytes long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_bytes_reencoded long, n_bytes_after long, n_tokens_after long"


class TokenTree:
    """Segment tree over the pre-tokens of one document."""

    def __init__(self, raw, lengths, counts):
        self.leaves = [
            (raw[a:b], lengths[k : k + LEAF], counts[k : k + LEAF])
            for k, a, b in _leaf_bounds(lengths)
        ] or [(b"", np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.base)
        for i, leaf in enumerate(self.leaves):
            self.sums[self.base + i] = (len(leaf[0]), int(leaf[2].sum()))
        for i in range(self.base - 1, 0, -1):
            a, b = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a[0] + b[0], a[1] + b[1])

    @property
    def n_bytes(self):
        return self.sums[1][0]

    @property
    def n_tokens(self):
        return self.sums[1][1]

    def whole(self):
        """(bytes, lengths, counts) of all pre-tokens."""
        return b"".join(x[0] for x in self.leaves), *(np.concatenate([x[k] for x in self.leaves]) for k in (1, 2))

    def _leaf(self, at):
        """(leaf that holds byte `at`, bytes before it)."""
        i, before = 1, 0
        while i < self.base:
            i *= 2
            if at >= before + self.sums[i][0] and self.sums[i + 1][0]:
                before += self.sums[i][0]
                i += 1
        return i - self.base, before

    def _set(self, k, leaf):
        self.leaves[k] = leaf
        i = self.base + k
        self.sums[i] = (len(leaf[0]), int(leaf[2].sum()))
        while i > 1:
            i //= 2
            a, b = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a[0] + b[0], a[1] + b[1])

    def begin(self, start, end, text):
        """Prepare an edit: the bytes to encode anew and how many of them count (what follows is context)."""
        n = self.n_bytes
        start = min(max(start or 0, 0), n)
        end = min(max(start if end is None else end, start), n)
        first, before = self._leaf(max(start - CONTEXT, 0))
        last, last_before = self._leaf(min(end + CONTEXT, max(n - 1, 0)))
        joined = [self.leaves[k] for k in range(first, last + 1)]
        raw = b"".join(x[0] for x in joined)
        lengths, counts = (np.concatenate([x[m] for x in joined]) for m in (1, 2))
        stops = before + np.cumsum(lengths)
        a, z = start - before, end - before
        while a > 0 and a < len(raw) and raw[a] & 0xC0 == 0x80:
            a -= 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        lo = int(np.searchsorted(stops, max(start - CONTEXT, 0), side="right"))
        hi = min(int(np.searchsorted(stops, end + CONTEXT, side="left")) + 1, len(lengths))
        b0 = int(stops[lo - 1] - before) if lo else 0
        b1 = int(stops[hi - 1] - before) if hi else 0
        edited = raw[b0:a] + text + raw[z:b1]
        after = raw[b1 : b1 + int(lengths[hi])] if hi < len(lengths) else b"".join(self._next(last))
        self.pending = first, last, raw[:b0], raw[b1:], lengths[:lo], lengths[hi:], counts[:lo], counts[hi:], edited
        return edited, after

    def _next(self, last):
        for leaf in self.leaves[last + 1 :]:
            if len(leaf[1]):
                yield leaf[0][: int(leaf[1][0])]
                return

    def finish(self, lengths, counts):
        first, last, head, tail, la, lb, ca, cb, edited = self.pending
        self._set(first, (head + edited + tail, np.concatenate([la, lengths, lb]), np.concatenate([ca, counts, cb])))
        nothing = np.zeros(0, np.int64)
        for k in range(first + 1, last + 1):
            self._set(k, (b"", nothing, nothing))


def _leaf_bounds(lengths):
    stops = np.cumsum(lengths)
    for k in range(0, len(lengths), LEAF):
        yield k, int(stops[k - 1]) if k else 0, int(stops[min(k + LEAF, len(lengths)) - 1])


def apply_round(work, path):
    """Apply one edit to each tree of work [(tree, start, end, text)], encoding all touched regions together; (pre-tokens, bytes) encoded for each."""
    parts, bounds, kept = [], [0], []
    for tree, start, end, text in work:
        edited, after = tree.begin(start, end, text)
        parts.append(edited + after)
        bounds.append(bounds[-1] + len(parts[-1]))
        kept.append(bounds[-2] + len(edited))
    data, bounds = np.frombuffer(b"".join(parts), np.uint8), np.array(bounds, np.int64)
    begin, doc, _, size, _ = pretokens.encode(data, bounds, path)
    stop = np.minimum(np.append(begin[1:], len(data)), bounds[1:][doc]) if len(begin) else begin
    own = begin < np.array(kept, np.int64)[doc]
    begin, stop, size, doc = begin[own], stop[own], size[own], doc[own]
    edges = np.searchsorted(doc, np.arange(len(work) + 1))
    for k, (tree, *_) in enumerate(work):
        part = slice(edges[k], edges[k + 1])
        tree.finish(stop[part] - begin[part], size[part])
    return np.diff(edges), np.diff(bounds)


def _order(edit):
    """Edits in turn, nulls first."""
    return [(edit[k] is not None, edit[k] or 0) for k in ("seq", "start", "stop")] + [edit["text"] or ""]


def _count(path, kept, with_trees):
    """kept: the batch has `lengths` and `counts` of the trees, so nothing but the edits is encoded."""

    def run(batches):
        for batch in batches:
            ids = B.longs(batch, "doc_id")
            edits = batch.column(batch.schema.get_field_index("edits")).to_pylist()
            for i, j, data, bounds in B.chunks(batch, max_bytes=4 << 20):
                if kept:
                    lengths, size = (batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in ("lengths", "counts"))
                    edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False))]).tolist()
                    lengths, size = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lengths, size))
                else:
                    begin, doc, _, size, _ = pretokens.encode(data, bounds, path)
                    lengths = np.diff(np.append(begin, len(data)))
                    edges = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
                raw = data.tobytes()
                trees = [TokenTree(raw[bounds[k] : bounds[k + 1]], lengths[edges[k] : edges[k + 1]], size[edges[k] : edges[k + 1]]) for k in range(j - i)]
                rows = [[ids[i + k].as_py(), t.n_bytes, edges[k + 1] - edges[k], t.n_tokens, 0, 0, 0] for k, t in enumerate(trees)]
                queues = [sorted((e for e in edits[i + k] or [] if e), key=_order) for k in range(j - i)]
                for turn in range(max(map(len, queues), default=0)):
                    now = [k for k, q in enumerate(queues) if len(q) > turn]
                    tokens, touched = apply_round([(trees[k], queues[k][turn]["start"], queues[k][turn]["stop"], (queues[k][turn]["text"] or "").encode()) for k in now], path)
                    for k, n, m in zip(now, tokens.tolist(), touched.tolist(), strict=True):
                        rows[k][4] += 1
                        rows[k][5] += n
                        rows[k][6] += m
                out = [(*r, t.n_bytes, t.n_tokens) for r, t in zip(rows, trees, strict=True)]
                made = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                if with_trees:
                    whole = [t.whole() for t in trees]
                    made += [pa.array([x[0].decode() for x in whole], pa.string()), *(pa.array([x[k] for x in whole], pa.list_(pa.int32())) for k in (1, 2))]
                    names += ["text", "lengths", "counts"]
                yield pa.RecordBatch.from_arrays(made, names)

    return run


EDIT = "array<struct<seq: long, start: long, stop: long, text: string>>"
#: What is kept of a tree: the leaves' bytes, and the byte length and the token count of each pre-token.
TREE = "text string, lengths array<int>, counts array<int>"


def _with_lists(own, edits, columns):
    if edits is None:
        return own
    rows = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(c).cast("string" if c == "text" else "long").alias(c) for c in ("seq", "start", "stop", "text")]).alias("e"))
    lists = rows.groupBy("doc_id").agg(F.collect_list("e").alias("edits"))
    return own.drop("edits").join(lists, "doc_id", "left").select(*columns)


def count_with_edits(df, tokenizer, edits=None, id_col="doc_id", text_col="text", edits_col=None, with_trees=False):
    """Counts of every document before and after its edits: SCHEMA; with_trees also what is kept of its tree (TREE), for `edit`.

    Edits come as rows (doc_id, seq, start, stop, text) in `edits`, or as a column of type EDIT.
    """
    runtime.ready(df.sparkSession)
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(edits_col) if edits_col else F.lit(None)).cast(EDIT).alias("edits"))
    own = _with_lists(own, edits, ["doc_id", "text", "edits"])
    return own.mapInArrow(_count(tokenizer, False, with_trees), SCHEMA + (f", {TREE}" if with_trees else ""))


def edit(trees, tokenizer, edits):
    """Apply later edits to kept trees (rows of count_with_edits or of this, with_trees): SCHEMA and TREE; only touched regions are encoded."""
    runtime.ready(trees.sparkSession)
    own = trees.select("doc_id", "text", "lengths", "counts", F.lit(None).cast(EDIT).alias("edits"))
    own = _with_lists(own, edits, ["doc_id", "text", "lengths", "counts", "edits"])
    return own.mapInArrow(_count(tokenizer, True, True), f"{SCHEMA}, {TREE}")
