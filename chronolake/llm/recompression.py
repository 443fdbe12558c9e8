"""Substring dedup over words by recompression.

A window is SPAN consecutive words (`[^\\x20\\x09-\\x0D]+`, unchanged).  Every word of a window
that also starts in a document with a smaller doc_id goes, judged on the input.

Recompression renames the words in rounds: a run of one symbol becomes one symbol, then each
pair of a left and a right symbol becomes one (a symbol's side is a bit of its name).
Names are hashes of what they stand for, so they are global: the same words get the same name in
every document and no table of names has to be passed around.  With each symbol goes the stretch of words
that its making has looked at; a symbol whose stretch lies in a window is the same in all
copies of that window.  A window's anchor is such a symbol of the highest level kept (of the words
themselves where none fits) with the least name; its bucket names all words of the stretch.
Shared buckets reveal repeats, and rounds over the cluster that name more and more of the words around them
verify them (see repeats).

Null texts and texts without words have none; shorter texts than SPAN words keep all.  Rows
that share a doc_id are told apart and are no smaller than each other; a row with a null
doc_id is neither smaller nor larger than any and keeps all.  An empty table gives no rows.
Other columns of the input are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolake.llm import bytesops as B
from chronolake.llm import repeats, runtime

SPAN = 50
#: Rounds of naming runs and pairs.
ROUNDS = 4
#: Anchor places in a cell of each round of refinement.
WIDTHS = (8, 2, 1)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def rounds(word, doc, many=ROUNDS):
    """(name, first word, stop, seen from, seen to) of the symbols after `many` rounds; symbols never cross documents."""
    n = len(word)
    name = B.mix(word)
    start = np.arange(n)
    stop = start + 1
    low, high = start.copy(), stop.copy()
    for _ in range(many):
        if len(name) < 2:
            break
        joined = (name[1:] == name[:-1]) & (doc[start[1:]] == doc[start[:-1]])
        first = np.flatnonzero(np.append(True, ~joined))
        last = np.append(first[1:], len(name)) - 1
        # A run's ends are known by the symbols beside it, so those have been looked at.
        near_low = np.minimum.reduceat(low, first)
        near_high = np.maximum.reduceat(high, first)
        many_one = last > first
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        same_before = (first > 0) & (doc[start[before]] == doc[start[first]])
        same_after = (last < len(name) - 1) & (doc[start[after]] == doc[start[first]])
        # The edge of a document has been looked at too: elsewhere the same words may go on.
        low_one = np.minimum(near_low, np.where(same_before, low[before], start[first] - 1))
        high_one = np.maximum(near_high, np.where(same_after, high[after], stop[last] + 1))
        count = (last - first + 1).astype(np.uint64)
        name = np.where(many_one, B.mix(name[first] * _B + count), name[first])
        start, stop, low, high = start[first], stop[last], low_one, high_one
        if len(name) < 2:
            break
        right = (name >> np.uint64(17) & np.uint64(1)).astype(bool)
        same = doc[start[1:]] == doc[start[:-1]]
        pair = ~right[:-1] & right[1:] & same
        takes = np.append(pair, False)
        taken = np.append(False, pair)
        # A symbol left alone has looked at the neighbour that might have joined it.
        low_seen, high_seen = low.copy(), high.copy()
        look_right = np.append(~right[:-1] & same, False)
        look_left = np.append(False, right[1:] & same)
        edge_right = ~right & np.append(~same, True)
        edge_left = right & np.append(True, ~same)
        high_seen[edge_right] = np.maximum(high_seen[edge_right], stop[edge_right] + 1)
        low_seen[edge_left] = np.minimum(low_seen[edge_left], start[edge_left] - 1)
        i = np.flatnonzero(look_right)
        high_seen[i] = np.maximum(high_seen[i], high[i + 1])
        low_seen[i] = np.minimum(low_seen[i], low[i + 1])
        i = np.flatnonzero(look_left)
        low_seen[i] = np.minimum(low_seen[i], low[i - 1])
        high_seen[i] = np.maximum(high_seen[i], high[i - 1])
        i = np.flatnonzero(takes)
        name = name.copy()
        name[i] = B.mix(name[i] * _A ^ B.mix(name[i + 1] * _B + np.uint64(1)))
        stop = stop.copy()
        stop[i] = stop[i + 1]
        high_seen[i] = np.maximum(high_seen[i], high_seen[i + 1])
        low_seen[i] = np.minimum(low_seen[i], low_seen[i + 1])
        keep = ~taken
        name, start, stop, low, high = name[keep], start[keep], stop[keep], low_seen[keep], high_seen[keep]
    return name, start, stop, low, high


def _least(n, from_, to, key):
    """Least key of the ranges [from_, to] that hold each of n places."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    ok = (from_ <= to) & (to >= 0) & (from_ < n)
    from_, to, key = np.maximum(from_[ok], 0), np.minimum(to[ok], n - 1), key[ok]
    if not len(key):
        return np.full(n, top)
    level = np.log2(to - from_ + 1).astype(np.int64)
    tables = [np.full(n, top) for _ in range(int(level.max()) + 1)]
    for k in range(len(tables)):
        own = level == k
        np.minimum.at(tables[k], from_[own], key[own])
        np.minimum.at(tables[k], to[own] - (1 << k) + 1, key[own])
    for k in range(len(tables) - 1, 0, -1):
        half = 1 << (k - 1)
        np.minimum(tables[k - 1], tables[k], out=tables[k - 1])
        np.minimum(tables[k - 1][half:], tables[k][:-half], out=tables[k - 1][half:])
    return tables[0]


#: Bits of a symbol's place in a chunk; the bits above hold the part of its name that picks anchors.
PLACE = 28


def find_runs(data, bounds, span=SPAN, many=ROUNDS, named=True):
    """(document, first window, windows, place of the anchor in the first window, bucket, and if named two names) of the runs of a chunk, in words."""
    start, end, doc = B.word_spans(data, bounds, B.BLANKS)
    none = np.zeros(0, np.int64)
    n = len(start)
    if n < span:
        return none, none, none, none, *(none.view(np.uint64),) * (3 if named else 1)
    roll = B.roller(61)
    word = roll.ranges(roll.prefix(data), start, end)
    words = np.bincount(doc, minlength=len(bounds) - 1)
    first = np.cumsum(words) - words
    at = np.arange(n)
    fits = at + span <= (first + words)[doc]
    place = np.uint64(PLACE)
    name, begin, _, low, high = rounds(word, doc, many)
    key = (name >> place << place) | np.arange(len(name), dtype=np.uint64)
    best = _least(n, high - span, low, key)
    plain = best == np.uint64(0xFFFFFFFFFFFFFFFF)
    own = B.roller(62)
    prefix = own.prefix_of(B.mix(word))
    pick = (best & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    pick[plain] = 0
    anchor, a, z = begin[pick], np.maximum(low[pick], 0), np.minimum(high[pick], n)
    if (fits & plain).any():
        low_key = (B.mix(word) >> place << place) | at.astype(np.uint64)
        lone = B.sliding_min(low_key, span)
        lone = (np.append(lone, np.full(n - len(lone), at[-1], np.uint64)) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        anchor = np.where(plain, lone, anchor)
        a, z = np.where(plain, lone, a), np.where(plain, lone + 1, z)
    edge = np.ones(n, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (plain[1:] != plain[:-1]) | (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1])
    s = np.flatnonzero(fits & (edge | ~np.append(False, fits[:-1])))
    e = np.flatnonzero(fits & (np.append(edge[1:], True) | ~np.append(fits[1:], False)))
    bucket = B.mix(own.ranges(prefix, a[s], z[s]) + (anchor[s] - a[s]).astype(np.uint64) * _A + (z[s] - a[s]).astype(np.uint64) * _B)
    names = []
    if named:  # each from word hashes of its own
        other = B.roller(63)
        for over, units in ((B.roller(64), word), (B.roller(65), other.ranges(other.prefix(data), start, end))):
            names.append(over.ranges(over.prefix_of(units), s, e + span))
    return doc[s], s - first[doc[s]], e - s + 1, anchor[s] - s, bucket, *names


def _parts(span, many=1 << 15):
    """A long document's overlapping parts: (words before, bytes)."""

    def cut(data):
        start, end, _ = B.word_spans(data, np.array([0, len(data)]), B.BLANKS)
        for a in range(0, max(len(start) - span + 1, 0), many):
            yield a, data[start[a] : end[min(a + many + span - 1, len(end)) - 1]]

    return cut


def _bodies(span):
    """The words of runs, joined by one space."""

    def of(data):
        start, end, _ = B.word_spans(data, np.array([0, len(data)]), B.BLANKS)
        raw = data.tobytes()
        return lambda pos, count: b" ".join(raw[start[k] : end[k]] for k in range(pos, pos + count - 1 + span)).decode()

    return of


def _piece(body, start, many):
    """`many` words of body from place `start`."""
    return F.array_join(F.slice(F.split(body, " "), (start + 1).cast("int"), many.cast("int")), " ")


def _shape(with_text):
    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            out = []
            for i, j, data, bounds in B.chunks(batch):
                start, end, doc = B.word_spans(data, bounds, B.BLANKS)
                edges = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
                raw = data.tobytes()
                for k in range(j - i):
                    mine = slice(edges[k], edges[k + 1])
                    words = [raw[a:b] for a, b in zip(start[mine].tolist(), end[mine].tolist(), strict=True)]
                    listed = spans[i + k].values
                    gone = []
                    if listed is not None and len(listed):
                        gone = list(zip(*(x.tolist() for x in repeats.union_of(*(listed.field(f).to_numpy() for f in ("start", "stop")))), strict=True))
                    kept, at = [], 0
                    for a, b in gone:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    body = b" ".join(kept)
                    row = (batch.column(0)[i + k].as_py(), len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest())
                    out.append((*row, body, [{"start": a, "stop": b} for a, b in gone]) if with_text else row)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            kinds = [pa.int64()] * 3 + [pa.string()]
            if with_text:
                names += ["kept", "spans"]
                kinds += [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def dedup(df, id_col="doc_id", text_col="text", span=SPAN, many=ROUNDS, with_text=False, widths=WIDTHS):
    """SCHEMA for every row; with_text also kept (words that stay, joined by a space) and spans (in words)."""
    runtime.ready(df.sparkSession)
    docs, _ = runtime.numbered(runtime.text_frame(df, id_col, text_col), "doc_id", "key", repeated=True)
    find = lambda data, bounds, named: find_runs(data, bounds, span, many, named)
    found = repeats.repeated(docs, find, _parts(span), _bodies(span), pa.string(), _piece, span, [min(w, span) for w in widths], True)
    return repeats.finish(docs, found, _shape(with_text), SCHEMA + (", kept binary, spans array<struct<start: long, stop: long>>" if with_text else ""))
