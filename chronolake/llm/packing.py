"""Bounded-space online best-fit packing of tokenised documents into fixed-length sequences.

A document is its token ids and a closing id 0.  Longer ones than a sequence are
cut so that every piece but the first is a full sequence.  Each input partition is
packed on its own, in the order it arrives (within a chunk of documents the longest
pieces go first): a fixed number of open bins stands in a bitset keyed by free
space, a piece goes to the open bin that it leaves the least space in, and when too
many bins are open the fullest closes.  No rows move between machines.

Nulls and empty texts give the closing id alone.  Repeated rows are packed each on
their own.  An empty table gives no rows.  Only the id and text columns are read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from chronolake.llm import bytesops as B
from chronolake.llm import pretokens, runtime

CAPACITY = 2048
#: Bins that a partition holds open; each is two integers.
OPEN_BINS = 8192
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Packer:
    """Open bins by free space; `place` answers (sequence number, offset)."""

    def __init__(self, capacity=CAPACITY, open_bins=OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.bins, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free):
        own = self.bins[free]
        made = own.pop()
        if not own:
            self.bits ^= 1 << free
        self.open -= 1
        return made

    def place(self, length):
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def cuts(n, capacity):
    """(start, length) of the pieces of n ids: all but the first are full."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pack(path, capacity, open_bins, with_ids):
    def run(batches):
        packer = Packer(capacity, open_bins)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = B.longs(batch, "doc_id")
            for i, j, data, bounds in B.chunks(batch, max_bytes=4 << 20):
                _, doc, at, size, store = pretokens.encode(data, bounds, path)
                flat = pretokens.flat_ids(at, size, store)
                stop = np.cumsum(np.bincount(doc, weights=size, minlength=j - i).astype(np.int64))
                pieces = []
                for k, (a, b) in enumerate(zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)):
                    own = np.append(flat[a:b], np.uint32(0)).astype("<u4")
                    pieces += [(i + k, p, s, n, own[s : s + n]) for p, (s, n) in enumerate(cuts(len(own), capacity))]
                pieces.sort(key=lambda x: -x[3])
                rows = [(k, p, s, n, zlib.crc32(own.tobytes()), *packer.place(n)) for k, p, s, n, own in pieces]
                out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)]
                out[0] = ids.take(out[0])
                out[5] = pa.array(np.asarray(out[5]) + base)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                if with_ids:
                    out.append(pa.array([x[4].astype(np.int64) for x in pieces], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def pack(df, tokenizer, capacity=CAPACITY, open_bins=OPEN_BINS, id_col="doc_id", text_col="text", with_ids=False):
    """Pieces of every document with their place: SCHEMA, and with_ids the token ids of each piece."""
    runtime.ready(df.sparkSession)
    return runtime.text_frame(df, id_col, text_col).mapInArrow(_pack(tokenizer, capacity, open_bins, with_ids), SCHEMA + (", ids array<long>" if with_ids else ""))
