"""Byte-level BPE over pre-tokens: vectorised pre-token boundaries, and each distinct pre-token is encoded once.

The boundary rules are those of the pattern that the public tokenizer states:
contractions, letters, digits, other marks (each with one leading space), white space.
A worker keeps the ids of the pre-tokens it has seen, up to CACHE_TOKENS ids.
"""

import os
from itertools import chain

import numpy as np

from chronolake.llm import bytesops as B

#: Ids that a worker's cache holds before it starts afresh (4 bytes each, and about 100 bytes for each pre-token).
CACHE_TOKENS = 1 << 23
#: Contraction endings of the tokenizer's pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

_STATE = {}


def _classes():
    if "classes" not in _STATE:
        import regex

        out = np.full(0x110000, OTHER, np.uint8)
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for found in regex.finditer(pattern, points):
                shift = 0x800 if found.start() >= 0xD800 else 0
                out[found.start() + shift : found.end() + shift] = kind
        _STATE["classes"] = out
    return _STATE["classes"]


def starts(data, bounds):
    """Byte offsets where pre-tokens start, in the concatenated UTF-8 documents of a chunk.

    A document's start is always one; empty documents have none.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    n = len(points)
    edges = np.searchsorted(lead, bounds[:-1][bounds[:-1] < bounds[1:]])
    first = np.zeros(n + 1, bool)
    first[edges] = True
    first[n] = True
    begin = first[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # The last white space before a mark opens a token: a plain space takes the mark along.
    space = kind == SPACE
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    begin |= before
    joined = np.flatnonzero(before & (points == 32))
    begin[joined + 1] = False
    # Contractions: a lone quote that opens a token, and the letters that follow.
    quote = np.flatnonzero((points == 39) & begin[:n])
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        stop = np.concatenate([first, np.ones(3, bool)])
        taken = np.zeros(len(quote), bool)
        for ending in ENDINGS:
            hit = ~taken
            for k, letter in enumerate(ending, 1):
                hit &= (padded[quote + k] == ord(letter)) & ~stop[np.minimum(quote + k, n)]
            where = quote[hit]
            begin[where + 1] = False
            after = where + len(ending) + 1
            begin[after[after < n]] = True
            taken |= hit
    return lead[begin]


def _encoder(path):
    if ("bpe", path) not in _STATE:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _STATE["bpe", path] = made
    return _STATE["bpe", path]


_MASK = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)


def _eight(data, begin, length):
    """The first eight bytes of ranges as one number, zeros after a shorter one's end."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[begin] & _MASK[np.minimum(length, 8)]


def _same(data, begin, length, other, other_begin, other_length):
    """Whether all ranges of `data` equal those of `other`, byte for byte: the first eight as numbers, the rest of longer ones one by one."""
    if not np.array_equal(length, other_length) or not np.array_equal(_eight(data, begin, length), _eight(other, other_begin, length)):
        return False
    long = np.flatnonzero(length > 8)
    begin, other_begin, length = begin[long] + 8, other_begin[long] + 8, length[long] - 8
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return np.array_equal(data[np.repeat(begin, length) + inside], other[np.repeat(other_begin, length) + inside])


class Cache:
    """Ids of distinct pre-tokens, flat, found by a 64-bit hash of their bytes and held against the bytes themselves."""

    def __init__(self, path):
        self.path = path
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        #: Of each key: offset and count in ids, offset and count in bytes.
        self.at, self.size, self.begin, self.length = (np.zeros(0, np.int64) for _ in range(4))
        self.ids = np.zeros(0, np.uint32)
        self.bytes = np.zeros(0, np.uint8)

    def find(self, keys, data, begin, length):
        """(offset, count) in ids of each sorted distinct key, whose pre-token is data[begin : begin + length]; None if a key stands for two."""
        if len(self.ids) > CACHE_TOKENS:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        old = place[known]
        if not _same(data, begin[known], length[known], self.bytes, self.begin[old], self.length[old]):
            return None
        new = np.flatnonzero(~known)
        if len(new):
            pieces = [data[a : a + n].tobytes() for a, n in zip(begin[new].tolist(), length[new].tolist(), strict=True)]
            encoded = ids_of(pieces, self.path)
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
            where = np.searchsorted(self.keys, keys[new])
            made = (len(self.ids) + np.cumsum(sizes) - sizes, sizes, len(self.bytes) + np.cumsum(length[new]) - length[new], length[new])
            self.at, self.size, self.begin, self.length = (np.insert(x, where, y) for x, y in zip((self.at, self.size, self.begin, self.length), made, strict=True))
            self.keys = np.insert(self.keys, where, keys[new])
            self.ids = np.concatenate([self.ids, flat])
            self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
            place = np.searchsorted(self.keys, keys)
        return self.at[place], self.size[place]


def ids_of(pieces, path):
    """Ids of each pre-token (bytes)."""
    return [x.ids for x in _encoder(path).encode_batch([x.decode() for x in pieces], add_special_tokens=False)]


def cache(path):
    if ("cache", path) not in _STATE:
        _STATE["cache", path] = Cache(path)
    return _STATE["cache", path]


def keys_of(data, begin, end):
    roll = B.roller(11)
    return roll.ranges(roll.prefix(data), begin, end)


def encode(data, bounds, path):
    """(first byte of each pre-token, its document, its offset in flat, its number of ids, flat ids store)."""
    begin = starts(data, bounds)
    end = np.append(begin[1:], len(data))[: len(begin)]
    doc = np.searchsorted(bounds, begin, side="right") - 1
    length = end - begin
    distinct, sample, back = np.unique(keys_of(data, begin, end), return_index=True, return_inverse=True)
    store = cache(path)
    found = None
    # All pre-tokens of a key are the same bytes, here and in the cache, or the keys are not used.
    if _same(data, begin, length, data, begin[sample][back], length[sample][back]):
        found = store.find(distinct, data, begin[sample], length[sample])
    if found is None:
        return begin, doc, *_plainly(data, begin, end, path)
    at, size = found
    return begin, doc, at[back], size[back], store.ids


def _plainly(data, begin, end, path):
    """Offsets, counts and ids without keys: pre-tokens told apart by their bytes."""
    raw = data.tobytes()
    number = {}
    back = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
    encoded = ids_of(list(number), path)
    size = np.fromiter(map(len, encoded), np.int64, len(encoded))
    ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(size.sum()))
    return (np.cumsum(size) - size)[back], size[back], ids


def flat_ids(at, size, ids):
    """The ids of pre-tokens at offsets `at`, one after the other."""
    total = int(size.sum())
    first = np.cumsum(size) - size
    return ids[np.repeat(at - first, size) + np.arange(total)]
