"""Vectorised byte and word primitives shared by the Python-backed operators.

Documents arrive as Arrow batches.  They are cut into chunks of whole documents
(about ``max_bytes`` each, so that work arrays stay bounded) and every primitive
works on the concatenated UTF-8 bytes of a chunk.  Null texts count as empty.

Hashing is polynomial modulo the prime 2**61 - 1 in a random base, so two texts of n units
have equal hashes with probability n / 2**61 at most, whatever they look like (a power of two
as modulus has no such bound: texts that repeat in halves collide there under every odd
base).  The hash of any range is one subtraction and one product of prefix sums.
Callers that decide on equality compare the content too, or use two bases.
"""

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STATE = {}


def mix(x):
    """Finalise 64-bit hashes so that all bits depend on all bits (wraps)."""
    out = np.empty(x.shape, U64)
    if x.ndim != 1:
        return mix(np.ascontiguousarray(x).ravel()).reshape(x.shape)
    for i in range(0, len(x), _AT_ONCE):
        here = out[i : i + _AT_ONCE]
        part = _WORK[0][: len(here)]
        np.right_shift(x[i : i + _AT_ONCE], U64(32), out=part)
        np.bitwise_xor(x[i : i + _AT_ONCE], part, out=here)
        for _ in range(2):
            np.multiply(here, U64(0xD6E8FEB86659FD93), out=here)
            np.right_shift(here, U64(32), out=part)
            np.bitwise_xor(here, part, out=here)
    return out


PRIME = (1 << 61) - 1
_P, _LOW, _HALF = U64(PRIME), U64((1 << 31) - 1), U64((1 << 30) - 1)


def reduced(x):
    """x modulo PRIME for any 64-bit x."""
    x = (x & _P) + (x >> U64(61))
    return x - _P * (x >= _P)


#: Entries that are multiplied at once: the work arrays stay in the processor's cache.
_AT_ONCE = 1 << 13
_WORK = [np.empty(_AT_ONCE, U64) for _ in range(5)]


def times(a, b):
    """a * b modulo PRIME for a, b below PRIME, in halves of 31 bits (2**61 is 1 there, and 2**62 is 2); b may be one number."""
    made = np.empty(len(a), U64)
    b = np.broadcast_to(b, a.shape)
    for i in range(0, len(a), _AT_ONCE):
        x, y, out = a[i : i + _AT_ONCE], b[i : i + _AT_ONCE], made[i : i + _AT_ONCE]
        x_low, x_high, y_low, y_high, part = (w[: len(out)] for w in _WORK)
        np.bitwise_and(x, _LOW, out=x_low)
        np.right_shift(x, U64(31), out=x_high)
        np.bitwise_and(y, _LOW, out=y_low)
        np.right_shift(y, U64(31), out=y_high)
        np.multiply(x_high, y_high, out=out)
        np.left_shift(out, U64(1), out=out)
        np.multiply(x_high, y_low, out=x_high)
        np.multiply(x_low, y_high, out=y_high)
        np.add(x_high, y_high, out=x_high)
        np.right_shift(x_high, U64(30), out=part)
        np.add(out, part, out=out)
        np.bitwise_and(x_high, _HALF, out=x_high)
        np.left_shift(x_high, U64(31), out=x_high)
        np.add(out, x_high, out=out)
        np.multiply(x_low, y_low, out=x_low)
        np.add(out, x_low, out=out)
        _reduce(out, part)
    return made


def _reduce(out, part):
    """out modulo PRIME in place: zero stands as PRIME only where a caller adds on."""
    np.right_shift(out, U64(61), out=part)
    np.bitwise_and(out, _P, out=out)
    np.add(out, part, out=out)
    np.greater_equal(out, _P, out=part, casting="unsafe")
    np.multiply(part, _P, out=part)
    np.subtract(out, part, out=out)


def powers(base, n):
    """base**0 ... base**(n - 1) modulo PRIME."""
    out = np.ones(n, U64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = times(out[:more], U64(pow(base, done, PRIME)))
        done += more
    return out


class Roller:
    """Prefix sums of unit values times powers of a random base, modulo PRIME."""

    def __init__(self, seed, fold_case=False):
        rng = np.random.default_rng(seed)
        self.image = rng.integers(1, PRIME, 256, dtype=np.uint64)
        if fold_case:
            self.image[65:91] = self.image[97:123]
        self.base = int(rng.integers(1 << 32, PRIME - 1))
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n):
        if len(self.up) < n + 1:
            n = max(n + 1, 1 << 18)
            self.up, self.down = powers(self.base, n), powers(pow(self.base, -1, PRIME), n)

    def prefix(self, data):
        return self._sums(self.image[data])

    def prefix_of(self, values):
        """Prefix sums for a sequence of 64-bit values instead of bytes."""
        return self._sums(reduced(values))

    def _sums(self, values):
        self._grow(len(values))
        out = np.zeros(len(values) + 1, U64)
        sums = out[1:]
        terms = times(values, self.up[: len(values)])
        for i in range(0, len(terms), _AT_ONCE):
            part, here = terms[i : i + _AT_ONCE], sums[i : i + _AT_ONCE]
            high, low, rest = (w[: len(part)] for w in _WORK[:3])
            # Sums of halves cannot overflow: at most 2**13 terms of 31 bits.
            np.right_shift(part, U64(31), out=high)
            np.cumsum(high, out=high)
            np.bitwise_and(part, _LOW, out=low)
            np.cumsum(low, out=low)
            np.right_shift(high, U64(30), out=here)
            np.add(here, low, out=here)
            np.bitwise_and(high, _HALF, out=high)
            np.left_shift(high, U64(31), out=high)
            np.add(here, high, out=here)
            np.add(here, out[i], out=here)
            _reduce(here, rest)
        return out

    def ranges(self, prefix, start, end):
        """Hash of data[start:end] for index arrays start and end; ranges of other lengths differ as other texts do."""
        gone = prefix[end]
        gone += _P
        gone -= prefix[start]
        _reduce(gone, np.empty(len(gone), U64))
        return mix(times(gone, self.down[start]))


def roller(seed, fold_case=False):
    key = (seed, fold_case)
    if key not in _STATE:
        _STATE[key] = Roller(seed, fold_case)
    return _STATE[key]


def utf8_column(column):
    """(values, offsets) of an Arrow string or binary array; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(batch, text_col="text", max_bytes=1 << 18):
    """Yield (row_from, row_to, data, bounds): whole documents, bounds has one more entry than rows."""
    data, offsets = utf8_column(batch.column(batch.schema.get_field_index(text_col)))
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def longs(batch, name):
    """An Arrow column, nulls and all: NumPy has no null among integers."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64())


def word_spans(data, bounds, separator):
    """Start and end of maximal runs of non-separator bytes, which never cross documents, and the document of each."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def byte_set(*ranges):
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: The separators of words `[^\x20\x09-\x0D]+`.
BLANKS = byte_set((0x20, 0x20), (0x09, 0x0D))


def sliding_min(x, width):
    """Minimum of every `width` consecutive entries, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def same_as_previous(*keys):
    """For sorted parallel arrays: whether each entry equals the one before."""
    out = np.ones(len(keys[0]), bool)
    out[:1] = False
    for k in keys:
        out[1:] &= k[1:] == k[:-1]
    return out
