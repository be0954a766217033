"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {}
# Bytes that are hashed together.
STRETCH = 1 << 18
# Places of a span whose random numbers are kept; further ones are worked out.
PLACES = 64
_VALUES = None

# Bytes that separate words: space and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
# Letters, digits and all bytes beyond ASCII; punctuation separates.
WORD_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lower_latin(data):
    """The bytes in lower case: ASCII, and the Latin-1 capitals 0xC3 0x80 to 0xC3 0x9E."""
    low = LOWER[data]
    wide = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] <= 0x9E) & (low[1:] >= 0x80)) + 1
    low[wide] += 32
    return low


def mix(h):
    """Finalizer of a 64-bit hash; every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n):
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    size = 1 << 20
    while size <= n:
        size *= 2
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def word_spans(data, bounds, inside):
    """(start, end, text number) of every run of bytes for which ``inside`` holds."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    flag = np.zeros(n + 2, np.int8)
    flag[1:-1] = inside[data]
    begins = np.diff(flag[:-1]) == 1
    ends = np.diff(flag[1:]) == -1
    # A text's end also ends a word.
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = flag[1:-1][cuts] == 1
    ends[cuts - 1] = flag[1:-1][cuts - 1] == 1
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(bounds, start, "right") - 1


def byte_values():
    """A fixed random 64-bit number for each byte at each of the first places of a span."""
    return mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * BASE)


def span_hashes(data, start, end):
    """One hash for each span of bytes; equal bytes have equal hashes.

    It is the mixed sum of random numbers, one for each place in the span and byte there, so no
    pattern of bytes makes two spans collide. Spans are taken in stretches of bytes, so that the
    tables stay small.
    """
    global _VALUES
    if _VALUES is None:
        _VALUES = byte_values()
    size = end - start
    out = np.zeros(len(size), np.uint64)
    before = np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < len(size):
        last = max(int(np.searchsorted(before, before[first] + STRETCH, "right")) - 1, first + 1)
        if before[last] - before[first] > STRETCH:
            out[first] = long_span(data, int(start[first]), int(end[first]))
        elif before[last] > before[first]:
            out[first:last] = short_spans(data, start[first:last], size[first:last])
        first = last
    return mix(out + size.astype(np.uint64))


def place_values(data, place):
    """The random numbers of bytes at their places."""
    near = _VALUES[np.minimum(place, PLACES - 1) * 256 + data]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        near[far] = mix((place[far] * 256 + data[far] + 1).astype(np.uint64) * BASE)
    return near


def short_spans(data, start, size):
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    value = place_values(data[place + np.repeat(start, size)], place)
    real = np.flatnonzero(size)
    out = np.zeros(len(size), np.uint64)
    out[real] = np.add.reduceat(value, (ends - size)[real])
    return out


def long_span(data, start, end):
    total = np.uint64(0)
    for at in range(start, end, STRETCH):
        part = data[at : min(at + STRETCH, end)]
        total += place_values(part, np.arange(at - start, at - start + len(part))).sum()
    return total


def shingles(words, owner, k):
    """Hashes of all runs of k words inside one text, their text number and first word.

    The hash of k words is the mixed sum of the word hashes, each times its own odd factor.
    """
    n = len(words) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    h = np.zeros(n, np.uint64)
    factor = int(BASE)
    for j in range(k):
        h += words[j : j + n] * np.uint64(factor | 1)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(h[at]), owner[at], at
