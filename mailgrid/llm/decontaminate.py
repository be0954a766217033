"""Benchmark decontamination by greedy string tiling.

Runs of five words that a document shares with a benchmark item are the seeds; looking them up
is a join of each document with the index of a bounded block of items. A pair whose seeds could
cover enough of the item is tiled: running Karp-Rabin finds the matches of at least a search
length, the longest are marked as tiles wherever they do not overlap earlier ones, and the
search length falls until five words. The covered share of the item decides, so a passage whose
parts were put into another order is caught as well.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailgrid.llm.common import text_pieces
from mailgrid.llm.grams import (
    WORD_BYTE,
    lower_latin,
    mix,
    powers,
    shingles,
    span_hashes,
    word_spans,
)

# Words of the shortest tile, and the share of an item that must be tiled.
MIN_TILE = 5
COVERAGE = 0.5
# Bytes of the items of one block; a larger benchmark is checked block by block.
BLOCK_BYTES = 8 << 20


def text_words(data, bounds):
    """Word hashes (letters and digits, lower case) and the text of each word."""
    low = lower_latin(data)
    begin, end, owner = word_spans(low, bounds, WORD_BYTE)
    return span_hashes(low, begin, end), owner


class Index:
    """The seeds of a block of benchmark items, sorted for look-up."""

    def __init__(self, items):
        """``items``: (item id, word hashes). Items without words are left out; one with fewer
        words than a tile has itself as its only seed."""
        self.items = [(i, w) for i, w in items if len(w)]
        self.sizes = sorted({min(MIN_TILE, len(w)) for _, w in self.items})
        self.seeds = {}
        for k in self.sizes:
            own = [n for n, (_, w) in enumerate(self.items) if min(MIN_TILE, len(w)) == k]
            words = np.concatenate([self.items[n][1] for n in own])
            owner = np.repeat(own, [len(self.items[n][1]) for n in own])
            h, item, at = shingles(words, owner, k)
            place = at - np.searchsorted(owner, item)
            order = np.argsort(h, kind="stable")
            h, item, place = h[order], item[order], place[order]
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[k] = h, item, place, bits

    def hits(self, words, owner):
        """(text, item number, seed length, word of the text, word of the item) of all seeds
        that texts share with items."""
        out = []
        for k, (h, item, place, bits) in self.seeds.items():
            found, text, at = shingles(words, owner, k)
            maybe = np.flatnonzero(bits[(found >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(h, found[maybe], "left")
            n = np.searchsorted(h, found[maybe], "right") - lo
            hit = np.repeat(maybe, n)
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((text[hit], item[which], np.full(len(hit), k), at[hit], place[which]))
        if not out:
            return (np.zeros(0, np.int64),) * 5
        return tuple(np.concatenate(c) for c in zip(*out))


def window_hashes(words, size):
    """Rolling Karp-Rabin hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n])


def matches(text, item, size, free_text, free_item):
    """(length, place in text, place in item) of maximal matches of at least ``size`` words
    between words that are still free."""
    run = np.ones(size, int)
    open_text = np.convolve(free_text, run, "valid") == size if len(text) >= size else np.zeros(0, bool)
    open_item = np.convolve(free_item, run, "valid") == size if len(item) >= size else np.zeros(0, bool)
    where = {}
    own = window_hashes(item, size)
    for j in np.flatnonzero(open_item):
        where.setdefault(int(own[j]), []).append(int(j))
    hashes = window_hashes(text, size)
    spots = np.flatnonzero(open_text & np.isin(hashes, own)) if len(hashes) else []
    done, found = set(), []
    for i in map(int, spots):
        for j in where.get(int(hashes[i]), ()):
            if (i, j) in done or not np.array_equal(text[i : i + size], item[j : j + size]):
                continue
            length = size
            while (
                i + length < len(text) and j + length < len(item)
                and free_text[i + length] and free_item[j + length]
                and text[i + length] == item[j + length]
            ):
                # Later windows of the same match are part of it.
                done.add((i + length - size + 1, j + length - size + 1))
                length += 1
            found.append((length, i, j))
    return found


def tiles(text, item, least=MIN_TILE):
    """Greedy string tiling: (length, place in text, place in item) of every tile."""
    least = min(least, max(len(item), 1))
    free_text, free_item = np.ones(len(text), int), np.ones(len(item), int)
    out, size = [], max(least, min(20, len(item)))
    while True:
        found = matches(text, item, size, free_text, free_item)
        longest = max(found, default=(0,))[0]
        if longest > 2 * size:
            # Very long matches first, as the method asks.
            size = longest
            continue
        left = 0
        for length, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_text[i : i + length].all() and free_item[j : j + length].all():
                free_text[i : i + length] = free_item[j : j + length] = 0
                out.append((length, i, j))
            else:
                left += 1
        if left:
            # What an earlier tile cut may still hold matches of this size.
            continue
        if size == least:
            return out
        size = max(least, size // 2)


def regions(at, near):
    """Groups of sorted positions with gaps of at most ``near``: (first, last + 1)."""
    breaks = np.flatnonzero(np.diff(at) > near)
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks + 1, [len(at)]])


def judge(index, words, owner, threshold):
    """(text number, item number, coverage, tiles, longest tile) of the contaminated pairs.

    Seeds bound the coverage from above, so a pair is tiled only if they could reach the
    threshold. Words of the text outside its seeds cannot be part of a tile and are left out;
    a stop between the parts keeps tiles from running across.
    """
    text, item, size, at, place = index.hits(words, owner)
    if not len(text):
        return []
    order = np.lexsort((at, item, text))
    text, item, size, at, place = (c[order] for c in (text, item, size, at, place))
    edges = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
    out = []
    for lo, hi in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(text)]])):
        number = int(item[lo])
        item_words = index.items[number][1]
        k = int(size[lo])
        covered = np.zeros(len(item_words) + 1, int)
        np.add.at(covered, place[lo:hi], 1)
        np.add.at(covered, np.minimum(place[lo:hi] + k, len(item_words)), -1)
        need = threshold * len(item_words) - 1e-9
        if (np.cumsum(covered)[:-1] > 0).sum() < need:
            continue
        spots = np.unique(at[lo:hi])
        parts = []
        for a, b in zip(*regions(spots, k)):
            parts += [words[spots[a] : spots[b - 1] + k], np.array([len(parts)], np.uint64)]
        got = tiles(np.concatenate(parts), item_words, MIN_TILE)
        total = sum(t[0] for t in got)
        if total >= need:
            out.append((int(text[lo]), number, total / len(item_words), len(got), max(got)[0]))
    return out


def item_blocks(benchmark, key, text, block_bytes):
    """Blocks of (item id, word hashes), each of at most ``block_bytes`` or one item. Items
    come to the driver one partition at a time and only one block is held."""
    block, size = [], 0
    rows = benchmark.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")))
    for item, body in rows.toLocalIterator():
        raw = np.frombuffer(body.encode(), np.uint8)
        words, _ = text_words(raw, np.array([0, len(raw)]))
        if block and size + len(raw) > block_bytes:
            yield Index(block)
            block, size = [], 0
        block.append((item, words))
        size += len(raw)
    yield Index(block)


def contaminated_pairs(docs, benchmark, key="doc_id", text="text", item_key="item_id",
                       item_text="text", threshold=COVERAGE, block_bytes=BLOCK_BYTES):
    """One row per contaminated pair: key, item_id, coverage, n_tiles, longest_tile.

    Words are runs of letters, digits and bytes beyond ASCII, in lower case (ASCII and Latin-1). Tiles have
    at least five words (the whole item if it has fewer). A pair counts if the tiles cover the
    share ``threshold`` of the item's words. NULL and empty texts and items without words have
    no pairs; repeated rows have their pairs each. A benchmark of more than ``block_bytes`` is
    checked in blocks, so what is sent to the tasks is bounded.
    """
    kind = docs.schema[key].dataType.simpleString()
    item_kind = benchmark.schema[item_key].dataType
    arrow = pa_type(benchmark, item_key)
    rows = docs.select(key, F.col(text).cast("string").alias("_text"))
    out = None
    for index in item_blocks(benchmark, item_key, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                found = []
                for at, data, bounds in text_pieces(batch.column(1)):
                    words, owner = text_words(data, bounds)
                    found += [(at + t, *rest) for t, *rest in judge(own, words, owner, threshold)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([own.items[f[1]][0] for f in found], arrow),
                        pa.array([f[2] for f in found], pa.float64()),
                        pa.array([f[3] for f in found], pa.int64()),
                        pa.array([f[4] for f in found], pa.int64()),
                    ],
                    [key, "item_id", "coverage", "n_tiles", "longest_tile"],
                )

        pairs = rows.mapInArrow(
            run,
            f"`{key}` {kind}, item_id {item_kind.simpleString()}, coverage double,"
            " n_tiles long, longest_tile long",
        )
        out = pairs if out is None else out.unionByName(pairs)
    return out


def pa_type(df, column):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def drop_contaminated(docs, benchmark, text="text", item_key="item_id", item_text="text",
                      threshold=COVERAGE, block_bytes=BLOCK_BYTES):
    """The documents that no item contaminates, with all their columns; same rule as
    ``contaminated_pairs``. Each block filters what the one before left, without a join."""
    place = docs.columns.index(text)
    for index in item_blocks(benchmark, item_key, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for at, data, bounds in text_pieces(batch.column(place).cast(pa.string())):
                    words, owner = text_words(data, bounds)
                    clean[[at + f[0] for f in judge(own, words, owner, threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
