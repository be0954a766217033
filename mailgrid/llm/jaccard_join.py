"""N-gram Jaccard join by a size-aware heavy-light method.

Texts with equal shingle sets are one node, so copies are never paired. Small sets list their
subsets of the fixed sizes a partner must share; large sets scan inverted lists of the first
shingles in a global order, rare ones first, of which any partner must have one. The size at
which the one gives way to the other comes from the counted cost of both. Lists of few sets
give candidate pairs; long lists are compared inside tasks, block by block, so no pair of them
becomes a row. Parity bitmaps drop pairs that cannot link. What is left connects small clusters,
to which the whole sets are sent once; there every link is verified.
"""

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailgrid.llm.common import text_pieces
from mailgrid.llm.components import connected_components
from mailgrid.llm.grams import LOWER, NOT_SPACE, mix, shingles, span_hashes, word_spans
from mailgrid.operators.relational import hot_join
from mailgrid.session import checkpointed

# Slots of the shingle counts; they decide the order of shingles, never a result.
SLOTS = 1 << 22
PARTS = 64
# Sets on a list that are paired directly; a longer list goes to the block comparison.
LIGHT = 24
# Sets of one block of a long list or a cluster.
BLOCK = 1000
# Shingles that are scanned together.
WIDTH = 2048
# Bits of the smallest parity bitmap, which bounds how much two sets can share.
BITMAP = 512
# Cost of checking a candidate pair, in rows of a list.
CHECK = 4


def least_size(n, percent):
    """Smallest partner of a set of n shingles, which is also the least overlap with any."""
    return -(-percent * n // 100)


def least_overlap(a, b, percent):
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(data, bounds, k):
    """The sorted different shingle hashes of each text.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A text of fewer
    than k words has all of them as its one shingle.
    """
    low = LOWER[data]
    begin, end, owner = word_spans(low, bounds, NOT_SPACE)
    words = span_hashes(low, begin, end)
    h, of, _ = shingles(words, owner, k)
    texts = len(bounds) - 1
    cut = np.searchsorted(of, np.arange(texts + 1))
    first = np.searchsorted(owner, np.arange(texts + 1))
    for t in range(texts):
        own = h[cut[t] : cut[t + 1]]
        few = first[t + 1] - first[t]
        if not len(own) and few:
            ordered = words[first[t] : first[t + 1]] * np.arange(3, 2 * few + 3, 2).astype(np.uint64)
            own = mix(ordered.sum(keepdims=True) + np.uint64(few))
        yield np.unique(own)


def name_of(own):
    """16 bytes that stand for a set."""
    a = mix(own).sum() + np.uint64(len(own))
    b = mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    return np.array([a, b], np.uint64)


def bitmap_of(own):
    """Parity of the set's shingles in classes by their first bits, as bytes.

    The number of differing bits of two bitmaps is at most the number of shingles that only one
    of the sets has. A set has as many classes as shingles, at least, so that unlike sets
    differ in more bits than similar ones may.
    """
    bits = BITMAP
    while bits < len(own):
        bits *= 2
    place = (own >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8))


def folded(bitmap):
    """The bitmap of the same set with half as many classes."""
    pairs = np.unpackbits(bitmap).reshape(-1, 2)
    return np.packbits(pairs[:, 0] ^ pairs[:, 1])


class Bitmaps:
    """Bitmaps of several sets, at every size down to the smallest."""

    def __init__(self, maps, sizes, percent):
        self.sizes, self.percent = np.asarray(sizes, np.int64), percent
        self.own = np.array([len(m) for m in maps], np.int64)
        found = {}
        for i, bitmap in enumerate(maps):
            while True:
                found.setdefault(len(bitmap), []).append((i, bitmap))
                if len(bitmap) * 8 <= BITMAP:
                    break
                bitmap = folded(bitmap)
        self.levels = {}
        for size, rows in found.items():
            place = np.full(len(maps), -1)
            place[[i for i, _ in rows]] = np.arange(len(rows))
            self.levels[size] = place, np.stack([b for _, b in rows]).view(np.uint64)

    def near(self, i, rest):
        """Whether set i may link with each of the sets ``rest``."""
        a, b, p = self.sizes[i], self.sizes[rest], self.percent
        out = 100 * np.minimum(a, b) >= p * np.maximum(a, b)
        common = np.minimum(self.own[i], self.own[rest])
        for size in np.unique(common[out]):
            these = np.flatnonzero(out & (common == size))
            place, matrix = self.levels[size]
            differ = np.bitwise_count(matrix[place[rest[these]]] ^ matrix[place[i]])
            differ = differ.sum(1, dtype=np.int64)
            out[these] = differ * (100 + p) <= (a + b[these]) * (100 - p)
        return out


def names_column(names):
    """Arrow binary column of an (n, 2) array of names."""
    n = len(names)
    flat = np.ascontiguousarray(names, np.uint64)
    ends = np.arange(0, 16 * n + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())]
    )


def names_array(column):
    """(n, 2) array of an Arrow binary column of names."""
    n = len(column)
    if not n:
        return np.zeros((0, 2), np.uint64)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint64, 2 * n, start).reshape(n, 2)


# --- slot counts ---------------------------------------------------------------------------


def slot_rows(counts):
    """A task's slot counts (at most 255 each) as rows part, counts."""
    cut = np.minimum(counts, 255).astype(np.uint8).reshape(PARTS, -1)
    return pa.array(range(PARTS), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())


def summed_slots(rows):
    """Sum of the slot counts of all tasks, as one array of fixed size.

    The parts are summed where they meet, one batch at a time.
    """

    def add(batches):
        sums = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(counts.as_buffer(), np.uint8)
                if part not in sums:
                    sums[part] = np.zeros(len(own), np.uint32)
                sums[part] += own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()),
             pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            ["part", "counts"],
        )

    met = rows.repartition(PARTS, "part").mapInArrow(add, "part int, counts binary")
    total = np.zeros((PARTS, SLOTS // PARTS), np.uint32)
    for part, counts in met.toLocalIterator():
        total[part] = np.frombuffer(counts, np.uint32)
    return total.ravel()


def slot(h):
    return (h >> np.uint64(42)).astype(np.int64)


# --- passes over the texts -----------------------------------------------------------------


def describe(texts, kind, k):
    """Rows of two sorts: one per document (id, n, name, bits), and the slot
    counts of the task (part, counts)."""

    def run(batches):
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for at, data, bounds in text_pieces(batch.column(1)):
                sets = list(shingle_sets(data, bounds, k))
                np.add.at(counts, slot(np.concatenate(sets)), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        names_column(np.array([name_of(s) for s in sets])),
                        pa.array([bitmap_of(s).tobytes() for s in sets], pa.binary()),
                        pa.nulls(len(sets), pa.int32()),
                        pa.nulls(len(sets), pa.binary()),
                    ],
                    FIELDS,
                )
        if not counts.any():
            return
        part, slots = slot_rows(counts)
        nothing = [
            pa.nulls(PARTS, batch_type) for batch_type in
            (kind[1], pa.int64(), pa.binary(), pa.binary())
        ]
        yield pa.RecordBatch.from_arrays([*nothing, part, slots], FIELDS)

    return texts.mapInArrow(
        run, f"id {kind[0]}, n long, name binary, bits binary, part int, counts binary"
    )


FIELDS = ["id", "n", "name", "bits", "part", "counts"]


def subset_keys(own, small, percent):
    """(smaller size of the pair, hash) of every subset of a small set that one of its partners
    must share. The hash of a subset is the set's sum less the elements left out."""
    n = len(own)
    g = mix(own + np.uint64(0x9E37))
    total = g.sum()
    for m in range(least_size(n, percent), small + 1):
        a, b = min(n, m), max(n, m)
        if a < least_size(b, percent):
            break
        out = n - least_overlap(a, b, percent)
        left = [np.zeros(1, np.uint64)] if not out else [
            np.array([sum(c) & (2**64 - 1) for c in combinations(g.tolist(), out)], np.uint64)
        ]
        yield a, mix(mix(total - left[0]) + np.uint64(a * 1_000_003 + b))


def subset_count(n, small, percent):
    rows = 0
    for m in range(least_size(n, percent), small + 1):
        a, b = min(n, m), max(n, m)
        if a < least_size(b, percent):
            break
        rows += math.comb(n, n - least_overlap(a, b, percent))
    return rows


def choose_boundary(sizes, usual, percent):
    """Largest size whose subsets cost no more than scanning lists.

    ``sizes`` counts the sets of each size; ``usual`` is how many texts have a usual shingle. A
    set of n shingles has as many rows as subsets, or as many as its list entries, each of
    which brings candidates to check.
    """
    best = 0
    for n in range(1, 41):
        top = 100 * n // percent
        subsets = subset_count(n, top, percent)
        entries = n - least_size(n, percent) + 1
        if subsets > entries * (1 + CHECK * min(usual, LIGHT) / 2):
            break
        best = n
    return best if any(sizes.get(n) for n in range(1, best + 1)) else 0


def list_rows(texts, k, percent, small, levels):
    """Rows token, kind, n, name: entries of the inverted lists (kind 0), and subsets of small
    sets (kind is the smaller size of the pair). A task names each set once."""

    def run(batches):
        own_levels, met = levels.value, set()
        for batch in batches:
            for _, data, bounds in text_pieces(batch.column(1)):
                tokens, kinds, sizes, names = [], [], [], []

                def put(token, kind, n, name):
                    tokens.append(token)
                    kinds.append(np.full(len(token), kind, np.int32))
                    sizes.append(np.full(len(token), n, np.int32))
                    names.append(np.tile(name, (len(token), 1)))

                for own in shingle_sets(data, bounds, k):
                    n = len(own)
                    if not n:
                        continue
                    name = name_of(own)
                    if (seen := name.tobytes()) in met:
                        continue
                    met.add(seen)
                    if n <= small:
                        for a, token in subset_keys(own, small, percent):
                            put(token, a, n, name)
                    if n >= least_size(small + 1, percent):
                        order = np.argsort(own_levels[slot(own)], kind="stable")
                        head = own[order[: n - least_size(n, percent) + 1]]
                        put(head, 0, n, name)
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)),
                         pa.array(np.concatenate(kinds)), pa.array(np.concatenate(sizes)),
                         names_column(np.concatenate(names))],
                        ["token", "kind", "n", "name"],
                    )

    return texts.mapInArrow(run, "token long, kind int, n int, name binary")


def scan_lists(rows, percent, small):
    """Rows token, a, b: candidate pairs of short lists and of equal subsets (token NULL), and
    the entries of long lists (b NULL).

    The rows are grouped by token and sorted by size; a list is read as a stream, and only its
    first entries are held.
    """

    def run(batches):
        held = None
        for batch in batches:
            part = (
                batch.column(0).to_numpy(), batch.column(1).to_numpy(),
                batch.column(2).to_numpy(), names_array(batch.column(3)),
            )
            if held is not None:
                part = tuple(np.concatenate(p) for p in zip(held, part))
            token, kind = part[0], part[1]
            new = np.flatnonzero((token[1:] != token[:-1]) | (kind[1:] != kind[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            yield from lists(*(p[:last] for p in part), percent, small)
            held = distinct(*(p[last:] for p in part))
            if len(held[0]) > 50 * LIGHT:
                # A long list goes on in the next batch; a few entries keep it long.
                yield from lists(*held, percent, small)
                keep = LIGHT + 1 if held[1][0] == 0 else 1
                held = tuple(p[:keep] for p in held)
        if held is not None:
            yield from lists(*held, percent, small)

    ordered = rows.repartition("token").sortWithinPartitions("token", "kind", "n", "name")
    return ordered.mapInArrow(run, "token long, a binary, b binary")


def distinct(token, kind, n, name):
    """The sorted entries without those that several tasks have named."""
    same = (token[1:] == token[:-1]) & (kind[1:] == kind[:-1]) & (name[1:] == name[:-1]).all(1)
    new = np.concatenate([[True], ~same]) if len(token) else np.zeros(0, bool)
    return token[new], kind[new], n[new], name[new]


def lists(token, kind, n, name, percent, small):
    """The output of whole lists."""
    if not len(token):
        return
    token, kind, n, name = distinct(token, kind, n, name)
    edge = np.concatenate([[True], (token[1:] != token[:-1]) | (kind[1:] != kind[:-1]), [True]])
    start = np.flatnonzero(edge)
    size = np.diff(start)
    start = start[:-1]
    run_of = np.repeat(np.arange(len(start)), size)
    # Equal subsets: everything links to the first, if that has the smaller size of the pair.
    hub = start[run_of]
    sure = (kind > 0) & (n[hub] == kind) & (np.arange(len(n)) > hub)
    left, right = [hub[sure]], [np.flatnonzero(sure)]
    short = np.flatnonzero((kind == 0) & (size[run_of] <= LIGHT) & (size[run_of] > 1))
    for gap in range(1, LIGHT):
        at = short[short + gap < start[run_of[short]] + size[run_of[short]]]
        if not len(at):
            break
        near = 100 * n[at].astype(np.int64) >= percent * n[at + gap].astype(np.int64)
        near &= n[at + gap] > small
        left.append(at[near])
        right.append((at + gap)[near])
    left, right = np.concatenate(left), np.concatenate(right)
    if len(left):
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(left), pa.int64()), names_column(name[left]), names_column(name[right])],
            ["token", "a", "b"],
        )
    long = np.flatnonzero((kind == 0) & (size[run_of] > LIGHT))
    if len(long):
        yield pa.RecordBatch.from_arrays(
            [pa.array(token[long]), names_column(name[long]), pa.nulls(len(long), pa.binary())],
            ["token", "a", "b"],
        )


def close_pairs(pairs, bits, percent):
    """The pairs (a, b) whose sizes and bitmaps leave room for a link."""
    first = bits.select(F.col("name").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x"))
    second = bits.select(F.col("name").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y"))
    both = hot_join(hot_join(pairs, first, ["a"]), second, ["b"])

    def run(batches):
        other = np.array([1])
        for batch in batches:
            keep = []
            for x, y, n_a, n_b in zip(*(batch.column(c).to_pylist() for c in range(2, 6))):
                maps = [np.frombuffer(m, np.uint8) for m in (x, y)]
                if len(x) == len(y):
                    differ = np.bitwise_count(maps[0] ^ maps[1]).sum(dtype=np.int64)
                    keep.append(differ * (100 + percent) <= (n_a + n_b) * (100 - percent))
                else:
                    keep.append(Bitmaps(maps, (n_a, n_b), percent).near(0, other)[0])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y", "n_a", "n_b").mapInArrow(run, "a binary, b binary")


def forest(n, near):
    """Pairs of places below n that connect each component of a graph as a tree.
    ``near(i, rest)`` tells which of the places ``rest`` are next to i."""
    rest, out = np.arange(n), []
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            hit = near(i, rest)
            new = rest[hit].tolist()
            rest = rest[~hit]
            out += [(i, j) for j in new]
            stack += new
    return out


def edge_table(names, found):
    return pa.table(
        {"a": pa.array([names[i] for i, _ in found], pa.binary()),
         "b": pa.array([names[j] for _, j in found], pa.binary())}
    )


def cells_of(groups, key, node):
    """Rows key, node, i, j: blocks of bounded size of each group meet in pairs, so a group of
    any size is compared whole and no task holds more than two blocks."""
    sized = hot_join(groups, groups.groupBy(key).agg(F.count(F.lit(1)).alias("_size")), [key])
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return sized.select(key, node, own.alias("own"), other.alias("k")).select(
        key, node, F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j")
    )


def long_list_edges(members, bits, percent):
    """Edges (a, b) that connect the sets of each long list whose bitmaps are close."""
    rows = cells_of(members, "token", "name").join(bits, "name")

    def run(table):
        names, maps = table.column("name").to_pylist(), table.column("bits").to_pylist()
        maps = Bitmaps(
            [np.frombuffer(m, np.uint8) for m in maps], table.column("n").to_numpy(), percent
        )
        return edge_table(names, forest(len(names), maps.near))

    return (
        rows.select("token", "i", "j", "name", "n", "bits")
        .groupBy("token", "i", "j")
        .applyInArrow(run, "a binary, b binary")
    )


def whole_sets(texts, k, wanted):
    """(name, shingles as bytes) of the sets named in ``wanted``, perhaps of some others, and
    some more than once.

    A task passes on what a table of fixed size does not rule out.
    """

    def mark(batches):
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            np.add.at(counts, slot(names_array(batch.column(0))[:, 0]), 1)
        if counts.any():
            yield pa.RecordBatch.from_arrays(list(slot_rows(counts)), ["part", "counts"])

    marks = summed_slots(wanted.mapInArrow(mark, "part int, counts binary")) > 0
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches):
        bits, met = np.unpackbits(shared.value).astype(bool), set()
        for batch in batches:
            for _, data, bounds in text_pieces(batch.column(1)):
                names, sets = [], []
                for own in shingle_sets(data, bounds, k):
                    name = name_of(own)
                    if len(own) and bits[slot(name[:1])[0]] and (seen := name.tobytes()) not in met:
                        met.add(seen)
                        names.append(name)
                        sets.append(own.tobytes())
                if names:
                    yield pa.RecordBatch.from_arrays(
                        [names_column(np.array(names)), pa.array(sets, pa.binary())],
                        ["name", "shingles"],
                    )

    return texts.mapInArrow(run, "name binary, shingles binary")


# --- links ---------------------------------------------------------------------------------


def overlaps(sets):
    """Number of shingles that each pair of sets shares.

    Only shingles of two sets or more are scanned, a stretch of them at a time: the lists of a
    stretch are a 0/1 matrix, whose product with itself adds up what they have in common.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[number]
    column, row = place[number[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(shared.sum()), WIDTH):
        lo, hi = np.searchsorted(column, [first, first + WIDTH])
        part = np.zeros((len(sets), WIDTH), np.float32)
        part[row[lo:hi], column[lo:hi] - first] = 1
        total += part @ part.T
    return total.astype(np.int64)


def verified_links(texts, k, percent, candidates):
    """Links between whole sets: of each component as many as connect it.

    Candidate pairs and long lists make clusters, which hold every pair that may link. Each
    set is sent to its cluster once (a large cluster is compared in blocks), not to each pair.
    """
    clusters = checkpointed(connected_components(candidates))
    cells = checkpointed(cells_of(clusters, "root", "node").withColumnRenamed("node", "name"))
    sets = whole_sets(texts, k, cells.select("name"))

    def run(table):
        once = dict(zip(table.column("name").to_pylist(), table.column("shingles")))
        names = sorted(once)
        own = [np.frombuffer(once[n].as_buffer(), np.uint64) for n in names]
        n, shared = np.array([len(s) for s in own]), overlaps(own)

        def near(i, rest):
            both = shared[i, rest]
            return 100 * both >= percent * (n[i] + n[rest] - both)

        return edge_table(names, forest(len(own), near))

    full = hot_join(sets, cells, ["name"]).select("root", "i", "j", "name", "shingles")
    return full.groupBy("root", "i", "j").applyInArrow(run, "a binary, b binary")


def jaccard_components(docs, k=3, percent=90, key="doc_id", text="text"):
    """One row per document: key, n_shingles, component_id.

    Two documents link when 100 * shared shingles >= percent * all shingles of both; a
    component is what links connect, and its id is the smallest key in it. A NULL text and one
    without words has no shingles, links with nothing and is its own component. Copies share a
    set; repeated rows come out each. A component in which every key is NULL has a NULL id.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    own = docs.schema[key].dataType
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    described = checkpointed(describe(texts, (own.simpleString(), to_arrow_type(own)), k))
    counts = summed_slots(described.filter("part is not null").select("part", "counts"))
    described = described.filter("part is null")
    spark = docs.sparkSession
    # Counts fall into powers of two, so a shingle's place does not hang on single texts.
    levels = spark.sparkContext.broadcast(
        np.ceil(np.log2(np.maximum(counts, 1))).astype(np.uint8)
    )
    seen = np.sort(counts[counts > 0])
    usual = 1
    if len(seen):
        weight = np.cumsum(seen.astype(np.int64))
        # The mean count of a slot is chance; what is above it is a shingle's own.
        usual = 1 + max(0, int(seen[np.searchsorted(weight, weight[-1] / 2)]) - int(seen.mean()))
    sizes = dict(
        described.filter("n between 1 and 40").groupBy("n").count().select("n", "count").collect()
    )
    small = choose_boundary(sizes, usual, percent)
    found = checkpointed(
        scan_lists(list_rows(texts, k, percent, small, levels), percent, small)
    )
    bits = described.filter("n > 0").select("name", "n", "bits").dropDuplicates(["name"])
    pairs = found.filter("token is null").select("a", "b").distinct()
    pairs = close_pairs(pairs, bits, percent)
    members = found.filter("token is not null").select("token", F.col("a").alias("name"))
    edges = checkpointed(pairs.unionByName(long_list_edges(members, bits, percent)))
    links = verified_links(texts, k, percent, edges)
    roots = checkpointed(connected_components(links))
    named = hot_join(described, roots.withColumnRenamed("node", "name"), ["name"], "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("root", "name")).alias("root")
    )
    heads = named.filter("root is not null").groupBy("root").agg(F.min("id").alias("head"))
    return hot_join(named, heads, ["root"], "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("head")).alias("component_id"),
    )


def drop_near_duplicates(docs, k=5, percent=80, key="doc_id", text="text"):
    """The documents that stay, with all their columns: of each component the one with the
    smallest key. Documents without a key are never dropped, and rows that share a key stay or
    go together (exact repeats are for the exact dedup to drop)."""
    judged = checkpointed(jaccard_components(docs, k, percent, key, text))
    stay = judged.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("_stay"))
    gone = judged.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone"))
    gone = gone.join(stay, F.col("_gone") == F.col("_stay"), "left_anti").distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
