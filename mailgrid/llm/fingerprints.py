"""MinHash fingerprints of documents, and a banded join of near copies.

A text is the set of its five-word shingles. A fingerprint keeps, for each of 128 multiply-shift
hash functions, which are universal, the smallest value over the set; numpy works it out for many
texts at once. The share of equal places of two fingerprints estimates the Jaccard similarity of
the sets. For search, signatures are cut into bands, Spark joins the bands, and the Jaccard
similarity of every pair that shares one is verified on the whole sets.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from mailgrid.llm.common import reachable
from mailgrid.llm.grams import mix
from mailgrid.llm.periodic_runs import split_words, text_slices
from mailgrid.operators.relational import hot_join
from mailgrid.session import checkpointed

SHINGLE = 5
PERMUTATIONS = 128
# Two sets of similarity 0.8 share none of 32 bands of 4 places once in 10**7 times.
BAND = 4
# Bytes of text signed together, so that the values stay in the cache, and shingles at once.
SIGNED = 1 << 18
SHINGLES = 1 << 16
EMPTY = np.uint32(0xFFFFFFFF)


def factors(n, seed):
    """Fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def shingle_hashes(texts, k=SHINGLE):
    """(hashes, bounds): the 64-bit hashes of the shingles of text i are
    hashes[bounds[i]:bounds[i + 1]].

    Words are runs of anything but ASCII white space, A-Z in lower case; fewer than k words are
    one shingle, no word none. Each different word is hashed once.
    """
    words, bounds = split_words(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    known = [hashlib.blake2b(w.as_buffer(), digest_size=8).digest() for w in coded.dictionary]
    word = np.frombuffer(b"".join(known), np.uint64)
    word = word[coded.indices.to_numpy(zero_copy_only=False)]
    sizes = np.diff(bounds)
    many = np.where(sizes, np.maximum(sizes - k + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(sizes)), many)
    first = bounds[owner] + np.arange(len(owner)) - ends[owner]
    hashes = np.zeros(len(owner), np.uint64)
    for j, factor in enumerate(factors(k, 1)):
        inside = first + j < bounds[owner + 1]
        hashes[inside] += word[first[inside] + j] * factor
    return mix(hashes), ends


def signatures(texts, permutations=PERMUTATIONS):
    """One row of uint32 per text: the minimum of each hash function over its shingles."""
    hashes, bounds = shingle_hashes(texts)
    signed = np.full((permutations, len(texts)), EMPTY)
    times, plus = factors(permutations, 2), factors(permutations, 3)
    for at in range(0, len(hashes), SHINGLES):
        part = hashes[at : at + SHINGLES] >> np.uint64(32)
        own = np.flatnonzero((bounds[:-1] < at + len(part)) & (bounds[1:] > at))
        own = own[bounds[own + 1] > bounds[own]]
        first = np.maximum(bounds[own] - at, 0)
        value, low = np.empty_like(part), np.empty(len(part), np.uint32)
        for i in range(permutations):
            np.multiply(part, times[i], out=value)
            value += plus[i]
            np.right_shift(value, np.uint64(32), out=low, casting="unsafe")
            least = np.minimum.reduceat(low, first)
            signed[i, own] = np.minimum(signed[i, own], least)
    return np.ascontiguousarray(signed.T)


def as_hex(signed):
    """Signatures as strings of eight hex digits a place."""
    size = 8 * signed.shape[1]
    data = signed.astype(">u4").tobytes().hex().encode()
    ends = np.arange(len(signed) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(
        pa.string(), len(signed), [None, pa.py_buffer(ends), pa.py_buffer(data)]
    )


def fingerprints(docs, key="doc_id", text="text", permutations=PERMUTATIONS):
    """One row per document: key, fingerprint (eight hex digits for each hash function).

    NULL counts as the empty text; texts without a word have the fingerprint of the empty set.
    Equal texts have equal fingerprints; repeated rows are worked out each.
    """
    reachable(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1).fill_null(""), SIGNED):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)),
                     as_hex(signatures(texts, permutations))],
                    [key, "fingerprint"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def likeness(a, b):
    """Share of equal places of two fingerprints of equal length."""
    size = F.length(a).cast("int") / 8
    places = F.sequence(F.lit(0), size.cast("int") - 1)
    same = lambda i: (F.substr(a, 8 * i + 1, F.lit(8)) == F.substr(b, 8 * i + 1, F.lit(8)))
    return F.aggregate(places, F.lit(0), lambda n, i: n + same(i).cast("int")) / size


# --- documents next to each other -----------------------------------------------------------


def in_stretches(rows, key, stretches):
    """Cuts rows into stretches of neighbouring keys; the first row of each stretch comes again
    at the end of the one before it, marked ``_tail``, so every row meets its successor.

    Keys descend, NULL keys come last, equal keys ascend by text; after the last row comes the
    first. The driver holds ``stretches`` quantiles of the numeric key and as many first keys.
    """
    valued = rows.withColumn("_value", F.coalesce(F.col(key).cast("double"), F.lit(float("nan"))))
    known = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("double").alias("_value"))
    shares = [i / stretches for i in range(1, stretches)]
    cuts = known.approxQuantile("_value", shares, 1 / (2 * stretches)) if shares else []
    splits = [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    cutter = Bucketizer(
        splits=splits, inputCol="_value", outputCol="_stretch", handleInvalid="keep"
    )
    cut = cutter.transform(valued).withColumn("_stretch", F.col("_stretch").cast("int"))
    heads = dict(cut.groupBy("_stretch").agg(F.max(key)).collect())
    nameless = len(splits) - 1
    order = sorted(heads, key=lambda s: (s == nameless, -s))
    kind = rows.schema[key].dataType.simpleString()
    before = [(s, heads[s], order[i - 1]) for i, s in enumerate(order)]
    # One row for each stretch.
    table = rows.sparkSession.createDataFrame(before, f"_own int, _head {kind}, _before int")
    own = F.struct(F.col("_stretch").alias("_in"), F.lit(False).alias("_tail"))
    again = F.struct(F.col("_before").alias("_in"), F.lit(True).alias("_tail"))
    first = F.col(key).eqNullSafe(F.col("_head"))
    return (
        cut.join(F.broadcast(table), F.col("_stretch") == F.col("_own"))
        .withColumn("_copy", F.explode(F.when(first, F.array(own, again)).otherwise(F.array(own))))
        .select(*rows.columns, "_copy._in", "_copy._tail")
        .repartition("_in")
        .sortWithinPartitions("_in", "_tail", F.col(key).desc_nulls_last(), "_text")
    )


def edited(text, following):
    """The text, the second half of its characters replaced by the first of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs, key="doc_id", text="text", stretches=None):
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last half of its characters replaced by the first of the next
    document, in the order of ``in_stretches``; a lone document is its own next. ``near_edited``
    and ``near_next`` are the share of places the fingerprint has in common with the edited
    text's and the next document's. NULL counts as the empty text; two texts without words are
    alike. Whole texts are shuffled once; keys must be numbers.
    """
    spark = docs.sparkSession
    reachable(spark)
    stretches = stretches or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    )

    def run(batches):
        last = None
        for batch in batches:
            for at, part in text_slices(batch.column(1), SIGNED):
                ids = batch.column(0).slice(at, len(part))
                texts = part.to_pylist()
                where = batch.column(2).slice(at, len(part)).to_numpy()
                tail = batch.column(3).slice(at, len(part)).to_numpy(zero_copy_only=False)
                signed = signatures(part)
                if last is not None:
                    ids = pa.concat_arrays([last[0], ids])
                    texts = last[1] + texts
                    where, tail = np.append(last[2], where), np.append(last[3], tail)
                    signed = np.concatenate([last[4], signed])
                last = ids[-1:], texts[-1:], where[-1:], tail[-1:], signed[-1:]
                rows = np.flatnonzero((where[1:] == where[:-1]) & ~tail[:-1])
                if len(rows):
                    yield compared(ids, texts, signed, rows)

    def compared(ids, texts, signed, rows):
        changed = pa.array([edited(texts[i], texts[i + 1]) for i in rows], pa.string())
        marks = np.concatenate([signatures(t) for _, t in text_slices(changed, SIGNED)])
        own = signed[rows]
        digests = [hashlib.sha256(t.as_buffer()).hexdigest() for t in changed]
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(rows)),
                pa.array([len(texts[i]) for i in rows], pa.int64()),
                pa.array(digests, pa.string()),
                as_hex(own),
                as_hex(marks),
                pa.array((own == marks).mean(1)),
                pa.array((own == signed[rows + 1]).mean(1)),
            ],
            [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"],
        )

    kind = docs.schema[key].dataType.simpleString()
    return in_stretches(rows, "_id", stretches).mapInArrow(
        run,
        f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


# --- near copies ----------------------------------------------------------------------------


def text_sets(docs, key, text):
    """key, set (sorted different shingle hashes), digest of the set, bands of its signature."""

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1).fill_null(""), SIGNED):
                hashes, bounds = shingle_hashes(texts)
                sets = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
                bands = signatures(texts).reshape(len(texts), -1, BAND)
                value = np.zeros(bands.shape[:2], np.uint64)
                for j, factor in enumerate(factors(BAND, 4)):
                    value += bands[:, :, j].astype(np.uint64) * factor
                value = mix(value + np.arange(bands.shape[1], dtype=np.uint64)).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64)
                digests = [hashlib.sha256(s.tobytes()).hexdigest() for s in sets]
                wide = np.arange(len(texts) + 1, dtype=np.int32) * value.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                        pa.array(digests),
                        pa.ListArray.from_arrays(pa.array(wide), pa.array(value.ravel())),
                    ],
                    ["_id", "_set", "_digest", "_bands"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(
        run, f"_id {kind}, _set array<long>, _digest string, _bands array<long>"
    )


def near_copies(docs, asked, key="doc_id", text="text", percent=80):
    """Two frames: (key, class) of every document, and (asked_class, class, jaccard) of the
    classes that link with a class of an asked document.

    A class holds the documents with equal shingle sets and is named by its smallest key.
    ``asked`` is a condition on the key that selects the queries; all rows are searched. Pairs
    link when they share a band and their sets have a Jaccard similarity of at least ``percent``
    per cent, which is verified. Copies are never paired, and a frequent band can be split.
    Documents without a key or a word link with nothing.
    """
    reachable(docs.sparkSession)
    rows = checkpointed(text_sets(docs.filter(F.col(key).isNotNull()), key, text))
    heads = rows.groupBy("_digest").agg(
        F.min("_id").alias("_class"), F.max(asked(F.col("_id")).cast("int")).alias("_asked")
    )
    classes = hot_join(rows.select("_id", "_digest"), heads.select("_digest", "_class"), ["_digest"])
    sets = checkpointed(
        hot_join(rows, heads, ["_digest"]).filter("_id = _class").dropDuplicates(["_class"])
        .filter(F.size("_set") > 0).select("_class", "_asked", "_set", "_bands")
    )
    banded = sets.select("_class", "_asked", F.explode("_bands").alias("_band"))
    wanted = banded.filter("_asked = 1").select(F.col("_class").alias("_query"), "_band")
    found = hot_join(banded, wanted, ["_band"]).filter("_class <> _query")
    pairs = found.select("_query", "_class").distinct()
    own = sets.select("_class", F.col("_set").alias("_b"))
    other = sets.select(F.col("_class").alias("_query"), F.col("_set").alias("_a"))
    both = hot_join(hot_join(pairs, own, ["_class"]), other, ["_query"])
    shared = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - shared
    links = (
        both.select("_query", "_class", shared.alias("_shared"), union.alias("_union"))
        .filter(F.col("_shared") * 100 >= F.col("_union") * percent)
        .select(
            F.col("_query").alias("asked_class"), F.col("_class").alias("class"),
            (F.col("_shared") / F.col("_union")).alias("jaccard"),
        )
    )
    return classes.select(F.col("_id").alias(key), F.col("_class").alias("class")), links
