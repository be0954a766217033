"""Periodic runs of words by a sparse online dynamic programme over diagonals.

A diagonal is a lag at which words equal the words that many places before them. While it lasts
its match length grows; when it ends with at least one whole period (and enough words) the run
it stands for is emitted. The programme is sparse in two ways. A run of period q needs q matching
words in a row, so of every stretch of words only a checkpoint has to look up its earlier
occurrences, by the words that follow it, and a lag that is too rare to meet a checkpoint cannot
give a run. And an occurrence inside a run already emitted, a multiple of its period away, is
only that run's shadow and opens nothing. So a text of n words opens at most about n log n
diagonals, whatever repeats in it: all active lags of a batch of texts advance together, and one
that meets the next occurrence on its lag goes on from there instead of being opened twice.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from mailgrid.llm.common import reachable
from mailgrid.llm.grams import mix

# Bytes of text whose diagonals advance together; a longer text is taken alone.
TOGETHER = 1 << 22
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NONE = np.zeros(0, np.int64)


def text_slices(column, limit=TOGETHER):
    """(first row, Arrow strings) of whole texts of about ``limit`` bytes."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at, done = 0, 0
    while at < len(column):
        end = max(int(np.searchsorted(ends, done + limit, "right")), at + 1)
        yield at, column.slice(at, end - at)
        at, done = end, ends[end - 1]


def split_words(texts):
    """(words of all texts, bounds): text i has words[bounds[i]:bounds[i + 1]]."""
    parts = pc.ascii_split_whitespace(texts)
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    offsets = parts.offsets.to_numpy()
    return words.filter(real), before[offsets - offsets[0]].astype(np.int64)


def advance(words, at, lag, stop, step):
    """Moves each place on its diagonal while words match, forward (step 1) or back (step -1),
    but not past ``stop``; returns where it ends. All places move together."""
    at = at.copy()
    active = np.flatnonzero(at != stop)
    width = 4
    while len(active):
        width = max(4, min(2 * width, (1 << 20) // len(active)))
        here = at[active]
        places = here[:, None] + step * np.arange(width) - (step < 0)
        partner = places - lag[active][:, None]
        end = len(words) - 1
        same = words[np.clip(places, 0, end)] == words[np.clip(partner, 0, end)]
        same &= (partner >= 0) & (places <= end)
        moved = np.where(same.all(1), width, same.argmin(1))
        room = (stop[active] - here) * step
        at[active] = here + step * np.minimum(moved, room)
        active = active[(moved == width) & (room > width)]
    return at


def short_lags(words, least):
    """Runs of the lags below half the least length, which all words are compared at."""
    found = []
    for lag in range(1, (least + 1) // 2):
        same = np.zeros(len(words) - lag + 2, np.int8)
        np.equal(words[lag:], words[:-lag], out=same[1:-1], casting="unsafe")
        edges = np.diff(same)
        first, end = np.flatnonzero(edges == 1) + lag, np.flatnonzero(edges == -1) + lag
        enough = end - first + lag >= least
        start, end = first[enough] - lag, end[enough]
        own = start * len(words) + end
        for p, known in found:
            if lag % p == 0 and len(known):
                shadow = np.isin(own, known)
                start, end, own = start[~shadow], end[~shadow], own[~shadow]
        found.append((lag, own))
    start = np.concatenate([k // len(words) for _, k in found] + [NONE])
    end = np.concatenate([k % len(words) for _, k in found] + [NONE])
    return start, end, np.concatenate([np.full(len(k), p) for p, k in found] + [NONE])


def occurrences(value, at, checkpoint, low, high):
    """(place, earlier place) of equal values, ``low`` to ``high`` - 1 apart, for the places
    that are checkpoints; and the places whose value occurs more than once."""
    order = np.argsort(value, kind="stable")
    value, at = value[order], at[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    again = ~(new & np.concatenate([new[1:], [True]]))
    at, group = at[again], np.cumsum(new)[again]
    if not len(at):
        return NONE, NONE, NONE
    span = int(at.max()) + 1
    keyed = group * span + at
    asks = np.flatnonzero(checkpoint(at))
    base, here = group[asks] * span, at[asks]
    first = np.searchsorted(keyed, base + np.maximum(here - high + 1, 0))
    last = np.searchsorted(keyed, base + here - low, "right")
    many = np.maximum(last - first, 0)
    place = np.repeat(here, many)
    inside = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
    return place, at[np.repeat(first, many) + inside], np.sort(at)


def drop_shadows(place, lag, width, runs):
    """Removes occurrences inside one known run whose period divides the lag."""
    order = np.argsort(place, kind="stable")
    place, lag = place[order], lag[order]
    keep = np.ones(len(place), bool)
    for start, end, period in zip(*runs):
        low, high = np.searchsorted(place, [start, end - width + 1])
        inside = (lag[low:high] % period == 0) & (place[low:high] - lag[low:high] >= start)
        keep[low:high] &= ~inside
    return place[keep], lag[keep]


def long_lags(words, owner, longest, least, runs):
    """Adds the runs of all longer lags, one doubling of the lag after the other."""
    low = (least + 1) // 2
    width = low // 2
    word = mix(words.astype(np.uint64) | owner.astype(np.uint64) << np.uint64(32))
    n = max(len(words) - width + 1, 0)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = mix(value * FACTOR + word[k : k + n])
    at = np.arange(n)
    while 2 * low <= longest and len(at):
        # Any ``low`` matching words in a row hold a checkpoint and the words it is known by.
        apart = low - width + 1
        place, earlier, at = occurrences(
            value[at], at, lambda p: p % apart == 0, low, 2 * low
        )
        lag = place - earlier
        wide = runs[1] - runs[0] >= low + width
        place, lag = drop_shadows(place, lag, width, [r[wide] for r in runs])
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        if len(place):
            last = np.concatenate([lag[1:] != lag[:-1], [True]])
            stop = np.where(last, len(words), np.concatenate([place[1:], [0]]))
            end = advance(words, place, lag, stop, 1)
            # A diagonal that reaches the next occurrence on its lag goes on there.
            goes_on = (end == stop) & ~last
            opens = np.flatnonzero(~np.concatenate([[False], goes_on[:-1]]))
            end, lag = end[~goes_on], lag[opens]
            first = advance(words, place[opens], lag, lag, -1)
            enough = end - first >= lag
            found = first[enough] - lag[enough], end[enough], lag[enough]
            runs = [np.concatenate([a, b]) for a, b in zip(runs, found)]
        if len(at):
            repeated = np.zeros(n + width, bool)
            repeated[at] = True
            at = at[repeated[at + width]]
            value[at] = mix(value[at] * FACTOR + value[at + width])
        low, width = 2 * low, 2 * width
    return runs


def runs_of(codes, bounds, least=12):
    """(text, start, length, period) of all runs of the texts, by text, start and period.

    ``codes`` are numbers for words, equal for equal words. A place between two texts gets a
    number of its own there, so no diagonal crosses it.
    """
    sizes = np.diff(bounds)
    texts = len(sizes)
    owner = np.repeat(np.arange(texts), sizes + 1)
    begin = bounds[:-1] + np.arange(texts)
    gaps = begin + sizes
    words = np.empty(len(owner), np.int64)
    inside = np.ones(len(owner), bool)
    inside[gaps] = False
    words[inside] = codes
    words[gaps] = len(codes) + np.arange(texts)
    if not len(codes):
        return NONE, NONE, NONE, NONE
    runs = long_lags(words, owner, int(sizes.max()), least, short_lags(words, least))
    start, end, period = runs
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    text = owner[start]
    return text, start - begin[text], end - start, period


def collapse(words, bounds, runs):
    """The texts without the repetitions: of each run the first period stays."""
    text, start, length, period = runs
    change = np.zeros(len(words) + 1, np.int64)
    first = bounds[text] + start
    np.add.at(change, first + period, 1)
    np.add.at(change, first + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[bounds]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept)))
    return pc.binary_join(lists, " ")


def find_runs(docs, key="doc_id", text="text", least=12):
    """One row per document: key, runs (array of start, length, period) by start and period,
    collapsed (the words that are left, joined by one space).

    A run is a maximal stretch of words with smallest period q and a length of at least
    ``least`` (4 or more) and 2 q words. Words are runs of anything but the six ASCII white
    space characters. NULL and empty texts have no words, no runs and an empty collapsed text.
    Repeated rows and keys are worked out each; other columns are not read. Memory is about
    15 times the longest text; results are exact, hashes only propose occurrences.
    """
    reachable(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1).fill_null("")):
                words, bounds = split_words(texts)
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                runs = runs_of(codes, bounds, least)
                ends = np.searchsorted(runs[0], np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()),
                            pa.StructArray.from_arrays(
                                [pa.array(r, pa.int64()) for r in runs[1:]],
                                ["start", "length", "period"],
                            ),
                        ),
                        collapse(words, bounds, runs),
                    ],
                    [key, "runs", "collapsed"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string"))
    spans = "array<struct<start: long, length: long, period: long>>"
    return rows.mapInArrow(run, f"`{key}` {kind}, runs {spans}, collapsed string")


def echoed_text(key, text):
    """The text of the planted repetitions, as its words joined by one space: where the crc32 h
    of the key ends in the digit 0, the words from place g % n on, g = h div 10, repeat with
    period 1 + (n - g % n) div (3 + g % 8). Other texts, also those without a key or words,
    are returned as they are."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def repeat(row):
        n = F.size(row["words"]).cast("long")
        first = row["g"] % n
        period = 1 + F.floor((n - first) / (3 + row["g"] % 8))
        place = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        echo = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(row["words"], place(i).cast("int")),
        )
        return F.when(n > 0, F.array_join(echo, " ")).otherwise(F.col(text))

    bound = F.transform(
        F.array(F.struct(words.alias("words"), F.floor(crc / 10).cast("long").alias("g"))), repeat
    )
    return F.when(crc % 10 == 0, F.get(bound, 0)).otherwise(F.col(text))


def run_digests(docs, key="doc_id", text="text"):
    """One row per document: key, n_runs, start, length, period, exponent_milli of its longest
    run (ties: smallest start, then period; NULL without runs), runs_sha256, collapsed_sha256;
    all of the texts with planted repetitions, see ``echoed_text``."""
    found = find_runs(docs.select(key, echoed_text(key, text).alias("text")), key)
    longest = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r["length"].alias("length"), (-r["start"]).alias("start"),
                (-r["period"]).alias("period"),
            ),
        )
    )
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("_top", longest).select(
        F.col(key),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.start")).alias("start"),
        F.col("_top.length").alias("length"),
        (-F.col("_top.period")).alias("period"),
        F.floor(1000 * F.col("_top.length") / -F.col("_top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
