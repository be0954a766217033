"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table serves all languages: each slot holds a bit per language, so the AND of the slots an
n-gram hashes to returns every language that contains it. The bits are counted per language
over the whole text, the share that false positives alone would give is taken off (the filled
part of each language's slice is known), and the language with the largest share wins.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailgrid.llm.common import key_remainder, smallest_by_hash, text_pieces
from mailgrid.llm.grams import lower_latin

# Slots of the filter, a power of two, and the multipliers that pick them.
BITS = 20
HASHES = (0x9E3779B1, 0x85EBCA77)
UNKNOWN = "und"

FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def gram_codes(data, bounds):
    """Four-byte n-grams of each text in lower case, and the number of their text.

    Letters stay, everything else of ASCII is a space, a text has one space around it; n-grams
    with two spaces side by side are left out.
    """
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    low = FOLD[lower_latin(data)]
    padded = np.full(len(low) + 2 * len(sizes), 32, np.uint8)
    padded[np.arange(len(low)) + 2 * owner + 1] = low
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    if len(padded) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    wide = padded.astype(np.uint32)
    code = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16)
    code |= wide[3:] << np.uint32(24)
    space = padded == 32
    pair = space[:-1] & space[1:]
    good = (owner[:-3] == owner[3:]) & ~(pair[:-2] | pair[1:-1] | pair[2:])
    return code[good], owner[:-3][good]


def slots(code):
    return [(code * np.uint32(h)) >> np.uint32(32 - BITS) for h in HASHES]


class Filters:
    """``grams[language]`` are n-gram codes; languages are kept in alphabetical order."""

    def __init__(self, grams):
        self.languages = sorted(grams)
        planes = max(1, -(-len(self.languages) // 8))
        self.table = np.zeros((planes, 1 << BITS), np.uint8)
        filled = []
        for number, language in enumerate(self.languages):
            plane, bit = divmod(number, 8)
            for at in slots(np.asarray(grams[language], np.uint32)):
                self.table[plane, at] |= np.uint8(1 << bit)
            filled.append(np.mean(self.table[plane] >> bit & 1))
        # Chance that an n-gram the language lacks finds all its slots set.
        self.false = np.array(filled) ** len(HASHES)

    def judge(self, data, bounds):
        """(number of the winning language, its corrected share) of each text."""
        code, owner = gram_codes(data, bounds)
        first, second = slots(code)
        texts = len(bounds) - 1
        bits = np.arange(256)[:, None] >> np.arange(8) & 1
        hits, total = [], np.maximum(np.bincount(owner, minlength=texts), 1)
        for plane in self.table:
            mask = (plane[first] & plane[second]).astype(np.int64)
            seen = np.bincount(owner * 256 + mask, minlength=texts * 256).reshape(texts, 256)
            hits.append(seen @ bits)
        share = np.hstack(hits)[:, : len(self.languages)] / total[:, None]
        share = np.clip((share - self.false) / (1 - self.false), 0, 1)
        best = share.argmax(axis=1)
        return best, share[np.arange(texts), best]


def learn_filters(docs, learn, key="doc_id", text="text", lang="lang", per_language=800,
                  least=2e-5):
    """Filters of the languages in ``lang``.

    Fitted on at most ``per_language`` documents of each language, the first by a hash of the
    key among those that ``learn`` admits; NULL languages, keys and texts are left out. An
    n-gram belongs to a language if it makes up at least ``least`` of the sample's n-grams, so
    a language has at most 1 / ``least`` of them.
    """
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")
    )
    # At most per_language rows for each language.
    picked = smallest_by_hash(known.select("key", "lang"), "key", "lang", per_language)
    sample = known.join(F.broadcast(picked.distinct()), ["key", "lang"]).select(
        F.col("lang").cast("string"), "text"
    )

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for at, data, bounds in text_pieces(batch.column(1)):
                code, owner = gram_codes(data, bounds)
                spoken = langs[at : at + len(bounds) - 1][owner]
                for language in set(spoken):
                    grams, n = np.unique(code[spoken == language], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([language] * len(grams), pa.string()),
                         pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "gram", "n"],
                    )

    counts = sample.mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= least * F.col("total"))
    grams = {}
    for row in kept.select("lang", "gram").toLocalIterator():
        grams.setdefault(row[0], []).append(row[1])
    counts.unpersist()
    return Filters(grams)


def identify(docs, filters, key="doc_id", text="text"):
    """One row per document: key, lang_pred, score.

    ``score`` is the share of the text's n-grams that the language contains, corrected for
    false positives. A NULL text, an empty one and one without any letter are ``und`` with
    score 0, and so are all texts if no language was learned. Of equal shares the language
    that comes first in the alphabet wins. Repeated rows are judged each.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        own = model.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = [], []
            for _, data, bounds in text_pieces(batch.column(1)):
                if own.languages:
                    winner, share = own.judge(data, bounds)
                else:
                    winner, share = np.zeros(len(bounds) - 1, int), np.zeros(len(bounds) - 1)
                best.append(winner)
                score.append(share)
            if not best:
                continue
            best = np.where(letters, np.concatenate(best), len(own.languages))
            score = np.where(best < len(own.languages), np.concatenate(score), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                [key, "lang_pred", "score"],
            )

    body = F.col(text).cast("string")
    rows = docs.select(key, body.alias("_text"), F.coalesce(body.rlike("\\p{L}"), F.lit(False)).alias("_letters"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def learning_rows(key="doc_id"):
    """The rows that may be learned from; the others are held out."""
    return key_remainder(key, 5) != 0


def predict_languages(docs, key="doc_id", text="text", lang="lang"):
    """Learns from the documents themselves (rows not held out) and judges every one of them:
    key, held_out, lang_pred, score."""
    filters = learn_filters(docs, learning_rows(key), key, text, lang)
    judged = identify(docs, filters, key, text)
    return judged.select(
        key, (~learning_rows(key)).alias("held_out"), "lang_pred", "score"
    )


def keep_known_languages(docs, least=0.2, key="doc_id", text="text", lang="lang"):
    """The documents whose language is known, with all their columns.

    Rejected are texts that are NULL or have no letter, and texts of whose n-grams no language
    contains the share ``least``. The score is computed beside the row, so nothing is joined.
    """
    filters = learn_filters(docs, learning_rows(key), key, text, lang)
    model = docs.sparkSession.sparkContext.broadcast(filters)
    place = docs.columns.index(text)

    def run(batches):
        own = model.value
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            if own.languages:
                for at, data, bounds in text_pieces(batch.column(place).cast(pa.string())):
                    good[at : at + len(bounds) - 1] = own.judge(data, bounds)[1] >= least
            yield batch.filter(pa.array(good))

    return docs.filter(F.col(text).rlike("\\p{L}")).mapInArrow(run, docs.schema)
