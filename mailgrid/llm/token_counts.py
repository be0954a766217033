"""Exact token counts of whole texts and of each of their prefixes.

A byte-level pair-merging tokenizer is read from its public file. Dynamic programming over the
prefixes of a word stores the exact count at every prefix (``lattice.py``); words repeat and share prefixes,
so each worker keeps the counts of the prefixes it has met. A text's table is the running sum of
its words' tables. Truncation and budget questions are then look-ups: nothing is encoded again.
"""

import json
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F

from mailgrid.llm.lattice import LONG, Lattice

# The white space of the tokenizer's pattern, and the pattern itself.
SPACE = "\\x20\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
def byte_letters():
    """The printable letter the file format uses for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """A dictionary that computes what is missing. When it is full it becomes the older half,
    from which entries still in use come back, and a new half begins."""

    def __init__(self, compute, most=150_000):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixCounter:
    """Counts for one tokenizer file of the ``tokenizers`` library, byte-level BPE."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level tokenizers without normalizer")
        model = spec["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.lattice = Lattice(model["vocab"], lambda a, b: ranks.get((a, b)))
        self.letters = byte_letters()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile(
            "(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")"
        ) if special else None
        self.marks = special
        # A space before a word always opens a new piece, so texts fall apart there.
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.words = regex.compile(PATTERN).findall
        self.spaces = re.compile(f"[{SPACE}]").match
        self.totals = Remembered(lambda c: sum(map(self.word, self.words(c))))

    def coded(self, word):
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def word(self, word):
        """Tokens of one word of the pattern."""
        coded = self.coded(word)
        if len(coded) <= LONG:
            return self.lattice.word(coded) >> 8
        return self.lattice.prefix_counts(coded)[-1]

    def word_table(self, word):
        """Tokens of every character prefix of one word of the pattern."""
        counts, at = self.lattice.prefix_counts(self.coded(word)), [0]
        for char in word:
            at.append(at[-1] + len(char.encode("utf-8", "surrogatepass")))
        return [counts[i] for i in at]

    def segments(self, text):
        """(part, is special) of the text, in order."""
        if not self.special or not any(m in text for m in self.marks):
            return [(text, False)]
        return [(p, i % 2 == 1) for i, p in enumerate(self.special.split(text)) if p]

    def count(self, text):
        """Tokens of the whole text."""
        total = 0
        for part, special in self.segments(text):
            total += 1 if special else sum(map(self.totals.__getitem__, self.chunks(part)))
        return total

    def ending(self, text, start, end):
        """Tokens of text[start:end], a piece of the pattern that the cut may have changed."""
        return sum(map(self.word, self.words(text[start:end])))

    def prefixes(self, text):
        """(characters, tokens) of every prefix, in order, the empty one first.

        A prefix that ends in white space ends in one run of it; a cut contraction falls into
        its parts; otherwise the stored tables of the words hold.
        """
        yield 0, 0
        base = at = 0
        # Where splitting must start again if the text goes on, and the tokens before it.
        run = again = None
        for part, special in self.segments(text):
            if special:
                # A cut mark is ordinary text and may join what stands before it.
                start, tokens = run or again or (at, base)
                for end in range(1, len(part)):
                    yield at + end, tokens + self.ending(text, start, at + end)
                base, at, run, again = base + 1, at + len(part), None, None
                yield at, base
                continue
            for word in self.words(part):
                table = self.word_table(word)
                for end in range(1, len(word) + 1):
                    if self.spaces(word[end - 1]):
                        run = (at + end - 1, base) if run is None else run
                        yield at + end, run[1] + self.ending(text, run[0], at + end)
                    else:
                        run = None
                        cut = word[0] == "'" and end < len(word)
                        yield at + end, base + (self.ending(word, 0, end) if cut else table[end])
                again = at, base
                base, at = base + table[-1], at + len(word)

    def longest_within(self, text, budget):
        """Characters of the longest prefix of at most ``budget`` tokens."""
        best = 0
        for size, tokens in self.prefixes(text):
            if tokens <= budget:
                best = size
            elif tokens > budget + 8:
                break
        return best


@lru_cache(maxsize=2)
def counter(path):
    return PrefixCounter(path)


SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs, path, key="doc_id", text="text", limit=1024):
    """One row per document: key, n_bytes (UTF-8), n_tokens, over_limit.

    NULL counts as the empty text: no bytes, no tokens. Repeated rows are counted each; other
    columns are not read. ``path`` must name the file on every executor, as an installed
    package does.
    """

    def run(batches):
        count = counter(path).count
        for batch in batches:
            texts, tokens = batch.column(1).fill_null(""), []
            for at in range(0, len(texts), 500):
                tokens += map(count, texts.slice(at, 500).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(key, F.col(text).cast("string"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def truncate_texts(docs, path, budget, key="doc_id", text="text"):
    """One row per document: key, text cut to its longest prefix within the budget, n_tokens of
    what is left. NULL gives an empty text."""

    def run(batches):
        own = counter(path)
        for batch in batches:
            cut = [t[: own.longest_within(t, budget)] for t in
                   (t or "" for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cut, pa.string()),
                 pa.array([own.count(t) for t in cut], pa.int64())],
                [key, "text", "n_tokens"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {kind}, text string, n_tokens long")
