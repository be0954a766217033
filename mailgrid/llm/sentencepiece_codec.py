"""Encoding with a public sentencepiece BPE model by a streaming Viterbi, and decoding.

The lattice of ``piece_lattice.py`` runs over characters: a path may pass from one piece to the
next only if merging leaves both, which makes the one surviving path to each position the
library's own segmentation. A piece that is still to come starts at most ``reach`` characters back, so
only the paths into that window survive. Whenever all of them run through one boundary, the
ids before it are final: they are committed and their part of the lattice is dropped. No piece
of the model has its word mark inside, so all paths meet at the start of every word: there the
stream is always flushed. What it gives between two such places depends on the word alone, so
the different words of a slice of texts go through the stream once each, in order, so that words
that begin alike share the paths to there; numpy gathers the ids of the texts from theirs.
Nothing is kept between slices but which pieces get along.
"""

import codecs
from array import array
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import functions as F

from mailgrid.llm.common import reachable
from mailgrid.llm.periodic_runs import text_slices
from mailgrid.llm.piece_lattice import Pieces, Stream

MARK = "▁"
# Bytes of text whose different words are encoded together; a longer text is taken alone.
TOGETHER = 1 << 23

codecs.register_error("mailgrid_each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def spread(values, sizes, which):
    """(the values of the chosen runs, one after the other, and their sizes); run i has the
    next ``sizes[i]`` values."""
    begin, many = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(many)
    place = np.arange(ends[-1] if len(ends) else 0)
    return values[place + np.repeat(begin[which] - ends + many, many)], many


def sums(values, sizes):
    """Sums of the next ``sizes[i]`` values."""
    before = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return before[ends] - before[ends - sizes]


class Codec:
    def __init__(self, path):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(names[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self.ids = {
            n: i for i, n in enumerate(names) if i not in special and not model.is_byte(i)
        }
        ranks = {n: -model.get_score(i) for n, i in self.ids.items()}
        self.lattice = Pieces(ranks)
        if any(MARK in n.lstrip(MARK) for n in names):
            raise ValueError("a piece has the word mark inside; words are no certain boundaries")
        # A line break that no piece has ends a word, too.
        self.by_line = not any("\n" in n for n in self.ids)
        text_of = {i: n.replace(MARK, " ").encode() for n, i in self.ids.items()}
        text_of |= {i: bytes([b]) for b, i in self.bytes.items()}
        text_of |= {i: b" \xe2\x81\x87 " if model.is_unknown(i) else b"" for i in special}
        self.texts = [text_of[i] for i in range(size)]
        self.raw_bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.raw_sizes = np.array([len(t) for t in self.texts], np.int64)
        # Ids of the numbered pieces, one after the other, and how many each has.
        self.flat, self.sizes = [], []

    def encode_words(self, words):
        """(numbers, sizes): the numbers of the pieces of sorted stretches between two certain
        boundaries, and how many each has."""
        stream, before = Stream(self.lattice), ""
        numbers, sizes = array("q"), array("q")
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            if not stream.rewind(shared):
                stream, shared = Stream(self.lattice), 0
            found = stream.push(word[shared:])
            found += stream.finish()
            numbers.extend(found)
            sizes.append(len(found))
            before = word
        return np.frombuffer(numbers, np.int64), np.frombuffer(sizes, np.int64)

    def piece_ids(self):
        """(ids, sizes): the ids of every numbered piece; what the model lacks is its bytes."""
        names = self.lattice.names
        for name in names[len(self.sizes) :]:
            own = self.ids.get(name)
            own = [own] if own is not None else [self.bytes[b] for b in name.encode()]
            self.flat.extend(own)
            self.sizes.append(len(own))
        return np.array(self.flat, np.int32), np.array(self.sizes, np.int64)

    def cut(self, texts):
        """(words, first word of each text) of Arrow strings, where each space stands for a
        mark; a text that is not empty starts with one more."""
        marked = pc.if_else(
            pc.equal(pc.binary_length(texts), 0), texts,
            pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" ")),
        )
        if marked.offset:
            marked = pa.concat_arrays([marked, pa.array([], marked.type)])
        _, offsets, data = marked.buffers()
        bounds = np.frombuffer(offsets, np.int32)[: len(marked) + 1]
        text = np.frombuffer(data, np.uint8)[: bounds[-1]] if data else np.zeros(0, np.uint8)
        begin = np.zeros(len(text) + 1, bool)
        space = text == 32
        begin[:-1] = space
        begin[1:-1] &= ~space[:-1]
        if self.by_line:
            line = text == 10
            begin[:-1] |= line
            begin[1:] |= line
        begin[bounds] = True
        starts = np.flatnonzero(begin).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data)
        return words, np.searchsorted(starts, bounds)

    def encode_slice(self, texts):
        """(ids, ends, same) of Arrow strings without NULL: text i has ids[ends[i]:ends[i + 1]],
        and ``same[i]`` says whether decoding them gives the text back."""
        words, first = self.cut(pc.replace_substring(texts, MARK, " "))
        coded = words.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        which = rank[coded.indices.to_numpy(zero_copy_only=False)]
        known = pc.replace_substring(coded.dictionary.take(order), " ", MARK).to_pylist()
        numbers, pieces = self.encode_words(known)
        ids, wide = spread(*self.piece_ids(), numbers)
        sizes = sums(wide, pieces)
        # Decoded bytes of the different words, beside what they were.
        raw, long = spread(self.raw_bytes, self.raw_sizes, ids)
        own = pc.binary_length(coded.dictionary.take(order)).to_numpy(zero_copy_only=False)
        whole = sums(long, sizes) == own
        text = np.frombuffer("".join(known).replace(MARK, " ").encode(), np.uint8)
        if whole.all():
            whole = sums(raw != text, own) == 0
        else:
            inside = np.repeat(whole, own)
            equal = np.zeros(len(text), bool)
            equal[inside] = raw[np.repeat(whole, sums(long, sizes))] == text[inside]
            whole = sums(equal, own) == own
        broken = np.concatenate([[0], np.cumsum(~whole[which])])[first]
        marks = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        same = (np.diff(broken) == 0) & ~marks.astype(bool)
        gathered, many = spread(ids, sizes, which)
        ends = np.concatenate([[0], np.cumsum(many)])
        return gathered, ends[first], same

    def encode(self, text):
        """The ids of a text as an int32 array."""
        return self.encode_slice(pa.array([text], pa.string()))[0]

    def decode(self, ids):
        """The text of ids; broken byte sequences become replacement characters."""
        texts = self.texts
        text = b"".join([texts[i] for i in ids]).decode("utf-8", "mailgrid_each_byte")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path):
    return Codec(path)


def encode_texts(docs, path, key="doc_id", text="text"):
    """One row per document: key, ids (array of int), n_ids, round_trip (decoding the ids gives
    the text back).

    NULL counts as the empty text, which has no ids. A text that holds the word mark itself
    comes back with a space there, so its round_trip is false. Repeated rows are encoded each;
    other columns are not read. Memory is bounded by ``TOGETHER`` or the longest text. ``path``
    must name the model on every executor.
    """
    reachable(docs.sparkSession)

    def run(batches):
        own = codec(path)
        for batch in batches:
            for at, texts in text_slices(batch.column(1).fill_null(""), TOGETHER):
                ids, ends, same = own.encode_slice(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                        pa.array(np.diff(ends)),
                        pa.array(same),
                    ],
                    [key, "ids", "n_ids", "round_trip"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_ids long, round_trip boolean")


def decode_ids(encoded, path, key="doc_id", ids="ids"):
    """One row per row: key, text of the ids; NULL ids give an empty text."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
