import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mailgrid.llm import sentencepiece_codec, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", "  ", "\n", "\t", "a", "the", "'re", "'s", "'", "re", "0", "12", "é", "ß", "日本", "😀",
    "<|endoftext|>", "<|endo", "\x1c", "\u3000", "\x85", "!", "...", "\r\n", "İ", "ing", " th",
    "\x00", "▁", "<s>", "<0x0A>", "aaaa", "tion",
]


def texts(n, longest, seed):
    random.seed(seed)
    return ["".join(random.choices(PARTS, k=random.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(JSON)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(counter, library):
    for text in texts(800, 30, 1) + ["x" * 500, "ab" * 3000]:
        assert counter.count(text) == library(text)


def test_every_prefix_equals_the_library(counter, library):
    for text in texts(300, 8, 2):
        for size, tokens in counter.prefixes(text):
            assert tokens == library(text[:size])


def test_longest_prefix_within_a_budget(counter, library):
    for text in texts(150, 12, 3):
        for budget in (0, 1, 3, 6):
            best = max(n for n in range(len(text) + 1) if library(text[:n]) <= budget)
            assert counter.longest_within(text, budget) == best


def test_count_rows(frame, messy, library):
    got = token_counts.count_tokens(frame(messy), JSON, limit=100).collect()
    wanted = [
        (i, len((t or "").encode()), library(t or ""), library(t or "") > 100) for i, t, _ in messy
    ]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
    assert token_counts.count_tokens(frame([]), JSON).count() == 0


def test_truncated_texts(frame, messy, library):
    for row in token_counts.truncate_texts(frame(messy), JSON, 5).collect():
        assert row["n_tokens"] == library(row["text"]) <= 5


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_texts_equal_the_library(model):
    codec = sentencepiece_codec.Codec(MODEL)
    for text in texts(800, 20, 4) + ["abc" * 2000, "▁" * 300, "日本語" * 200]:
        ids = codec.encode(text).tolist()
        assert ids == model.encode(text, num_threads=1)
        assert codec.decode(ids) == model.decode(ids)


def test_stream_holds_a_bounded_window():
    codec = sentencepiece_codec.Codec(MODEL)
    stream = sentencepiece_codec.Stream(codec.lattice)
    pieces, widest = [], 0
    for part in ["internationalisation"] * 200:
        pieces += stream.push(part)
        widest = max(widest, len(stream.text))
    pieces += stream.finish()
    assert "".join(codec.lattice.names[p] for p in pieces) == "internationalisation" * 200
    assert widest < 10 * stream.step


def test_slices_equal_the_library(model):
    """Different words go through the stream once, in order; texts are gathered from them."""
    codec = sentencepiece_codec.Codec(MODEL)
    rows = texts(400, 30, 6) + ["", " ", "\n", "a\n\n b", "unseen \U0001f9ff\u0f3a signs", "x" * 999]
    ids, ends, same = codec.encode_slice(pa.array(rows).slice(3))
    for i, text in enumerate(rows[3:]):
        own = ids[ends[i] : ends[i + 1]].tolist()
        assert own == model.encode(text)
        assert same[i] == (model.decode(own) == text)


def test_pairs_stay_as_plain_merging_says():
    """The fast test of neighbours against merging their whole text."""
    lattice = sentencepiece_codec.Codec(MODEL).lattice

    def merged(text):
        parts = list(text)
        while True:
            ranks = [lattice.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return parts
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    random.seed(7)
    for _ in range(4000):
        a, b = random.choices(range(len(lattice.names)), k=2)
        left, right = lattice.names[a], lattice.names[b]
        assert lattice.apart(a, b) == (merged(left + right) == [left, right])


def test_encode_rows(frame, messy, model):
    docs = frame(messy)
    got = sentencepiece_codec.encode_texts(docs, MODEL)
    wanted = [(i, model.encode(t or ""), "▁" not in (t or "")) for i, t, _ in messy]
    rows = [(r["doc_id"], r["ids"], r["round_trip"]) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted))
    back = sentencepiece_codec.decode_ids(got, MODEL).collect()
    assert sorted(r["text"] for r in back) == sorted((t or "").replace("▁", " ") for _, t, _ in messy)
    assert sentencepiece_codec.encode_texts(frame([]), MODEL).count() == 0
