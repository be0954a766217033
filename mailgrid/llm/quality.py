"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines around it. The
field is fitted by gradient ascent on a bounded sample in which all lines of a document carry
the document's label. Forward-backward gives each line's marginal of good; a document's quality
is their mean, weighted by the length of the line.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailgrid.llm.common import key_remainder, labelled_sample, text_pieces
from mailgrid.llm.grams import LOWER, NOT_SPACE, span_hashes, word_spans

# Byte classes that are counted in each line.
CLASSES = [
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)), b"0123456789", b" \t",
    b"|", b"!?", b"#$%&*@^~", b".,;:'\"()-", b"<>{}[]\\/_=+",
]
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _n, _c in enumerate(CLASSES):
    CLASS_OF[list(_c)] = _n
OWN = len(CLASSES) + 10
FEATURES = 3 * OWN + 3


def line_features(data, bounds):
    """(features, length, text number) of the lines of each text; every text has one at least.

    Features: shares of the byte classes, size, words and their length, share of words that
    equal the one before, that occurred in the line just before (two back), of different
    words, marks at both ends, and whether the line occurred before in the text; then the same
    of the line before and after, and whether there are such lines.
    """
    n, texts = len(data), len(bounds) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([bounds[:-1], breaks + 1])
    owner = np.concatenate(
        [np.arange(texts), np.searchsorted(bounds, breaks, "right") - 1]
    ).astype(np.int64)
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    lines = len(starts)
    last = np.concatenate([owner[1:] != owner[:-1], [True]])
    ends = np.where(last, bounds[1:][owner], np.concatenate([starts[1:] - 1, [0]]))
    size = np.maximum(ends - starts, 0)
    # The line of every byte; line feeds belong to the line they end.
    line = np.repeat(np.arange(lines), size + ~last)
    width = len(CLASSES) + 1
    counts = np.bincount(line * width + CLASS_OF[data], minlength=lines * width)
    f = np.zeros((lines, OWN), np.float32)
    some = np.maximum(size, 1)
    f[:, : len(CLASSES)] = counts.reshape(lines, width)[:, :-1] / some[:, None]
    at = len(CLASSES)
    f[:, at] = np.log1p(size) / 8
    begin, end, text = word_spans(data, bounds, NOT_SPACE)
    if len(begin):
        of = line[begin]
        low = LOWER[data]
        words = span_hashes(low, begin, end)
        number = np.bincount(of, minlength=lines)
        many = np.maximum(number, 1)
        f[:, at + 1] = np.log1p(number) / 6
        f[:, at + 2] = np.bincount(of, end - begin, lines) / many / 10
        for back in (1, 2):
            same = np.zeros(len(of))
            same[back:] = (words[back:] == words[:-back]) & (of[back:] == of[:-back])
            f[:, at + 2 + back] = np.bincount(of, same, lines) / many
        ordered = np.lexsort((words, of))
        new = np.ones(len(of))
        new[1:] = (words[ordered][1:] != words[ordered][:-1]) | (of[ordered][1:] != of[ordered][:-1])
        f[:, at + 5] = np.bincount(of[ordered], new, lines) / many
        capital = (data[begin] >= 65) & (data[begin] <= 90)
        f[:, at + 6] = np.bincount(of, capital, lines) / many
        f[:, at + 7] = np.bincount(of, data[end - 1] == 46, lines) / many
    full = size > 0
    f[full, at + 8] = np.isin(data[ends[full] - 1], np.frombuffer(b".!?\"", np.uint8))
    # Whether the text had this line before.
    whole = span_hashes(data, starts, np.maximum(ends, starts)) if n else np.zeros(lines, np.uint64)
    ordered = np.lexsort((np.arange(lines), whole, owner))
    again = np.zeros(lines, bool)
    again[ordered[1:]] = (whole[ordered][1:] == whole[ordered][:-1]) & (
        owner[ordered][1:] == owner[ordered][:-1]
    )
    f[:, at + 9] = again
    out = np.zeros((lines, FEATURES), np.float32)
    out[:, :OWN] = f
    first = np.concatenate([[True], last[:-1]])
    out[1:, OWN : 2 * OWN] = f[:-1] * ~first[1:, None]
    out[:-1, 2 * OWN : 3 * OWN] = f[1:] * ~last[:-1, None]
    out[:, -3], out[:, -2], out[:, -1] = first, last, 1
    return out, np.maximum(size, 1), owner


class Chain:
    """Two labels, 0 bad and 1 good. ``unary`` scores good against bad, ``pair`` scores the
    step from one label to the next."""

    def __init__(self, unary, pair):
        self.unary, self.pair = unary, pair

    def marginals(self, features, owner):
        """(marginal of good of each line, expected steps summed over all pairs of lines).

        ``owner`` is sorted. All texts take a step together; a text leaves when it ends.
        """
        score = np.clip(features @ self.unary, -30, 30).astype(np.float64)
        emit = np.stack([np.ones_like(score), np.exp(score)], 1)
        emit /= emit.sum(1, keepdims=True)
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.concatenate([begin, [len(owner)]]))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        step = np.exp(self.pair)
        ahead, behind = np.zeros_like(emit), np.ones_like(emit)
        ahead[begin] = emit[begin]
        longest = int(size[0]) if len(size) else 0
        alive = [int(np.searchsorted(-size, -t, "left")) for t in range(longest + 1)]
        for t in range(1, longest):
            at = begin[: alive[t]] + t
            value = (ahead[at - 1] @ step) * emit[at]
            ahead[at] = value / value.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            at = begin[: alive[t + 1]] + t
            value = (emit[at + 1] * behind[at + 1]) @ step.T
            behind[at] = value / value.sum(1, keepdims=True)
        both = ahead * behind
        good = both[:, 1] / both.sum(1)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        joint = ahead[inner][:, :, None] * step * (emit * behind)[inner + 1][:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        return good, joint.sum(0)


def fit(features, owner, label, rounds=300, rate=0.1, ridge=1e-4):
    """A chain fitted by Adam on the log-likelihood of the labels of all lines.

    Each text counts the same whatever its number of lines. With one label only the chain
    answers with that label.
    """
    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)))
    if not len(owner):
        return chain
    if label.min() == label.max():
        chain.unary[-1] = 4.0 if label[0] else -4.0
        return chain
    truth = label[owner].astype(np.float64)
    lines = np.bincount(owner)
    weight = (1.0 / lines)[owner]
    inner = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[1:][inner].astype(int), truth[1:][inner].astype(int)), weight[1:][inner])
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    texts = len(lines)
    total = max(seen.sum(), 1e-9)
    for n in range(1, rounds + 1):
        chain.unary, chain.pair = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        good, joint = chain.marginals(features, owner)
        slope = features.T @ ((truth - good) * weight) / texts
        steps = (seen - joint * total / max(joint.sum(), 1e-9)).ravel() / texts
        gradient = np.concatenate([slope, steps]) - ridge * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
    return Chain(theta[:FEATURES].copy(), theta[FEATURES:].reshape(2, 2).copy())


def learn_chain(docs, labels, learn, key="doc_id", text="text", label="quality", most=1500):
    """A chain fitted on at most ``most`` bad and 2 * ``most`` good documents, the first by a
    hash of the key among those that ``learn`` admits."""
    sample = labelled_sample(docs, labels, label, key, text, learn, (most, 2 * most))

    def run(batches):
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for at, data, bounds in text_pieces(batch.column(0)):
                features, _, owner = line_features(data, bounds)
                parts = np.split(features, np.flatnonzero(np.diff(owner)) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.tobytes() for p in parts], pa.binary()),
                     pa.array(marks[at : at + len(bounds) - 1].astype(np.int32))],
                    ["lines", "label"],
                )

    # Bounded by the size of the sample; only features come to the driver.
    rows = sample.select("text", "label").mapInArrow(run, "lines binary, label int").toArrow()
    lines = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows["lines"].to_pylist()]
    if not lines:
        return Chain(np.zeros(FEATURES), np.zeros((2, 2)))
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return fit(np.concatenate(lines), owner, rows["label"].to_numpy())


def score_quality(docs, chain, key="doc_id", text="text", threshold=0.3):
    """One row per document: key, score, predicted, n_lines, bad_lines.

    A NULL text is an empty one, which has one empty line. An empty line weighs as one byte.
    Repeated rows are scored each; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            score, lines, bad = [], [], []
            for _, data, bounds in text_pieces(batch.column(1)):
                features, size, owner = line_features(data, bounds)
                good, _ = chain.marginals(features, owner)
                weight = np.bincount(owner, size)
                score.append(np.bincount(owner, good * size) / weight)
                lines.append(np.bincount(owner))
                bad.append(np.bincount(owner, good < 0.5))
            if not score:
                continue
            score = np.clip(np.concatenate(score), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                 pa.array(np.concatenate(lines).astype(np.int64)),
                 pa.array(np.concatenate(bad).astype(np.int64))],
                [key, "score", "predicted", "n_lines", "bad_lines"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(
        run, f"`{key}` {kind}, score double, predicted int, n_lines long, bad_lines long"
    )


def predict_quality(docs, labels, key="doc_id", text="text"):
    """Learns from labelled documents that are not held out and scores every document: key,
    held_out, score, predicted, n_lines, bad_lines."""
    learn = key_remainder(key, 5) != 0
    chain = learn_chain(docs, labels, learn, key, text)
    scored = score_quality(docs, chain, key, text)
    return scored.select(
        key, (~learn).alias("held_out"), "score", "predicted", "n_lines", "bad_lines"
    )
