"""Toxicity from a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters with what is known of it as a word and of its character n-grams: tables of
log-odds that are counted on the learning sample (for the network's own training on the folds
a text is not in). The network runs over all overlapping windows of a text, each half a window
further on, so every word is seen with what stands before and after it. Attention weighs the
states of a window; a text is as toxic as its worst window. Training is by Adam on that worst
window, with gradients by hand.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailgrid.llm.common import key_remainder, labelled_sample, text_pieces
from mailgrid.llm.grams import WORD_BYTE, lower_latin, mix, span_hashes, word_spans

WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION, INPUTS = 8, 8, 7
WORD_BITS, CHAR_BITS = 17, 16
FOLDS = 4
# Windows that are run together.
BLOCK = 4096


def buckets(data, bounds):
    """Word buckets, character n-gram buckets, and the word and text each belongs to."""
    low = lower_latin(data)
    begin, end, text = word_spans(low, bounds, WORD_BYTE)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    words = (span_hashes(low, begin, end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    size = end - begin
    place = np.repeat(np.arange(len(begin)), size)
    inside = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
    at = begin[place] + inside
    # Four bytes from the one before; beyond the word there are spaces.
    code = np.zeros(len(at), np.uint64)
    for shift in range(-1, 3):
        there = inside + shift
        within = (there >= 0) & (there < size[place])
        byte = np.where(within, low[np.where(within, at + shift, 0)], 32)
        code = code << np.uint64(8) | byte.astype(np.uint64)
    chars = (mix(code) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
    return words, chars, place, text, size


class Tables:
    """Log-odds of word and character buckets, from the texts of each label that have them."""

    def __init__(self, word, char, texts):
        self.word, self.char = self.odds(word, texts), self.odds(char, texts)
        self.known = np.log1p(word.sum(0)).astype(np.float32) / 6

    @staticmethod
    def odds(counts, texts):
        rate = np.log(counts + 0.5) - np.log(texts + 1.0)[:, None]
        # Buckets that were never met say nothing.
        return np.where(counts.sum(0) > 0, rate[1] - rate[0], 0).astype(np.float32)

    def inputs(self, words, chars, place, size):
        """The input vector of every word."""
        x = np.zeros((len(words), INPUTS), np.float32)
        if len(words):
            own = self.char[chars]
            first = np.cumsum(size) - size
            x[:, 0] = self.word[words] / 3
            x[:, 1] = self.known[words]
            x[:, 2] = np.add.reduceat(own, first) / size / 3
            x[:, 3] = np.maximum.reduceat(own, first) / 3
            x[:, 4] = np.minimum.reduceat(own, first) / 3
            x[:, 5] = np.minimum(size, 30) / 10
            x[:, 6] = 1
        return x


def windows(text, texts):
    """(first word, number of words, text) of every window; a text has one at least."""
    n = np.bincount(text, minlength=texts)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(texts), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(n) - n)[owner] + number * STRIDE
    return start, np.clip(n[owner] - number * STRIDE, 0, WINDOW), owner


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_network(seed=7):
    rng = np.random.default_rng(seed)

    def matrix(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    net = {}
    for way in "fb":
        net["W" + way] = matrix(INPUTS, 3 * HIDDEN)
        net["U" + way] = matrix(HIDDEN, 3 * HIDDEN)
    net["A"], net["v"] = matrix(2 * HIDDEN, ATTENTION), matrix(ATTENTION)
    net["w"], net["b"] = matrix(2 * HIDDEN), np.full(1, -1, np.float32)
    return net


def scan(net, way, x, mask, keep=False):
    """States (time, window, hidden) of one direction, and what the gradient needs."""
    steps, n, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    u = net["U" + way]
    out, kept = np.zeros((steps, n, HIDDEN), np.float32), [None] * steps
    gates = (x.reshape(-1, INPUTS) @ net["W" + way]).reshape(steps, n, -1)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        rec = h @ u
        zr = sigmoid(gates[t, :, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(gates[t, :, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
        new = (c + z * (h - c)) * mask[t]
        if keep:
            kept[t] = h, z, r, c, rec[:, 2 * HIDDEN :]
        h = out[t] = new
    return out, kept


def forward(net, x, size, keep=False):
    """Logit of every window; x is (time, window, input), padded after ``size`` words."""
    mask = (np.arange(len(x))[:, None] < size)[:, :, None].astype(np.float32)
    ahead, kept_f = scan(net, "f", x, mask, keep)
    back, kept_b = scan(net, "b", x, mask, keep)
    h = np.concatenate([ahead, back], 2)
    s = np.tanh(h @ net["A"])
    e = np.where(mask[:, :, 0] > 0, s @ net["v"], -1e9)
    a = np.exp(e - e.max(0)) * mask[:, :, 0]
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", a, h)
    logit = pooled @ net["w"] + net["b"]
    return logit, (mask, h, s, a, pooled, kept_f, kept_b)


def gradients(net, x, size, slope_of):
    """Logits and the gradients of sum(slope * logit), slope = slope_of(logit)."""
    logit, (mask, h, s, a, pooled, *kept) = forward(net, x, size, True)
    d = slope_of(logit)
    g = {"w": pooled.T @ d, "b": np.array([d.sum()])}
    dp = d[:, None] * net["w"]
    da = np.einsum("nh,tnh->tn", dp, h)
    de = a * (da - (a * da).sum(0))
    g["v"] = np.einsum("tn,tna->a", de, s)
    ds = de[:, :, None] * net["v"] * (1 - s * s)
    g["A"] = np.einsum("tnh,tna->ha", h, ds)
    dh_all = a[:, :, None] * dp + ds @ net["A"].T
    for way, states, half in zip("fb", kept, (slice(0, HIDDEN), slice(HIDDEN, None))):
        u = net["U" + way]
        du, dw = np.zeros_like(u), np.zeros_like(net["W" + way])
        carry = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1) if way == "f" else range(len(x)):
            prev, z, r, c, rec = states[t]
            dh = (carry + dh_all[t][:, half]) * mask[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (prev - c) * z * (1 - z)
            dr = dc * rec * r * (1 - r)
            into = np.concatenate([dz, dr, dc], 1)
            back = np.concatenate([dz, dr, dc * r], 1)
            dw += x[t].T @ into
            du += prev.T @ back
            carry = dh * z + back @ u.T
        g["U" + way], g["W" + way] = du, dw
    return logit, g


def gather(x, start, size):
    """Inputs of windows as (time, window, input); zeros after the last word."""
    steps = np.arange(WINDOW)[:, None]
    at = np.minimum(start + steps, max(len(x) - 1, 0))
    if not len(x):
        return np.zeros((WINDOW, len(start), INPUTS), np.float32)
    return x[at] * (steps < size)[:, :, None]


def logits(net, x, start, size):
    out = [
        forward(net, gather(x, start[i : i + BLOCK], size[i : i + BLOCK]), size[i : i + BLOCK])[0]
        for i in range(0, len(start), BLOCK)
    ]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


class Model:
    def __init__(self, tables, net):
        self.tables, self.net = tables, net

    def score(self, data, bounds):
        """(score of each text, number of its windows)."""
        words, chars, place, text, size = buckets(data, bounds)
        x = self.tables.inputs(words, chars, place, size)
        texts = len(bounds) - 1
        start, length, owner = windows(text, texts)
        value = logits(self.net, x, start, length)
        first = np.searchsorted(owner, np.arange(texts))
        worst = np.maximum.reduceat(value, first) if texts else value
        return sigmoid(worst.astype(np.float64)), np.bincount(owner, minlength=texts)


# Steps after which the loss of the texts held back is looked at, at least.
LOOK = 50


def loss_of(net, inputs, label):
    """Mean log loss of texts, each judged by its worst window."""
    x = np.concatenate(inputs)
    text = np.repeat(np.arange(len(inputs)), [len(i) for i in inputs])
    start, size, owner = windows(text, len(inputs))
    value = logits(net, x, start, size)
    worst = np.maximum.reduceat(value, np.searchsorted(owner, np.arange(len(inputs))))
    right = sigmoid(np.where(label == 1, worst, -worst).astype(np.float64))
    return -np.log(np.maximum(right, 1e-12)).mean()


def fit(texts, label, steps=600, batch=64, rate=0.01, epochs=12, patience=4):
    """A model of the texts (list of str) and their labels (0 or 1).

    Every tenth text is held back; training ends when the loss on those has not fallen for
    ``patience`` looks, and at the latest after ``steps`` steps or ``epochs`` epochs, whichever
    is more. The weights of the lowest loss count. Without texts of both labels every score is
    the share of label 1, or 0.
    """
    label = np.asarray(label, np.int64)
    net = new_network()
    column = pa.array(texts, pa.large_string())
    fold = np.arange(len(texts)) % FOLDS
    word = np.zeros((FOLDS, 2, 1 << WORD_BITS), np.float32)
    char = np.zeros((FOLDS, 2, 1 << CHAR_BITS), np.float32)
    for at, data, bounds in text_pieces(column):
        words, chars, place, text, _ = buckets(data, bounds)
        for table, value, of in ((word, words, text), (char, chars, text[place])):
            one = np.unique(of * table.shape[2] + value)
            doc = one // table.shape[2] + at
            np.add.at(table, (fold[doc], label[doc], one % table.shape[2]), 1)
    texts_of = np.zeros((FOLDS, 2))
    np.add.at(texts_of, (fold, label), 1)
    tables = Tables(word.sum(0), char.sum(0), texts_of.sum(0))
    if len(label) == 0 or label.min() == label.max():
        for name in net:
            net[name][:] = 0
        net["b"][:] = 30 if len(label) and label[0] else -30
        return Model(tables, net)
    # Inputs of each text from the folds it is not in.
    other = [
        Tables(word.sum(0) - word[f], char.sum(0) - char[f], texts_of.sum(0) - texts_of[f])
        for f in range(FOLDS)
    ]
    inputs = [None] * len(texts)
    for at, data, bounds in text_pieces(column):
        words, chars, place, text, size = buckets(data, bounds)
        for f in range(FOLDS):
            x = other[f].inputs(words, chars, place, size)
            for i in range(len(bounds) - 1):
                if fold[at + i] == f:
                    lo, hi = np.searchsorted(text, [i, i + 1])
                    inputs[at + i] = x[lo:hi].copy()
    rng = np.random.default_rng(11)
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(w) for k, w in net.items()}
    held = np.arange(len(texts)) % 10 == 9
    both = all(len(set(label[part])) == 2 for part in (held, ~held))
    train = np.flatnonzero(~held) if both else np.arange(len(texts))
    per_epoch = max(1, len(train) // batch)
    look = -(-LOOK // per_epoch) * per_epoch
    n, waited, best = 0, 0, (np.inf, net)
    while n < max(steps, epochs * per_epoch) and waited < patience:
        for pick in np.array_split(rng.permutation(train), per_epoch):
            x = np.concatenate([inputs[i] for i in pick])
            text = np.repeat(np.arange(len(pick)), [len(inputs[i]) for i in pick])
            start, size, owner = windows(text, len(pick))
            value = logits(net, x, start, size)
            order = np.lexsort((-value, owner))
            worst = order[np.searchsorted(owner, np.arange(len(pick)))]
            truth = label[pick].astype(np.float32)

            def slope(logit):
                return ((sigmoid(logit) - truth) / len(truth)).astype(np.float32)

            _, g = gradients(net, gather(x, start[worst], size[worst]), size[worst], slope)
            n += 1
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net[k] = (
                    net[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-7)
                    - 1e-4 * rate * net[k]
                ).astype(np.float32)
        if both and n % look == 0:
            loss = loss_of(net, [inputs[i] for i in np.flatnonzero(held)], label[held])
            waited = waited + 1 if loss >= best[0] else 0
            best = min(best, (loss, dict(net)), key=lambda b: b[0])
    return Model(tables, best[1] if both and best[0] < np.inf else net)


def learn_model(docs, labels, learn, key="doc_id", text="text", label="toxic", most=1500):
    """A model fitted on at most ``most`` toxic and 2 * ``most`` other documents, the first by
    a hash of the key among those that ``learn`` admits."""
    sample = labelled_sample(docs, labels, label, key, text, learn, (2 * most, most))
    rows = sorted((r["key"], r["text"] or "", r["label"]) for r in sample.collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score_toxicity(docs, model, key="doc_id", text="text", threshold=0.7):
    """One row per document: key, score, predicted, n_windows.

    A NULL text is an empty one, which is scored as one window without words. Repeated rows
    are scored each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            got = [own.score(data, bounds) for _, data, bounds in text_pieces(batch.column(1))]
            if not got:
                continue
            score = np.concatenate([s for s, _ in got])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                 pa.array(np.concatenate([n for _, n in got]).astype(np.int64))],
                [key, "score", "predicted", "n_windows"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, score double, predicted int, n_windows long")


def predict_toxicity(docs, labels, key="doc_id", text="text"):
    """Learns from labelled documents that are not held out and scores every document: key,
    held_out, score, predicted, n_windows."""
    held = key_remainder(key, 3) == 1
    model = learn_model(docs, labels, ~held, key, text)
    scored = score_toxicity(docs, model, key, text)
    return scored.select(key, held.alias("held_out"), "score", "predicted", "n_windows")
