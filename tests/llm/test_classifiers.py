import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailgrid.llm import common, quality, toxicity
from mailgrid.llm.common import text_pieces

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa", "zeta", "été"]


def labelled(spark, frame, mark, n=240, seed=3):
    random.seed(seed)
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(random.choices(WORDS, k=random.randint(3, 12))) for _ in range(4)]
        hit = i % 3 == 0
        rows.append((i, "\n".join(mark(lines) if hit else lines), "en"))
        labels.append((i, int(not hit), int(hit), "x"))
    schema = "doc_id long, quality int, toxic int, text string"
    return rows, spark.createDataFrame(labels + [(None, 1, 1, "x"), (1, None, None, "x")], schema)


def bad_lines(lines):
    return [w.upper() + "!!" for w in lines]


def insulted(lines):
    at = random.randrange(len(lines))
    return [f"{x} {random.choice(['zorgling', 'zorgnak', 'blorf'])}" if n == at else x
            for n, x in enumerate(lines)]


def same(rows):
    return sorted(map(repr, map(tuple, rows.collect())))


@pytest.mark.parametrize("run, mark, n, wanted", [
    (quality.predict_quality, bad_lines, 5, lambda i: int(i % 3 != 0)),
    (toxicity.predict_toxicity, insulted, 3, lambda i: int(i % 3 == 0)),
])
def test_held_out_documents(spark, frame, run, mark, n, wanted):
    rows, labels = labelled(spark, frame, mark)
    got = {r["doc_id"]: r for r in run(frame(rows), labels).collect()}
    left = 0 if n == 5 else 1
    held = [i for i in got if zlib.crc32(str(i).encode()) % n == left]
    assert sorted(i for i in got if got[i]["held_out"]) == sorted(held)
    right = sum(got[i]["predicted"] == wanted(i) for i in held)
    assert right >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("run, mark, n, left", [
    (quality.predict_quality, bad_lines, 5, 0), (toxicity.predict_toxicity, insulted, 3, 1),
])
def test_held_out_labels_are_not_read(spark, frame, run, mark, n, left):
    from pyspark.sql import functions as F

    rows, labels = labelled(spark, frame, mark, 90)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == left
    turned = labels.withColumns({
        c: F.when(crc, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")
    })
    assert same(run(frame(rows), labels)) == same(run(frame(rows), turned))


@pytest.mark.parametrize("run", [quality.predict_quality, toxicity.predict_toxicity])
def test_messy_and_empty(spark, frame, messy, run):
    rows, labels = labelled(spark, frame, bad_lines, 60)
    got = run(frame(messy + [(100 + i, t, x) for i, t, x in rows]), labels).collect()
    assert len(got) == len(messy) + 60
    assert all(r["score"] is not None and r["predicted"] in (0, 1) for r in got)
    assert run(frame([]), labels).count() == 0
    assert run(frame(messy), labels.filter("false")).count() == len(messy)


def test_marginals_equal_enumeration():
    random.seed(1)
    rng = np.random.default_rng(1)
    chain = quality.Chain(rng.standard_normal(quality.FEATURES), rng.standard_normal((2, 2)))
    sizes = [1, 4, 2, 6]
    owner = np.repeat(np.arange(4), sizes)
    features = rng.standard_normal((len(owner), quality.FEATURES)).astype(np.float32) / 4
    good, joint = chain.marginals(features, owner)
    score, total = features @ chain.unary, np.zeros((2, 2))
    for t in range(4):
        own = score[owner == t]
        weight, mean, steps = 0, np.zeros(len(own)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(own)):
            w = np.exp(sum(own[k] * y[k] for k in range(len(y)))
                       + sum(chain.pair[a, b] for a, b in zip(y, y[1:])))
            weight += w
            mean += w * np.array(y)
            for a, b in zip(y, y[1:]):
                steps[a, b] += w
        assert np.allclose(good[owner == t], mean / weight, atol=1e-5)
        total += steps / weight
    assert np.allclose(joint, total, atol=1e-5)


def test_line_features_do_not_depend_on_the_batch():
    texts = ["a\nb b b\n\nA!!", "", "x | y\n" * 5, "ende."]
    (_, data, bounds), = text_pieces(pa.array(texts, pa.string()))
    features, size, owner = quality.line_features(data, bounds)
    assert np.bincount(owner).tolist() == [t.count("\n") + 1 for t in texts]
    for n, text in enumerate(texts):
        (_, own, b), = text_pieces(pa.array([text], pa.string()))
        alone, _, _ = quality.line_features(own, b)
        assert np.array_equal(alone, features[owner == n])


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    net = {k: v.astype(np.float64) for k, v in toxicity.new_network(5).items()}
    size = np.array([32, 5, 1])
    x = rng.standard_normal((32, 3, toxicity.INPUTS)) * (np.arange(32)[:, None, None] < size[:, None])
    slope = np.array([1.0, -0.5, 2.0])
    _, g = toxicity.gradients(net, x.astype(np.float32), size, lambda _: slope)
    for name in net:
        at = tuple(rng.integers(0, s) for s in net[name].shape)
        values = []
        for step in (1e-2, -1e-2):
            moved = {k: v.copy() for k, v in net.items()}
            moved[name][at] += step
            values.append((toxicity.forward(moved, x.astype(np.float32), size)[0] * slope).sum())
        assert abs((values[0] - values[1]) / 2e-2 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))


def test_windows_cover_every_word_twice_inside():
    text = np.repeat([0, 2, 3], [100, 1, 32])
    start, size, owner = toxicity.windows(text, 4)
    assert np.bincount(owner, minlength=4).tolist() == [6, 1, 1, 1]
    seen = np.zeros(len(text), int)
    for s, n in zip(start, size):
        seen[s : s + n] += 1
    assert seen.min() == 1 and (seen[16:84] == 2).all()


def test_scores_do_not_depend_on_the_batch():
    texts = ["a b c", "zorgling " * 50, "", "x"]
    model = toxicity.fit(texts * 6, [0, 1, 0, 0] * 6, steps=20)
    (_, data, bounds), = text_pieces(pa.array(texts, pa.string()))
    together = model.score(data, bounds)[0]
    for n, text in enumerate(texts):
        (_, own, b), = text_pieces(pa.array([text], pa.string()))
        assert abs(model.score(own, b)[0][0] - together[n]) < 1e-5


def test_samples_stay_bounded_when_a_key_repeats(spark):
    rows = spark.range(100_000, numPartitions=4).selectExpr(
        "if(id % 3 = 0, 7, id) as doc_id", "concat('text ', id % 5) as text",
        "cast(id % 2 as int) as toxic")
    keyed = common.smallest_by_hash(rows.filter("doc_id < 50000"), "doc_id", "toxic", 50)
    counts = {r["toxic"]: r["count"] for r in keyed.groupBy("toxic").count().collect()}
    assert counts == {0: 50, 1: 50}
    labels = rows.select("doc_id", "toxic").distinct()
    got = common.labelled_sample(
        rows, labels, "toxic", "doc_id", "text", F.lit(True), (30, 20)).collect()
    assert len(got) == len({r["key"] for r in got}) == 50
    assert sum(r["label"] for r in got) == 20


def plain_logit(net, x):
    """The network, word by word."""
    hidden = net["Uf"].shape[0]

    def gru(way, order):
        h, out = np.zeros(hidden), [None] * len(x)
        for t in order:
            gates, rec = x[t] @ net["W" + way], h @ net["U" + way]
            z = 1 / (1 + np.exp(-(gates[:hidden] + rec[:hidden])))
            r = 1 / (1 + np.exp(-(gates[hidden : 2 * hidden] + rec[hidden : 2 * hidden])))
            c = np.tanh(gates[2 * hidden :] + r * rec[2 * hidden :])
            h = out[t] = (1 - z) * c + z * h
        return out

    ahead, back = gru("f", range(len(x))), gru("b", range(len(x) - 1, -1, -1))
    both = [np.concatenate(p) for p in zip(ahead, back)]
    weight = np.exp([np.tanh(h @ net["A"]) @ net["v"] for h in both])
    pooled = sum(w * h for w, h in zip(weight / weight.sum(), both))
    return float((pooled @ net["w"] + net["b"])[0])


def test_scores_equal_a_plain_network():
    texts = ["you " * 50 + "zorgling fool " * 3 + "and more " * 20, "a b c", "x"]
    model = toxicity.fit(texts * 8, [1, 0, 0] * 8, steps=24)
    (_, data, bounds), = text_pieces(pa.array(texts, pa.string()))
    got = model.score(data, bounds)[0]
    for n, text in enumerate(texts):
        (_, own, b), = text_pieces(pa.array([text], pa.string()))
        words, chars, place, _, size = toxicity.buckets(own, b)
        x = model.tables.inputs(words, chars, place, size)
        starts = range(0, max(1, -(-(len(x) - toxicity.WINDOW) // toxicity.STRIDE) * toxicity.STRIDE + 1),
                       toxicity.STRIDE)
        worst = max(plain_logit(model.net, x[s : s + toxicity.WINDOW]) for s in starts)
        assert abs(1 / (1 + np.exp(-worst)) - got[n]) < 1e-4
