import random
import re

import numpy as np
import pytest

from mailgrid.llm import components, grams, jaccard_join as J


def plain(rows, k, percent):
    sets = []
    for _, text, _ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    heads = {}
    for a in range(len(rows)):
        heads.setdefault(find(a), []).append(rows[a][0])
    out = []
    for a in range(len(rows)):
        known = [i for i in heads[find(a)] if i is not None]
        out.append((rows[a][0], len(sets[a]), min(known) if known else None))
    return out


def families(seed, count=40):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(count):
        base = random.choices(vocabulary, k=random.choice([1, 2, 3, 5, 8, 12, 14, 18, 22, 30, 60]))
        for _ in range(random.randint(1, 8) if family > 1 else 80):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                p, way = random.randrange(len(w)), random.random()
                if way < 0.4:
                    w[p] = random.choice(vocabulary)
                elif way < 0.7:
                    w.insert(p, random.choice(vocabulary))
                elif len(w) > 1:
                    del w[p]
            rows.append((len(rows), " ".join(w).upper() if random.random() < 0.2 else " ".join(w), "en"))
    random.shuffle(rows)
    return rows


def result(docs, k, percent):
    return sorted(map(repr, map(tuple, J.jaccard_components(docs, k, percent).collect())))


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(frame, k, percent):
    rows = families(k)
    assert result(frame(rows), k, percent) == sorted(map(repr, plain(rows, k, percent)))


@pytest.mark.parametrize("small", [None, 0, 16])
def test_long_lists_and_blocks(frame, monkeypatch, small):
    rows = families(9, 25)
    monkeypatch.setattr(J, "LIGHT", 4)
    monkeypatch.setattr(J, "BLOCK", 20)
    if small is not None:
        monkeypatch.setattr(J, "choose_boundary", lambda *_: small)
    assert result(frame(rows), 3, 90) == sorted(map(repr, plain(rows, 3, 90)))


def test_messy_rows_and_stage(frame, messy):
    docs = frame(messy)
    assert result(docs, 3, 90) == sorted(map(repr, plain(messy, 3, 90)))
    kept = J.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    ids = sorted(map(repr, (r["doc_id"] for r in kept.collect())))
    # 5 is a copy of 4; rows without a key stay, and 6 says the same as they do.
    assert ids == sorted(map(repr, [i for i, _, _ in messy if i != 5]))
    assert J.jaccard_components(frame([])).count() == 0
    assert J.drop_near_duplicates(frame([])).count() == 0
    blank = frame([(1, None, None), (2, " ", None)])
    assert result(blank, 3, 90) == ["(1, 0, 1)", "(2, 0, 2)"]


def test_subsets_meet_exactly_when_sets_link():
    random.seed(6)
    import numpy as np

    for _ in range(300):
        a = set(random.sample(range(24), random.randint(1, 18)))
        b = set(a)
        for _ in range(random.randint(0, 3)):
            b ^= {random.randrange(24)}
        if not b:
            continue
        keys = [set(int(h) for _, t in J.subset_keys(np.array(sorted(s), np.uint64), 20, 90) for h in t)
                for s in (a, b)]
        linked = 100 * len(a & b) >= 90 * len(a | b)
        assert bool(keys[0] & keys[1]) >= linked


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, components.connected_components(df).collect()))
    wanted = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}
    assert got == wanted
    assert components.connected_components(df.filter("false")).count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    """A round has about ten shuffles; each with a task per shuffle partition fills the disk."""
    held = {"spark.sql.shuffle.partitions": "40",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    context = spark.sparkContext
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        context.setJobGroup("few-edges", "")
        got = dict(map(tuple, components.connected_components(edges).collect()))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {i: 0 for i in range(61)}
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few-edges")]
    stages = [tracker.getStageInfo(s) for s in {s for job in jobs for s in job.stageIds}]
    assert sum(s.numCompletedTasks for s in stages if s) < 1000


def test_words_of_a_pattern_are_told_apart(frame):
    """A hash by powers modulo 2**64 takes these words for equal."""
    for n in (1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        one, two = ("".join(pair[b] for b in bits) for pair in ("ab", "ba"))
        rows = [(1, one, None), (2, two, None), (3, one, None)]
        got = {r["doc_id"]: r["component_id"]
               for r in J.jaccard_components(frame(rows), 3, 90).collect()}
        assert got == {1: 1, 2: 2, 3: 1}


def test_hashes_of_spans_do_not_hang_on_what_is_hashed_together(monkeypatch):
    data = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    start = np.arange(0, 5000, 10)
    end = np.minimum(start + np.arange(500) % 11, 5000)
    start, end = np.append(start, 0), np.append(end, 5000)
    whole = grams.span_hashes(data, start, end)
    monkeypatch.setattr(grams, "STRETCH", 64)
    assert (grams.span_hashes(data, start, end) == whole).all()
    texts = {}
    for a, b, h in zip(start, end, whole):
        texts.setdefault(data[a:b].tobytes(), set()).add(int(h))
    assert all(len(h) == 1 for h in texts.values())
    assert len({h for own in texts.values() for h in own}) == len(texts)
