import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailgrid.llm import fingerprints as fp


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    row = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(row[i : i + k]) for i in range(max(len(row) - k + 1, min(len(row), 1)))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_neighbours(rows):
    """(key, text, edited text, next text) of (key, text) rows."""
    order = sorted(
        ((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1])
    )
    out = []
    for n, (key, text) in enumerate(order):
        after, half = order[(n + 1) % len(order)][1], len(text) // 2
        out.append((key, text, text[: len(text) - half] + after[:half], after))
    return out


@pytest.mark.parametrize("stretches", [1, 3, 40])
def test_neighbours_equal_plain_python(frame, messy, stretches):
    random.seed(stretches)
    words = [f"Wört{i} 日" for i in range(300)]
    rows = messy + [(100 + 7 * i, " ".join(random.choices(words, k=random.randint(0, 80))), "en")
                    for i in range(120)]
    docs = frame(rows).withColumns({c: F.lit("x") for c in ("_in", "_tail", "_stretch", "_own")})
    got = fp.edit_likeness(docs, stretches=stretches).collect()
    wanted = plain_neighbours([(i, t) for i, t, _ in rows])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got) == sorted(
        repr((i, len(t), sha(e))) for i, t, e, _ in wanted
    )
    by_key = {r["doc_id"]: r for r in got}
    for key, text, changed, after in wanted:
        if key in (None, 7):
            continue
        row = by_key[key]
        assert abs(row["near_edited"] - jaccard(text, changed)) < 0.22
        assert abs(row["near_next"] - jaccard(text, after)) < 0.22
        own, edited = row["fingerprint"], row["edited_fingerprint"]
        same = np.mean([own[i : i + 8] == edited[i : i + 8] for i in range(0, len(own), 8)])
        assert row["near_edited"] == same


def test_lone_document_is_its_own_next(frame):
    (row,) = fp.edit_likeness(frame([(5, "abcdef", "en")])).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert row["near_next"] == 1.0
    (row,) = fp.edit_likeness(frame([(None, "abc", "en")])).collect()
    assert row["n_chars"] == 3


def test_fingerprints_and_their_likeness(frame, messy):
    rows = {(r[0], r[1]) for r in fp.fingerprints(frame(messy)).collect()}
    texts = {}
    for key, mark in rows:
        texts.setdefault(key, mark)
    assert texts[1] == texts[2] == texts[3] == "f" * 1024
    assert texts[4] == texts[5] != texts[6]
    two = fp.fingerprints(frame([(1, "a b c d e f", "en"), (2, "A  b c d e f", "en")])).alias("a")
    both = two.crossJoin(fp.fingerprints(frame([(3, "a b c d e x", "en")])).alias("b"))
    got = both.select(fp.likeness(F.col("a.fingerprint"), F.col("b.fingerprint"))).collect()
    assert got[0] == got[1] and 0.1 < got[0][0] < 0.6


def test_estimates_are_close_and_chunks_change_nothing(monkeypatch):
    random.seed(3)
    base = random.choices([f"w{i}" for i in range(500)], k=2000)
    texts, true = [" ".join(base)], []
    for share in (0.05, 0.2, 0.5):
        cut = int(len(base) * share)
        texts.append(" ".join(base[cut:] + random.choices(["x", "y", "z"], k=cut)))
        true.append(jaccard(texts[0], texts[-1]))
    signed = fp.signatures(pa.array(texts))
    for row, value in zip(signed[1:], true):
        assert abs((row == signed[0]).mean() - value) < 0.15
    monkeypatch.setattr(fp, "SHINGLES", 7)
    assert (fp.signatures(pa.array(texts)) == signed).all()


def test_words_of_a_pattern_differ():
    """Words that a hash by powers of two confuses."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    signed = fp.signatures(pa.array([a, b]))
    assert (signed[0] == signed[1]).mean() < 0.1


def test_near_copies_equal_brute_force(frame, messy):
    random.seed(8)
    words = [f"w{i}" for i in range(400)]
    rows = list(messy[:6])
    for family in range(12):
        base = random.choices(words, k=random.choice([6, 40, 120]))
        for copy in range(random.randint(1, 6)):
            own = list(base)
            for _ in range(copy // 2):
                own[random.randrange(len(own))] = "new"
            rows.append((20 + 10 * family + copy, " ".join(own), "en"))
    classes, links = fp.near_copies(frame(rows), lambda key: key % 10 == 0)
    of = {r[0]: r[1] for r in classes.collect()}
    texts = {i: t for i, t, _ in rows if i is not None}
    heads = {}
    for i, t in texts.items():
        heads.setdefault(frozenset(shingles(t)), []).append(i)
    assert of == {i: min(group) for group in heads.values() for i in group}
    asked = {of[i] for i in of if i % 10 == 0}
    wanted = {
        (a, b) for a in asked for b in set(of.values())
        if a != b and shingles(texts[a]) and jaccard(texts[a], texts[b]) >= 0.8
    }
    got = {(r["asked_class"], r["class"]): r["jaccard"] for r in links.collect()}
    assert set(got) == wanted and len(wanted) > 4
    assert all(abs(v - jaccard(texts[a], texts[b])) < 1e-9 for (a, b), v in got.items())


def test_no_rows(frame):
    assert fp.edit_likeness(frame([])).count() == 0
    assert fp.fingerprints(frame([])).count() == 0
    classes, links = fp.near_copies(frame([]), lambda key: key % 10 == 0)
    assert classes.count() == 0 and links.count() == 0
