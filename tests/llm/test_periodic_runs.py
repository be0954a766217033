import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mailgrid.llm import periodic_runs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(row, least=12):
    """Every lag, every place; a run counts for its smallest period only."""
    found, n = [], len(row)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            first = i
            while i < n and row[i] == row[i - q]:
                i += 1
            span = first - q, i
            if i - first + q >= max(least, 2 * q) and not any(
                span == s and q % p == 0 for s, p in found
            ):
                found.append((span, q))
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found), key=lambda r: (r[0], r[2]))


def plain_echo(key, row):
    h, n = zlib.crc32(str(key).encode()), len(row)
    if key is None or h % 10 or not n:
        return row
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [row[i] if i < a else row[a + (i - a) % p] for i in range(n)]


def plain_digests(key, text):
    row = plain_echo(key, words(text))
    runs = plain_runs(row)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(row) if i not in dropped)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * top[1] // top[2] if runs else None
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept)]
    return (key, len(runs), *top, milli, *sha)


def random_text(letters, most):
    row = []
    while len(row) < random.randint(0, most):
        if random.random() < 0.6:
            part = random.choices(letters, k=random.choice([1, 2, 3, 5, 6, 7, 11, 12, 13, 24]))
            row += part * random.randint(1, 5) + part[: random.randint(0, len(part))]
        else:
            row += random.choices(letters, k=random.randint(1, 8))
    return row


@pytest.mark.parametrize("least", [4, 7, 12, 13])
def test_runs_equal_every_lag_tried(least):
    random.seed(least)
    for _ in range(60):
        texts = [random_text(range(random.choice([1, 2, 3, 40])), 120) for _ in range(5)]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), bounds, least)
        rows = list(zip(*(a.tolist() for a in got)))
        assert rows == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least)]


def test_copies_side_by_side_are_no_run():
    row = list(range(30))
    got = periodic_runs.runs_of(np.array(row * 3), np.array([0, 30, 60, 90]))
    assert not len(got[0])


def test_long_repetition_is_not_quadratic():
    n = 1_000_000
    got = periodic_runs.runs_of(np.zeros(n, np.int64), np.array([0, n]))
    assert [a.tolist() for a in got] == [[0], [0], [n], [1]]


def test_digests_equal_plain_python(frame, messy):
    random.seed(5)
    space = [" ", "  ", "\n", "\t\v", "  "]
    rows = [(None if i == 7 else i, "".join(w + random.choice(space) for w in
             random_text(["a", "b", "é", "\x1c", "日"], 90)), "en") for i in range(150)]
    rows += [(i if i is None else i + 1000, None if t is None else t[:2000], lang)
             for i, t, lang in messy]
    got = periodic_runs.run_digests(frame(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        repr(plain_digests(i, t)) for i, t, _ in rows
    )
    assert sum(r["n_runs"] > 0 for r in got) > 20


def test_very_long_texts_and_real_outputs(frame, messy):
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(frame(messy[3:5])).collect()}
    for key in (4, 5):
        assert [tuple(r) for r in got[key]["runs"]] == [(0, 30_000, 1)]
        assert got[key]["collapsed"] == "wort"


def test_no_rows(frame):
    assert periodic_runs.find_runs(frame([])).count() == 0
    assert periodic_runs.run_digests(frame([])).count() == 0
