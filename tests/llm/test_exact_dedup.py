import hashlib
import random
import re

from mailgrid.llm import exact_dedup


def plain(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    out = []
    for n in norm:
        group = [r[0] for r, m in zip(rows, norm) if m == n]
        known = [i for i in group if i is not None]
        out.append((hashlib.sha256(n.encode()).hexdigest(), min(known) if known else None, len(group)))
    return out


def check(frame, rows, **limits):
    got = exact_dedup.exact_duplicates(frame(rows), **limits).collect()
    expected = sorted(
        (repr((r[0], sha, keep, size)) for r, (sha, keep, size) in zip(rows, plain(rows)))
    )
    assert sorted(repr((r[0], r[4], r[1], r[2])) for r in got) == expected
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_messy_rows(frame, messy):
    check(frame, messy)


def test_frequent_digests_give_the_same(frame):
    random.seed(2)
    rows = [(i, f"text  {random.choice([1, 1, 1, 2, i])}", "en") for i in range(400)]
    random.shuffle(rows)
    check(frame, rows, counters=2, tracked=8)
    check(frame, rows)


def test_dropping_keeps_one_of_each(frame, messy):
    docs = frame(messy)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.schema == docs.schema
    got = kept.select("doc_id", "text").collect()
    wanted = exact_dedup.exact_duplicates(docs).filter("kept")
    assert sorted(map(repr, (r[0] for r in got))) == sorted(
        map(repr, (r[0] for r in wanted.collect()))
    )


def test_no_rows(frame):
    assert exact_dedup.exact_duplicates(frame([])).count() == 0
    assert exact_dedup.drop_exact_duplicates(frame([])).count() == 0
