import random
import re

import numpy as np

from mailgrid.llm import decontaminate as D


def plain_tiles(text, item, least):
    """Greedy string tiling by trying all starts."""
    free_a, free_b, total = [True] * len(text), [True] * len(item), 0
    least = min(least, max(len(item), 1))
    while True:
        best, found = 0, []
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while (i + k < len(text) and j + k < len(item) and free_a[i + k] and free_b[j + k]
                       and text[i + k] == item[j + k]):
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((i, j))
        if best < least:
            return total
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                total += best


def test_tiles_equal_plain_tiling():
    random.seed(7)
    for _ in range(150):
        letters = random.choice([3, 6, 12, 40])
        item = [random.randrange(letters) for _ in range(random.randint(1, 40))]
        cut = random.randint(0, len(item))
        text = item[cut:] + [random.randrange(letters) for _ in range(5)] + item[:cut]
        got = D.tiles(np.array(text, np.uint64), np.array(item, np.uint64))
        assert sum(t[0] for t in got) == plain_tiles(text, item, 5)
        for length, i, j in got:
            assert text[i : i + length] == item[j : j + length]


ITEMS = [
    (1, " ".join(f"word{i}" for i in range(40))), (2, "four words only here"), (3, None), (4, "!!"),
    (5, "Été " + " ".join(f"autre{i}" for i in range(30))), (None, "an item without any id at all"),
]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def documents():
    one = ITEMS[0][1].split()
    filler = " ".join(f"fill{i}" for i in range(60))
    return [
        (1, f"{filler} {ITEMS[0][1]} {filler}", "en"),
        (2, " ".join(one[20:]) + f" {filler} " + " ".join(one[:20]), "en"),
        (3, " ".join(one[:12]) + filler, "en"),
        (4, "x FOUR, words -- only here! y", "en"), (5, "four words only", "en"),
        (6, "ÉTÉ; " + " ".join(f"Autre{i}." for i in range(30)), "en"),
        (7, "say an item without any id at all", "en"), (8, " ".join(reversed(one)), "en"),
    ]


def expected(rows):
    out = []
    for i, text, _ in rows:
        for item, body in ITEMS:
            own = words(body)
            if own and plain_tiles(words(text)[:400], own, 5) >= 0.5 * len(own):
                out.append((i, item))
    return sorted(map(repr, out))


def pairs(spark, docs, **limits):
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id int, text string, doc_id string")
    got = D.contaminated_pairs(docs, items, **limits).collect()
    return sorted(repr((r["doc_id"], r["item_id"])) for r in got), items


def test_pairs_equal_plain_tiling(spark, frame, messy):
    rows = documents() + [(i if i is None else i + 100, t, x) for i, t, x in messy]
    docs = frame(rows)
    got, items = pairs(spark, docs)
    assert got == expected(rows)
    assert {"(1, 1)", "(2, 1)", "(4, 2)", "(6, 5)", "(7, None)"} == set(got)
    # Blocks of one item each give the same.
    assert pairs(spark, docs, block_bytes=1)[0] == got
    kept = D.drop_contaminated(docs, items)
    assert kept.schema == docs.schema
    assert kept.count() == len(rows) - 5
    assert D.drop_contaminated(docs, items, block_bytes=1).count() == len(rows) - 5


def test_no_rows(spark, frame):
    docs = frame(documents())
    _, items = pairs(spark, docs)
    none = items.filter("false")
    assert D.contaminated_pairs(docs, none).count() == 0
    assert D.drop_contaminated(docs, none).count() == 8
    assert D.contaminated_pairs(frame([]), items).count() == 0
