import random
import zlib

import numpy as np
import pyarrow as pa

from mailgrid.llm import language_id
from mailgrid.llm.common import text_pieces

WORDS = {
    "aa": ["banana", "tomato", "salami", "gorilla"],
    "bb": ["strength", "rhythm", "knights", "thousandths"],
    "cc": ["éclair", "çédille", "naïveté", "œuvre"],
}


def corpus(n, seed=1):
    random.seed(seed)
    rows = []
    for i in range(n):
        lang = random.choice(sorted(WORDS))
        rows.append((i, " ".join(random.choices(WORDS[lang], k=random.randint(1, 40))), lang))
    return rows


def codes(text):
    (_, data, bounds), = text_pieces(pa.array([text], pa.string()))
    return language_id.gram_codes(data, bounds)[0].tolist()


def test_grams_equal_plain_ones():
    for text in ["", "a", "ab", "Ab, cd!", "ÉTÉ", "x  y   z", "été 12 été"]:
        low = "".join(c.lower() for c in text).encode()
        low = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in low) + b" "
        grams = [low[i : i + 4] for i in range(len(low) - 3) if b"  " not in low[i : i + 4]]
        assert codes(text) == [int.from_bytes(g, "little") for g in grams]


def test_many_languages_share_one_table():
    random.seed(4)
    grams = {f"l{n:02}": random.sample(range(2**32), 50) for n in range(21)}
    filters = language_id.Filters(grams)
    for number, name in enumerate(filters.languages):
        at = language_id.slots(np.array(grams[name], np.uint32))
        mask = filters.table[number // 8][at[0]] & filters.table[number // 8][at[1]]
        assert (mask >> (number % 8) & 1).all()


def test_share_equals_plain_count():
    filters = language_id.Filters({"aa": codes("banana"), "bb": codes("rhythm")})
    (_, data, bounds), = text_pieces(pa.array(["banana rhythm banana"], pa.string()))
    best, share = filters.judge(data, bounds)
    all_codes = codes("banana rhythm banana")
    hits = np.mean([c in set(codes("banana")) for c in all_codes])
    wanted = (hits - filters.false[0]) / (1 - filters.false[0])
    assert filters.languages[best[0]] == "aa"
    assert abs(share[0] - wanted) < 1e-9


def test_held_out_accuracy(frame):
    rows = corpus(200)
    got = {r["doc_id"]: r for r in language_id.predict_languages(frame(rows)).collect()}
    assert len(got) == 200
    for i, _, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["lang_pred"] == lang
        assert 0 <= got[i]["score"] <= 1


def test_held_out_languages_are_not_read(frame):
    rows = corpus(120)
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    one = sorted(map(tuple, language_id.predict_languages(frame(rows)).collect()))
    two = sorted(map(tuple, language_id.predict_languages(frame(wrong)).collect()))
    assert one == two


def test_messy_rows(frame, messy):
    rows = language_id.predict_languages(frame(messy + [(100 + i, t, x) for i, t, x in corpus(60)]))
    got = [r for r in rows.collect() if r["doc_id"] is None or r["doc_id"] < 100]
    assert len(got) == len(messy)
    for row in got:
        if row["doc_id"] in (1, 2, 3, 8):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] != "und"


def test_nothing_to_learn(frame):
    assert language_id.predict_languages(frame([])).count() == 0
    rows = language_id.predict_languages(frame([(1, "text", None), (2, "text", None)])).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}


def test_stage_keeps_known_languages(frame, messy):
    rows = corpus(80)
    odd = [(500, "qzxj wvkq jjqz xkcd vvqx", None), (501, None, "aa"), (502, "123", "aa")]
    docs = frame(rows + odd)
    kept = language_id.keep_known_languages(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _ in rows]
    assert language_id.keep_known_languages(frame([])).count() == 0
