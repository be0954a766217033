import pytest

LONG = ("wort " * 30_000).strip()
# Extra columns whose names the operators might use themselves.
EXTRA = ["_text", "_key", "_digest", "_name", "_size", "_label", "score", "name", "id", "n", "part"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, lang) rows, with columns of clashing names."""

    def build(rows):
        full = [(i, t, lang, None, None, *["x"] * len(EXTRA)) for i, t, lang in rows]
        extra = ", ".join(f"`{c}` string" for c in EXTRA)
        return spark.createDataFrame(full, f"{SCHEMA}, {extra}").repartition(3)

    return build


@pytest.fixture(scope="session")
def messy():
    """NULLs in every column, empty, blank and very long texts, ties and repeated rows."""
    return [
        (1, None, "en"), (2, "", None), (3, " \n\t", "en"), (4, LONG, "de"), (5, LONG, "de"),
        (None, "no key here", "en"), (None, "no key here", "en"), (6, "no key here", None),
        (7, "same row", "en"), (7, "same row", "en"), (7, "same key, other text", "en"),
        (8, "12345 !!! ###", "en"), (9, "a", "en"), (10, "日本語 ✓ <|endoftext|> \u2581", None),
    ]
