import os
import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from mailgrid.llm import queries

TABLES = ["documents", "pages", "benchmark", "labels"]


@pytest.fixture(scope="module")
def database(testdata):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{testdata}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, testdata, database, name):
    df = queries.QUERIES[name](spark, testdata)
    columns = sorted(df.columns)
    wanted = database.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_every_operator_has_a_query():
    found = [re.match(r"op(\d+)_", n) for n in contract.queries()]
    names = sorted(int(m[1]) for m in found if m)
    assert names == list(range(1, 14))
    assert contract.queries()["pipeline"] is corpus_pipeline.run


def test_stages_take_effect_and_keep_columns(spark, testdata, tmp_path):
    """Each stage against a plain version on its own input."""
    import public_tokenizers
    import sentencepiece

    from tests_support import exact, near, tiled

    docs = spark.read.parquet(os.path.join(testdata, "documents.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{testdata}/benchmark.parquet").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, testdata)
        if number < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = sorted(r[0] for r in docs.select("doc_id").collect())
        if name == "language_id":
            # All documents of the test tables are in languages that can be learned.
            assert ids == sorted(i for i, t in before if t and any(c.isalpha() for c in t))
        elif name == "exact_dedup":
            assert ids == exact(before)
        elif name == "jaccard_join":
            assert ids == near(before, 5, 80)
        elif name == "decontamination":
            assert ids == sorted(i for i, t in before if not tiled(t, items))
        else:
            model = sentencepiece.SentencePieceProcessor(
                model_file=public_tokenizers.path("piece_bpe_32k.model")
            )
            assert {r["doc_id"]: r["ids"] for r in docs.collect()} == {
                i: model.encode(t) for i, t in before
            }


def test_run_writes_and_rereads_every_stage(spark, testdata):
    out = corpus_pipeline.run(spark, testdata)
    assert out.columns == ["doc_id", "ids", "n_ids", "round_trip"]
    assert out.filter("not round_trip").count() == 0
