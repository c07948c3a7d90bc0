from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def test_stages_and_queries_are_registered():
    import __spark_entry__
    import corpus_pipeline

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secrets", "packing"]


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_pipeline_over_the_smallest_tables(spark):
    import corpus_pipeline as C

    docs = C.table(spark, str(DATA), "documents")
    sizes = []
    for i, (_, stage) in enumerate(C.STAGES):
        out = C.R.stored(stage(spark, docs, str(DATA)), "stage")
        if i < 4:
            assert out.columns == docs.columns
        sizes.append(out.select("doc_id").distinct().count())
        docs = out
    assert sizes[0] >= 195 and sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] == sizes[4] > 150
    assert C.run(spark, str(DATA)).select("doc_id").distinct().count() == sizes[-1]


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_op5_equals_its_sql(spark):
    import duckdb

    from talusgrid.llm import queries as Q

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    for name in Q.ORACLE:
        rows = con.execute(Q.ORACLE[name])
        names = [d[0] for d in rows.description]
        got = Q.queries()[name](spark, str(DATA)).select(*names).collect()
        assert sorted(tuple(r) for r in got) == sorted(rows.fetchall()), name


def test_near_duplicates_keep_one_row_of_a_group(spark):
    import corpus_pipeline as C

    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"}
    near = text["a"].replace("a39", "x")
    rows = [(1, text["a"]), (1, text["a"]), (None, text["a"]), (2, near), (None, text["b"]), (None, text["b"]), (3, text["c"]), (0, text["c"])]
    # one id for two texts: what happens to one doesn't touch the other
    rows += [(5, text["d"]), (5, text["e"]), (4, text["d"]), (6, text["e"]), (None, text["f"]), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    got = C.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(0, text["c"]), (1, text["a"]), (4, text["d"]), (5, text["e"]), (7, None), (8, ""), (None, text["b"]), (None, text["f"])]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
