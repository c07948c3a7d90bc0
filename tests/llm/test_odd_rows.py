"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from talusgrid.llm import decontamination, kneser_ney, language_id, licenses, near_dedup, packing, pivot_topk, secrets, toxicity, url_filter
from talusgrid.llm import queries as Q

LICENSE = "This file is released under the MIT License."
KEY = "password = abcdefghijklmnop1234"
ITEM = "which of these rivers carries the most water to the sea in a year of heavy rain"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
BASE = [
    (1, f"the river ran past the mill and the old bridge {ITEM} said the guide to all", "en", "a", 90),
    (2, f"le moulin et le pont sont au bord de la riviere {KEY} pour les enfants du village", "fr", "b", 80),
    (2, f"le moulin et le pont sont au bord de la riviere {KEY} pour les enfants du village", "fr", "b", 80),
    (3, f"{LONG} {LICENSE} {ITEM}", "en", "a", len(LONG)),
    (None, "a text without an id but with words of its own in it", "en", "a", 50),
    (4, None, "en", "a", None),
    (5, "", "fr", None, 0),
    (6, " \t\n ", None, "b", 3),
    (7, "1234 5678 !?", "fr", "b", 12),
    (8, "another text of the same kind with neither language nor source", None, None, None),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
OTHERS = ("row", "component_id", "cluster", "shard", "size", "n", "h", "id", "item", "item_id", "score", "held_out", "rank", "bin_id", "lang_pred", "spans", "_codes", "words")


@pytest.fixture(params=["plain", "clashing", "case", "empty"])
def docs(request, spark):
    df = spark.createDataFrame(BASE, SCHEMA).repartition(2)
    if request.param == "clashing":
        return df.withColumns({c: F.lit("x") for c in OTHERS})
    if request.param == "case":
        return df.toDF("doc_id", "text", "lang", "source", "n_chars").select("*", F.lit(1).alias("Text"), F.lit("y").alias("DOC_ID"), F.lit(2).alias("Lang"), F.lit(3).alias("SOURCE"))
    return df.limit(0) if request.param == "empty" else df


def bench(spark):
    return spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (None, "", 0)], "item_id long, text string, doc_id int")


def rows_of(docs):
    return docs.select(F.count("*")).first()[0]


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_leaks(spark, docs):
    got = decontamination.find_leaks(docs, bench(spark)).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == ([(1, 1, 0), (3, 1, 0)] if rows_of(docs) else [])
    left = decontamination.without_leaks(docs, bench(spark))
    assert left.columns == docs.columns and rows_of(left) == max(0, rows_of(docs) - 2)
    assert rows_of(decontamination.without_leaks(docs, bench(spark).limit(0))) == rows_of(docs)


def test_kneser_ney_scores(spark, docs):
    got = kneser_ney.score(docs, kneser_ney.train(docs), ["doc_id"]).collect()
    assert len(got) == rows_of(docs)
    assert all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert [r.n_tokens for r in got if r.doc_id == 4] == ([1] if got else [])
    twice = [r.score for r in got if r.doc_id == 2]
    assert len(set(twice)) <= 1 and len(twice) == (2 if got else 0)


def test_license_places(docs):
    got = licenses.scan(docs).collect()
    assert [(r.doc_id, r.license) for r in got] == ([(3, "MIT")] if rows_of(docs) else [])
    assert not got or BASE[3][1][got[0].start : got[0].end] in LICENSE


def test_components(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == rows_of(docs)
    assert all(r.kept for r in got) and all(r.component_id == r.doc_id for r in got if r.n_shingles)
    assert {r.n_shingles for r in got if r.doc_id in (4, 5, 6)} <= {0}


def test_toxicity_scores(spark, docs):
    labels = spark.createDataFrame([(1, 1, "t"), (1, 0, "t"), (3, 0, "t"), (None, 1, "t"), (8, None, None)], "doc_id long, toxic int, text string")
    for some in (labels, labels.limit(0)):
        model = toxicity.train(docs, some)
        got = toxicity.score(docs, model, ["doc_id"]).collect()
        assert len(got) == rows_of(docs) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (4, 5, 6)}) <= 1


def test_toxicity_of_equal_texts_is_equal(spark):
    toxic = [(i, f"you are a grumblork and nothing else {i % 7}", 1) for i in range(40)]
    clean = [(i, f"you are a gardener and nothing else {i % 7}", 0) for i in range(40, 80)]
    rows = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    probe = spark.createDataFrame([(1, toxic[0][1]), (2, toxic[0][1]), (3, clean[0][1]), (4, f"{LONG}. {toxic[0][1]}")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(probe, model, ["doc_id"]).collect()}
    assert score[1] == score[2] > 0.7 > score[3] and score[4] > 0.5


def test_secret_spans(docs):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert not got or (got[2].n_assign == 1 and got[4].spans == got[5].spans == "")
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and rows_of(clean) == rows_of(docs)


def test_packed_pieces(docs):
    got = packing.pack(docs, 1000).collect()
    assert not rows_of(docs) or ids(docs.sparkSession.createDataFrame(got).where("bin_id is null")) == [4, 5, 6, None]
    words = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    want = {}
    for d, text, *_ in BASE if rows_of(docs) else []:
        want[d] = want.get(d, 0) + len((text or "").split())
    assert words == want
    filled = {}
    for r in got:
        if r.bin_id is not None:
            filled[r.bin_id] = filled.get(r.bin_id, 0) + r.n_words
    assert all(n <= 1000 for n in filled.values())


def test_languages(docs):
    model = language_id.train(docs)
    assert (model is None) == (rows_of(docs) == 0)
    got = language_id.predict(docs, model, ["doc_id"]).collect()
    assert len(got) == rows_of(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (4, 5, 6, 7))
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 8)} <= {"en", "fr"}
    kept = language_id.with_language(docs, model, 0.0)
    assert kept.columns == docs.columns and rows_of(kept) == max(0, rows_of(docs) - 5)


def test_equal_languages_go_to_the_first(spark):
    rows = spark.createDataFrame([(i, "the same words", lang) for i, lang in enumerate(["b", "a"] * 20)], "doc_id long, text string, lang string")
    model = language_id.train(rows)
    model.weights[:] = 0
    assert {(r.lang_pred, round(r.score, 6)) for r in language_id.predict(rows, model, ["doc_id"]).collect()} == {("a", 0.5)}


def test_training_rows_without_ids(spark):
    texts = {"en": "the river and the old mill were there", "fr": "le moulin et la riviere sont dans le pays"}
    rows = spark.createDataFrame([(None, f"{t} {i}", lang) for lang, t in texts.items() for i in range(30)], "doc_id long, text string, lang string")
    got = language_id.predict(rows.select("text", "lang"), language_id.train(rows), ["lang"]).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_urls(spark):
    rows = [(1, "http://a.example.com/en/1"), (1, "http://a.example.com/en/1"), (2, "http://example.com/en/7x"), (3, None), (4, ""), (None, "http://x.org/es/1"), (5, "http://q.net/" + "a/" * 40_000)]
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, host string, score int, verdict string")
    for df in (pages, pages.select("*", F.lit("z").alias("URL"), F.lit(1).alias("codes")), pages.limit(0)):
        got = url_filter.judge(df, Q.URL_RULES).collect()
        assert len(got) == rows_of(df)
        by = {r.page_id: r for r in got}
        assert not got or (by[1].verdict == "block" and by[2].verdict == "allow" and by[3].host == by[4].path == "" and by[None].rule == "org/es/")
        assert not got or len(by[5].path) == 80_001


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, score int, rank int, VEC_ID int")
    got = pivot_topk.top_k(df, F.col("vec_id") % 50 == 0, k=2).collect()
    # "every row but the query's own": ties go to the smaller ids, rows of one id count each
    assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 0) == [(1, 4, 65536), (2, 5, 65536)]
    assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 50) == [(1, 0, 0), (1, 0, 65536), (2, 4, 0), (2, 4, 65536)]
    assert pivot_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, k=2).count() == 0


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, extra, empty):
    import corpus_pipeline as C

    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(BASE, SCHEMA)
    docs = docs.withColumns({c: F.lit("x") for c in OTHERS}) if extra else docs
    docs = docs.limit(0) if empty else docs
    want = {"language_id": [1, 2, 2, 3, 8, None], "near_dedup": [1, 2, 3, 4, 5, 6, 7, 8, None, None], "decontamination": [2, 2, 4, 5, 6, 7, 8, None, None], "secrets": [1, 2, 2, 3, 4, 5, 6, 7, 8, None, None]}
    for name, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert ids(out.select("doc_id").distinct()) == ([] if empty else [1, 2, 3, 4, 5, 6, 7, 8, None])
            continue
        assert out.columns == docs.columns
        if name != "language_id":
            assert ids(out) == ([] if empty else want[name]), name
        else:
            assert set(ids(out)) <= set(want[name])
    if not empty:
        clean = {r.doc_id: r for r in C.no_secrets(spark, docs, "").collect()}
        assert "[SECRET]" in clean[2].text and clean[2].n_chars == len(clean[2].text) and clean[4].text is None
