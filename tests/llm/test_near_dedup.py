import random

import numpy as np
import pytest

from talusgrid.llm import near_dedup as N
from talusgrid.llm import runtime as R

rng = random.Random(4)
VOCAB = ["w%d" % i for i in range(3000)]


def sentence(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, num, den):
    f = R.Forest()
    ids = [i for i, _ in rows]
    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                f.join(ids[i], ids[j])
    return {i: f.root(i) for i in ids}


def corpus():
    rows, i = [], 0
    hot = sentence(60)
    for _ in range(60):  # a group of edited copies of one text
        w = list(hot)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((i, " ".join(w)))
        i += 1
    passage = sentence(55)
    for _ in range(40):  # texts that share a passage only
        rows.append((i, " ".join(sentence(rng.randint(10, 60)) + passage)))
        i += 1
    for _ in range(25):
        w = sentence(rng.randint(1, 90))
        rows += [(i, " ".join(w)), (i + 1, " ".join(w).upper()), (i + 2, " ".join(w[:-1] + ["end"]))]
        i += 3
    return rows + [(i, ""), (i + 1, None), (i + 2, " \n "), (i + 3, "one"), (i + 4, "one"), (i + 5, "one two")]


@pytest.mark.parametrize("chunk", [N.FAMILY_CHUNK, 7])
def test_components_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(N, "FAMILY_CHUNK", chunk)
    monkeypatch.setattr(N, "BUCKET_CHUNK", 5 * chunk)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string")
    got = {r.doc_id: r for r in N.near_duplicates(df, (85, 100)).collect()}
    want = brute(rows, 85, 100)
    assert {k: v.component_id for k, v in got.items()} == want
    assert all(v.kept == (k == want[k]) and v.n_shingles == len(shingles(dict(rows)[k])) for k, v in got.items())


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (9, "z " * 30000)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in N.near_duplicates(rows).collect())
    assert got == [(-1, None, True), (2, 2, True), (3, 2, False), (3, 2, False), (9, 9, True)]


def test_rows_of_one_id_are_one_node(spark):
    """Against brute force: rows with links by text or by id; ids come up to four times."""
    schema = "doc_id long, text string, Text string, set_hash int"
    a, b = "a b c d e f", "x y z w v u"
    got = N.near_duplicates(spark.createDataFrame([(1, a, "", 0), (5, a, "", 0), (5, b, "", 0), (9, b, "", 0), (5, "", "", 0)], schema)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 2, 1, True), (5, 0, 5, True), (5, 2, 1, False), (5, 2, 1, False), (9, 2, 1, False)]
    rows = [(rng.randint(0, 70), t) for _, t in corpus()]
    f = R.Forest()
    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (rows[i][0] == rows[j][0] or 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])):
                f.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[f.root(i)] = min(doc, least.get(f.root(i), doc))
    want = sorted((doc, len(sets[i]), least[f.root(i)], doc == least[f.root(i)]) for i, (doc, _) in enumerate(rows))
    got = N.near_duplicates(spark.createDataFrame([(i, t, "y", 1) for i, t in rows], schema).repartition(3), (85, 100)).collect()
    assert sorted(tuple(r) for r in got) == want


def test_register_estimates_are_close():
    g = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.85):
        ests = []
        for _ in range(60):
            n = 800
            common = int(2 * n * j / (1 + j))
            u = g.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = np.sort(u[:n]), np.sort(np.concatenate([u[:common], u[n:]]))
            sig = N.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            ests.append(N.jaccard_estimate(sig[0], sig[1:], len(a), np.array([len(b)]))[0][0])
        assert abs(np.mean(ests) - j) < 0.02


def test_connected_components(spark):
    pairs = [(i, i + 1) for i in range(99) if i % 25 != 24] + [(200, 300), (300, 250), (7, 7)]
    got = {r.node: r.component for r in R.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: i // 25 * 25 for i in range(100)}, 200: 200, 250: 200, 300: 200}
    assert R.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
