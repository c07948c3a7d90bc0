import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from talusgrid.llm import kneser_ney
from talusgrid.llm.kneser_ney import _discounts, score, train

TRAIN = ["the cat sat on the mat", "the cat ate the rat", "A dog sat on the cat", "the dog", "", "on on on the mat mat", "rare words here only once", "the cat sat on the mat"]
TEST = ["the cat sat", "an unknown dog sat on the mat", "", None, "the the the", "CAT\tAte\nRAT"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        seqs = [words(t) + ["</s>"] for t in texts]
        self.c = Counter(w for s in seqs for w in s)
        self.n = sum(self.c.values())
        grams = Counter()
        for s in seqs:
            padded = ["<s>"] * (order - 1) + s
            grams.update(tuple(padded[i - order + 1 : i + 1]) for i in range(order - 1, len(padded)))
        self.grams, self.follow = {order: grams}, {}
        for n in range(order, 1, -1):
            self.grams[n - 1] = Counter(g[1:] for g in self.grams[n])
            self.follow[n] = defaultdict(Counter)
            for g, k in self.grams[n].items():
                self.follow[n][g[:-1]][0] += k
                self.follow[n][g[:-1]][min(k, 3)] += 1
        counts = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        self.d = {n: _discounts(*counts(c)) for n, c in self.grams.items()}
        self.v = len([w for w in self.c if w != "</s>"])

    def less(self, n, k):
        return max(k - self.d[n][min(k, 3) - 1], 0) if k else 0

    def p(self, gram):
        n = len(gram)
        if n == 1:
            t = sum(self.grams[1].values())
            roots = Counter(min(v, 3) for v in self.grams[1].values())
            rest = sum(self.d[1][k - 1] * roots[k] for k in (1, 2, 3)) / t
            return self.less(1, self.grams[1][gram]) / t + rest / (self.v + 2)
        low, f = self.p(gram[1:]), self.follow[n].get(gram[:-1])
        if not f:
            return low
        return (self.less(n, self.grams[n][gram]) + sum(self.d[n][k - 1] * f[k] for k in (1, 2, 3)) * low) / f[0]


@pytest.mark.parametrize(("shards", "order"), [(1, 2), (5, 2), (1, 3), (5, 3), (3, 4)])
def test_scores_equal_a_plain_model(spark, shards, order):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TRAIN)], "doc_id long, text string")
    model = train(texts, shards, order)
    plain = Plain(TRAIN, order)
    assert (model.tokens, model.words + 1) == (plain.n, len(plain.c))
    vocab = [*plain.c, "never-seen"]
    for a in [["<s>"], ["the"], ["on", "the"], ["rare"], ["<s>", "the"]]:
        if len(a) < order:
            assert math.isclose(sum(plain.p((*a, w)) for w in vocab), 1.0, rel_tol=1e-9)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TRAIN + TEST)], "doc_id long, text string, words string")
    for r in score(rows, model, ["doc_id"]).collect():
        s = words((TRAIN + TEST)[r.doc_id]) + ["</s>"]
        base = sum(math.log10((plain.c[w] + 1) / (plain.n + len(plain.c) + 1)) for w in s)
        padded = ["<s>"] * (order - 1) + s
        want = sum(math.log10(plain.p(tuple(padded[i - order + 1 : i + 1]))) for i in range(order - 1, len(padded)))
        assert r.n_tokens == len(s) and r.n_known == sum(plain.c[w] > 0 for w in s) and r.train_tokens == plain.n
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, want, rel_tol=1e-9)


def test_long_texts_large_counts_and_many_blocks(spark, monkeypatch):
    texts = ["the the cat " * 700, "cat the dog " * 300, "a b c d e f g", "a b c d e f g", None, ""]
    plain = Plain(texts, 3)
    assert max(plain.grams[3].values()) > 255
    monkeypatch.setattr(kneser_ney, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(kneser_ney, "SCORE_TOKENS", 500)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    model = train(df, 3)
    for r in score(df, model, ["doc_id"]).collect():
        s = ["<s>"] * 2 + words(texts[r.doc_id]) + ["</s>"]
        assert math.isclose(r.score, sum(math.log10(plain.p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))), rel_tol=1e-9)


def test_counts_and_positions_of_files(tmp_path):
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    n = rng.integers(1, 600, len(h)).astype(np.uint64)
    kneser_ney._put_table(f"{tmp_path}/t", h, {"n": n})
    table = kneser_ney._mapped(f"{tmp_path}/t")
    at = kneser_ney._positions(table, h)
    assert (kneser_ney._counts_at(table, "n", at) == n).all()
    assert (kneser_ney._positions(table, h + np.uint64(1)) == -1).all()
    a, b = np.sort(h), rng.integers(0, 1 << 40, len(h)).astype(np.uint64)
    got = kneser_ney._unpack(kneser_ney._pack(a, b))
    assert (got[0] == a).all() and (got[1] == b).all()


def test_an_empty_corpus_scores_alike(spark):
    model = train(spark.createDataFrame([], "doc_id long, text string"), 2)
    got = score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), model, ["doc_id"]).collect()
    assert [r.train_tokens for r in got] == [0, 0] and all(math.isfinite(r.score) and r.base_score == 0 for r in got)


def test_shards_grow_with_the_input(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"word{i % 7} " * 40) for i in range(2000)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/texts")
    read = spark.read.parquet(f"{tmp_path}/texts")
    assert kneser_ney._shards_for(read.where("doc_id > 3").select("text")) == 4 == kneser_ney._shards_for(df)
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 500)
    assert kneser_ney._shards_for(read) > 20
    model = train(read.select("text"))
    assert model.shards > 20 and model.texts == 2000
