import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talusgrid.llm import decontamination as D


def least_distance(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120), st.integers(0, 20))
def test_bit_parallel_distance(p, t, k):
    want = least_distance(p, t)
    got = D.distance_in(p, t, k)
    assert (got is None) == (want > k) and (got is None or got[0] == want)


@settings(max_examples=80, deadline=None)
@given(st.text("abcde ", min_size=20, max_size=70), st.data())
def test_every_match_within_the_budget_is_found(item, data):
    item = D.normal(item)
    if len(item) < 12:
        return
    k = int(0.15 * len(item))
    text = list(item)
    for _ in range(k):
        at = data.draw(st.integers(0, len(text) - 1))
        how = data.draw(st.sampled_from(["put", "drop", "change"]))
        text[at : at + (how != "put")] = [] if how == "drop" else [data.draw(st.sampled_from("abcdexyz"))]
        if not text:
            return
    inside = "zz yy " + "".join(text) + " xx ww"
    found = D.Matcher([(1, item)], 0.15).find(inside)
    assert least_distance(item, inside) <= k and (k == 0 or found and found[0][1] <= k)


def test_leaks_and_clean_texts(spark):
    rng = random.Random(2)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(30))
    noise = lambda: " ".join("".join(rng.choice("ijklmnop") for _ in range(5)) for _ in range(40))
    words = item.split()
    edited = " ".join(words[:4] + ["changed"] + words[5:]).upper()
    docs = [(1, f"{noise()}\n{item}. {noise()}"), (2, noise() + " " + edited), (3, noise() + " " + " ".join(item.split()[:8]) + " " + noise()), (4, None), (5, ""), (1, item)]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "!?")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance > 0) for r in D.find_leaks(df, bench).collect())
    assert got == [(1, 7, False), (1, 7, False), (2, 7, True)]
    hit = D.find_leaks(df, bench).where("doc_id = 1 and start > 0").first()
    assert D.normal(docs[0][1])[hit.start : hit.end] == D.normal(item)
    assert sorted(r.doc_id for r in D.without_leaks(df, bench).collect()) == [3, 4, 5]
    assert D.find_leaks(df.limit(0), bench).count() == 0 and D.find_leaks(df, bench.limit(0)).count() == 0


def brute_force(items, docs, rate):
    """(doc, item, least distance) of what the contract of a match asks for, without pieces."""
    out = []
    for d, text in docs:
        t = D.normal(text)
        for i, item in items:
            p = D.normal(item)
            k = int(rate * len(p))
            if not p or not t:
                continue
            if k == 0:
                if f" {p} " in f" {t} ":
                    out.append((d, i, 0))
            elif (least := least_distance(p, t)) <= k:
                out.append((d, i, least))
    return sorted(out)


@pytest.mark.parametrize(("block", "held"), [(400_000, 1 << 24), (150, 700), (1, 1)])
def test_finds_equal_brute_force(spark, monkeypatch, block, held):
    monkeypatch.setattr(D, "PASS_CHARS", block)
    monkeypatch.setattr(D, "HELD_CHARS", held)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 8, 15])))) for i in range(12)]
    docs = []
    for d in range(40):
        text = [word() for _ in range(rng.randint(0, 25))]
        for _, item in rng.sample(items, rng.randint(0, 2)):
            part = list(item)
            for _ in range(rng.randint(0, len(part) // 7)):
                part[rng.randrange(len(part))] = rng.choice("abcd ")
            text.insert(rng.randint(0, len(text)), "".join(part))
        docs.append((d, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(df, bench, 0.1).collect()
    want = brute_force(items, docs, 0.1)
    assert sorted((r.doc_id, r.item_id) for r in got) == [w[:2] for w in want] and len(want) > 30
    # any match within the budget may be the one reported, the least one is never beaten
    least = {w[:2]: w[2] for w in want}
    budget = {i: int(0.1 * len(D.normal(t))) for i, t in items}
    assert all(least[r.doc_id, r.item_id] <= r.distance <= budget[r.item_id] for r in got)
    leaked = {w[0] for w in want}
    assert sorted(r.doc_id for r in D.without_leaks(df, bench, 0.1).collect()) == [d for d, _ in docs if d not in leaked]


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "PASS_CHARS", 60)
    items = [(i, " ".join(f"word{i}{j}" for j in range(6))) for i in range(5)]
    docs = spark.createDataFrame([(i, "start " + t + " end") for i, t in items], "doc_id long, text string")
    got = D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), 0.02)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(5)]
