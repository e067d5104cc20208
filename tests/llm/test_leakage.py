import random

import numpy as np
import pytest
import regex
from plenarium.llm import leakage as L


def split(text):
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def brute(docs, items, k=12):
    grams = [(d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) for d, t in docs if t is not None for w in [split(t)]]
    return {(d, i) for i, t in items if t for w in [split(t)] for d, g in grams if any(tuple(w[j : j + k]) in g for j in range(len(w) - k + 1))}


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words").repartition(3), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")


def find(spark, docs, items):
    c, b = frames(spark, docs, items)
    return L.leaked_passages(c, "doc_id", "text", b, "item_id", "text")


def make(seed=2, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]  # few words, so that long chance repeats occur
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, say(rng.randint(5, 40))) for i in range(20)] + [(98, None), (99, "")]
    docs = []
    for d in range(n):
        text = say(rng.randint(0, 60))
        if rng.random() < 0.5:
            ws = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(ws))
            text += " " + " ".join(ws[a : a + rng.randint(1, 20)]).upper() + " " + say(rng.randint(0, 9))
        docs.append((d, text))
    return docs + [(1000, None), (1001, ""), (1002, docs[0][1])], items


@pytest.mark.parametrize("shard,block", [(400_000, 5_000), (300, 7)])
def test_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(L, "SHARD", shard)
    monkeypatch.setattr(L, "BLOCK", block)
    docs, items = make()
    got = find(spark, docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items)
    texts, own = dict(docs), {i: split(t) for i, t in items if t}
    for r in got:  # each span is a passage of the item, and cannot be longer on either side without leaving it
        span = split(texts[r["doc_id"]])[r["first_word"] : r["first_word"] + r["n_words"]]
        assert len(span) == r["n_words"] >= 12
        grams = {tuple(own[r["item_id"]][i : i + 12]) for i in range(len(own[r["item_id"]]) - 11)}
        assert tuple(span[:12]) in grams and tuple(span[-12:]) in grams


def test_boundaries(spark):
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words))]
    docs = [(1, "X " + "; ".join(words[3:15])), (2, " ".join(words[3:14])), (3, " ".join(words[:6]) + " x " + " ".join(words[6:17])), (4, " ".join(words[:8])), (5, " ".join(words[8:16])), (6, "W0-W1_" + "\n".join(words[2:12]))]
    assert {r["doc_id"] for r in find(spark, docs, items).collect()} == {1, 6}


def test_empty(spark):
    assert find(spark, [], [(1, "a " * 20)]).count() == find(spark, [(1, "a " * 20)], []).count() == find(spark, [(1, None)], [(1, None)]).count() == 0


def test_one_document_longer_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 50)
    passage = " ".join(f"q{i}" for i in range(20))
    got = find(spark, [(1, "other words " * 400 + passage + " end" * 300)], [(7, passage)]).collect()
    assert [tuple(r) for r in got] == [(1, 7, 800, 20)]


def test_index_counts_and_places():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 6, 500), 0).astype(np.int32)
    index = L.FMIndex(text, 6)
    patterns = rng.integers(2, 6, (200, 3)).astype(np.int32)
    hit, low, high = index.search(patterns)
    found = {tuple(patterns[h]): sorted(index.locate(np.arange(a, b))) for h, a, b in zip(hit, low, high)}
    for p in {tuple(x) for x in patterns}:
        assert found.get(p, []) == [i for i in range(498) if tuple(text[i : i + 3]) == p]
