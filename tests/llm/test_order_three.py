"""Kneser-Ney scores of order 3 equal brute force."""

import collections
import math
import random

from pyspark.sql import functions as F

from tactus.llm import kneser_ney


def test_order_three_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BUCKET_TOKENS", 900)
    monkeypatch.setattr(kneser_ney, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(kneser_ney, "MAPPED_BYTES", 1000)
    monkeypatch.setattr(kneser_ney, "HOT_SHARE", 0.1)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words[:4] if rng.random() < 0.6 else words) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    rows += [(200, None), (201, "zz w1 w2 qq w1"), (205, "w1 w1 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = kneser_ney.train_model(docs, F.col("doc_id") % 7 != 2, span=16, order=3)
    split = lambda t: (t or "").split() + ["</s>"]
    train = [split(t) for i, t in rows if i % 7 != 2]
    words_of = collections.Counter(w for t in train for w in t)
    tri = collections.Counter(x for t in train for x in zip(["<s>", "<s>"] + t, ["<s>"] + t, t))
    mid = collections.Counter((v, w) for _, v, w in tri)
    low = collections.Counter(w for _, w in mid)
    times = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    by = [kneser_ney._discounts(times(c)) for c in (low, mid, tri)]
    cut = lambda x, d: 0 if x <= 0 else d[min(x, 3) - 1]
    share = sum(cut(x, by[0]) for x in low.values()) / len(mid) / (len(words_of) + 1)

    def level(counts, head, w, d, p):
        own = {k[-1]: x for k, x in counts.items() if k[:-1] == head}
        total = sum(own.values())
        return max(own.get(w, 0) - cut(own.get(w, 0), d), 0) / total + sum(cut(x, d) for x in own.values()) / total * p if total else p

    def p(u, v, w):
        one = max(low[w] - cut(low[w], by[0]), 0) / len(mid) + share
        return level(tri, (u, v), w, by[2], level(mid, (v,), w, by[1], one))

    assert model.buckets > 1 and len(model.upper.hot)
    assert abs(sum(p("w1", "w2", w) for w in words_of) + p("w1", "w2", "?") - 1) < 1e-9
    found = {r.doc_id: r.score for r in kneser_ney.score(docs, model).collect()}
    known = {}
    for i, t in rows[:30] + rows[-3:]:
        mine = split(t)
        want = 0.0
        for x in zip(["<s>", "<s>"] + mine, ["<s>"] + mine, mine):
            if x not in known:
                known[x] = math.log10(p(*x))
            want += known[x]
        assert abs(found[i] - want) < 1e-9
    empty = kneser_ney.train_model(docs.limit(0), F.lit(True), order=3)
    assert {r.score for r in kneser_ney.score(docs, empty).collect()} == {0.0}
