"""What leaves the shards of the phrase miner, which were as many rows as phrases that reach a shard's share of the support."""

import collections
import random

from pyspark.sql import functions as F

from tactus.llm import collocations as phrases


def corpus(n):
    rng = random.Random(5)
    return [(i, " ".join(f"w{int(400 ** rng.random())}" for _ in range(100)), "en") for i in range(n)]


def test_what_leaves_the_shards(spark, monkeypatch):
    """Packed rows leave, a few for each shard and bucket, with no phrase whose beginning or rest is rare; counts are exact."""
    settled, seen = phrases._settled, []

    def spy(leaves, support, words):
        seen.append(leaves.agg(F.count("*"), F.sum("n")).first())
        return settled(leaves, support, words)

    monkeypatch.setattr(phrases, "_settled", spy)
    rows, size = corpus(750), 20_000
    found = phrases.frequent(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), shard_bytes=size)
    counts = collections.Counter()
    for _, text, _ in rows:
        words = text.split()
        counts.update(tuple(words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert {(r["n"], r["phrase"]): r["f"] for r in found.filter("n > 0").collect()} == {(len(p), " ".join(p)): f for p, f in counts.items() if f >= phrases.SUPPORT}
    shards = -(-sum(len(text) for _, text, _ in rows) // size)
    often = lambda p: counts[p] >= phrases.SUPPORT
    going = [sum(f for p, f in counts.items() if len(p) == k and (k == 1 or often(p[:-1]) and often(p[1:]))) for k in range(1, 5)]
    for (sent, keys), most in zip(seen, going, strict=True):
        assert sent <= shards * shards * phrases.BUCKETS and (keys or 0) <= most
