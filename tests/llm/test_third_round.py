"""Fingerprint groups, product codes and collocations against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tactus.llm import codes, collocations, vantage

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = rng.choice(base).split()
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\t", "\n", "  "]).join(words), rng.choice(["en", "de", None])))
    return rows + [(400, None, "en"), (401, "", None), (402, " \n\t", "en"), (403, "ÉCOLE École a.b", "fr"), (None, rows[0][1], "en"), (None, "only here nobody else", "en"),
                   rows[7], rows[7], (404, "x y " * 70_000, "en"), (405, "q" * 100_000, "en")]


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    x = np.array(fps, np.uint64)
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2):
        parent[root(int(i))] = root(int(j))
    groups = collections.defaultdict(list)
    for i, d in enumerate(ids):
        groups[root(i)].append(d)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(x))]


def test_fingerprint_groups(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, DOCS).withColumn("fp", F.lit("clash")).withColumn("leaf", F.lit(1))
    fps = [brute_fingerprint(t) for _, t, _ in texts]
    expected = collections.Counter(zip([i for i, _, _ in texts], fps, brute_components([i for i, _, _ in texts], fps)))
    got = lambda: collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in vantage.groups(docs).collect())
    assert got() == expected
    monkeypatch.setattr(vantage, "LEAF", 20)  # several levels of trees
    monkeypatch.setattr(vantage, "WINDOW", 100)
    assert got() == expected
    assert vantage.groups(docs.limit(0)).count() == 0


def test_dense_fingerprints(spark, monkeypatch):
    """A cluster that no tree divides, and blocks of a leaf."""
    monkeypatch.setattr(vantage, "LEAF", 50)
    monkeypatch.setattr(vantage, "CELLS", 500)
    rng = np.random.default_rng(1)
    centre, far = np.uint64(0x123456789ABCDEF0), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in rng.integers(0, 5, 700)]
    x = np.unique(np.concatenate((far, np.array([centre ^ f for f in flips], np.uint64), far[:50] ^ np.uint64(3))))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for block in (80, 1 << 20):
        found = vantage.edges(fps, block=block).collect()
        index = {int(v): i for i, v in enumerate(x.view(np.int64))}
        label = vantage.merged(np.arange(len(x)), np.array([index[r.u] for r in found]), np.array([index[r.v] for r in found]))
        assert label.tolist() == brute_components(list(range(len(x))), x)
        assert all(np.bitwise_count(np.uint64(r.u % (1 << 64)) ^ np.uint64(r.v % (1 << 64))) > 0 for r in found)


def test_visits_are_few(spark):
    x = np.random.default_rng(2).integers(0, 1 << 63, 4_000, dtype=np.uint64)
    tree = vantage.grow(x[:1_000], 64)
    row, leaf, home = vantage.route(tree, x, np.full(len(x), True))
    assert sorted(row[home]) == list(range(len(x))) and len(np.unique(leaf)) > 8
    assert len(row) < 16 * len(x)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted(((i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    books = [[v[p * width:(p + 1) * width] for _, v in kept[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, v in kept:
            row = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(v[p * width:(p + 1) * width], e)) for e in books[p]]
                row.append((d.index(min(d)), min(d)))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * width:(p + 1) * width] for (_, v), row in zip(kept, found) if row[p][0] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, bytes(k for k, _ in row), sum(d for _, d in row)) for (i, _), row in zip(kept, assign())), digest


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e10])
def test_product_codes(spark, scale):
    rng = random.Random(3)
    rows = [(i, [rng.choice([rng.gauss(0, 1), -0.0005, 0.25]) * scale for _ in range(8)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0] * 7 + [None], 1), (302, [math.nan] * 8, 2), (303, [math.inf] * 8, 2), rows[5], rows[5], (2, [0.0] * 8, None), (None, [1.0] * 8, 1), (304, [], 1)]
    rows = [r for r in rows if r[1] != []]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).repartition(3)
    expected, digest = brute_codes(rows, entries=40)
    model = codes.fit(vectors, entries=40)
    assert model.digest() == digest
    found = codes.with_label_error(codes.encode(vectors, model, keep=("label",))).collect()
    fits = lambda e: e if e < 1 << 63 else None
    assert collections.Counter((r.vec_id, bytes(r.code), r.error) for r in found) == collections.Counter({(i, c, fits(e)): n for (i, c, e), n in expected.items()})
    if scale < 1e9:
        total = collections.Counter()
        for r in found:
            total[r.label] += r.error
        assert all(r.label_error == total[r.label] for r in found)


def test_limbs_are_exact():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-1 << 28, 1 << 28, (20, 16)), rng.integers(-1 << 28, 1 << 28, (30, 16))
    assert (codes.dots(a, b) == a @ b.T).all()
    assert len(codes.limbs(a, 24)) == 2
    a = np.array([[-1 << 24, (1 << 24) - 1, 1 << 24, 0]])
    assert (sum(x.astype(np.int64) << 24 * k for k, x in enumerate(codes.limbs(a, 24))) == a).all()


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert codes.fit(empty) is None
    assert codes.with_label_error(codes.encode(empty, None, keep=("label",))).count() == 0
    uneven = spark.createDataFrame([(1, [1.0] * 6)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        codes.fit(uneven)


def brute_phrases(rows, support=30, top=2_000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        inside = collections.defaultdict(int)
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i:i + size]] = max(inside[p[i:i + size]], a)
        best = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, b" ".join(p), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 26, 2_500, 600])
def test_collocations(spark, texts, shard_bytes, monkeypatch):
    """One shard a language; several, with candidates to be counted again; more shards than the support."""
    monkeypatch.setattr(collocations, "PART", 300)
    monkeypatch.setattr(collocations, "SENT", 70)
    rng = random.Random(8)
    rows = [r for r in texts if len(r[1] or "") < 10_000]
    rows += [(500 + i, " ".join(rng.choice(["red fox", "Red  Fox ran", "ran off.", "red\tfox ran home", "home; the", "é\\x"]) for _ in range(rng.randint(1, 9))), rng.choice(["fr", "es", None])) for i in range(250)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(0)).repartition(5)
    assert sorted(map(tuple, collocations.collocations(docs, shard_bytes=shard_bytes).collect())) == brute_phrases(rows)
    assert collocations.collocations(docs, shard_bytes=shard_bytes, support=45, top=5).count() == len(brute_phrases(rows, 45, 5))


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, " .\n", None)], DOCS)
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.limit(0)).count() == 0
