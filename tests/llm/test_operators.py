"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tactus.llm import additive, arrow_files, bpe, components, jaccard, kneser_ney, neighbours, queries, sharding, suffixes, token_counts, toxicity

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "src", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 80))] for _ in range(25)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    hot = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(200, 280):
        words = list(hot)
        for _ in range(rng.choice([1, 1, 2, 7])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows + [(160, None), (161, ""), (162, " \n"), (None, "Unique words stand here alone today"), (None, rows[0][1]), rows[5], rows[5], (163, "long Text. " * 8_000), (164, "x" * 50_000)]


def test_bpe_round_trip(spark, odd):
    docs = docs_of(spark, odd).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    found = bpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert collections.Counter((r.doc_id, bytes(r.decoded)) for r in found) == collections.Counter((i, (t or "").encode()) for i, t in odd)
    encoded = bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in decoded) == sorted((str(i), (t or "").encode()) for i, t in odd)
    assert bpe.encode(docs.limit(0), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_token_counts(spark, odd):
    library = Tokenizer.from_file(WORD_BPE)
    found = token_counts.count_tokens(docs_of(spark, odd).withColumn("n_tokens", F.lit("x")), WORD_BPE).collect()
    expected = collections.Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in odd)
    assert collections.Counter(tuple(r) for r in found) == expected
    assert token_counts.count_tokens(docs_of(spark, odd[:0]), WORD_BPE).count() == 0


def test_arrow_files(spark, odd):
    library = Tokenizer.from_file(WORD_BPE)
    docs = docs_of(spark, odd)
    manifest = arrow_files.write(docs, WORD_BPE, 2, length=64)
    found = arrow_files.read_back(spark, manifest, docs).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    at = 0
    texts = collections.Counter()
    for r in found:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
        texts[r.doc_id, bytes(r.ids)] += 1
    encode = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert texts == collections.Counter((i, encode(t)) for i, t in odd)
    row = manifest.orderBy("part").first()
    file = arrow_files.TokenFile(row["tokens"])
    last = (row["n_tokens"] - 1) // 64
    sequence, mask = file.sequence(last)
    assert len(sequence) == 64 and mask.sum() == (row["n_tokens"] - 1) % 64 + 1 and file.sequence(0)[1].all()
    assert sequence.base is not None  # a view, not a copy
    empty = arrow_files.write(docs.limit(0), WORD_BPE, 2)
    assert arrow_files.read_back(spark, empty, docs).count() == 0


def test_shards(spark, odd):
    docs = docs_of(spark, odd).withColumn("shard", F.lit("clash"))
    placed, slots = sharding.shard(docs, 5)
    rows = placed.collect()
    assert len(rows) == len(odd) and slots.count() == sharding.SLOTS
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd)
    assert sharding.shard(docs.limit(0), 5)[0].count() == 0


def test_decontamination(spark, odd):
    item = odd[3][1].split()
    benchmark = spark.createDataFrame([(1, " ".join(item[2:14])), (2, None), (None, "unique WORDS"), (3, "..."), (3, "zz")], "item_id long, text string")
    docs = docs_of(spark, odd).withColumn("items", F.lit(1))
    found = {r.doc_id: r for r in suffixes.scan(docs, benchmark).collect()}
    window = " ".join(item[2:12])
    for i, t in odd:
        if i is not None:
            assert ("1" in found[i]["items"]) == (window in (t or "") or " ".join(item[3:13]) in (t or "") or " ".join(item[4:14]) in (t or ""))
    kept = suffixes.remove(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(r.n_hit == 0 for r in suffixes.scan(docs, benchmark).collect())
    many = suffixes.scan(docs, benchmark, block_bytes=40)  # several blocks give the same
    assert sorted((str(r.doc_id), r.n_hit, *r["items"]) for r in many.collect()) == sorted((str(r.doc_id), r.n_hit, *r["items"]) for r in suffixes.scan(docs, benchmark).collect())
    assert suffixes.scan(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert suffixes.scan(docs.limit(0), benchmark).count() == 0


def brute_groups(rows):
    sets = [set(jaccard.shingles((t or "").encode()).tolist()) for _, t in rows]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(n):
        groups[root(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return collections.Counter((rows[i][0], least[root(i)], links[i]) for i in range(n)), len(groups)


@pytest.mark.parametrize("small", [3, 12])
def test_large_buckets_equal_brute_force(spark, odd, small, monkeypatch):
    """Pivots, far members and pairs of blocks of buckets above `SMALL`."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    expected, _ = brute_groups(odd)
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.links(docs_of(spark, odd)).collect()) == expected


def test_jaccard_join_equals_brute_force(spark, odd):
    docs = docs_of(spark, odd).withColumn("key", F.lit("clash")).withColumn("bucket", F.lit(1))
    expected, groups = brute_groups(odd)
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.links(docs).collect()) == expected
    rows, linked = jaccard.near_classes(docs, block=30)  # components in several blocks
    got = rows.join(linked, "key", "left").select("doc_id", F.coalesce("group", "doc_id"), F.coalesce("links", F.lit(0)))
    assert collections.Counter(map(tuple, got.collect())) == expected
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == groups
    assert jaccard.links(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    names = list(range(400))
    rng.shuffle(names)
    path = [(names[i], names[i + 1]) for i in range(199)] + [(names[i], names[i + 1]) for i in range(200, 399)] + [(7, 7)]
    found = components.components(spark.createDataFrame(path, "u long, v long")).collect()
    assert {r.node: r.root for r in found} == {n: min(names[:200] if n in names[:200] else names[200:]) for n in names} and len(found) == 400
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_kneser_ney_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BUCKET_TOKENS", 900)
    monkeypatch.setattr(kneser_ney, "CHUNK_TOKENS", 500)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[:5] if rng.random() < 0.6 else words) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    rows += [(200, None), (201, "zz Qq w1 zz"), (None, "W1 w2\x0bw3")]
    docs = docs_of(spark, rows).repartition(5)
    model = kneser_ney.train_model(docs, ~F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)), span=16)
    split = lambda t: (t or "").lower().split() + ["</s>"]
    train = [split(t) for i, t in rows if i is None or i % 7 != 2]
    count = collections.Counter(w for t in train for w in t)
    total, distinct = sum(count.values()), len(count)
    pairs = collections.Counter(x for t in train for x in zip(["<s>"] + t, t))
    heads = dict(count) | {"<s>": len(train)}
    preceding = collections.Counter(w for _, w in pairs)
    times = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d, e = kneser_ney._discounts(times(pairs)), kneser_ney._discounts(times(preceding))
    cut = lambda x, by: 0 if x <= 0 else by[min(x, 3) - 1]
    share = sum(cut(x, e) for x in preceding.values()) / len(pairs) / (distinct + 1)
    held = collections.Counter()
    for (h, _), x in pairs.items():
        held[h] += cut(x, d)

    def p(w, h):
        low = max(preceding[w] - cut(preceding[w], e), 0) / len(pairs) + share
        return low if h not in heads else max(pairs[h, w] - cut(pairs[h, w], d), 0) / heads[h] + held[h] / heads[h] * low

    assert model.buckets > 1 and len(model.hot) and model.vocabulary.tokens == total
    assert abs(sum(p(w, "w1") for w in count) + p("<unk>", "w1") - 1) < 1e-9
    found = {r.doc_id: r for r in kneser_ney.score(docs, model).collect()}
    for i, t in rows:
        mine = split(t)
        assert found[i].n_tokens == len(mine) and found[i].n_known == sum(w in count for w in mine)
        assert abs(found[i].base_score - sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in mine)) < 1e-9
        assert abs(found[i].score - sum(math.log10(p(w, h)) for h, w in zip(["<s>"] + mine, mine))) < 1e-9
    empty = kneser_ney.train_model(docs.limit(0), F.lit(True))
    assert {r.score for r in kneser_ney.score(docs, empty).collect()} == {0.0}


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.7 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[400:700] = x[400]  # a third of the rows near one key
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [None] + [1.0] * 15), (5080, [float("nan")] * 16), (5100, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("score", F.lit(2))
    found = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    wide, recall = x.astype(float), []
    for q, got in found.items():
        s = (wide * wide[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        recall.append(len({v for v, _ in got} & set(best.tolist())) / 20)
        assert len(got) == 20 and all(abs(s[v] - y) < 1e-9 for v, y in got)
        assert got == sorted(got, key=lambda r: (-r[1], r[0]))
    assert np.mean(recall) >= 0.9
    few = neighbours.nearest(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert neighbours.nearest(df.limit(0), F.lit(True), 20).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_classifiers_on_held_out_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    quality = queries.QUERIES["op4_additive_quality"](spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
    assert (quality.predicted == quality.quality).mean() > 0.95


@pytest.mark.parametrize("sf, recall, precision", [("sf0.01", 0.6, 0.9), ("sf0.1", 0.92, 0.95)])
def test_toxicity_on_held_out_rows(spark, sf, recall, precision):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.fit(docs, labels)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = toxicity.score(docs, grammar).filter(held).join(labels.filter("toxic IS NOT NULL"), "doc_id").toPandas()
    hit = ((found.score >= 0.3) & (found.toxic == 1)).sum()
    assert hit / (found.toxic == 1).sum() >= recall and hit / (found.score >= 0.3).sum() >= precision
    score = lambda text: grammar.score(grammar.arcs(text.encode())[None])[0]
    clean = ["The pathway is closed.", "A pathology report.", "Die Worte sind alt.", "I will not call anyone an idiot.", "The trasport was late, a loss of days.", ""]
    assert max(map(score, clean)) < 0.3 < min(map(score, ["You are an idiot.", "—Idiot!—", "They are pathetic losers.", "you stupid clown"]))
    assert score("You are an idiot.") > score("plain words and one idiot more in a long line") > score("It was not an idiot at all.")


def test_classifiers_without_labels(spark, odd):
    docs, none = docs_of(spark, odd), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, found = additive.fitted(docs, none)
    assert {r.score for r in additive.score(found, model).collect()} == {0.5}
    grammar = toxicity.fit(docs, none)
    assert toxicity.score(docs, grammar).filter("score >= 0.3").count() == 0
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(150)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    model, found = additive.fitted(docs, labels)
    assert additive.score(found, model).count() == len(odd) and additive.keep_good(docs, model).columns == docs.columns
    assert additive.score(found.limit(0), model).count() == 0


def test_queries_match_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in queries.QUERIES["op1_byte_bpe"](spark, sf).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        ids = library.encode_ordinary(t or "")
        assert found[i].n_tokens == len(ids) and found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
