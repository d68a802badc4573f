"""What travels and what a task holds stays bounded."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash

from tactus.llm import kneser_ney, neighbours, pieces


def vectors(spark, n, dim=16):
    x = np.random.default_rng(3).standard_normal((n, dim)).astype("<f4")
    return x, spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "node long, full binary")


def test_first_neighbours_travel_as_lists(spark):
    """A node and a cell it is in make one row, however many neighbours the cell gives."""
    x, nodes = vectors(spark, 600)
    rows = neighbours._first_edges(nodes, x[:neighbours.DRAWS * 3], 16, 7).toArrow()
    assert len(rows) <= 600 * neighbours.DRAWS * neighbours.CELLS
    sizes = [len(r) // 8 for r in rows["near"].to_pylist()]
    assert sizes == [len(r) // 4 for r in rows["sims"].to_pylist()] and max(sizes) == neighbours.LEAF_BEST
    for node, near, sims in zip(*(rows[c].to_pylist()[:50] for c in ("node", "near", "sims"))):
        np.testing.assert_allclose(x[np.frombuffer(near, "<i8")] @ x[node], np.frombuffer(sims, "<f4"), rtol=1e-4, atol=1e-5)


def test_rows_meet_all_pivots_in_steps():
    batch = pa.record_batch([pa.array(range(1_300))], ["node"])
    parts = list(neighbours._steps([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= neighbours.STEP
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(1_300))


def test_packed_numbers_of_slices_and_chunks():
    raw = [np.arange(k, k + 3, dtype="<i8").tobytes() for k in range(6)]
    column = pa.chunked_array([pa.array(raw[:4]).slice(1), pa.array([None, b""], pa.binary()), pa.array(raw[4:])])
    assert neighbours._flat(column, "<i8").tolist() == [j for k in range(1, 6) for j in range(k, k + 3)]
    assert neighbours._matrix(pa.array(raw), "<i8").shape == (6, 3)


def test_proposals_per_node_do_not_grow_with_the_table(spark):
    """A node's proposals are a row per place it goes to, at most DEGREE a round, however many bundles there are."""
    for n in (500, 2_500):
        x, nodes = vectors(spark, n)
        graph = neighbours._kept(nodes, None, neighbours._first_edges(nodes, x[:24], 16, 7), n // 100).cache()
        for bundles in (1, n // 100):
            rows = neighbours._proposed(graph, bundles, 0).toArrow()
            assert len(rows) <= n * neighbours.DEGREE
            per_place = len(rows) if bundles == 1 else per_place
        assert abs(len(rows) - per_place) < 0.05 * per_place  # not fewer because bundles are few
        graph.unpersist()


def test_pieces_met_again_are_not_encoded_again(monkeypatch):
    """Pieces that come back after slices without them are still known, and what is kept stays bounded."""
    monkeypatch.setattr(pieces, "KEPT_PIECES", 400)
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        worker = pieces.Pieces(file.read())
    word = lambda n: "".join(chr(97 + n // 26 ** k % 26) for k in range(4))
    common = " ".join(word(n) for n in range(100))
    rare = lambda k: " ".join(word(1_000 + 200 * k + n) for n in range(200))
    worker.encode([common.encode()])
    worker.encode([common.encode()])
    sizes = []
    for k in range(8):
        worker.encode([rare(k).encode()])
        sizes.append(len(worker.kept))
    assert max(sizes) <= 400 and all(word(n).encode() in worker.kept for n in range(100))
    texts = [common, rare(0) + "?! " + common, rare(7), "", "x" * 100, common]
    plain = worker.library.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(x, worker.dtype).tolist() for x in worker.encode([t.encode() for t in texts])] == [e.ids for e in plain]


def test_each_different_word_of_a_slice_is_hashed_once(monkeypatch):
    raw = ["A b\tc  A".encode(), b"", b" \n", "É é\x0bz\x1cz\xa0".encode(), b"b" * 5_000, b"a\x00 \xff\xfe a", b"", b" b c "]
    asked, plain = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(kneser_ney.xxhash, "xxh3_64_intdigest", lambda w: asked.append(w) or plain(w))
    hashes, at, lengths = kneser_ney.tokens(raw)
    split = [re.findall(rb"[^\x20\x09-\x0D]+", x.lower()) for x in raw]
    assert lengths.tolist() == [len(x) + 1 for x in split]
    assert hashes[at].tolist() == [h for x in split for h in [*map(plain, x), kneser_ney.END]]
    assert sorted(asked) == sorted({w for x in split for w in x}) and (np.diff(hashes.astype(float)) > 0).all()
    assert [len(x) for x in kneser_ney.tokens([])] == [1, 0, 0]


def test_scoring_looks_up_each_different_word_and_bigram_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d{i % 7} a b a") for i in range(60)], "doc_id long, text string")
    model = kneser_ney.train_model(docs, docs.doc_id >= 0, order=3)
    asked, plain = [], kneser_ney._dense
    monkeypatch.setattr(kneser_ney, "_dense", lambda files, span, number: asked.append(len(number)) or plain(files, span, number))
    one = model.score([b"a b c d1 a b a"])
    asked_one, _ = asked[:], asked.clear()
    many = model.score([b"a b c d1 a b a"] * 50)
    assert asked == asked_one and len(asked) == 3  # words, heads of bigrams, heads of trigrams
    assert all(np.array_equal(np.repeat(x, 50), y) for x, y in zip(one, many))
