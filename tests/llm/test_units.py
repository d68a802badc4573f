"""Operators' inner functions against brute force and the public libraries."""

import base64
import collections
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tactus.llm import additive, bpe, jaccard, pieces, sharding, suffixes, token_counts, toxicity
from tactus.llm.bpe import Encoder, PerfectHash
from tactus.llm.common import slices
from tactus.llm.pieces import Pieces
from tactus.llm.token_counts import spliced

RANKS = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
WORD_BPE = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()


def some_text(rng, alphabet, extra, most):
    return "".join(rng.choice(alphabet) if rng.random() < 0.85 else rng.choice(extra) for _ in range(rng.randint(0, most)))


@pytest.fixture(scope="module")
def encoder():
    return Encoder(RANKS, public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    found = PerfectHash(keys, list(range(3000)))
    assert [found.get(k) for k in keys] == list(range(3000)) and len(found.keys) == 3000
    assert found.get(b"absent") is None and PerfectHash([], []).get(b"x") is None


def test_bpe_equals_tiktoken(encoder):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [some_text(rng, "ab 's\n\t .,éß漢字🙂１2  \x1cć'TlL", [" ", "<|endoftext|>", "   "], 20) for _ in range(3000)]
    for text in [*texts, "", " ", "abc" * 50_000, "word " * 3000, "\x00", "a  b "]:
        ids = encoder.encode(text.encode())
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_pieces_and_splices_equal_the_library():
    pieces, rng = Pieces(WORD_BPE), random.Random(2)
    pieces.prepare()
    library = Tokenizer.from_str(WORD_BPE.decode())
    assert pieces.safe
    extra = ["<|endoftext|>", "<|STARTOFTEXT|>", "'ll", "!!,", " ́"]
    for _ in range(1500):
        text = some_text(rng, "aBé.,!;'s \n\t <|>1１́Σİ漢🙂", extra, 20)
        assert np.frombuffer(pieces.encode([text.encode()])[0], pieces.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    for _ in range(200):
        text = some_text(rng, "aBé.,!;'s \n\t <|>1１́Σİ漢🙂", extra, 500)
        assert spliced(text, library, 64, 8) == library.encode(text, add_special_tokens=False).ids
    text = "ab" * 20_000 + " c d " + "é" * 3_000
    assert spliced(text, library, 2048, 64) == library.encode(text, add_special_tokens=False).ids


def brute_hits(texts, items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
    out = []
    for words in map(split, texts):
        hit, found = set(), set()
        for name, item in ((n, split(t)) for n, t in items):
            width = min(window, len(item))
            for i in range(len(item) - width + 1 if item else 0):
                for p in range(len(words) - width + 1):
                    if words[p:p + width] == item[i:i + width]:
                        found.add(name)
                        hit.update(range(p, p + width))
        out.append((len(words), len(hit), found))
    return out


def test_suffix_search_equals_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        letters, window = "Abcdeé"[:rng.choice([2, 3, 6])], rng.choice([2, 3, 4])
        text = lambda most: " ".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
        texts, items = [text(25) for _ in range(rng.randint(0, 6))], [(str(rng.randint(0, 4)), text(7)) for _ in range(rng.randint(0, 6))]
        half = len(items) // 2
        blocks = [suffixes.Block([(n, t.encode()) for n, t in some], window) for some in (items[:half], items[half:])]
        shard = suffixes.Shard([t.encode() for t in texts])
        n_hit, found, matches = suffixes.hits(shard, iter(blocks))
        assert list(zip(shard.n.tolist(), n_hit.tolist(), found)) == brute_hits(texts, items, window)
        for d, of in enumerate(matches):
            for _, _, start, n in of:
                assert n >= 1 and start + n <= shard.n[d]


def test_longest_match_reaches_beyond_the_window():
    item = "one two three four five six seven"
    shard = suffixes.Shard([b"x one two three four five y", b"six seven"])
    _, _, matches = suffixes.hits(shard, iter([suffixes.Block([("q", item.encode())], 3)]))
    assert ("q", 0, 1, 5) in matches[0] and matches[1] == []


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_and_rows(0.8, 0.9999)
    assert bands * rows <= jaccard.MOST_HASHES and 1 - (1 - 0.8 ** rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        jaccard.bands_and_rows(0.01, 0.9999, 4)


def test_shared_counts_equal_sets():
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(1, 40))], np.uint64)) for _ in range(30)]
    got = jaccard._shared(sets)
    assert all(got[i, j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(sets) for j, b in enumerate(sets))


def test_short_texts_have_one_shingle():
    assert len(jaccard.shingles(b"a b")) == 1 and len(jaccard.shingles(b"...")) == 0 and jaccard.set_key(jaccard.shingles(b"")) is None


def test_slot_maps_balance_and_move_little():
    rng = random.Random(4)
    sizes = [(s, rng.randint(0, 100), 1) for s in range(500)]
    first = sharding.first_map(sizes, 7)
    load = collections.Counter()
    for _, slot, shard, size, _ in first:
        load[shard] += size
    assert max(load.values()) - min(load.values()) <= 100
    grown = sharding.rebalanced(first, sizes, 8)
    moved = [(a, b) for a, b in zip(first, grown) if a[2] != b[2]]
    assert {r[0] for r in grown} == {1} and 0 < len(moved) < 120 and sum(b[2] == 7 for _, b in moved) > len(moved) // 2
    shrunk = sharding.rebalanced(grown, sizes, 5)
    assert {r[2] for r in shrunk} == set(range(5)) and {r[0] for r in shrunk} == {2}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = additive.fit(x, y, rounds=20, pairs=2)
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1) and ((model.score(x) > 0.5) == y).mean() > 0.9
    one = additive.fit(x, np.ones(4000))
    assert (one.score(x) > 0.99).all() and len(additive.features_of(b"")) == len(additive.FEATURES)


def test_grammar_arcs():
    grammar = toxicity.Grammar()
    arc = lambda text: [round(float(x), 2) for x in grammar.arcs(text.encode())[:toxicity.ARCS]]
    lone, predicate, targeted = ([float(k == j) for j in range(6)] for k in range(3))
    assert arc("What a plain old idiot word.") == lone and arc("This stone is an idiot of some kind.") == predicate and arc("Idiot!") == predicate
    assert arc("You are an idiot.") == targeted and arc("Only an idiot, you said it.") == targeted and arc("I will kill you.") == [0, 0, 0, 0, 0, 1]
    assert arc("nobody near here is an idiot")[1] == toxicity.MUTED and arc("it said \"idiot\" aloud in a long line")[0] == toxicity.MUTED
    assert arc("a fine day") == [0] * 6
    score = lambda text: grammar.score(grammar.arcs(text.encode())[None])[0]
    assert score("You idiot!") > 0.3 > max(score(""), score("one lone idiot word in a line of others"), score("not an idiot by any means"))


@pytest.mark.parametrize("text", ["„idiot“", "«idiot»", "“idiot”", "‘idiot’", "‹idiot›", "¡idiota!", "¿idiota?", "—idiot—", "idiot…", "don’t be an idiot", "\u3010idiot\u3011"])
def test_marks_outside_ascii_part_words(text):
    assert toxicity.Grammar().arcs(text.encode())[toxicity.ARCS] == 1


def test_one_machine_does_what_its_parts_do():
    rng = random.Random(2)
    parts = [toxicity._fading(toxicity.NEGATION, 3), toxicity.REPORTED, toxicity.NEAR_TARGET]
    whole = toxicity.composed(parts)
    for _ in range(200):
        symbols = [rng.randrange(8) for _ in range(rng.randint(0, 20))]
        assert whole(symbols) == [sum(bool(b) << k for k, b in enumerate(bits)) for bits in zip(*(m(symbols) for m in parts))]


def test_weights_keep_the_order_of_the_arcs():
    rng = np.random.default_rng(4)
    sums = np.zeros((400, toxicity.ARCS + 2))
    sums[:, 7] = 50
    sums[np.arange(400), rng.integers(0, 3, 400)] = 1
    y = (sums[:, 0] > 0).astype(float)  # labels that would put lone words first
    w = toxicity._logistic(toxicity.features(sums), y, toxicity.Grammar().weights)
    assert (w >= toxicity.LEAST).all() and (w <= toxicity.MOST).all()
    one = np.zeros((3, toxicity.ARCS + 2))
    one[[0, 1, 2], [0, 1, 2]], one[:, 7] = 1, 50
    scores = toxicity.Grammar(weights=w).score(one)
    assert scores[0] < scores[1] < scores[2]


def test_slices_hold_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in (5, 0, 20, 3, 3)], pa.binary())], ["raw"])
    assert [s.num_rows for s in slices(batch, 0, 8)] == [2, 1, 2]


def test_unbroken_text_is_encoded_a_few_times():
    """Without any border chunks double: the characters encoded grow in proportion to the text."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    spent = []

    class Counting:
        def encode(self, text, **options):
            spent[-1] += len(text)
            return library.encode(text, **options)

    for n in (4_000, 16_000):
        spent.append(0)
        text = "abcdefghij" * (n // 10) + " tail words here " * 20
        assert token_counts.spliced(text, Counting(), 500, 64) == library.encode(text, add_special_tokens=False).ids
    assert spent[1] < 6 * spent[0] and spent[1] < 40 * 16_000


def test_two_generations_of_pieces(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PIECES", 40)
    path = public_tokenizers.path("word_bpe_49k.json")
    worker, library = pieces.Pieces(open(path, "rb").read()), Tokenizer.from_file(path)
    texts = [f"some words word{i % 7} number{i}, and-more{i % 11}! {'z' * (60 + i)}" for i in range(60)]
    for i in range(0, 60, 6):
        got = worker.encode([t.encode() for t in texts[i:i + 6]])
        assert [np.frombuffer(x, worker.dtype).tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[i:i + 6]]
        assert len(worker.kept) + len(worker.last) < 120


def test_two_generations_of_a_table():
    made = []
    table = bpe.Bounded(lambda k: made.append(k) or len(k), 6)
    for key in "a b c d a b e f a".split():
        assert table[key] == 1
    assert len(table) <= 3 and made.count("a") == 1
