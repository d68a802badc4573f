"""Words of a slice are numbered right whatever stands between them; merging packed counts holds few arrays at once."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash

from tactus.llm import kneser_ney


def test_merging_packed_counts_is_lean():
    rng = np.random.default_rng(1)
    made = [np.unique(rng.integers(0, 1 << 40, 20_000).astype(np.uint64), return_counts=True) for _ in range(30)]
    table = pa.Table.from_pylist([kneser_ney._packed(0, *x) for x in made])
    tracemalloc.start()
    keys, counts = kneser_ney._unpacked(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(keys, np.unique(np.concatenate([k for k, _ in made]))) and counts.sum() == 600_000
    assert peak < 52 * len(keys)  # bytes: keys, their order, counts and what replaces them


def test_words_before_several_blanks():
    rng = random.Random(4)
    for _ in range(300):
        raw = [bytes(rng.choice(b"aAbB \t\n\x0b\x0c\r.\xc3\x00") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        hashes, at, lengths = kneser_ney.tokens(raw)
        split = [re.findall(rb"[^\x20\x09-\x0D]+", x.lower()) for x in raw]
        assert lengths.tolist() == [len(x) + 1 for x in split]
        assert hashes[at].tolist() == [h for x in split for h in [*map(xxhash.xxh3_64_intdigest, x), kneser_ney.END]]
