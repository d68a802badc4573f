"""Token counts of whole texts; huge ones are encoded in overlapping chunks and resynchronised.

A text above `HUGE` characters is cut into chunks that overlap. Every chunk is encoded with offsets. In an overlap both
encodings must begin a token at the same character, after a white space, and agree on `AGREE` tokens (ids and offsets)
on either side, as far as the overlap holds so many. There the left chunk's tokens end and the right chunk's begin.
White space is a border that no step of the tokenizer crosses, so such a place is a token border of the whole text too.
If an overlap has no such place, it is doubled and both chunks are encoded anew, in the end as one; then the next step is
as long as that chunk.

Other texts are cut at white space, where the same border holds, and each distinct piece is encoded once.
Tokenizers for which that isn't certain get whole texts.

Null and empty texts have no tokens; a text of white space only has none either. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tactus.llm.common import as_bytes, slices, text_bytes, vocabulary_bytes
from tactus.llm.pieces import Pieces

HUGE = 32_768
CHUNK = 8_192
OVERLAP = 256
AGREE = 4


def _border(text: str, left: list, right: list, start: int, end: int) -> int | None:
    """The first character in the overlap at which both encodings agree, or None.

    left, right: (offset, end, id) with offsets of the whole text; tokens that touch the overlap's ends are not trusted.
    """
    ours = [t for t in left if start < t[0] and t[1] < end]
    theirs = [t for t in right if start < t[0] and t[1] < end]
    where = {t[0]: i for i, t in enumerate(theirs)}
    for i, (at, _, _) in enumerate(ours):
        j = where.get(at)
        if j is None or not text[at - 1].isspace():
            continue
        back, ahead = min(AGREE, i, j), AGREE
        if ours[i - back:i] == theirs[j - back:j] and ours[i:i + ahead] == theirs[j:j + ahead] and len(ours[i:i + ahead]) == ahead:
            return at
    return None


def spliced(text: str, library, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a huge text from overlapping chunks."""
    def tokens(start: int, end: int) -> list:
        e = library.encode(text[start:end], add_special_tokens=False)
        return [(start + a, start + b, i) for (a, b), i in zip(e.offsets, e.ids)]

    n = len(text)
    out: list[int] = []
    start, end, step = 0, min(n, chunk), chunk
    left = tokens(start, end)
    begin = 0  # character from which the left chunk's tokens count
    while end < n:
        wide = overlap
        while True:
            from_, to = max(start, end - wide), min(n, end + step)
            right = tokens(from_, to)
            at = _border(text, left, right, from_, end)
            if at is not None and at >= begin:
                break
            if from_ == start:  # no border in the whole chunk: encode both as one
                at = None
                break
            wide *= 2
        if at is None:
            end, left = to, right
            step = end - start  # the chunk doubles, so all that is encoded in vain is a fixed number of times its length
            continue
        out += [i for a, _, i in left if begin <= a < at]
        left, begin, start, end, step = right, at, from_, to, chunk
    return out + [i for a, _, i in left if a >= begin]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(vocabulary_bytes(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value
        worker.prepare()
        width = worker.dtype.itemsize
        for batch in batches:
            for part in slices(batch, 1):
                raw = as_bytes(part.column(1))
                counts = [0] * len(raw)
                small = [i for i, x in enumerate(raw) if len(x) <= huge or not worker.safe]
                for i, ids in zip(small, worker.encode([raw[i] for i in small])):
                    counts[i] = len(ids) // width
                for i, x in enumerate(raw):
                    if len(x) > huge and worker.safe:
                        counts[i] = len(spliced(x.decode("utf-8", "replace"), worker.library))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(counts, pa.int64())],
                    schema=pa.schema([("doc_id", part.column(0).type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())]))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes(text_col).alias("raw")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
