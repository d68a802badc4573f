"""Ids of pieces of text from the tokenizers library, each distinct piece encoded once.

For a word tokenizer that drops white space, white space is a hard border: normalization, the pre-token pattern and the
special strings never reach across it, so a text's ids are those of its pieces in a row. `Pieces.safe` holds only if
the tokenizer's description says so; otherwise texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Pieces whose ids a worker keeps; when they are more, those met in one slice of texts only go.
KEPT_PIECES = 600_000
#: Pieces handed to the library at a time.
BULK = 4_000
LONGEST_KEPT = 64
#: ASCII white space to space, A-Z to a-z; for texts without special strings.
PLAIN = bytes(32 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Letters, then marks that end a word in the pattern of such tokenizers.
TAIL = re.compile(rb"([a-z]+)([.,;:!?]+)")


class Pieces:
    def __init__(self, description: bytes, name: str = "pieces"):
        self.description, self.name, self.library = description, name, None

    def __getstate__(self):
        return {"description": self.description, "name": self.name, "library": None}

    def prepare(self) -> None:
        if self.library is not None:
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(self.description.decode())
        self.library.no_truncation()
        self.library.no_padding()
        about = json.loads(self.description)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        steps = json.dumps(about.get("pre_tokenizer") or {})
        normal = json.dumps(about.get("normalizer") or {})
        special = about.get("added_tokens") or []
        self.safe = (
            '"behavior": "Removed", "invert": true' in steps and "[^\\\\s" in steps and '"Lowercase"' in normal
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in special))
        ends = [i for w, i in self.library.get_vocab().items() if w.endswith("</w>")]
        self.ends = np.zeros(max(self.library.get_vocab().values(), default=0) + 1, bool)
        self.ends[ends] = about.get("model", {}).get("end_of_word_suffix") == "</w>"
        self.marks = sorted({t["content"].encode()[:2] for t in special})
        self.kept: dict[bytes, bytes] = {}
        self.last: set[bytes] = set()  # known pieces that came back; they outlast the others

    def split(self, raw: bytes) -> list[bytes]:
        """Pieces between ASCII white space."""
        return (raw if any(m in raw for m in self.marks) else raw.translate(PLAIN)).split()

    def learn(self, texts: list[list[bytes]]) -> dict[bytes, bytes]:
        """Makes the ids of all pieces of the texts known; returns those too long to be kept."""
        met = set().union(*texts)
        new = met.difference(self.kept)
        met -= new
        self.last |= met
        if len(self.kept) + len(new) > KEPT_PIECES:
            if len(self.last) > KEPT_PIECES // 2:
                self.last = met
            self.kept = {p: self.kept[p] for p in self.last}
        cut: dict[bytes, tuple[bytes, bytes]] = {}
        letters: set[bytes] = set()
        rest: set[bytes] = set()
        known = lambda p: p in self.kept or p in new
        for p in new:
            if p[-1] in b".,;:!?" and (m := TAIL.fullmatch(p)):
                cut[p] = stem, tail = m.groups()
                if not known(stem):
                    letters.add(stem)
                if not known(tail):
                    rest.add(tail)
            else:
                (letters if p.isalpha() or (not p.isascii() and p.decode("utf-8", "replace").isalpha()) else rest).add(p)
        long: dict[bytes, bytes] = {}
        words = list(letters)
        for i in range(0, len(words), BULK):
            rest.update(self._words(words[i:i + BULK], long))
        for some in (list(rest)[i:i + BULK] for i in range(0, len(rest), BULK)):
            encoded = self.library.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)
            for p, e in zip(some, encoded):
                (self.kept if len(p) <= LONGEST_KEPT else long)[p] = np.array(e.ids, self.dtype).tobytes()
        for p, (stem, tail) in cut.items():
            ids = (self.kept.get(stem) or long[stem]) + (self.kept.get(tail) or long[tail])
            (self.kept if len(p) <= LONGEST_KEPT else long)[p] = ids
        return long

    def _words(self, some: list[bytes], long: dict[bytes, bytes]) -> list[bytes]:
        """Encodes pieces of letters as one text and cuts its ids at word ends; returns the pieces if the ends don't fit."""
        encoded = self.library.encode_batch_fast([b" ".join(some).decode("utf-8", "replace")], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, np.int64)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(some) or (len(ids) and stop[-1] != len(ids)):
            return some
        packed, width, at = ids.astype(self.dtype).tobytes(), self.dtype.itemsize, 0
        for p, end in zip(some, (stop * width).tolist()):
            (self.kept if len(p) <= LONGEST_KEPT else long)[p] = packed[at:end]
            at = end
        return []

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, packed in `dtype`."""
        self.prepare()
        if not self.safe:
            encoded = self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() for e in encoded]
        cut = [self.split(t) for t in texts]
        long = self.learn(cut)
        self.kept |= long
        try:
            return [b"".join(map(self.kept.__getitem__, c)) for c in cut]
        finally:
            for p in long:
                del self.kept[p]
