"""Toxicity by a weighted finite-state grammar over clauses.

A word becomes a symbol: insult, threat, target, copula, negation, report, quotation mark or other. Insults and threats
come from a lexicon of whole words and word beginnings with weights; some are given, the rest is learned from labels: terms
whose log odds in toxic against other documents are surely high. A learned beginning is a whole number of characters and
stands for at least `KINDS` different words of toxic documents, so it is no single word cut short.

Small transducers for negation (open for a few words after "not"), reported speech (after a verb of saying or inside
quotation marks), target ("you" near the word) and predicate ("is" before it) are composed into one machine, once, whose
state says all of it. The machine reads the symbols of a clause (the words between sentence marks) forwards, another one
backwards for targets that follow; an insult or a threat leaves by the arc that both states name:

* targeted: a target is near; predicate or address: a copula stands before it or the clause is a call of a few words;
  lone: neither;
* negated or reported matches count only `MUTED` of the others.

A document's score is the logistic of the arcs' sums over clauses. Learned weights are bounded so that for one match the
targeted arc never weighs less than the predicate arc, nor that less than the lone one.

The lexicon and the weights are learned from at most `SAMPLE_ROWS` labelled rows. Term counts are summed in Spark; the
driver gets the terms that pass the test, at most `TERMS`, and one row of arc sums per sampled document.

Quotation marks and other punctuation outside ASCII part words as those inside ASCII do. Null texts count as empty; empty
texts have the score of a text without matches. Null labels are not learned from. Without labels of both kinds the given
lexicon and given weights hold. Extra columns are kept by `keep_clean` and not returned by `score`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.additive import bounded_labels
from tactus.llm.common import as_bytes, lean, slices, stored, text_bytes, words

SAMPLE_ROWS = 30_000
TERMS = 20_000
#: Characters of a word's beginning that can be a term of its own, and the different words it must stand for.
STEMS, KINDS = (7, 6, 5, 4), 3
#: Share that counts of a negated or reported match.
MUTED = 0.15
#: Words of a clause that is a call.
CALL = 3
#: Words whose entries a worker keeps.
KEPT_WORDS = 200_000
#: A learned term's share in toxic documents must surely exceed this many times its share in others.
ODDS = 4.0

#: Other documents in which a given word must stand before it can be found to say nothing.
COMMON = 20

# Given vocabulary of the grammar; weights of its insults and threats are 1.
INSULTS = "idiot idiots moron morons stupid loser losers pathetic scum trash worthless disgusting clown dumb imbecile idiota estúpido basura idiote imbécile débile blöd dumm abschaum".split()
THREATS = "kill murder hurt destroy burn strangle töten umbringen tuer mourir matar morir".split()
TARGETS = "you your yours u ur he she they them him her these those du dich dir ihr euch sie tu toi vous te ti tú usted ustedes ellos".split()
NEGATIONS = "not never no none nobody isn aren wasn don doesn didn nicht kein keine nie pas jamais aucun nunca ningún".split()
REPORTS = "said says say wrote writes called claims claimed quoted reported sagte sagt dit disait écrit dijo dice según".split()

COPULAS = "is are am was were be being isn aren wasn ist sind bist bin war es son eres soy est sont suis êtes sei".split()

INSULT, THREAT, TARGET, COPULA, NEGATION, REPORT, QUOTE, OTHER = range(8)
CLAUSES = re.compile(rb"(?:[.!?;:\n]|\xe2\x80\xa6|\xc2[\xa1\xbf])+")
#: Double, angled and single quotation marks; a single one between letters is an apostrophe.
QUOTES = re.compile(rb'"|\xc2[\xab\xbb]|\xe2\x80[\x98\x9a-\x9f\xb9\xba]|(?<![A-Za-z])\xe2\x80\x99|\xe2\x80\x99(?![A-Za-z])')
#: UTF-8 of punctuation, signs and spaces outside ASCII: Latin-1 without its letters, general punctuation, CJK marks.
MARKS = re.compile(rb"\xc2[\xa0-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\x9f]")
#: Stands for a quotation mark among the words; capitals can't occur in a word.
QUOTE_WORD = b"Q"
LONE, PREDICATE, TARGETED = range(3)
#: Sums of a document: each arc for insults, then for threats; matches; words.
ARCS = 6
#: Bounds of the weights of: constant, any match, predicate or target, target, threat, matches per hundred words.
LEAST = np.array([-np.inf, 0.3, 0.3, 0.3, 0.0, 0.0])
MOST = np.array([np.inf, np.inf, np.inf, np.inf, np.inf, 1.0])


def parted(raw: bytes) -> list[bytes]:
    """Words of a text, parted at any punctuation."""
    return words(raw if raw.isascii() else MARKS.sub(b" ", raw))


class Transducer:
    """A deterministic machine: (state, symbol) to state; a state emits one bit."""

    def __init__(self, arcs: dict[tuple[int, int], int], otherwise: dict[int, int], bits: dict[int, int]):
        self.states = 1 + max(otherwise)
        self.next = [[arcs.get((s, x), otherwise[s]) for x in range(8)] for s in range(self.states)]
        self.bits = [bits.get(s, 0) for s in range(self.states)]

    def __call__(self, symbols: list[int]) -> list[int]:
        state, out, step, bits = 0, [], self.next, self.bits
        for x in symbols:
            state = step[state][x]
            out.append(bits[state])
        return out


def _fading(symbol: int, reach: int) -> Transducer:
    """Emits 1 at the symbol and for `reach` words after it."""
    arcs = {(s, symbol): reach for s in range(reach + 1)}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)}, {s: 1 for s in range(1, reach + 1)})


def composed(parts: list[Transducer]) -> Transducer:
    """One machine whose state holds a state of each part; bit k of what it emits is that of part k."""
    numbers, todo, arcs, bits = {(0,) * len(parts): 0}, [(0,) * len(parts)], {}, {}
    while todo:
        at = todo.pop()
        here = numbers[at]
        bits[here] = sum(bool(m.bits[s]) << k for k, (m, s) in enumerate(zip(parts, at)))
        for x in range(8):
            to = tuple(m.next[s][x] for m, s in zip(parts, at))
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            arcs[here, x] = numbers[to]
    return Transducer(arcs, dict.fromkeys(range(len(numbers)), 0), bits)


#: 0 plain, 1 after a verb of saying, 2 inside quotation marks, 3 both.
REPORTED = Transducer({(0, REPORT): 1, (0, QUOTE): 2, (1, QUOTE): 3, (2, REPORT): 3, (2, QUOTE): 0, (3, QUOTE): 1}, {0: 0, 1: 1, 2: 2, 3: 3}, {1: 1, 2: 1, 3: 1})
NEAR_TARGET = _fading(TARGET, 5)
FORWARDS = composed([_fading(NEGATION, 6), REPORTED, _fading(COPULA, 3), NEAR_TARGET])


@dataclass
class Grammar:
    """Lexicon (term to symbol and weight) and the weights of the sums."""

    terms: dict[bytes, tuple[int, float]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.5, 1.5, 2.0, 0.5, 0.0]))

    def __post_init__(self):
        self.symbols = {w.encode(): s for group, s in ((TARGETS, TARGET), (COPULAS, COPULA), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in group}
        self.symbols[QUOTE_WORD] = QUOTE
        for group, s in ((INSULTS, INSULT), (THREATS, THREAT)):
            for w in group:
                self.terms.setdefault(w.encode(), (s, 1.0))
        self.terms = {w: e for w, e in self.terms.items() if e[1] > 0}
        self.stems = tuple(n for n in STEMS if any(t.endswith(b"*") and len(t.decode()) == n + 1 for t in self.terms))
        self.known: dict[bytes, tuple[int, float] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def find(self, word: bytes) -> tuple[int, float] | None:
        """The lexicon's entry for a word: the whole word, else its longest beginning."""
        if word in self.known:
            return self.known[word]
        hit = self.terms.get(word)
        if hit is None and self.stems:
            text = word.decode("utf-8", "replace")
            hit = next((t for n in self.stems if len(text) > n and (t := self.terms.get(text[:n].encode() + b"*"))), None)
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        self.known[word] = hit
        return hit

    def arcs(self, raw: bytes) -> np.ndarray:
        """Sums of weights by arc, number of matches, and number of words."""
        out = np.zeros(ARCS + 2)
        found = parted(raw)
        out[ARCS + 1] = len(found)
        if not any(map(self.find, set(found))):
            return out
        for clause in CLAUSES.split(raw):
            said = [w for k, part in enumerate(QUOTES.split(clause)) for w in ([QUOTE_WORD] if k else []) + parted(part)]
            entries = [self.find(w) for w in said]
            if not any(entries):
                continue
            symbols = [e[0] if e else self.symbols.get(w, OTHER) for w, e in zip(said, entries)]
            ahead, behind = FORWARDS(symbols), NEAR_TARGET(symbols[::-1])[::-1]
            call = sum(x != QUOTE for x in symbols) <= CALL
            for e, bits, target in zip(entries, ahead, behind):
                if e:
                    arc = TARGETED if target or bits & 8 else PREDICATE if call or bits & 4 else LONE
                    out[arc + 3 * (e[0] == THREAT)] += e[1] * (MUTED if bits & 3 else 1.0)
                    out[ARCS] += 1
        return out

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(sums) @ self.weights, -30, 30)))


def features(sums: np.ndarray) -> np.ndarray:
    """Columns of the logistic model; each arc counts in all columns of the weaker ones, so weights of at least 0 keep their order."""
    arcs = sums[:, :3] + sums[:, 3:ARCS]
    every = arcs.sum(1)
    return np.stack([np.ones(len(sums)), np.log1p(every), np.log1p(arcs[:, 1:].sum(1)), np.log1p(arcs[:, TARGETED]), np.log1p(sums[:, 3:ARCS].sum(1)),
                     np.log1p(100 * every / np.maximum(sums[:, ARCS + 1], 1))], 1)


def _terms(found: set[bytes]) -> set[bytes]:
    """Whole words and beginnings of the words of a document."""
    return found | {stem for w in found for stem in _stems(w)}


def _stems(word: bytes) -> list[bytes]:
    text = word.decode("utf-8", "replace")
    return [text[:n].encode() + b"*" for n in STEMS if len(text) > n]


def _sample(labels: DataFrame, modulus: int, held_out: int, bound: int) -> dict:
    """doc_id to label; repeated ids are toxic if any of their labels says so."""
    rows = bounded_labels(labels, "toxic", bound, modulus, held_out).groupBy("doc_id").agg(F.max("y").alias("y")).toPandas()
    return dict(zip(rows["doc_id"].tolist(), rows["y"].tolist()))


def _sampled(docs: DataFrame, chosen, text_col: str, per_slice, schema: str, names: list[str]) -> DataFrame:
    """Rows that `per_slice` makes of the sampled documents of a slice: [(label, bytes)]."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = chosen.value
        for batch in batches:
            keep = [i for i, d in enumerate(batch.column(0).to_pylist()) if d in labels]
            if keep:
                for part in slices(batch.take(pa.array(keep)), 1):
                    rows = per_slice([(labels[d], raw) for d, raw in zip(part.column(0).to_pylist(), as_bytes(part.column(1)))])
                    yield pa.RecordBatch.from_arrays(rows, names)

    return docs.select("doc_id", text_bytes(text_col).alias("raw")).mapInArrow(lean(run), schema)


def _learn_terms(docs: DataFrame, chosen, n_toxic: int, n_clean: int, text_col: str) -> dict[bytes, tuple[int, float]]:
    def count(rows: list[tuple[float, bytes]]) -> list[pa.Array]:
        toxic, clean = Counter(), Counter()
        for y, raw in rows:
            (toxic if y else clean).update(_terms(set(parted(raw))))
        keys = list(toxic.keys() | clean.keys())
        return [pa.array(keys, pa.binary()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())]

    least = max(4, n_toxic // 200)
    per_term = _sampled(docs, chosen, text_col, count, "term binary, toxic long, clean long", ["term", "toxic", "clean"]).groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    per_term = stored(per_term, "terms")
    # how many different words of toxic documents a beginning stands for
    text = F.col("term").cast("string")
    whole = per_term.filter((F.col("t") > 0) & ~text.endswith("*")).select(text.alias("w"))
    behind = whole.select(F.explode(F.array(*[F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in STEMS])).alias("stem"))
    kinds = behind.filter(F.col("stem").isNotNull()).groupBy(F.col("stem").cast("binary").alias("term")).agg(F.count(F.lit(1)).alias("kinds"))
    per_term = per_term.join(kinds, "term", "left").filter(~text.endswith("*") | (F.col("kinds") >= KINDS))
    surely = per_term.filter(F.col("t") >= least).withColumn("sure", odds - 1.5 * error).filter(F.col("sure") > float(np.log(ODDS)))
    rows = surely.orderBy(F.desc("sure"), "term").limit(TERMS).collect()
    # a given word that other documents hold about as often says nothing here
    given = [w.encode() for w in (*INSULTS, *THREATS)]
    usual = per_term.filter(F.col("term").isin(given) & (F.col("c") >= COMMON) & (odds < float(np.log(2.0)))).select("term").collect()
    return {bytes(r["term"]): (INSULT, 0.0) for r in usual} | {bytes(r["term"]): (INSULT, min(3.0, r["sure"] / np.log(ODDS) / 2)) for r in rows}


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, steps: int = 100, ridge: float = 0.1) -> np.ndarray:
    """Newton's method inside the bounds, with a slight pull towards the given weights."""
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    w = np.clip(prior, LEAST, MOST)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - pull * (w - prior)
        free = ~(((w <= LEAST) & (g < 0)) | ((w >= MOST) & (g > 0)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.zeros(len(w))
        step[free] = np.clip(np.linalg.solve(h[np.ix_(free, free)], g[free]), -1, 1)
        new = np.clip(w + step, LEAST, MOST)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", modulus: int = 4, held_out: int = 2, bound: int = SAMPLE_ROWS) -> Grammar:
    """Learns lexicon and path weights."""
    sample = _sample(labels, modulus, held_out, bound)
    n_toxic = sum(y > 0 for y in sample.values())
    if not n_toxic or n_toxic == len(sample):
        return Grammar()
    context = docs.sparkSession.sparkContext
    chosen = context.broadcast(sample)
    grammar = Grammar(_learn_terms(docs, chosen, n_toxic, len(sample) - n_toxic, text_col))
    shared = context.broadcast(grammar)

    def match(rows: list[tuple[float, bytes]]) -> list[pa.Array]:
        return [pa.array([y for y, _ in rows]), pa.array([shared.value.arcs(raw).tolist() for _, raw in rows], pa.list_(pa.float64()))]

    rows = _sampled(docs, chosen, text_col, match, "y double, sums array<double>", ["y", "sums"]).toPandas()
    if len(rows) and rows["y"].nunique() > 1:
        grammar.weights = _logistic(features(np.array(rows["sums"].tolist())), rows["y"].to_numpy(), grammar.weights)
    return grammar


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """doc_id, score and the number of matches of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                sums = np.array([worker.arcs(x) for x in as_bytes(part.column(1))]).reshape(-1, ARCS + 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(worker.score(sums)), pa.array(sums[:, ARCS].astype(np.int64))], ["doc_id", "score", "n_matches"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes(text_col).alias("raw")).mapInArrow(lean(run), f"doc_id {id_type}, score double, n_matches long")


def keep_clean(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents with a score below the threshold, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value
        for batch in batches:
            for part in slices(batch, at):
                sums = np.array([worker.arcs(x) for x in as_bytes(part.column(at))]).reshape(-1, ARCS + 2)
                yield part.filter(pa.array(worker.score(sums) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
