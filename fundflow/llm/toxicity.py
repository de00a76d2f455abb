"""Toxicity: a lexicon trie run against Levenshtein automata, scored by context.

Terms are learned from labelled texts: words that stand almost only in toxic
ones.  The product of the terms' trie with the Levenshtein automaton of each
term is explored lazily and kept as one deterministic automaton, which reads a
word once and stops at the first letter after which no term is near.  A window
around each hit tells quotation (quote marks, words of saying) from address.
A logistic model over counts of direct, misspelled and quoted hits gives the
score.  Words, not labels or sources, are all that a score sees.

Defined cases: null texts are empty; a text without a hit, empty ones too, gets
the model's base score; without labelled rows of both kinds nothing is learned
and every score is 0; labelled documents that repeat count each time; rows
whose label is null are not learned from.
"""

from __future__ import annotations

import math
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.3
SAMPLE = 8000       # labelled rows learned from, at most, those of the smallest hash
TERMS = 5000        # most frequent terms kept
LEAST_TEXTS = 3     # toxic texts that a term must stand in
PRECISION = 0.85    # share of toxic texts among all that hold it
LEAST_LETTERS = 4
FUZZY_LETTERS = 5   # from this length on one misspelling is allowed
WINDOW = 6          # words looked at on either side of a hit
STATES = 50_000     # states of the automaton held; then it starts anew
SAYING = frozenset("say says said saying quote quotes quoted wrote write writes called calls "
                   "word words term terms phrase insult insults dijo sagte dit".split())
_WORD = re.compile(r"[^\W\d_]+")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
SCHEMA = "doc_id long, score double, n_direct long, n_misspelled long, n_quoted long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]
                   + [(c, pa.int64()) for c in ("n_direct", "n_misspelled", "n_quoted")])


class Automaton:
    """Deterministic product of the lexicon trie and Levenshtein automata."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.fuzzy = [False]  # some term below may be misspelled
        self.ends = [None]    # None, or whether the term that ends here may be
        for term in terms:
            node, fuzzy = 0, len(term) >= FUZZY_LETTERS
            for c in term:
                self.fuzzy[node] |= fuzzy
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.fuzzy.append(False)
                    self.ends.append(None)
                node = self.children[node][c]
            self.fuzzy[node] |= fuzzy
            self.ends[node] = fuzzy
        self._restart()

    def _restart(self) -> None:
        start = self._close({(0, 0)})
        self.states, self.number = [start], {start: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.found = [self._accepts(start)]

    def _close(self, items: set[tuple[int, int]]) -> frozenset:
        """Add the positions reached by leaving out a letter of a term."""
        out = set(items)
        for node, cost in items:
            if cost == 0 and self.fuzzy[node]:
                out.update((n, 1) for n in self.children[node].values())
        return frozenset(x for x in out if x[1] == 0 or ((x[0], 0) not in out and self.fuzzy[x[0]]))

    def _accepts(self, state: frozenset) -> int | None:
        costs = [cost for node, cost in state
                 if self.ends[node] is not None and (cost == 0 or self.ends[node])]
        return min(costs, default=None)

    def _step(self, number: int, c: str) -> int:
        items = set()
        for node, cost in self.states[number]:
            child = self.children[node].get(c)
            if child is not None:
                items.add((child, cost))
            if cost == 0 and self.fuzzy[node]:
                items.add((node, 1))  # a letter too many
                items.update((n, 1) for n in self.children[node].values())  # another letter
        state = self._close(items)
        got = self.number.get(state)
        if got is None:
            got = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.found.append(self._accepts(state))
        self.moves[number][c] = got
        return got

    def distance(self, word: str) -> int | None:
        """0 or 1 edits from some term, None if no term is near."""
        if len(self.states) > STATES:
            self._restart()
        at = 0
        for c in word:
            to = self.moves[at].get(c)
            at = self._step(at, c) if to is None else to
            if not self.states[at]:
                return None
        return self.found[at]


def hits(text: str, automaton: Automaton) -> tuple[int, int, int, int]:
    """(direct, misspelled, quoted, words): hits by their context."""
    low = text.lower()
    split = _WORD.findall(low)
    near = {w: d for w in set(split) if len(w) >= LEAST_LETTERS - 1
            and (d := automaton.distance(w)) is not None}
    counts = [0, 0, 0]
    if near:
        spans = [m.span() for m in _WORD.finditer(low)]
        for i, w in enumerate(split):
            if w in near:
                before = low[spans[max(0, i - WINDOW)][0]:spans[i][0]]
                after = low[spans[i][1]:spans[min(len(split) - 1, i + WINDOW)][1]]
                marks = sum(before.count(c) for c in set(_OPEN)) % 2 and any(c in after for c in _CLOSE)
                said = not SAYING.isdisjoint(split[max(0, i - WINDOW):i])
                counts[2 if marks or said else near[w]] += 1
    return (*counts, len(split))


def features(counts: tuple[int, int, int, int]) -> list[float]:
    direct, misspelled, quoted, n = counts
    every = direct + misspelled
    return [1.0, math.log1p(direct), math.log1p(misspelled), math.log1p(quoted),
            float(direct > 0), min(1.0, 20 * every / max(n, 1))]


def _score(x: list[float], weights: list[float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, weights))))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Logistic regression by Newton steps; the rows are a bounded sample."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty,
                               x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[float]]:
    """(terms, weights) from labelled documents.

    One half of the sample gives the terms, the other the weights, so the
    weights tell how terms do on texts that they were not taken from.  Only
    ids of the sample (``SAMPLE`` at most) are broadcast to find its texts.
    """
    sample = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL") \
        .select("doc_id", F.col("toxic").cast("int").alias("toxic")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL") \
        .join(F.broadcast(sample), "doc_id") \
        .select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))).alias("half"))
    words = rows.filter("half = 0").select("toxic", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))).alias("word"))
    terms = words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(
        F.sum("toxic").alias("n"), F.count(F.lit(1)).alias("of")) \
        .filter((F.col("n") >= LEAST_TEXTS) & (F.col("n") >= PRECISION * F.col("of"))) \
        .orderBy(F.desc("n"), "word").limit(TERMS)
    lexicon = sorted(r["word"] for r in terms.collect())
    counted = _counts(rows.filter("half = 1").select(
        F.col("toxic").cast("long").alias("doc_id"), "text"), lexicon)
    got = counted.select("doc_id", "n_direct", "n_misspelled", "n_quoted", "n_words").collect()
    y = np.array([r[0] for r in got], float)
    if not lexicon or not len(y) or y.min() == y.max():
        return [], []
    return lexicon, _fit(np.array([features(tuple(r[1:])) for r in got]), y)


def _counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    schema = pa.schema([(c, pa.int64()) for c in
                        ("doc_id", "n_direct", "n_misspelled", "n_quoted", "n_words")])

    def run(batches):
        automaton = Automaton(terms)

        def part(batch):
            rows = [hits(t, automaton) for t in batch.column("text").to_pylist()]
            return [batch.column("doc_id")] + [pa.array([r[i] for r in rows], pa.int64())
                                               for i in range(4)]
        yield from common.per_chunk(part, schema)(batches)
    return common.texts(docs).mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def score(docs: DataFrame, model: tuple[list[str], list[float]]) -> DataFrame:
    """Score and hits of every text.  Narrow: nothing is shuffled."""
    terms, weights = model

    def run(batches):
        automaton = Automaton(terms)

        def part(batch):
            rows = [hits(t, automaton) for t in batch.column("text").to_pylist()]
            scores = [_score(features(r), weights) if weights else 0.0 for r in rows]
            return [batch.column("doc_id"), pa.array(scores, pa.float64())] + [
                pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        yield from common.per_chunk(part, _ARROW)(batches)
    return common.texts(docs).mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: tuple[list[str], list[float]],
           threshold: float = THRESHOLD) -> DataFrame:
    """Documents whose score is below the threshold."""
    terms, weights = model

    def judge():
        automaton = Automaton(terms)
        return lambda text: not weights or _score(features(hits(text, automaton)), weights) < threshold
    return common.keep_rows(docs, judge)
