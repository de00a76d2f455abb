"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1.  A three-letter gram is the
product of its letters' vectors, rolled by their place; a text is the sum of its
grams, a language the sum of its texts, each scaled to length one.  A text gets
the language with the largest cosine.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any learned language every text is ``und``; ties go to the first name
in order.  Words shorter than three letters count through their blanks.  Any number
of languages: prototypes go to the tasks in blocks of a fixed number.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 512
SAMPLE = 1000          # ids learned from, at most, for each language
SALTS = 64             # pieces in which the ids of one language are ranked first
BLOCK = 1000           # languages compared in one pass over the texts (2 MB of prototypes)
KEPT_GRAMS = 20_000    # vectors of frequent grams held by a worker
SEED = 17
ROWS = "doc_id long, text string, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang_pred", pa.string()),
                    ("score", pa.float64())])


class Space:
    """Vectors of letters and grams; the same in every process."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.n = dimensions
        self.letters: dict[int, tuple] = {}
        self.slot: dict[int, int] = {}
        self.table = np.zeros((256, dimensions), np.float32)

    def letter(self, code: int) -> tuple[np.ndarray, ...]:
        got = self.letters.get(code)
        if got is None:
            v = (np.random.default_rng([SEED, code]).integers(0, 2, self.n) * 2 - 1).astype(np.int8)
            if len(self.letters) > 5000:
                self.letters.clear()
            got = self.letters[code] = (np.roll(v, 2), np.roll(v, 1), v)
        return got

    def gram(self, key: int) -> np.ndarray:
        return (self.letter(key >> 42)[0] * self.letter((key >> 21) & 0x1FFFFF)[1]
                * self.letter(key & 0x1FFFFF)[2])

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of gram vectors, each as often as it occurs."""
        if len(self.slot) > KEPT_GRAMS:
            self.slot.clear()
        total = np.zeros(self.n, np.float32)
        for at in range(0, len(grams), 4096):
            rows = []
            for key in grams[at:at + 4096].tolist():
                row = self.slot.get(key)
                if row is None:
                    row = self.slot[key] = len(self.slot)
                    if row >= len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[row] = self.gram(key)
                rows.append(row)
            total += counts[at:at + 4096].astype(np.float32) @ self.table[rows]
        return total

    def profile(self, text: str | None) -> np.ndarray | None:
        """Unit vector of a text, None without letters."""
        grams = grams_of(text)
        if grams is None:
            return None
        total = self.bundle(*grams)
        size = float(np.linalg.norm(total))
        return total / size if size else total


_ASCII = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def grams_of(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(grams, counts): three letters or word edges side by side, letters lowered."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _ASCII[np.minimum(codes, 127)]
    wide = codes > 127
    if wide.any():
        letters = letters.copy()
        kinds, back = np.unique(codes[wide], return_inverse=True)
        letters[wide] = np.array([c if unicodedata.category(chr(c))[0] in "LM" else 32
                                  for c in kinds.tolist()], np.uint32)[back]
    if not (letters != 32).any():
        return None
    padded = np.concatenate([[32], letters, [32]]).astype(np.int64)
    padded = padded[np.r_[True, (padded[1:] != 32) | (padded[:-1] != 32)]]
    keys = (padded[:-2] << 42) | (padded[1:-1] << 21) | padded[2:]
    return np.unique(keys, return_counts=True)


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes from rows (doc_id, text, lang): per language the texts of up to
    ``SAMPLE`` ids, those of the smallest hash.  Only ids are shuffled to find the
    last hash of each language; texts are then picked where they lie.  Sums are
    formed in the tasks; one vector for each language and task reaches the driver."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select(
        "lang", "text", F.struct(F.xxhash64("doc_id").alias("h"), "doc_id").alias("_at"))
    first = rows.select("lang", "_at", F.pmod("_at.h", F.lit(SALTS)).alias("_salt")).distinct()
    for key in (["lang", "_salt"], ["lang"]):        # the second sees at most SALTS x SAMPLE ids
        order = Window.partitionBy(*key).orderBy("_at")
        first = first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE)
    last = first.groupBy("lang").agg(F.max("_at").alias("_last"))
    # One row for each language, like the prototypes themselves.
    rows = rows.join(F.broadcast(last), "lang").filter(F.col("_at") <= F.col("_last"))
    schema = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        space, sums = Space(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                v = space.profile(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()],
                                                schema.field(1).type)], schema=schema)
    parts = rows.select("lang", "text").mapInArrow(run, "lang string, vector array<double>")
    sums: dict[str, np.ndarray] = {}
    for row in parts.toLocalIterator():
        sums[row["lang"]] = sums.get(row["lang"], 0) + np.array(row["vector"])
    names = sorted(sums)
    matrix = np.array([sums[n] / (np.linalg.norm(sums[n]) or 1) for n in names], np.float32)
    return names, matrix.reshape(len(names), DIMENSIONS)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Language and cosine of every text.  Narrow: nothing is shuffled.  Each block
    of languages is one step over the texts that keeps the better name so far."""
    names, matrix = model
    rows = common.texts(docs, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for at in range(0, len(names), BLOCK):
        step = _step(names[at:at + BLOCK], matrix[at:at + BLOCK], last=at + BLOCK >= len(names))
        rows = rows.mapInArrow(step, ROWS)
    return rows.select("doc_id", "lang_pred", "score")


def _step(names: list[str], matrix: np.ndarray, last: bool):
    def run(batches):
        space = Space()

        def one(text, name, score):
            v = space.profile(text)
            if v is None:
                return "und", 0.0
            cosines = matrix @ v
            best = int(np.argmax(cosines))
            got = float(min(1.0, max(0.0, cosines[best])))
            return (names[best], got) if name == "und" or got > score else (name, score)

        def part(batch):
            rows = [one(*r) for r in zip(*(batch.column(c).to_pylist()
                                           for c in ("text", "lang_pred", "score")))]
            text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
            return [batch.column("doc_id"), text,
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64())]
        yield from common.per_chunk(part, _ARROW)(batches)
    return run
