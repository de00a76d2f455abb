"""Licence scan: an Aho-Corasick automaton over words, and licence expressions.

One pass of the automaton over the normalised words of a text finds notice
phrases and identifier tags.  The expression behind a tag is read with a
shunting-yard parser and evaluated: ``and`` takes the stricter side, ``or`` the
freer one, ``with`` relaxes its licence.

Defined cases: a null text is empty; an empty text has no words, no hit and the
score of an unknown licence; repeated rows are scanned alike; a malformed
expression adds the label ``unparsed`` and no licence.
"""

from __future__ import annotations

import re
import sys

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE_PHRASES = {
    "mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = BASE_PHRASES | {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "creative commons zero": "cc0", "public domain": "public-domain",
    "licensed under cc by": "cc-by", "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc", "licensed under cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary"}
TAG = "spdx license identifier"
FREEDOM = {  # how freely a text under this licence may be reused
    "cc0": 1.0, "public-domain": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "apache": 0.9,
    "cc-by": 0.8, "mpl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2,
    "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0}
UNKNOWN = 0.5
RELAXED = 0.2  # what an exception adds
RANK = {"or": 1, "and": 2, "with": 3}

_BREAKS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
                for b in range(256))
_TAG_TEXT = re.compile(r"SPDX[-\s]+License[-\s]+Identifier[^\w(\n]*([^\n*<>\"']*)", re.I | re.A)
_ITEM = re.compile(r"[()]|[A-Za-z0-9.+-]+", re.A)

HITS = "array<struct<word:long,label:string,base:boolean>>"
SCHEMA = (f"doc_id long, n_words long, hits {HITS}, expressions array<string>, "
          "labels array<string>, score double")
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("hits", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()),
                                 ("base", pa.bool_())]))),
    ("expressions", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
    ("score", pa.float64())])


def words(text: str) -> list[bytes]:
    """Words of a text: A-Z lowered, ASCII other than letters and digits divides."""
    return text.encode().lower().translate(_BREAKS).split()


def licence_of(name: str) -> str:
    """Label of a licence identifier, version and variant suffixes left out."""
    name = name.lower().rstrip("+")
    for label in sorted(FREEDOM, key=len, reverse=True):
        if name == label or name.startswith(label + "-") or name.startswith(label + "."):
            return label
    return name


def postfix(items: list[str]) -> list[str]:
    """Shunting-yard: licence names and operators in evaluation order.
    Raises ValueError for an expression that is not well formed."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last item ended an operand
    for item in items:
        low = item.lower()
        if low in RANK or item == ")":
            if not operand:
                raise ValueError(f"operand missing before {item}")
            if item == ")":
                while held and held[-1] != "(":
                    out.append(held.pop())
                if not held:
                    raise ValueError("unopened parenthesis")
                held.pop()
            else:
                while held and held[-1] != "(" and RANK[held[-1]] >= RANK[low]:
                    out.append(held.pop())
                held.append(low)
                operand = False
        else:
            if operand:
                raise ValueError(f"operator missing before {item}")
            if item == "(":
                held.append(item)
            else:
                out.append(item)
                operand = True
    if not operand or "(" in held:
        raise ValueError("unfinished expression")
    return out + held[::-1]


def evaluate(items: list[str]) -> tuple[float, set[str]]:
    """(freedom, labels) of a postfix expression."""
    stack: list[tuple[float, set[str]]] = []
    for item in items:
        if item not in RANK:
            label = licence_of(item)
            stack.append((FREEDOM.get(label, UNKNOWN), {label}))
            continue
        right, left = stack.pop(), stack.pop()
        if item == "with":  # its right side names an exception, no licence
            stack.append((min(1.0, left[0] + RELAXED), left[1]))
        else:
            pick = min if item == "and" else max
            stack.append((pick(left[0], right[0]), left[1] | right[1]))
    return stack[0]


def expression(text: str) -> list[str]:
    """Items, in evaluation order, of the longest well-formed expression at the
    head of a text.  One pass finds where it ends: after an operand, outside
    parentheses, before the first item that cannot follow."""
    items, good, depth, operand = [], 0, 0, False
    for item in _ITEM.findall(text):
        closes = item == ")"
        follows = closes or item.lower() in RANK
        if follows != operand or (closes and not depth):
            break
        items.append(item)
        depth += (item == "(") - closes
        operand = closes or not (follows or item == "(")
        if operand and not depth:
            good = len(items)
    return postfix(items[:good]) if good else []


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE_PHRASES))
    found.add_word(f" {TAG} ", (len(TAG) + 1, None, False))
    found.make_automaton()
    return found


def scan_text(text: str, found: ahocorasick.Automaton) -> tuple:
    """(n_words, hits, expressions, labels, score) of one text."""
    split = words(text)
    line = " " + b" ".join(split).decode() + " "
    hits, tagged = [], False
    at, seen = 0, 0  # words before the character ``seen``
    for end, (back, label, base) in found.iter(line):
        start = end - back
        if label is None:
            tagged = True
            continue
        at += line.count(" ", seen, start) if start >= seen else -line.count(" ", start, seen)
        seen = start
        hits.append({"word": at, "label": label, "base": base})
    labels = {h["label"] for h in hits}
    scores = [FREEDOM[label] for label in labels]
    expressions = []
    if tagged:
        for raw in _TAG_TEXT.findall(text):
            items = expression(raw)
            if items:
                value, names = evaluate(items)
                expressions.append(" ".join(items))
                scores.append(value)
                labels |= names
            else:
                labels.add("unparsed")
    return (len(split), hits, expressions, sorted(labels), min(scores, default=UNKNOWN))


def scan(docs: DataFrame) -> DataFrame:
    """Notices, expressions, labels and freedom score of every document.

    Narrow: each text is read once by the task that scans it; nothing is shuffled.
    """
    def run(batches):
        found = automaton()

        def part(batch):
            rows = [scan_text(t, found) for t in batch.column("text").to_pylist()]
            return [batch.column("doc_id")] + [
                pa.array([r[i] for r in rows], _ARROW.field(i + 1).type) for i in range(5)]
        yield from common.per_chunk(part, _ARROW)(batches)
    return common.texts(docs).mapInArrow(run, SCHEMA)


def report(scanned: DataFrame) -> DataFrame:
    """One row of counts and labels per document."""
    base = F.filter("hits", lambda h: h["base"])
    found = scanned.withColumn("_base", base)
    return found.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda h: h["word"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda h: h["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(
            F.transform("_base", lambda h: h["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
        F.array_join("expressions", "; ").alias("expressions"))
