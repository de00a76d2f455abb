"""Byte-pair encoding as a streaming transducer, and incremental decoding.

The transducer keeps a buffer of symbols.  A merge can be decided otherwise by
later text only through a chain of merges of ever higher priority, each taking
the end of the one before it; the longest such chain, in characters, is the
merge list's lookahead.  Tokens that end further than that from the end of the
buffer are stable and leave it, so a word of any length needs constant memory.
Words within the lookahead are decided as soon as they end; many are merged at
once with array operations and remembered in a bounded cache.

Defined cases: a null or empty text has no token; special tokens written in a
text count as such; repeated rows are encoded alike.  A tokenizer file without
a decoder joins token strings with one space, as its library does.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_FILE = 64 << 20   # bytes of a tokenizer file that may be broadcast
CACHED_WORDS = 200_000  # per worker; older ones are forgotten
AT_ONCE = 1 << 16     # words of a text handled at once
SHORT = 64            # symbols up to which words are merged in bulk

# The split pattern of the tokenizer file.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Tokenizer:
    """Vocabulary and merges of a tokenizer file, ready for both directions."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.special_ids = set(self.special.values())
        self.letters = byte_letters()
        self.first = np.array([self.vocab[c] for c in self.letters], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in self.letters], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for a, b in pairs:
            self.rank[(self.vocab[a], self.vocab[b])] = len(self.made)
            self.made.append(self.vocab[a + b])
        keys = np.array([(a << 32) | b for a, b in self.rank], np.int64)
        ranks = np.array(list(self.rank.values()), np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], ranks[order]
        self._made = np.array(self.made, np.int64)
        self.strings = {i: s for s, i in self.vocab.items()} | {
            i: s for s, i in self.special.items()}
        self._seams = regex.compile("|".join(map(regex.escape, self.special))) \
            if self.special else None
        self.lookahead = self._lookahead()
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _lookahead(self) -> int:
        """Characters after a token that can still change it, at most."""
        size = {i: len(s.removesuffix(self.end)) if self.end else len(s)
                for i, s in self.strings.items()}
        parts: dict[int, tuple[int, int]] = {}  # token -> (its right half, rank)
        reach: dict[int, tuple[list[int], list[int]]] = {}  # left token -> ranks, longest chain
        longest = 0
        for (a, b), rank in self.rank.items():
            after, token, below = 0, b, rank
            while token is not None:  # every token that ends where this merge ends
                ranks, chain = reach.get(token, ((), ()))
                i = bisect.bisect_left(ranks, below)
                if i:
                    after = max(after, chain[i - 1])
                token, below = parts.get(token, (None, 0))
            own = size[b] + after
            ranks, chain = reach.setdefault(a, ([], []))
            ranks.append(rank)
            chain.append(max(own, chain[-1] if chain else 0))
            parts.setdefault(self.made[rank], (b, rank))
            longest = max(longest, own)
        return longest + max(size.values())

    def merge_all(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply the merges to many words at once: symbols side by side, and the
        number of the word each belongs to (ascending)."""
        done_s, done_o = [], []
        while len(symbols):
            key = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            hit = (self._keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(hit, self._ranks[at], 1 << 40)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, 1 << 40], starts)
            words = np.diff(np.r_[starts, len(owner)])
            best = np.repeat(lowest, words)
            open_ = best < (1 << 40)
            done_s.append(symbols[~open_])
            done_o.append(owner[~open_])
            take = np.r_[rank == best[:-1], False] & open_
            where = np.flatnonzero(take)
            if len(where):  # overlapping pairs (aaa): every second one of a chain, from the left
                chain = np.r_[True, np.diff(where) > 1]
                head = where[np.maximum.accumulate(np.where(chain, np.arange(len(where)), 0))]
                where = where[(where - head) % 2 == 0]
                symbols = symbols.copy()
                symbols[where] = self._made[best[where]]
                keep = open_.copy()
                keep[where + 1] = False
            else:
                keep = open_
            symbols, owner = symbols[keep], owner[keep]
        s, o = np.concatenate(done_s or [symbols]), np.concatenate(done_o or [owner])
        order = np.argsort(o, kind="stable")
        return s[order], o[order]

    def symbols(self, word: bytes, ends: bool = True) -> np.ndarray:
        out = self.first[np.frombuffer(word, np.uint8)]
        if ends and len(out):
            out[-1] = self.last[word[-1]]
        return out

    def stream(self, pieces: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of one word given in pieces; holds a few lookaheads of bytes.
        The last byte is held back, as it alone carries the mark of a word's end."""
        room = 4 * self.lookahead + 64
        held = b""
        for piece in pieces:
            for i in range(0, len(piece), room):
                held += piece[i:i + room]
                if len(held) < 2 * room:
                    continue
                ids, _ = self.merge_all(self.symbols(held, False), np.zeros(len(held), np.int64))
                ends = np.cumsum([len(self.strings[int(t)]) for t in ids])
                n = int(np.searchsorted(ends, len(held) - self.lookahead - 1))
                if n:
                    yield ids[:n]
                    held = held[ends[n - 1]:]
        if held:
            yield self.merge_all(self.symbols(held), np.zeros(len(held), np.int64))[0]

    def remember(self, words: Iterable[str]) -> None:
        """Encode the words not in the cache."""
        fresh = [w for w in set(words) if w not in self._new]
        if len(self._new) + len(fresh) > CACHED_WORDS:
            self._old, self._new = self._new, {}
            fresh = list(set(words))
        todo = []
        for w in fresh:
            known = self._old.get(w)
            if known is None:
                todo.append(w)
            else:
                self._new[w] = known
        raw = [w.encode() for w in todo]
        short = [i for i, w in enumerate(raw) if len(w) <= SHORT]
        if short:
            sizes = np.array([len(raw[i]) for i in short])
            joined = b"".join(raw[i] for i in short)
            symbols = self.symbols(joined, False)
            tails = np.cumsum(sizes) - 1
            symbols[tails] = self.last[np.frombuffer(joined, np.uint8)[tails]]
            ids, owner = self.merge_all(symbols, np.repeat(np.arange(len(short)), sizes))
            cuts = np.searchsorted(owner, np.arange(len(short) + 1)) * 4
            packed = ids.astype("<u4").tobytes()
            for k, i in enumerate(short):
                self._new[todo[i]] = packed[cuts[k]:cuts[k + 1]]
        for i, w in enumerate(raw):
            if len(w) > SHORT:
                self._new[todo[i]] = b"".join(x.astype("<u4").tobytes() for x in self.stream([w]))

    def segments(self, text: str) -> Iterator[list[str] | int]:
        """Words of a text in bounded lists, and ids of special tokens."""
        at = 0
        seams = list(self._seams.finditer(text)) if self._seams else []
        for seam in [*seams, None]:
            plain = text[at:seam.start() if seam else len(text)]
            plain = unicodedata.normalize("NFC", plain).replace("Σ", "σ").lower()
            if len(plain) < 8 * AT_ONCE:
                yield SPLIT.findall(plain)
            else:
                part: list[str] = []
                for m in SPLIT.finditer(plain):
                    part.append(m[0])
                    if len(part) >= AT_ONCE:
                        yield part
                        part = []
                yield part
            if seam:
                yield self.special[seam[0]]
                at = seam.end()

    def encode(self, text: str, parts: list | None = None) -> Iterator[bytes]:
        """Ids of a text as little-endian 32-bit integers, part by part; ``parts``:
        its segments, if they are known."""
        for part in self.segments(text) if parts is None else parts:
            if isinstance(part, int):
                yield part.to_bytes(4, "little")
                continue
            long = [w for w in part if len(w) > SHORT]
            if long:  # such words are not cached
                for w in part:
                    if len(w) > SHORT:
                        for ids in self.stream([w.encode()]):
                            yield ids.astype("<u4").tobytes()
                    else:
                        self.remember([w])
                        yield self._new[w]
            else:
                self.remember_missing(part)
                yield b"".join(map(self._new.__getitem__, part))

    def remember_missing(self, part: list[str]) -> None:
        if any(w not in self._new for w in part):
            self.remember(part)


class TextState:
    """Incremental decoder: token ids in, finished text out.

    ``joined`` gives token strings with one space between them.  Otherwise token
    bytes run through a UTF-8 state machine that holds back an unfinished
    character, and the end mark of a word becomes a space.
    """

    def __init__(self, tokenizer: Tokenizer, joined: bool):
        self.t, self.joined, self.begun = tokenizer, joined, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.byte_of = {c: b for b, c in enumerate(tokenizer.letters)}

    def feed(self, ids: Iterable[int]) -> str:
        if self.joined:
            out = " ".join(map(self.t.strings.__getitem__, ids))
            if out and self.begun:
                out = " " + out
            self.begun |= bool(out)
            return out
        raw = bytearray()
        for i in ids:
            s = self.t.strings[i]
            if i in self.t.special_ids:
                raw += s.encode()
            else:
                end = bool(self.t.end) and s.endswith(self.t.end)
                raw += bytes(self.byte_of[c] for c in (s.removesuffix(self.t.end) if end else s))
                raw += b" " * end
        return self.utf8.decode(bytes(raw))

    def finish(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)



def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        raw = file.read(MAX_FILE + 1)
    if len(raw) > MAX_FILE:
        raise ValueError(f"tokenizer file over {MAX_FILE} bytes: {path}")
    return raw


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Tokens of every text, and the digests of ids and of the decoded text.

    ``keep_ids`` adds the ids themselves.  Narrow: nothing is shuffled; the
    tokenizer file is broadcast, its size is checked.
    """
    raw = docs.sparkSession.sparkContext.broadcast(_read(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
                       + [("ids", pa.list_(pa.int32()))] * keep_ids)
    ddl = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
           + ", ids array<int>" * keep_ids)

    def run(batches):
        tokenizer = Tokenizer(raw.value)

        def one(text, parts):
            ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
            state, n, kept = TextState(tokenizer, joined=True), 0, []
            for packed in tokenizer.encode(text, parts):
                ids_hash.update(packed)
                ids = np.frombuffer(packed, "<u4")
                n += len(ids)
                text_hash.update(state.feed(ids.tolist()).encode())
                if keep_ids:
                    kept.append(ids)
            text_hash.update(state.finish().encode())
            row = (n, ids_hash.hexdigest(), text_hash.hexdigest())
            return row + ((np.concatenate(kept).astype(np.int32) if kept else [],) if keep_ids else ())

        def part(batch):
            texts = batch.column("text").to_pylist()
            split = [list(tokenizer.segments(t)) if len(t) < 8 * AT_ONCE else None for t in texts]
            tokenizer.remember(w for parts in split if parts for s in parts
                               if not isinstance(s, int) for w in s if len(w) <= SHORT)
            rows = list(map(one, texts, split))
            return [batch.column("doc_id")] + [
                pa.array([r[i] for r in rows], schema.field(i + 1).type)
                for i in range(len(schema) - 1)]
        yield from common.per_chunk(part, schema)(batches)
    return common.texts(docs).mapInArrow(run, ddl)
