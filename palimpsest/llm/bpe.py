"""Byte-level BPE by a hierarchical-bitmap rank queue.

A vocabulary is a file of token bytes and ranks; two neighbours merge when their joined
bytes have a rank, the lowest rank first, the leftmost of equal ranks first. The queue has a
bucket for each rank, holding positions of a linked list of tokens; a bitmap of three
levels marks the buckets in use, and find-first-set picks the next rank. Entries are never
removed when a neighbour changes: an entry whose position has another rank by now is stale
and skipped. One queue serves many pre-tokens at once (their lists do not touch, so their
merges do not depend on each other), and a pre-token of a million bytes costs no more per
byte than a short one.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes whose distinct pre-tokens share one queue.
BATCH_BYTES = 4_000_000
#: Token ids decoded at once.
DECODED = 1 << 18
_EMPTY = np.iinfo(np.int64).max
#: White space as the Unicode property has it.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    """Ranks by token bytes, as arrays for lookups of many pairs at once."""

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        size = max(self.ranks.values(), default=0) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        get = self.ranks.get
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        #: Ranks whose token has a merge of lower rank: after such a merge a lower bucket may come first.
        self.unordered = np.zeros(size, bool)
        self.unordered[left[rank < left]] = True
        self.unordered[right[rank < right]] = True
        self.bits = max(4, int(2 * max(1, len(rank)) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, _EMPTY, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, todo = left << 32 | right, np.arange(len(rank))
        slots = self._slot(keys)
        while len(todo):
            free = self.keys[slots[todo]] == _EMPTY
            _, first = np.unique(slots[todo], return_index=True)
            done = np.zeros(len(todo), bool)
            done[first] = True
            done &= free
            self.keys[slots[todo[done]]], self.values[slots[todo[done]]] = keys[todo[done]], rank[todo[done]]
            todo = todo[~done]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens]))).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, -1 where they do not merge."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (found != _EMPTY)]
        return out


class RankQueue:
    """Buckets of positions by rank, under a bitmap of three levels.

    A bucket is a chain of segments; what one push adds to it is one segment, a slice of
    that push's positions.
    """

    def __init__(self, ranks: int):
        self.levels = [[0] * n for n in ((ranks >> 6) + 1, (ranks >> 12) + 1, (ranks >> 18) + 1)]
        self.chains: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        else:
            cuts = [0, 1]
        chains, (low, middle, high) = self.chains, self.levels
        for (a, b), rank in zip(pairwise(cuts), ranks[cuts[:-1]].tolist()):
            if held := chains.get(rank):
                held.append(positions[a:b])
                continue
            chains[rank] = [positions[a:b]]
            low[rank >> 6] |= 1 << (rank & 63)
            middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            high[rank >> 18] |= 1 << (rank >> 12 & 63)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank in use and its positions, which leave the queue; None when it is empty."""
        low, middle, high = self.levels
        for top, word in enumerate(high):
            if word:
                break
        else:
            return None
        b = top << 6 | (word & -word).bit_length() - 1
        a = b << 6 | (middle[b] & -middle[b]).bit_length() - 1
        rank = a << 6 | (low[a] & -low[a]).bit_length() - 1
        low[a] &= low[a] - 1
        if not low[a]:
            middle[b] &= middle[b] - 1
            if not middle[b]:
                high[top] &= high[top] - 1
        held = self.chains.pop(rank)
        return rank, held[0] if len(held) == 1 else np.concatenate(held)


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, and where each piece's ids start (with the end at last)."""
    whole = [vocabulary.ranks.get(p, -1) for p in pieces]
    split = [i for i, r in enumerate(whole) if r < 0 and pieces[i]]
    counts = np.ones(len(pieces), np.int64)
    counts[[i for i, p in enumerate(pieces) if not p]] = 0
    ids, owner = _merge([pieces[i] for i in split], vocabulary)
    counts[split] = np.bincount(owner, minlength=len(split))
    starts = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(starts[-1], np.int32)
    direct = np.flatnonzero(np.array(whole, np.int64) >= 0)
    out[starts[direct]] = np.array(whole, np.int64)[direct]
    if len(split):
        base = starts[split]
        first = np.concatenate(([0], np.cumsum(counts[split])))[:-1]
        out[base[owner] + np.arange(len(ids)) - first[owner]] = ids
    return out, starts


def _merge(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merged ids of all pieces in order, and the piece of each."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    token = vocabulary.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    after = np.arange(1, n + 1, dtype=np.int32)
    after[np.cumsum(sizes) - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[np.cumsum(sizes) - sizes] = -1
    rank = np.full(n, -1, np.int32)  # of the pair that starts here; -1 also where a token was merged away
    open_ = np.flatnonzero(after >= 0).astype(np.int32)
    rank[open_] = vocabulary.pairs(token[open_], token[open_ + 1])
    open_ = open_[rank[open_] >= 0]
    alive = np.ones(n, bool)
    queue = RankQueue(len(vocabulary.tokens))
    queue.push(rank[open_], open_)
    while (popped := queue.pop()) is not None:
        now, at = popped
        at = at[rank[at] == now]  # others are stale
        if len(at) > 1:
            at.sort()
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        if not len(at):
            continue
        if len(at) > 1:
            if vocabulary.unordered[now]:
                own = piece[at]
                take = np.concatenate(([True], own[1:] != own[:-1]))  # a lower rank may come before the next in a piece
                queue.push(np.full(len(at) - take.sum(), now, np.int32), at[~take])
                at = at[take]
            elif len(touch := np.flatnonzero(after[at[:-1]] == at[1:])):  # overlapping pairs, as in aaaa: every second one
                run = np.ones(len(at), bool)
                run[touch + 1] = False
                first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        token[at] = now
        alive[gone] = False
        rank[gone] = -1
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        prior = before[at]
        changed = np.concatenate((at, prior[prior >= 0]))
        if len(prior) > 1:
            changed = np.unique(changed)
        ends = after[changed]
        rank[changed] = -1
        changed, ends = changed[ends >= 0], ends[ends >= 0]
        made = vocabulary.pairs(token[changed], token[ends])
        rank[changed] = made
        merges = made >= 0
        queue.push(made[merges], changed[merges])
    return token[alive], piece[alive].astype(np.int64)


@cache
def _classes(top: int) -> tuple[str, str]:
    """Ranges of letters and of numbers up to a code point, for a character class."""
    out = []
    for kind in "LN":
        points = [c for c in range(top + 1) if unicodedata.category(chr(c))[0] == kind]
        breaks = [0, *(i for i in range(1, len(points)) if points[i] != points[i - 1] + 1), len(points)]
        out.append("".join(f"{chr(points[a])}-{chr(points[b - 1])}" for a, b in pairwise(breaks)))
    return tuple(out)


@cache
def splitter(pattern: str, astral: bool) -> re.Pattern:
    r"""``pattern`` for ``re``, with ``\p{L}``, ``\p{N}`` and white space spelled out by Unicode category.

    Without ``astral`` it is right for texts below U+10000 only, and faster.
    """
    letters, numbers = _classes(sys.maxunicode if astral else 0xFFFF)
    spelled = re.sub(r"\[(\^?)((?:\\s|\\p\{L\}|\\p\{N\})+)\]", lambda m: f"[{m[1]}" + m[2].replace(r"\s", _SPACE).replace(r"\p{L}", letters).replace(r"\p{N}", numbers) + "]", pattern)
    spelled = spelled.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(spelled.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


def split(raw: bytes, pattern: str) -> list[str]:
    """Pre-tokens of a text's UTF-8; malformed bytes count as U+FFFD."""
    astral = bool(len(raw)) and int(np.frombuffer(raw, np.uint8).max()) >= 0xF0
    return splitter(pattern, astral).findall(raw.decode("utf-8", "replace"))


def _gather(flat: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated slices ``picks`` of ``flat``, and the length of each."""
    sizes = starts[picks + 1] - starts[picks]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[picks] - (ends - sizes), sizes)], sizes


def decode_ids(flat: np.ndarray, vocabulary: Vocabulary) -> tuple[bytes, np.ndarray]:
    """The bytes of all ids, and where each id's bytes start (with the end at last)."""
    parts = [_gather(vocabulary.flat, vocabulary.starts, flat[i : i + DECODED].astype(np.int64))[0].tobytes() for i in range(0, len(flat), DECODED)]
    return b"".join(parts), np.concatenate(([0], np.cumsum((vocabulary.starts[1:] - vocabulary.starts[:-1])[flat])))


def encode_texts(raws: list[bytes], vocabulary: Vocabulary, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, and where each text's ids start (with the end at last)."""
    names: dict[str, int] = defaultdict(count().__next__)
    picks = [np.fromiter(map(names.__getitem__, split(raw, pattern)), np.int32) for raw in raws]
    flat, starts = encode_pieces([p.encode() for p in names], vocabulary)
    ids, sizes = _gather(flat, starts, np.concatenate(picks).astype(np.int64) if picks else np.zeros(0, np.int64))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return ids, cuts[np.concatenate(([0], np.cumsum([len(p) for p in picks]))).astype(np.int64)]


_HELD: dict[str, Vocabulary] = {}


def _vocabulary(shared, name: str) -> Vocabulary:
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Vocabulary(shared.value)
    return _HELD[name]


def _portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of rows whose sizes add up to ``most`` at most, or of one row."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


class Tokenizer:
    """Encodes and decodes columns by a rank file and a pattern; the file goes to the executors whole."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.content = f.read()
        self.pattern = pattern

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
        """The columns ``keep`` of ``docs`` (all by default) and ``ids``, an array of token ids.

        Each match of the pattern is encoded by itself; no special tokens. Null and empty
        texts have no ids. A column named like ``ids`` is replaced.
        """
        names = [c for c in (docs.columns if keep is None else keep) if c != ids]
        rows = docs.select(*names, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("__raw"))
        schema = rows.select(*names, F.array().cast("array<int>").alias(ids)).schema
        shared, name, pattern = docs.sparkSession.sparkContext.broadcast(self.content), uuid.uuid4().hex, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raws = batch.column("__raw")
                for a, b in _portions(pa.compute.binary_length(raws).to_pylist(), BATCH_BYTES):
                    flat, starts = encode_texts(raws.slice(a, b - a).to_pylist(), _vocabulary(shared, name), pattern)
                    made = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), made], names=[*names, ids])
                pa.default_memory_pool().release_unused()

        return rows.mapInArrow(run, schema)

    def decode(self, rows: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """``rows`` with the bytes of its ids; null ids give null. Unknown ids raise."""
        names = [c for c in rows.columns if c != out]
        schema = rows.select(*names, F.when(F.col(ids).isNotNull(), F.lit(b"")).alias(out)).schema
        shared, name = rows.sparkSession.sparkContext.broadcast(self.content), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vocabulary = _vocabulary(shared, name)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(ids)), 0).to_pylist()
                for a, b in _portions(sizes, 4 * DECODED):
                    lists = batch.column(ids).slice(a, b - a)
                    raw, starts = decode_ids(lists.flatten().to_numpy(zero_copy_only=False), vocabulary)
                    ends = starts[np.concatenate(([0], np.cumsum(sizes[a:b]))).astype(np.int64)].tolist()
                    made = [None if empty else raw[ends[k] : ends[k + 1]] for k, empty in enumerate(lists.is_null().to_pylist())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), pa.array(made, pa.binary())], names=[*names, out])
                pa.default_memory_pool().release_unused()

        return rows.mapInArrow(run, schema)
