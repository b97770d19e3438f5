"""Suffix-array dedup: remove every byte that lies in a repeated string of LENGTH bytes.

Strings of SHORT bytes that repeat are found with them and reported, not removed: a passage
of some fifty words may be shorter than LENGTH.

A string of SHORT bytes is a window. Windows that are equal pick the same anchor: the
GRAM-byte substring with the least hash, at the same offset. Windows of a document that
share an anchor form a run; its segment is its bytes and what follows, up to LENGTH bytes
from the last window's start or the document's end. Only segments with equal anchors can hold
equal strings of either size. So

1. each document is cut into runs (prefix polynomial hashes give all substring hashes);
2. equal segments are counted together, and distinct segments meet by anchor. A segment
   that occurs twice is repeated as a whole, one alone with its anchor is not;
3. the windows of the other segments are starts of suffixes that are sorted, those with the
   same anchor and offset together: a mergesort compares two suffixes by binary search for
   their common extension over prefix hashes, up to LENGTH bytes. Neighbours whose common
   extension is SHORT or LENGTH bytes are equal strings, once their bytes are compared too;
4. anchors with more than GROUP distinct segments are split: their strings meet by two
   hashes of the whole string;
5. the repeated strings go back to all documents that hold the segment, and are cut out.

Whole segments are told apart by a polynomial hash and an independent 64-bit hash together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

LENGTH, SHORT = 400, 280
GRAM = 128
#: An anchor's distinct segments are sorted together up to this number.
GROUP = 4096
#: Bytes hashed at once, and segment bytes sorted at once.
BLOCK = 1 << 18
SORT_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = np.uint64((1 << 20) - 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return tuple(out)


def _prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes."""
    n = 1 << max(20, int(len(data)).bit_length())
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n)[0][: len(data)], out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


class Sizes(NamedTuple):
    """Bytes of a removed string, of a window, and of an anchor."""

    length: int
    short: int
    gram: int

    @property
    def both(self) -> tuple[int, ...]:
        return tuple(dict.fromkeys((self.short, self.length)))


class Part(NamedTuple):
    """A text, or a part of a long one, in a block: its bytes there, the windows that are its own, its text, and its offset in that."""

    start: int
    end: int
    windows: int
    owner: int
    offset: int


def _runs(data: bytes, parts: list[Part], of: Sizes) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor inside the parts: part, start in the block, number of windows,
    of those that a whole string of ``length`` follows, anchor's offset, anchor's hash, and two hashes of the segment."""
    view = np.frombuffer(data, np.uint8)
    windows = len(view) - of.short + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 8
    sums = _prefix(view)
    inverse = _powers(1 << max(20, len(view).bit_length()))[1]
    grams = sums[of.gram :] - sums[: -of.gram]
    grams *= inverse[: len(grams)]
    grams = _mix(grams)
    at = (_least((grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64), of.short - of.gram + 1) & _MASK).astype(np.int64)
    valid = np.zeros(windows, bool)
    cut = np.ones(windows + 1, bool)
    cut[1:-1] = at[1:] != at[:-1]
    for p in parts:
        valid[p.start : p.start + p.windows] = True
        cut[p.start] = cut[p.start + p.windows] = True
    starts = np.flatnonzero(cut[:-1] & valid)
    counts = np.flatnonzero(cut[1:] & valid) + 1 - starts
    own = np.searchsorted([p.start for p in parts], starts, side="right") - 1
    limit = np.array([p.end for p in parts])[own]
    ends = np.minimum(starts + counts + of.length - 1, limit)
    whole = np.clip(limit - starts - of.length + 1, 0, counts)
    # The number of windows is hashed too: a segment at a text's end may be all of another's bytes.
    first = _mix((sums[ends] - sums[starts]) * inverse[starts] + counts.astype(np.uint64) * _M2)
    digest = xxhash.xxh3_64_digest
    second = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), np.int64)
    return own, starts, counts, whole, at[starts] - starts, grams[at[starts]].view(np.int64), first.view(np.int64), second


def _blocks(raws: list[bytes], of: Sizes) -> Iterator[tuple[bytes, list[Part]]]:
    """Texts joined to blocks; a text longer than a block is cut into parts that overlap by what their last windows need."""
    held, parts, size = [], [], 0
    for k, raw in enumerate(raws):
        for offset in range(0, len(raw) - of.short + 1, BLOCK) if len(raw) > BLOCK else [0] * (len(raw) >= of.short):
            data = raw[offset : offset + BLOCK + of.length - 1] if len(raw) > BLOCK else raw
            if held and size + len(data) > 2 * BLOCK:
                yield b"".join(held), parts
                held, parts, size = [], [], 0
            windows = len(data) - of.short + 1
            parts.append(Part(size, size + len(data), min(windows, BLOCK) if len(raw) > BLOCK else windows, k, offset))
            held.append(data)
            size += len(data)
    if held:
        yield b"".join(held), parts


_RUN = ["id", "key", "start", "windows", "whole", "anchor_at", "anchor", "h1", "h2"]
_ANCHOR, _H1, _H2, _N = 6, 7, 8, 9


def _cut(of: Sizes, count: bool):
    """Runs of each row; with ``count``, equal segments of a batch as one row with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found: list[list[np.ndarray]] = [[] for _ in _RUN]
            for data, parts in _blocks([r or b"" for r in batch.column(2).to_pylist()], of):
                own, starts, *rest = _runs(data, parts, of)
                row = np.array([p.owner for p in parts])[own]
                place = starts - np.array([p.start - p.offset for p in parts])[own]
                for out, values in zip(found, (ids[row], keys[row], place, *rest), strict=True):
                    out.append(values)
            if not found[0]:
                continue
            columns = [np.concatenate(x) for x in found]
            if count:
                h1, h2 = columns[_H1], columns[_H2]
                order = np.lexsort((h2, h1))
                new = np.ones(len(order), bool)
                new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
                first = np.flatnonzero(new)
                columns = [c[order[first]] for c in columns] + [np.diff(np.append(first, len(order)))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=[*_RUN, "n"][: len(columns)])

    return run


def _meet(group: int):
    """Of rows sorted by anchor and segment: distinct segments that occur more than once
    (``repeated``) or must be compared (``hard`` 1, or 2 in a group that is too large)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.zeros((0, _N + 1), np.int64), None

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), bool)
            new[1:] = rows[1:, _ANCHOR] != rows[:-1, _ANCHOR]
            first = np.flatnonzero(new)
            sizes = np.repeat(np.diff(np.append(first, len(rows))), np.diff(np.append(first, len(rows))))
            hard = np.where(sizes > group, 2, np.where(sizes > 1, 1, 0))
            if large is not None:
                hard[rows[:, _ANCHOR] == large] = 2
            twice = rows[:, _N] > 1
            take = twice | (hard > 0)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(rows[take, k]) for k in range(_N)), pa.array(twice[take]), pa.array(hard[take].astype(np.int64))], names=[*_RUN, "repeated", "hard"]
            )

        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, _ANCHOR:_N] != rows[:-1, _ANCHOR:_N]).any(axis=1)
            first = np.flatnonzero(new)
            totals = np.add.reduceat(rows[:, _N], first)
            rows = rows[first]
            rows[:, _N] = totals
            others = np.flatnonzero(rows[:, _ANCHOR] != rows[-1, _ANCHOR])
            last = int(others[-1]) + 1 if len(others) else 0  # of the last anchor, which may go on
            if last:
                yield emit(rows[:last])
            held = rows[last:]
            if len(held) > group:
                large = int(held[0, _ANCHOR])
                yield emit(held[:-1])
                held = held[-1:]
        if len(held):
            yield emit(held)

    return run


def common_extension(sums: np.ndarray, inverse: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Lengths of the common extensions of the suffixes at ``x`` and ``y``, each up to its ``limit``."""
    sx, sy, ix, iy = sums[x], sums[y], inverse[x], inverse[y]
    low, step = np.zeros(len(x), np.int64), 1 << (int(limit.max(initial=1)).bit_length() - 1)
    while step:
        further = np.minimum(low + step, limit)
        same = (sums[x + further] - sx) * ix == (sums[y + further] - sy) * iy
        low = np.where(same, further, low)
        step >>= 1
    return low


def sort_suffixes(data: np.ndarray, positions: np.ndarray, classes: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Order of ``positions`` by class (they come sorted by it) and then by their suffixes, each of ``limit`` bytes.

    A bottom-up mergesort of all classes at once: each element finds its place in the
    neighbouring run by binary search, all elements a step at a time.
    """
    sums = _prefix(data)
    inverse = _powers(1 << max(20, len(data).bit_length()))[1]
    whole = (sums[positions + limit] - sums[positions]) * inverse[positions]
    n = len(positions)
    new = np.ones(n, bool)
    new[1:] = classes[1:] != classes[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    order, rank = np.arange(n), np.arange(n) - begin
    width = 1
    while width < (sizes.max() if n else 0):
        todo = np.flatnonzero(size > width)  # slots of classes that are not yet sorted
        run = rank[todo] // width
        other = run ^ 1
        low = np.minimum(other * width, size[todo])
        high = np.minimum(low + width, size[todo])
        start = low.copy()
        right = (run & 1).astype(bool)  # a right element goes after equal left ones
        mine = order[todo]
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            a, b = mine[open_], order[begin[todo[open_]] + middle]
            before = np.where(right[open_], True, False)  # equal: counts as before only for right elements
            differ = np.flatnonzero((whole[a] != whole[b]) | (limit[a] != limit[b]))
            if len(differ):
                x, y = a[differ], b[differ]
                both = np.minimum(limit[x], limit[y])
                far = common_extension(sums, inverse, positions[x], positions[y], both)
                inside = np.minimum(far, both - 1)
                before[differ] = np.where(far < both, data[positions[y] + inside] < data[positions[x] + inside], limit[y] < limit[x])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        place = np.minimum(run, other) * width + rank[todo] - run * width + (low - start)
        order[begin[todo] + place] = mine
        width *= 2
    return order


def _verified(raw: bytes, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Which of the strings of ``size`` bytes at ``x`` and ``y`` are equal; stretches that move together are compared once."""
    x, y = np.minimum(x, y), np.maximum(x, y)
    by = np.lexsort((x, y - x))
    x, y = x[by], y[by]
    cut = np.ones(len(x), bool)
    cut[1:] = (x[1:] != x[:-1] + 1) | (y[1:] - x[1:] != y[:-1] - x[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(x)) - 1
    true = np.ones(len(x), bool)
    for i, j, a, b, c in zip(first.tolist(), last.tolist(), x[first].tolist(), y[first].tolist(), (x[last] + size).tolist()):
        if raw[a:c] != raw[b : b + c - a]:
            for k in range(i, j + 1):
                true[k] = raw[x[k] : x[k] + size] == raw[y[k] : y[k] + size]
    out = np.empty(len(x), bool)
    out[by] = true
    return out


def repeated_strings(segments: list[bytes], groups: np.ndarray, anchors: np.ndarray, counts: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of ``sizes``, the first of them a window's, the segment and window of each string that occurs in two segments of a group."""
    raw = b"".join(segments)
    data = np.frombuffer(raw, np.uint8)
    lengths = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(segments)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    classes = groups[owner] * (2 * max(sizes)) + anchors[owner] - offset + max(sizes)
    order = np.argsort(classes, kind="stable")
    classes = classes[order]
    twin = np.zeros(len(order), bool)
    twin[1:] = classes[1:] == classes[:-1]
    twin[:-1] |= twin[1:]
    order, classes = order[twin], classes[twin]  # others have no partner
    positions = (ends - lengths)[owner[order]] + offset[order]
    limit = np.minimum(max(sizes), ends[owner[order]] - positions)
    ranked = sort_suffixes(data, positions, classes, limit)
    order, positions, classes, limit = order[ranked], positions[ranked], classes[ranked], limit[ranked]
    sums, inverse = _prefix(data), _powers(1 << max(20, len(data).bit_length()))[1]
    far = common_extension(sums, inverse, positions[:-1], positions[1:], np.minimum(limit[:-1], limit[1:]))
    out = []
    for size in sizes:
        pairs = np.flatnonzero((far >= size) & (classes[1:] == classes[:-1]))
        pairs = pairs[_verified(raw, positions[pairs], positions[pairs + 1], size)] if len(pairs) else pairs  # collisions
        at = np.unique(np.concatenate((order[pairs], order[pairs + 1])))
        out.append((owner[at], offset[at]))
    return out


_FETCHED = "k1 long, k2 long, h1 long, h2 long, windows long, anchor_at long, size long, bytes binary"


def _fetch(of: Sizes):
    """Segments' bytes out of their documents; for segments of too large groups the hashes of their strings of both sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for raw, segments in zip(batch.column(0), batch.column(1), strict=True):
                raw = raw.as_py() or b""
                for s in segments.as_py():
                    at, n = s["start"], s["windows"]
                    data = raw[at : at + n + of.length - 1]
                    if s["hard"] == 1:
                        out.append((s["anchor"], 0, s["h1"], s["h2"], n, s["anchor_at"], 0, data))
                        held += len(data)
                        continue
                    view = np.frombuffer(data, np.uint8)
                    sums, inverse = _prefix(view), _powers(1 << 20)[1]
                    for size, m in zip(of.both, (n, s["whole"])):
                        hashes = _mix((sums[size : size + m] - sums[:m]) * inverse[:m]).view(np.int64).tolist()
                        for k, h in enumerate(hashes):
                            h2 = int.from_bytes(xxhash.xxh3_64_digest(data[k : k + size]), "little", signed=True) | 1
                            out.append((h, h2, s["h1"], s["h2"], n, k, size, None))
                    held += 120 * n
                if held > SORT_BYTES:
                    yield _fetched(out)
                    out, held = [], 0
            if out:
                yield _fetched(out)

    return run


def _fetched(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 7 + [pa.binary()]
    names = ["k1", "k2", "h1", "h2", "windows", "anchor_at", "size", "bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


_JUDGED = ["h1", "h2", "first", "count", "size"]


def _judged(h1: np.ndarray, h2: np.ndarray, owner: np.ndarray, offset: np.ndarray, size: int) -> pa.RecordBatch:
    """Runs of repeated strings of ``size`` bytes as rows; owner and offset come sorted."""
    cut = np.ones(len(owner), bool)
    cut[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(owner)))
    own = owner[first]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (h1[own], h2[own], offset[first], count, np.full(len(own), size))], names=_JUDGED)


def _sort(of: Sizes):
    """Judge fetched rows, which come sorted by their two keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one anchor
        seen: list | None = None  # the last string of a too large group

        def segments(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sort whole groups, about SORT_BYTES at once."""
            batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            bytes_ = np.cumsum(pa.compute.binary_length(batch.column(7)).to_numpy(zero_copy_only=False))
            at = done = 0
            for end in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]:
                if bytes_[end - 1] - done < SORT_BYTES and end < len(keys):
                    continue
                part = batch.slice(at, end - at)
                own, h1, h2, windows, anchors = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5))
                groups = np.cumsum(np.concatenate(([0], own[1:] != own[:-1])))
                for size, found in zip(of.both, repeated_strings(part.column(7).to_pylist(), groups, anchors, windows, of.both), strict=True):
                    yield _judged(h1, h2, *found, size)
                at, done = end, int(bytes_[end - 1])

        for batch in batches:
            loose = pa.compute.is_null(batch.column(7)).to_numpy(zero_copy_only=False)
            if loose.any():
                rows = batch.filter(pa.array(loose))
                columns = [rows.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
                if seen is not None:
                    columns = [np.concatenate(([s], c)) for s, c in zip(seen, columns, strict=True)]
                same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
                twin = np.append(same, False)
                twin[1:] |= same
                if twin.any():
                    for size in of.both:
                        own = np.flatnonzero(twin & (columns[6] == size))
                        if len(own):
                            yield _judged(*columns[2:4], own, columns[5][own], size)
                seen = [c[-1] for c in columns]
                batch = batch.filter(pa.array(~loose))
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            if held and held[-1].column(0)[-1].as_py() != int(keys[0]):
                yield from segments(held)
                held = []
            others = np.flatnonzero(keys != keys[-1])
            last = int(others[-1]) + 1 if len(others) else 0
            if last:
                yield from segments([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from segments(held)

    return run


def _covered(runs: list[dict], size: int) -> list[list[int]]:
    """The bytes of the runs of strings of one size, merged."""
    merged: list[list[int]] = []
    for a, b in sorted((r["at"], r["at"] + r["count"] + size - 1) for r in runs if r["size"] == size):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _remove(of: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept, repeated = [], [], [], [], []
            for raw, runs in zip(batch.column("__raw"), batch.column("__runs"), strict=True):
                raw, runs = raw.as_py() or b"", runs.as_py() or []
                merged, at, parts = _covered(runs, of.length), 0, []
                for a, b in merged:
                    parts.append(raw[at:a])
                    at = b
                n.append(len(raw))
                removed.append(sum(b - a for a, b in merged))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join([*parts, raw[at:]]) if merged else raw)
                repeated.append(sum(b - a for a, b in _covered(runs, of.short)))
            new = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(repeated, pa.int64())]
            names = [c for c in batch.schema.names if c not in ("__raw", "__runs")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, "n_bytes", "n_removed", "spans", "kept", "n_repeated"])

    return run


def _key(doc_id: Column, text: Column) -> dict[str, Column]:
    """What tells rows apart: the id (null: 0) and a hash of text and id. Repeated rows share it, and their result."""
    return {"id": F.coalesce(doc_id, F.lit(0).cast("long")), "key": F.xxhash64(text, doc_id)}


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, short: int = SHORT, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept, n_repeated`` of each row.

    Each byte covered by a string of ``length`` bytes that also starts elsewhere in any
    document (the same included) is removed; ``spans`` are the maximal removed runs as byte
    offsets, ``kept`` is what remains. ``n_repeated`` counts the bytes covered by such strings
    of ``short`` bytes (``length`` if that is less), removed or not. All is judged on the input; strings do not span
    documents. A null text counts as empty; texts shorter than ``length`` stay. Repeated
    rows repeat each other. An empty table gives an empty result.
    """
    of = Sizes(length, min(short, length), min(gram, short, length))
    own = F.col(doc_id).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *(c.alias(n) for n, c in _key(F.col("doc_id"), F.col("text")).items()), F.col("text").cast("binary").alias("__raw"))
    source = rows.select("id", "key", "__raw")
    kinds = ", ".join(f"{c} long" for c in _RUN)
    counted = source.mapInArrow(_cut(of, True), f"{kinds}, n long")
    met = keep(counted.repartition("anchor").sortWithinPartitions("anchor", "h1", "h2").mapInArrow(_meet(group), f"{kinds}, repeated boolean, hard long"))
    wanted = met.where("hard > 0").groupBy("id", "key").agg(F.collect_list(F.struct("start", "windows", "whole", "anchor_at", "anchor", "h1", "h2", "hard")).alias("segments"))
    # Repeated rows are fetched twice, which adds nothing: all their strings are repeated.
    # With doc_id the texts' exchange has the columns of the last one, so Spark makes it once.
    fetched = rows.join(wanted, ["id", "key"]).select("__raw", "segments", "doc_id").mapInArrow(_fetch(of), _FETCHED)
    judged = fetched.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_sort(of), ", ".join(f"{c} long" for c in _JUDGED))
    string = lambda count, size: F.struct(F.lit(0).cast("long").alias("first"), F.col(count).alias("count"), F.lit(size).cast("long").alias("size"))
    repeated = met.where("repeated").select("h1", "h2", F.inline(F.array(string("windows", of.short), string("whole", of.length)))).where("count > 0")
    runs = source.mapInArrow(_cut(of, False), kinds).select("id", "key", "start", "h1", "h2")
    found = runs.join(judged.unionByName(repeated), ["h1", "h2"]).select("id", "key", F.struct((F.col("start") + F.col("first")).alias("at"), "count", "size").alias("run"))
    by_doc = found.groupBy("id", "key").agg(F.collect_set("run").alias("__runs"))  # a set, as repeated rows bring the same runs
    out = rows.join(by_doc, ["id", "key"], "left").select("doc_id", "__raw", "__runs")
    return out.mapInArrow(_remove(of), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, n_repeated long")
