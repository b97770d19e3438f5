"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Normalised text is its words, A-Z lower-cased. The automaton holds every window of the
benchmark, a word being a few symbols that number it, each from a range of its own, so that
a window occurs exactly where its symbols do and a state has few successors. A document is
normalised and scanned once; words that no item has are one symbol that leads nowhere. Hits
are found at words, and these at offsets of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Rows judged at once.
ROWS = 1000
#: Bytes of items, normalised, that one automaton holds; only a larger benchmark is scanned in several. A window takes about
#: half a kilobyte (SYMBOLS choices for each symbol), and each of the items' words begins one.
BLOCK_BYTES = 8_000_000
SYMBOLS = 64

#: Bytes that words consist of stay (A-Z in lower case), others become spaces. All bytes of
#: multi-byte characters are word bytes.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^ ]+")

RESULT = "words long, hits array<struct<first:long,last:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Runs of ``size`` words; all words if there are fewer; none if none."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def normalised(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, words`` of each item: the words of its text in a row; null texts have none, a null id is named ``null``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [b" ".join(words_of(raw or b"")) for raw in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(made, pa.binary())], names=["item", "words"])

    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("binary").alias("text"))
    return named.mapInArrow(run, "item string, words binary")


class Windows(NamedTuple):
    """The automaton, the symbols of each word that items have, and those of any other word."""

    automaton: ahocorasick.Automaton
    symbols: dict[bytes, str]
    other: str


def built(items: list[tuple[str, bytes]], size: int = WINDOW) -> Windows | None:
    """Of items as :func:`normalised` gives them; None without any window."""
    by_window: dict[tuple[bytes, ...], set[str]] = {}
    for item, words in items:
        for window in windows_of(words.split(), size):
            by_window.setdefault(window, set()).add(item)
    if not by_window:
        return None
    number: dict[bytes, int] = {}
    for window in by_window:
        for word in window:
            number.setdefault(word, len(number))
    width = 1
    while SYMBOLS**width < len(number):
        width += 1
    digits = [[chr(1 + SYMBOLS * place + k) for k in range(SYMBOLS)] for place in range(width)]
    symbols = {word: "".join(digits[p][n // SYMBOLS**p % SYMBOLS] for p in range(width)) for word, n in number.items()}
    automaton = ahocorasick.Automaton()
    for window, names in by_window.items():
        automaton.add_word("".join([symbols[w] for w in window]), (len(window), tuple(names)))
    automaton.make_automaton()
    return Windows(automaton, symbols, "\0" * width)


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def scan(raw: bytes, held: Windows | None, flags: np.ndarray | None = None) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, the words that are hit (None: none is), and the items with windows there."""
    words = words_of(raw)
    if held is None or not words:
        return len(words), flags, set()
    get, other, width = held.symbols.get, held.other, len(held.other)
    steps, items = None, set()
    for end, (size, names) in held.automaton.iter("".join([get(w, other) for w in words])):
        if steps is None:
            steps = np.zeros(len(words) + 1, np.int64)
        last = end // width + 1
        steps[last - size] += 1
        steps[last] -= 1
        items.update(names)
    if steps is not None:
        hit = np.cumsum(steps[:-1]) > 0
        flags = hit if flags is None else flags | hit
    return len(words), flags, items


def find_windows(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with ``words``, ``hits`` (runs of hit words, last exclusive), ``spans`` and ``items``.

    ``spans`` are the hit runs as code-point offsets of the original text, end exclusive;
    ``items`` the sorted ids, as strings, of the items with windows in the document. Null and
    empty texts have no words and no hits. Windows shared by items count for each of them.
    Only normalised items are collected, BLOCK_BYTES at most; a larger benchmark is dealt to
    blocks by item, each an automaton and a scan of its own. Columns of ``docs`` named like a
    result are replaced.
    """
    made = normalised(items, item_id, item_text).distinct()
    total = made.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = -(-total * 3 // (2 * BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    names = [c for c in docs.columns if c not in ("words", "hits", "spans", "items")]
    out = docs.select(*names, F.lit(0).cast("long").alias("words"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("hits"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    for block in range(blocks):
        part = made if blocks == 1 else made.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])
        out = out.mapInArrow(_scanner(shared, text, size), schema)
    return out


_HELD: dict = {}


def _scanner(shared, text: str, size: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = built([(i, bytes(w)) for i, w in shared.value], size)
        held = _HELD[name]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                yield judged(whole.slice(at, ROWS), held)
            pa.default_memory_pool().release_unused()

    def judged(batch: pa.RecordBatch, held: Windows | None) -> pa.RecordBatch:
        n, hits, spans, items = [], [], [], []
        raws = batch.column(text).cast(pa.binary())
        for k, (had, named) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)):
            raw = raws[k].as_py() or b""
            count, flags, found = scan(raw, held)
            if had:
                flags = np.zeros(count, bool) if flags is None else flags
                for run in had:
                    flags[run["first"] : run["last"]] = True
            n.append(count)
            items.append(sorted({*named, *found}))
            if flags is None:
                hits.append([])
                spans.append([])
                continue
            first, last = _ranges(flags)
            places = [m.span() for m in _WORD.finditer(raw.translate(_TABLE).decode("utf-8", "surrogateescape"))]
            hits.append([{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)])
            spans.append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(first, last, strict=True)])
        new = {"words": n, "hits": hits, "spans": spans, "items": items}
        return pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return run
