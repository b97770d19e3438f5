"""Language identification by a linear-chain conditional random field over words.

Each word is a node whose features are its affixes, its byte n-grams (with the word's
boundaries) and the word itself as a lexicon entry, all hashed into one weight table;
transitions between languages are learned with them, on word sequences that switch
documents now and then. Forward-backward gives each word's distribution over languages, a
text being one chain however long it is. Chains are stepped in chunks, all chunks at once: the
product of a chunk's factors carries messages across it, so that each chunk starts and ends
with what the rest of its text says. A document's language is the one with the largest mean.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD_OUT, fold

#: Documents the field is fitted on, shared out evenly between languages (those of the least hashes), but LEAST_DOCS of each.
SAMPLE_DOCS, LEAST_DOCS = 2000, 20
#: Characters of a text that are read; of a longer text PIECES spread over the whole of it.
SAMPLE_CHARS, PIECES = 6_000, 12
#: Words of a training sequence, and of the chunks in which a longer text's chain is stepped.
SEQUENCE = 64
TABLE_BITS = 16
BLOCK = 400_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15
UNKNOWN = "und"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return tuple(out)


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def words_and_features(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of words in lower case, parted and enclosed by spaces: their starts and ends, table
    slots of each word's affixes and of itself, and the slot of the n-gram around each byte."""
    b = np.frombuffer(data, np.uint8)
    inside = b != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    wide = b.astype(np.uint64)
    grams = np.zeros(len(b), np.uint64)
    grams[1:-1] = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
    n = 1 << max(19, len(b).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * _powers(n)[0][: len(b)])))
    inverse = _powers(n)[1]

    def span(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (sums[z] - sums[a]) * inverse[a]

    own = [
        _slot(span(starts, ends), 1),
        _slot(span(starts, np.minimum(starts + 2, ends)), 2),
        _slot(span(starts, np.minimum(starts + 4, ends)), 3),
        _slot(span(np.maximum(ends - 2, starts), ends), 4),
        _slot(span(np.maximum(ends - 4, starts), ends), 5),
    ]
    return starts, ends, own, _slot(grams, 6)


def _emissions(weights: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words and their scores by language."""
    starts, ends, own, grams = words_and_features(data)
    if not len(starts):
        return starts, np.zeros((0, weights.shape[1]), np.float32)
    cuts = np.stack([starts, ends], axis=1).ravel()
    out = np.add.reduceat(weights[grams], cuts, axis=0)[::2]
    for slots in own:
        out += weights[slots]
    return starts, out


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Distributions of all words: ``scores`` of sequences one after another, of ``sizes`` words each.

    ``pairs``, if given, gets the expected number of each transition added. ``before`` and
    ``after`` are messages that reach a sequence's first and last word from outside.
    """
    out = np.zeros_like(scores)
    if not len(scores):
        return out
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")  # then the sequences that still go on are a prefix
    first, sizes = first[order], sizes[order]
    node = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max()).astype(scores.dtype)
    ones = np.ones((len(sizes), scores.shape[1]), scores.dtype)
    before, after = (ones if m is None else m[order] for m in (before, after))
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]
    forward, state = [], None
    for t, n in enumerate(alive):
        state = node[first[:n] + t] * (before if state is None else state[:n] @ step)
        state = state / state.sum(axis=1, keepdims=True)
        forward.append(state)
    state = ones[:0]
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        state = np.concatenate([state, after[len(state) : n]])
        both = forward[t] * state
        out[first[:n] + t] = both / both.sum(axis=1, keepdims=True)
        ahead = state * node[first[:n] + t]
        if pairs is not None and t:
            joint = forward[t - 1][:n, :, None] * step[None] * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        state = ahead @ step.T
        state = state / state.sum(axis=1, keepdims=True)
    return out


def chain_forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, chunk: int = SEQUENCE) -> np.ndarray:
    """:func:`forward_backward` for sequences of any length, in steps of whole chunks."""
    if not len(scores):
        return np.zeros_like(scores)
    numbers = -(-sizes // chunk)
    of = np.repeat(np.arange(len(sizes)), numbers)
    at = np.arange(len(of)) - np.repeat(np.cumsum(numbers) - numbers, numbers)  # a chunk's place in its sequence
    parts = np.minimum(chunk, sizes[of] - at * chunk)
    n = scores.shape[1]
    before, after = np.ones((len(of), n), scores.dtype), np.ones((len(of), n), scores.dtype)
    if numbers.max() > 1:
        long = np.flatnonzero(numbers[of] > 1)
        node = np.exp(scores - scores.max(axis=1, keepdims=True))
        step = np.exp(transitions - transitions.max()).astype(scores.dtype)
        first = (np.cumsum(parts) - parts)[long]
        # What a chunk makes of each label before its first word's factor, at its last word.
        across = np.eye(n, dtype=scores.dtype)[None] * node[first][:, None, :]
        for t in range(1, chunk):
            on = np.flatnonzero(parts[long] > t)
            moved = (across[on].reshape(-1, n) @ step).reshape(-1, n, n) * node[first[on] + t][:, None, :]
            across[on] = moved / moved.max(axis=(1, 2), keepdims=True)
        product = np.zeros((len(of), n, n), scores.dtype)
        product[long] = across
        place = np.cumsum(numbers) - numbers
        order = np.argsort(-numbers, kind="stable")
        place, numbers = place[order], numbers[order]
        alive = [int(np.searchsorted(-numbers, -k, side="left")) for k in range(int(numbers[0]))]
        for k in range(1, len(alive)):
            now = place[: alive[k]] + k
            carried = np.einsum("ci,cij->cj", before[now - 1], product[now - 1]) @ step
            before[now] = carried / carried.sum(axis=1, keepdims=True)
        for k in range(len(alive) - 1, 0, -1):
            now = place[: alive[k]] + k
            carried = np.einsum("cij,cj->ci", product[now], after[now]) @ step.T
            after[now - 1] = carried / carried.sum(axis=1, keepdims=True)
    return forward_backward(scores, parts, transitions, None, before, after)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def _normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_TABLE)


def fit(texts: list[str], languages: list[str], rounds: int = 3, seed: int = 0) -> Model:
    """Weights and transitions by adaptive gradient steps on the conditional likelihood.

    Each training sequence is made of pieces of 4 to 24 words of random documents, so that
    transitions between languages occur; every word is labelled with its document's language.
    """
    names = sorted(set(languages))
    draw = np.random.default_rng(seed)
    data = b" " + b"  ".join(_normal(t) for t in texts) + b" "
    starts, ends, own, grams = words_and_features(data)
    weights = np.zeros((1 << TABLE_BITS, len(names)), np.float32)
    transitions = np.zeros((len(names), len(names)), np.float32)
    if len(names) < 2 or not len(starts):
        return Model(names, weights, transitions)
    doc_ends = np.cumsum([len(_normal(t)) + 2 for t in texts])
    label = np.array([names.index(x) for x in languages])[np.searchsorted(doc_ends, starts - 1, side="right").clip(0, len(texts) - 1)]
    pieces, at = [], 0
    while at < len(starts):
        size = int(draw.integers(4, 25))
        pieces.append((at, min(len(starts), at + size)))
        at += size
    square, square_t = np.full_like(weights, 1e-3), np.full_like(transitions, 1e-3)
    sizes = ends - starts
    for _ in range(rounds):
        order = draw.permutation(len(pieces))
        for k in range(0, len(order), 2048):
            batch = [pieces[i] for i in order[k : k + 2048]]
            index = np.concatenate([np.arange(a, b) for a, b in batch])
            lengths = np.full(-(-len(index) // SEQUENCE), SEQUENCE)
            lengths[-1] = len(index) - SEQUENCE * (len(lengths) - 1)
            bytes_ = np.arange(sizes[index].sum()) + np.repeat(starts[index] - (np.cumsum(sizes[index]) - sizes[index]), sizes[index])
            slots = np.concatenate([grams[bytes_], *(s[index] for s in own)])
            word = np.concatenate([np.repeat(np.arange(len(index)), sizes[index]), *(np.arange(len(index)),) * len(own)])
            scores = np.stack([np.bincount(word, weights[slots, l], len(index)) for l in range(len(names))], axis=1)
            expected = np.zeros(transitions.shape)
            p = forward_backward(scores, lengths, transitions.astype(float), expected)
            y = np.eye(len(names))[label[index]]
            slope = (y - p)[word]
            g = np.stack([np.bincount(slots, slope[:, l], len(weights)) for l in range(len(names))], axis=1) / len(index) - 1e-6 * weights
            square += g**2
            weights += (0.3 * g / np.sqrt(square)).astype(np.float32)
            inner = np.flatnonzero(np.arange(1, len(index)) % SEQUENCE)  # neighbours in one sequence
            gt = (y[inner].T @ y[inner + 1] - expected) / len(index) - 1e-4 * transitions
            square_t += gt**2
            transitions += (0.1 * gt / np.sqrt(square_t)).astype(np.float32)
    return Model(names, weights, transitions)


def _spread(text: str) -> Column:
    """A text of at most SAMPLE_CHARS characters, or whole words of PIECES at even distances from its start to its end."""
    size = SAMPLE_CHARS // PIECES
    length = F.length(text)
    parts = []
    for k in range(PIECES):
        part = F.substring(F.col(text), F.floor((length - size) * k / (PIECES - 1)).cast("int") + 1, F.lit(size))
        whole = F.regexp_replace(part, r"^\S*\s+|\s+\S*$", "")
        parts.append(F.when(F.trim(whole) == "", part).otherwise(whole))
    return F.when(length <= SAMPLE_CHARS, F.col(text)).otherwise(F.concat_ws(" ", *parts))


def _shares(counts: dict[str, int]) -> dict[str, int]:
    """How many documents of each language are taken: what rare ones leave of an even share goes to the others."""
    out, left = {}, SAMPLE_DOCS
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(LEAST_DOCS, left // (len(counts) - k)))
        left = max(0, left - out[lang])
    return out


def train(docs: DataFrame) -> Model:
    """Fit on documents that are not held out and have a language, a bounded sample of each language.

    Documents of any length are eligible. The sample is cut to pieces on executors.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(fold() != HELD_OUT)
    known = known.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    counted = {r.lang: (r.n, r.least) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}
    if not counted:
        return fit([], [])
    shares = _shares({lang: n for lang, (n, _) in counted.items()})
    # a hash below which about twice the share is, so that only these are ranked
    bounds = [(lang, shares[lang], max(least, min((1 << 63) - 1, ((2 * shares[lang] + 50) << 64) // n - (1 << 63)))) for lang, (n, least) in counted.items()]
    bounds = docs.sparkSession.createDataFrame(bounds, "lang string, share long, bound long")
    near = known.join(F.broadcast(bounds), "lang").where("h <= bound").select(_spread("text").alias("text"), "lang", "h", "share")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where((F.col("rank") <= max(shares.values())) & (F.col("rank") <= F.col("share")))
    rows = sorted((r.h, r.text, r.lang) for r in ranked.select("h", "text", "lang").collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def identify_texts(model: Model, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Of each text the starts of its words (in its lower-cased UTF-8) and their distributions; None without letters."""
    out: list = []
    parts, held = [], 0

    def flush() -> None:
        nonlocal parts, held
        if not parts:
            return
        data = b" " + b"  ".join(p for _, p in parts) + b" "
        starts, scores = _emissions(model.weights, data)
        bounds = np.cumsum([0] + [len(p) + 2 for _, p in parts])
        cuts = np.searchsorted(starts - 1, bounds)
        counts = np.diff(cuts)
        p = chain_forward_backward(scores, counts[counts > 0], model.transitions)
        for (k, _), a, b, base in zip(parts, cuts[:-1].tolist(), cuts[1:].tolist(), bounds[:-1].tolist()):
            out[k] = (starts[a:b] - 1 - base, p[a:b])
        parts, held = [], 0

    for text in texts:
        if not model.languages or not text or not any(map(str.isalpha, text)):
            out.append(None)
            continue
        out.append(None)
        raw = _normal(text)
        parts.append((len(out) - 1, raw))
        held += len(raw)
        if held > BLOCK:
            flush()
    flush()
    return out


_HELD: dict[str, Model] = {}


def identify(docs: DataFrame, model: Model, text: str = "text", runs: bool = False) -> DataFrame:
    """``docs`` without its text, and ``lang_pred`` and ``score``; with ``runs`` also the runs of words by language.

    ``score`` is the mean probability of the predicted language over the words. Texts that
    are null or have no letter get ``und`` with score 0, as does every text if the model
    knows no language. ``runs`` is an array of ``lang, words`` in order of the text. Columns
    of ``docs`` named like a result are replaced.
    """
    made = ["lang_pred", "score"] + ["runs"] * runs
    names = [c for c in docs.columns if c != text and c not in made]
    rows = docs.select(*names, F.col(text).alias("__text"))
    schema = rows.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), *[F.array().cast("array<struct<lang:string,words:bigint>>").alias("runs")] * runs).schema
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = shared.value
        held = _HELD[name]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                langs, scores, all_runs = [], [], []
                for found in identify_texts(held, part.column("__text").to_pylist()):
                    if found is None:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        all_runs.append([])
                        continue
                    p = found[1]
                    mean = p.mean(axis=0, dtype=float)
                    best = int(mean.argmax())
                    langs.append(held.languages[best])
                    scores.append(min(1.0, float(mean[best])))
                    if runs:
                        label = p.argmax(axis=1)
                        first = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
                        all_runs.append([{"lang": held.languages[label[a]], "words": int(n)} for a, n in zip(first, np.diff(np.append(first, len(label))), strict=True)])
                new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                if runs:
                    new.append(pa.array(all_runs, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new], names=[*names, *made])

    return rows.mapInArrow(run, schema)
