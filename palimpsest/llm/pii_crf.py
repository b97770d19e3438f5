"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns find the plain forms of e-mail addresses, IP addresses, card and phone numbers.
The field labels words by their shapes (O, or the beginning or inside of a kind), is trained
on a small table of labelled sentences made by rule, and is decoded by Viterbi over batches
of sequences. What it labels is kept if it is a possible value of its kind (``_possible``) and
does not overlap a span of the patterns.

Its sequences are the stretches within CONTEXT words of a word that has a digit, an at sign,
no letter at all, or an ``at`` or ``dot`` that stands alone or between other signs. No kept span
can have a word outside: numbers of any kind have no letters, so all their words are such
words, and in an address user, host and top domain stand beside an at or a dot.
"""

from __future__ import annotations

import random
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_crf import forward_backward

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CONTEXT = 3
TABLE_BITS = 14

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_SIGN = re.compile(r"[0-9@]")
_GATE = re.compile(r"[0-9@]|\b(?:at|dot)\b|^[\W\d_]+$", re.IGNORECASE)
#: A text without it has no possible value.
_NEEDED = re.compile(r"[0-9@]|\bat\b", re.IGNORECASE)
_WORD = re.compile(r"\S+")
_TRIM = ".,;:!?\"'<>[]{}*$%&#|="


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind's pattern that are valid.

    Each pattern runs in time linear in the text: a local part is read back from its at
    sign, and an address' numbers are taken four at a time from chains of numbers.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out["email"].append((start, match.end()))
            done = match.end()
        else:
            done = at
        at = text.find("@", max(at + 1, done))
    for match in _CHAIN.finditer(text):
        if match[0].count(".") < 3:
            continue
        place, parts = match.start(), match[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = place + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out["ip"].append((place, end))
            place = end + 1
    for match in _CARD.finditer(text):
        digits = _digits(match[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(match.span())
    for match in _PHONE.finditer(text):
        if 8 <= len(_digits(match[0])) <= 15:
            out["phone"].append(match.span())
    return out


#: Longer words are not held in caches.
_CACHED = 64


def _features(word: str) -> tuple[int, ...]:
    """Table slots of a word's own features."""
    return (_cached_features if len(word) <= _CACHED else _cached_features.__wrapped__)(word)


def _beside(word: str, where: str) -> tuple[int, ...]:
    """Table slots of what a neighbour sees of a word."""
    return (_cached_beside if len(word) <= _CACHED else _cached_beside.__wrapped__)(word, where)


@lru_cache(maxsize=200_000)
def _cached_features(word: str) -> tuple[int, ...]:
    shape = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", word))
    short = re.sub(r"a+", "a", shape)
    count = min(20, sum(c == "9" for c in shape))
    named = {"len": min(len(word), 20), "shape": short, "runs": re.sub(r"9+", "9", short), "digits": count, "dots": shape.count("."), "at": "@" in word, "first": shape[:2], "last": shape[-2:], "word": word.lower() if len(word) <= 6 and not count else ""}
    return tuple(_slot(f"{k}={v}") for k, v in named.items())


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) >> (32 - TABLE_BITS)


@lru_cache(maxsize=200_000)
def _cached_beside(word: str, where: str) -> tuple[int, ...]:
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", word))
    return _slot(f"{where} shape={shape}"), _slot(f"{where} word={word.lower().strip(_TRIM) if len(word) <= 8 else ''}"), _slot(f"{where} digits={min(12, sum(c.isdigit() for c in word))}")


def _slots(words: list[str]) -> list[list[int]]:
    padded = ["<s>", *words, "</s>"]
    return [[*_features(w), *_beside(padded[i], "before"), *_beside(padded[i + 2], "after")] for i, w in enumerate(words)]


def labelled_table(size: int = 1500, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Sentences of made-up words with personal data in plain and disguised forms, and with numbers that are none."""
    draw = random.Random(seed)
    pick, number = draw.choice, draw.randint
    syllables = ["an", "er", "ti", "on", "the", "re", "que", "ment", "sch", "la", "ou", "de", "é", "ción", "und", "is"]

    def word() -> str:
        return "".join(pick(syllables) for _ in range(number(1, 4)))

    def digits(n: int) -> str:
        return "".join(pick("0123456789") for _ in range(n))

    def card() -> str:
        body = pick("3456") + digits(number(13, 15))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def email() -> str:
        user, host, top = word() + pick(["", ".", "_"]) + pick([word(), digits(2)]), word(), pick(["com", "org", "net", "de"])
        return pick([f"{user}@{host}.{top}", f"{user} [at] {host} dot {top}", f"{user} (at) {host}.{top}", f"{user}[at]{host}[dot]{top}", f"{user} @ {host}.{top}", f"{user} (at) {host} (dot) {top}", f"{user} at {host} dot {top}", f"{user}(at){host}(dot){top}", f"{user}(at){host}.{top}", f"{user} [at] {host} [dot] {top}"])

    def ip() -> str:
        parts = [str(number(1, 255)) for _ in range(4)]
        return pick([".".join(parts), ".".join(parts), "[.]".join(parts), " . ".join(parts)])

    def numbered_card() -> str:
        c = card()
        four = [c[i : i + 4] for i in range(0, len(c), 4)]
        return pick([c, " ".join(four), "-".join(four), ".".join(four)])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{number(30, 49)} {a} {b}{c}", f"+{number(30, 49)} {a} {b} {c}", f"tel: {a}.{b}.{c}"])

    def none() -> str:
        return pick([f"{number(1900, 2030)}-{number(10, 12)}-{number(10, 28)}", f"{number(1, 9)}.{number(0, 9)}.", f"version {number(1, 9)}.{number(0, 20)}.{number(0, 9)}", digits(number(1, 7)), f"{number(1, 23)}:{number(10, 59)}", f"token = \"{uuid.UUID(int=draw.getrandbits(128)).hex}\"", f"{number(1, 999)},{digits(3)}", f"({number(1, 20)})", f"no. {number(1, 99)}", f"§ {number(1, 99)}", f"{digits(2)}%", f"${digits(3)}.{digits(2)}", digits(number(18, 30)), f"{word()}{digits(2)}", f"@{word()}", f"{number(1, 9)} {word()} {number(1, 9)}", f"{number(10, 99)} {number(10, 99)} {number(10, 99)}", f"{word()} at {word()}", f"{word()} at {word()} {word()}", f"{word()} at {word()}.{pick(['com', 'org', 'net', 'de'])}", f"at {word()}.", f"dot {word()}", f"{word()} at {number(1, 12)}", "-", "..."])

    makers = {"email": email, "ip": ip, "card": numbered_card, "phone": phone}
    rows = []
    for _ in range(size):
        words, labels = [], []
        for _ in range(number(1, 3)):
            for _ in range(number(1, 6)):
                words.append(word() + pick(["", "", ",", "."]))
                labels.append("O")
            kind = pick([*KINDS, "none", "none", "none"])
            parts = (makers.get(kind) or none)().split(" ")
            if kind == "phone" and parts[0] == "tel:":
                words.append(parts.pop(0))
                labels.append("O")
            if draw.random() < 0.3:
                parts[-1] += pick([".", ",", "###", "!!", ")"])
            words += parts
            labels += ["O"] * len(parts) if kind == "none" else [f"B-{kind}", *[f"I-{kind}"] * (len(parts) - 1)]
        words += [word() for _ in range(number(0, 4))]
        labels += ["O"] * (len(words) - len(labels))
        rows.append((words, labels))
    return rows


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray


def emissions(weights: np.ndarray, sequences_: list[list[str]]) -> np.ndarray:
    """Scores by label of all words of the sequences, each distinct word looked at once."""
    places: dict[str, int] = {}
    padded = np.array([places.setdefault(w, len(places)) for s in sequences_ for w in ("<s>", *s, "</s>")], np.int64)
    own, before, after = (
        weights[np.array([f(w) for w in places], np.int64).reshape(len(places), -1)].sum(axis=1)
        for f in (_features, lambda w: _beside(w, "before"), lambda w: _beside(w, "after"))
    )
    sizes = np.array([len(s) + 2 for s in sequences_], np.int64)
    inner = np.ones(len(padded), bool)
    inner[np.cumsum(sizes) - 1] = inner[np.cumsum(sizes) - sizes] = False
    inner = np.flatnonzero(inner)
    return own[padded[inner]] + before[padded[inner - 1]] + after[padded[inner + 1]]


def train(table: list[tuple[list[str], list[str]]] | None = None, rounds: int = 12, seed: int = 0) -> Model:
    """Adaptive gradient steps on the conditional likelihood of the table's labels."""
    table = labelled_table() if table is None else table
    slots = [np.array(_slots(w), np.int64) for w, _ in table if w]
    labels = [np.array([LABELS.index(x) for x in y]) for w, y in table if w]
    n = len(LABELS)
    weights, transitions = np.zeros((1 << TABLE_BITS, n)), np.zeros((n, n))
    square, square_t = np.full_like(weights, 1e-2), np.full_like(transitions, 1e-2)
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        order = draw.permutation(len(slots))
        for k in range(0, len(order), 100):
            batch = order[k : k + 100]
            x, y = np.concatenate([slots[i] for i in batch]), np.concatenate([labels[i] for i in batch])
            sizes = np.array([len(slots[i]) for i in batch])
            expected = np.zeros((n, n))
            p = forward_backward(weights[x].sum(axis=1), sizes, transitions, expected)
            slope = np.eye(n)[y] - p
            g = np.zeros_like(weights)
            np.add.at(g, x.ravel(), np.repeat(slope, x.shape[1], axis=0))
            g -= 1e-3 * weights
            square += g**2
            weights += 0.3 * g / np.sqrt(square)
            inner = np.ones(len(y), bool)
            inner[np.cumsum(sizes) - 1] = False
            inner = np.flatnonzero(inner)
            g = -expected - 1e-2 * transitions
            np.add.at(g, (y[inner], y[inner + 1]), 1)
            square_t += g**2
            transitions += 0.3 * g / np.sqrt(square_t)
    return Model(weights.astype(np.float32), transitions)


def viterbi(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best labels of all words; sequences of ``sizes`` words one after another, all stepped at once."""
    out = np.zeros(len(scores), np.int64)
    if not len(scores):
        return out
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]
    best, back = scores[first].astype(float), []
    ended = np.zeros((len(sizes), scores.shape[1]))
    for t in range(1, len(alive)):
        ended[alive[t] : len(best)] = best[alive[t] :]
        step = best[: alive[t], :, None] + transitions[None]
        back.append(step.argmax(axis=1))
        best = step.max(axis=1) + scores[first[: alive[t]] + t]
    ended[: len(best)] = best
    label = ended.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        out[first[:n] + t] = label[:n]
        if t:
            label[:n] = back[t - 1][np.arange(n), label[:n]]
    return out


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of words, as their spans, within CONTEXT words of one that may belong to personal data."""
    if not _NEEDED.search(text):
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    last = -1
    for k, (a, b) in enumerate(places):
        if not _GATE.search(text[a:b]):
            continue
        low, high = max(0, k - CONTEXT), min(len(places), k + CONTEXT + 1)
        if out and low <= last:
            out[-1] += places[last:high]
        else:
            out.append(places[low:high])
        last = max(last, high)
    return out


def _possible(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^\W\d_]", text)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", text) and bool(re.search(r"[ ().-]", text))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^\W\d_]", text)
    plain = re.sub(r"\s*[\[({]?\s*\bat\b\s*[\])}]?\s*", "@", re.sub(r"\s*[\[({]?\s*\bdot\b\s*[\])}]?\s*", ".", text, flags=re.IGNORECASE), flags=re.IGNORECASE)
    return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?@\s?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain))


def find(texts: list[str], model: Model) -> list[tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]]:
    """Of each text the pattern's spans and the spans that the field adds, by kind."""
    base, found = [base_spans(t) if _SIGN.search(t) else {k: [] for k in KINDS} for t in texts], [{k: [] for k in KINDS} for _ in texts]
    owner, spans, words, sizes = [], [], [], []
    for k, text in enumerate(texts):
        for sequence in sequences(text):
            owner += [k] * len(sequence)
            spans += sequence
            words.append([text[a:b] for a, b in sequence])
            sizes.append(len(sequence))
    if not spans:
        return list(zip(base, found, strict=True))
    labels = viterbi(emissions(model.weights, words), np.array(sizes), model.transitions)
    first = set(np.cumsum([0, *sizes]).tolist())
    i = 0
    while i < len(spans):
        name, j = LABELS[labels[i]], i + 1
        if name == "O":
            i = j
            continue
        kind = name[2:]
        while j < len(spans) and j not in first and LABELS[labels[j]] == f"I-{kind}":
            j += 1
        k, (a, b) = owner[i], (spans[i][0], spans[j - 1][1])
        i, text = j, texts[k]
        while a < b and text[a] in _TRIM:
            a += 1
        while a < b and (text[b - 1] in _TRIM or text[b - 1] == ")" and "(" not in text[a:b]):
            b -= 1
        if a < b and _possible(kind, text[a:b]) and not any(x < b and a < y for spans_ in base[k].values() for x, y in spans_):
            found[k][kind].append((a, b))
    return list(zip(base, found, strict=True))


_HELD: dict[str, Model] = {}
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal_data(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, and ``base`` and ``spans``: arrays of ``kind, start, end``.

    Offsets are code points, ends exclusive; both come by kind in the order of KINDS and
    then by start. ``spans`` has those of ``base`` and what the field adds. Null and empty
    texts have none. Columns of ``docs`` named like a result are replaced.
    """
    names = [c for c in docs.columns if c not in (text, "base", "spans")]
    rows = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    schema = rows.select(*names, F.array().cast(kind).alias("base"), F.array().cast(kind).alias("spans")).schema
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def listed(*groups: dict[str, list[tuple[int, int]]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in sorted(s for g in groups for s in g[k])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = find(part.column("__text").to_pylist(), _HELD[name])
                new = [pa.array([listed(b) for b, _ in made], _SPANS), pa.array([listed(b, f) for b, f in made], _SPANS)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new], names=[*names, "base", "spans"])

    return rows.mapInArrow(run, schema)
